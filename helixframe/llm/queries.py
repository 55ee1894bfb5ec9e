"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid, toxicity
from helixframe.llm.ann import nearest
from helixframe.llm.bpe import bpe_encode_decode
from helixframe.llm.embed_dedup import embedding_dedup
from helixframe.llm.licenses import scan_licenses
from helixframe.llm.minhash import MinHashOptions, minhash_dedup
from helixframe.llm.mixing import mix_sources
from helixframe.llm.token_files import read_token_files, write_token_files
from helixframe.llm.url_filter import filter_urls
from helixframe.llm.workspace import Workspace

#: (verdict, host, path)
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(of: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(4) != 2))
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    return langid.identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_remainder(5) != 0).select("doc_id", F.col("toxic").alias("label")))
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    return toxicity.score(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe_encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = f"{Workspace(spark, 'tokens').root}/files"
    write_token_files(_read(spark, sf_dir, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, files, summary=True)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_read(spark, sf_dir, "documents"), options=MinHashOptions(shingle=2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_license_scan, op3_url_filter, op4_toxicity, op5_nearest_neighbours, op6_bpe, op7_embedding_dedup, op8_mixing, op9_token_files, op10_minhash_dedup)
}


def _url_sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM u"""


def _mix_sql() -> str:
    return """
WITH RECURSIVE d AS (
  SELECT doc_id AS id, source, coalesce('s' || source, 't') AS tag, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 13))::BIGINT AS u FROM documents),
grp AS (SELECT tag, size, u, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT tag, sum(size * n)::BIGINT AS source_size FROM grp GROUP BY tag),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY tag) - 1) % 3 + 1)]::BIGINT AS weight, source_size * 3 AS cap FROM s),
c AS (SELECT *, cap / weight AS level,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY cap / weight, tag ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS part FROM w),
g AS (SELECT *, min(CASE WHEN part * weight <= cap THEN level END) OVER () AS lim FROM c),
h AS (SELECT *, first_value(part) OVER (ORDER BY level <> lim, cap) AS fin FROM g),
share0 AS (SELECT tag, source_size, coalesce(least(cap::DOUBLE, fin * weight), 0.0) AS target FROM h),
share1 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM share0),
share AS (SELECT *, target - copies * source_size AS missing FROM share1),
lev AS (SELECT tag, length(bin(size)) AS dg, sum(size * n)::BIGINT AS words, any_value(missing) AS missing FROM grp JOIN share USING (tag) WHERE size > 0 AND missing > 0 GROUP BY 1, 2),
lw AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY tag ORDER BY dg DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
         sum(dg * words) OVER (PARTITION BY tag ORDER BY dg ROWS UNBOUNDED PRECEDING)::BIGINT AS rest FROM lev),
cut AS (SELECT tag, max(dg) AS top, arg_max((missing - above) / rest, dg) AS scale, arg_max(missing - above, dg) AS budget FROM lw WHERE dg * ((missing - above) / rest) < 1 GROUP BY tag),
pl AS (SELECT grp.*, budget, scale * length(bin(size)) AS p, (u + 0.5) / 4503599627370496.0::DOUBLE AS r FROM grp JOIN cut USING (tag) WHERE size > 0 AND length(bin(size)) <= top),
pq AS (SELECT *, (r / (1 - r)) / (p / (1 - p)) AS q FROM pl),
o AS (SELECT tag, size, u, n, budget, q / (1 + q) AS place FROM pq),
o1 AS (SELECT *, sum(size * n) OVER (PARTITION BY tag ORDER BY place, u, size ROWS UNBOUNDED PRECEDING) - size * n AS before FROM o),
o2 AS (SELECT *, greatest(0, least(n, floor((budget - before) / size)))::BIGINT AS took FROM o1),
le AS (SELECT tag, any_value(budget) - sum(size * took)::BIGINT AS rem FROM o2 GROUP BY tag),
hist AS (SELECT tag, size, sum(n - took)::BIGINT AS n, any_value(rem) AS rem FROM o2 JOIN le USING (tag) WHERE size <= rem AND n > took GROUP BY 1, 2),
hr AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY size DESC) AS k FROM hist),
fill AS (
  SELECT tag, 1 AS k, size, least(n, floor(rem / size))::BIGINT AS picks, rem - least(n, floor(rem / size)) * size AS rem FROM hr WHERE k = 1
  UNION ALL SELECT hr.tag, hr.k, hr.size, least(hr.n, floor(fill.rem / hr.size))::BIGINT, fill.rem - least(hr.n, floor(fill.rem / hr.size)) * hr.size FROM fill JOIN hr ON hr.tag = fill.tag AND hr.k = fill.k + 1),
o3 AS (SELECT o2.*, coalesce(picks, 0) AS picks, sum(n - took) OVER (PARTITION BY tag, size ORDER BY place, u ROWS UNBOUNDED PRECEDING) - (n - took) AS ahead FROM o2 LEFT JOIN (SELECT tag, size, picks FROM fill) USING (tag, size)),
x AS (SELECT tag, size, u, took + greatest(0, least(n - took, picks - ahead)) AS took FROM o3),
each AS (SELECT *, row_number() OVER (PARTITION BY tag, size, u) AS nth FROM d)
SELECT id AS doc_id, each.size, source_size, target,
       (each.size * (copies + CASE WHEN each.size > 0 AND missing > 0 AND (x.took IS NULL OR nth <= x.took) THEN 1 ELSE 0 END))::BIGINT AS taken, source AS mix_source
FROM each JOIN share USING (tag) LEFT JOIN x ON x.tag = each.tag AND x.size = each.size AND x.u = each.u"""


ORACLE_SQL: dict[str, str] = {"op3_url_filter": _url_sql(), "op8_mixing": _mix_sql()}
