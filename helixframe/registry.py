"""Queries over the driver's tables, and the same in DuckDB SQL.

Roles of the tables: events are a signal (chromosome = event type, position =
seconds since 2024-01-01), lineitem rows are fragments on the chromosomes
l_returnflag, embeddings are windows of one track, documents are sequences,
customers and orders are genes and exons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import arrays, nucleotide
from helixframe.functions.numeric import bf16
from helixframe.operators import annotation, batching, coverage, ranges, signal
from helixframe.sources import fasta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bf16(x: str) -> str:
    return f"(35184372088833::DOUBLE * ({x}) - (35184372088833::DOUBLE * ({x}) - ({x})))"


# Signal

SIG = "sig AS (SELECT event_type AS chrom, floor(epoch(ts))::BIGINT - 1704067200 AS pos, sum(value) AS value FROM events GROUP BY 1, 2)"
SIZES = "sizes AS (SELECT chrom, max(pos) + 1 AS size FROM sig GROUP BY 1)"


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    rows = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("chrom"), at.alias("start")).agg(F.sum("value").alias("value"))
    return rows.select(F.lit("events").alias("track"), "chrom", "start", (F.col("start") + 1).alias("end"), "value")


def _sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("chrom").agg(F.max("end").alias("size"))


def _tiles(window: int, step: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranges.tile(_sizes(_signal(spark, sf_dir)), window, step).withColumn("region", ranges.format_region())

    return run


for _name, _window, _step in (("tile_tumbling", 86_400, 86_400), ("tile_sliding", 86_400, 21_600), ("tile_gapped", 3_600, 86_400)):
    QUERIES[_name] = _tiles(_window, _step)
    ORACLE_SQL[_name] = f"""WITH {SIG}, {SIZES}, t AS (SELECT chrom, size, unnest(generate_series(0, size - 1, {_step})) AS start FROM sizes)
SELECT chrom, start, least(start + {_window}, size) AS "end", chrom || ':' || start || '-' || least(start + {_window}, size) AS region FROM t"""

WINDOW, PAD, RES = 65_536, 4_096, 4_096
_SEG = f"seg AS (SELECT ascii(chrom) * 1000 + start // {WINDOW} AS seg_idx, chrom, start FROM (SELECT chrom, unnest(generate_series(0, size - 1, {WINDOW})) AS start FROM sizes))"
_BINS = f"""bins AS (SELECT seg_idx, (pos - start + {PAD}) // {RES} AS bin, {_bf16(f"sum({_bf16('value')}) / {RES}")}::FLOAT AS mean
  FROM seg JOIN sig USING (chrom) WHERE pos >= start - {PAD} AND pos < start + {WINDOW + PAD} GROUP BY 1, 2)"""


def _binned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = _signal(spark, sf_dir)
    segments = ranges.tile(_sizes(runs), WINDOW).withColumn("seg_idx", (F.ascii("chrom") * 1000 + F.floor(F.col("start") / WINDOW)).cast("long"))
    return segments, signal.bin_sums(segments, runs.withColumn("track_idx", F.lit(0)), WINDOW, PAD, RES, by=["track_idx"])


@_query(f"WITH {SIG}, {SIZES}, {_SEG}, {_BINS} SELECT seg_idx, bin::INT AS bin, mean FROM bins")
def binned_mean_signal(spark, sf_dir):
    return _binned(spark, sf_dir)[1].drop("track_idx")


@_query(f"""WITH {SIG}, {SIZES}, {_SEG}, {_BINS}, every AS (SELECT seg_idx, unnest(generate_series(0, {(WINDOW + 2 * PAD) // RES - 1})) AS bin FROM seg)
SELECT seg_idx, e.bin::INT AS i, coalesce(mean, 0)::FLOAT AS v FROM every e LEFT JOIN bins b USING (seg_idx, bin)""")
def signal_window_pad(spark, sf_dir):
    segments, binned = _binned(spark, sf_dir)
    keys = spark.createDataFrame([(0,)], "track_idx int")
    return signal.dense(binned, segments, keys, (WINDOW + 2 * PAD) // RES).select("seg_idx", F.posexplode("values").alias("i", "v"))


_STATS = """SELECT min(value) AS min, max(value) AS max, round(sum(value), 6) AS sum, round(avg(value), 9) AS mean,
 round(sum((value::FLOAT * value::FLOAT)::DOUBLE) / count(*) - avg(value) * avg(value), 6) AS variance, count(*)::DOUBLE AS n, chrom FROM sig WHERE isfinite(value) GROUP BY chrom"""


@_query(f"WITH {SIG} {_STATS}")
def signal_stats(spark, sf_dir):
    out = signal.track_stats(_signal(spark, sf_dir), ["chrom"])
    return out.select("chrom", "min", "max", F.round("sum", 6).alias("sum"), F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance"), "n")


@_query(f"WITH {SIG} SELECT chrom, round(abs(sum(value) - sum(value::FLOAT::DOUBLE)) / sum(value::FLOAT::DOUBLE), 12) AS difference FROM sig GROUP BY 1")
def signal_verify(spark, sf_dir):
    runs = _signal(spark, sf_dir)
    kept = signal.track_stats(runs.withColumn("value", F.col("value").cast("float")), ["chrom"])
    return signal.verify_sum(signal.track_stats(runs, ["chrom"]), kept, "chrom").withColumn("difference", F.round("difference", 12))


@_query(f"WITH {SIG} SELECT chrom, pos AS start, round((value / ((SELECT sum(value) FROM sig) / 1000000.0))::FLOAT::DOUBLE, 3) AS value FROM sig")
def norm_total(spark, sf_dir):
    runs = signal.normalise_total(_signal(spark, sf_dir), 1e6)
    return runs.select("chrom", "start", F.round(F.col("value").cast("double"), 3).alias("value"))


def _hist_sql(value: str, where: str) -> str:
    return f"""WITH v AS (SELECT {value} AS v FROM events WHERE {where}), s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS width FROM v)
SELECT floor((v - lo) / width)::BIGINT AS bin, round(lo + floor((v - lo) / width) * width, 9) AS bin_start, round(lo + (floor((v - lo) / width) + 1) * width, 9) AS bin_end, count(*) AS count
FROM v, s WHERE floor((v - lo) / width) < 20 GROUP BY ALL"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("bin", F.round("bin_start", 9).alias("bin_start"), F.round("bin_end", 9).alias("bin_end"), "count")


@_query(_hist_sql("value", "value IS NOT NULL"))
def signal_hist(spark, sf_dir):
    return _rounded(signal.histogram(_read(spark, sf_dir, "events"), 20))


@_query(_hist_sql("ln(value + 1)", "value >= 1"))
def signal_hist_log(spark, sf_dir):
    return _rounded(signal.histogram(_read(spark, sf_dir, "events"), 20, 1.0, True))


# Windows as arrays

_EMB = "e AS (SELECT vec_id, embedding[i]::DOUBLE AS x, i - 1 AS i FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"


def _windows(spark: SparkSession, sf_dir: str, nan: bool = False) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    hit = lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 3), F.lit(float("nan")).cast("float")).otherwise(x)
    v = F.transform("embedding", hit) if nan else F.col("embedding")
    return rows.select("vec_id", F.transform(v, bf16).alias("values"))


@_query(f"WITH {_EMB} SELECT vec_id, (i // 4)::INT AS i, {_bf16(f'sum({_bf16("x")}) / 4')}::FLOAT AS v FROM e GROUP BY vec_id, i // 4")
def rebin_bf16(spark, sf_dir):
    return _windows(spark, sf_dir).select("vec_id", F.posexplode(arrays.rebin("values", 4)).alias("i", "v"))


@_query(f"WITH {_EMB} SELECT vec_id, (i // 16)::INT AS split_idx, (i % 16)::INT AS i, {_bf16('x')}::FLOAT AS v FROM e")
def split_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("vec_id", F.posexplode(arrays.split("values", 16)).alias("split_idx", "s")).select("vec_id", "split_idx", F.posexplode("s").alias("i", "v"))


@_query(f"WITH {_EMB} SELECT vec_id, (i - 20)::INT AS i, {_bf16('x')}::FLOAT AS v FROM e WHERE i >= 20 AND i < 44")
def trim_target(spark, sf_dir):
    return _windows(spark, sf_dir).select("vec_id", F.posexplode(arrays.trim("values", 24, 64)).alias("i", "v"))


_CLAMPED = lambda x: f"least({_bf16(f'{_bf16(x)} * 2')}, {_bf16('0.25::DOUBLE')})::FLOAT"


@_query(f"WITH {_EMB} SELECT vec_id, i::INT AS i, {_CLAMPED('CASE WHEN vec_id % 7 = 0 AND i = 3 THEN 0 ELSE x END')} AS v FROM e")
def scale_clamp_nan(spark, sf_dir):
    return _windows(spark, sf_dir, nan=True).select("vec_id", F.posexplode(arrays.transform_values("values", 2.0, 0.25)).alias("i", "v"))


_DRAW = lambda key, seed, epoch=0: f"('0x' || substr(md5(({key})::VARCHAR || ':{seed}:{epoch}'), 1, 13))::BIGINT"
_SHIFT = lambda key, w, res, seed: f"(sign(({_DRAW(key, seed)}) % {2 * w + 1} - {w}) * (abs(({_DRAW(key, seed)}) % {2 * w + 1} - {w}) // {res}) * {res})::INT"


@_query(f"""WITH {_EMB}, p AS (SELECT vec_id, i - 8 - {_SHIFT('vec_id', 8, 2, 2025)} AS i, x FROM e),
b AS (SELECT vec_id, i // 4 AS b, {_bf16(f'sum({_bf16("x")}) / 4')} AS v FROM p WHERE i >= 0 AND i < 48 GROUP BY 1, 2)
SELECT vec_id, (b // 4)::INT AS split_idx, (b % 4 - 1)::INT AS i, least({_bf16('v * 2')}, {_bf16('0.25::DOUBLE')})::FLOAT AS v FROM b WHERE b % 4 IN (1, 2)""")
def read_pipeline(spark, sf_dir):
    shift = batching.random_shift(F.col("vec_id"), 8, 2, 2025)
    window = arrays.read_window("values", 48, 8, 1, 4, shift)
    rows = _windows(spark, sf_dir).select("vec_id", F.posexplode(arrays.split(window, 4)).alias("split_idx", "s"))
    return rows.select("vec_id", "split_idx", F.posexplode(arrays.transform_values(arrays.trim("s", 2, 4), 2.0, 0.25)).alias("i", "v"))


@_query(f"SELECT vec_id, {_SHIFT('vec_id', 64, 8, 7)} AS shift FROM embeddings")
def random_shift(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", batching.random_shift(F.col("vec_id"), 64, 8, 7).alias("shift"))


@_query(f"SELECT vec_id, row_number() OVER (ORDER BY {_DRAW('vec_id', 7)}, vec_id) - 1 AS ord FROM embeddings")
def shuffle_order(spark, sf_dir):
    return batching.shuffled(_read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 7)


# Fragments

FRAG = 'f AS (SELECT l_returnflag AS chrom, l_partkey AS start, l_partkey + l_quantity::BIGINT AS "end", l_linestatus AS strand FROM lineitem)'
FSIZES = 'fs AS (SELECT chrom, max("end") - 7 AS size FROM f GROUP BY 1)'


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linestatus").alias("strand"))


def _fragment_sizes(f: DataFrame) -> DataFrame:
    return f.groupBy("chrom").agg((F.max("end") - 7).alias("size"))


@_query(f"""WITH {FRAG}, {FSIZES}, x AS (SELECT DISTINCT chrom, start, "end", size FROM f JOIN fs USING (chrom)),
y AS (SELECT chrom, start AS start0, size, CASE WHEN "end" - start < 64 THEN greatest(0, start - (64 - ("end" - start)) // 2) ELSE start END AS start, "end", "end" - start < 64 AS short FROM x)
SELECT DISTINCT chrom, start, least(CASE WHEN short THEN start + 64 ELSE "end" END, size) AS "end" FROM y""")
def expand_segments(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    return ranges.expand(f.select("chrom", "start", "end"), _fragment_sizes(f), 64).distinct()


@_query(f'WITH {FRAG}, {FSIZES} SELECT chrom, start, least("end", size) AS "end", strand FROM f JOIN fs USING (chrom) WHERE start < size')
def clip_chrom(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    return ranges.clip(f, _fragment_sizes(f))


@_query(f'WITH {FRAG} SELECT chrom, start // 16 * 16 AS start, ("end" + 15) // 16 * 16 AS "end", strand FROM f')
def fit_to_bin(spark, sf_dir):
    return ranges.fit_to_bin(_fragments(spark, sf_dir), 16)


def _sweep_sql(frag: str, by: str = "chrom") -> str:
    return f"""ev AS (SELECT {by}, pos, sum(d) AS d FROM (SELECT {by}, start AS pos, 1 AS d FROM {frag} UNION ALL SELECT {by}, "end", -1 FROM {frag}) GROUP BY {by}, pos HAVING sum(d) <> 0),
ru AS (SELECT {by}, pos AS start, lead(pos) OVER (PARTITION BY {by} ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY {by} ORDER BY pos)::DOUBLE AS value FROM ev)"""


@_query(f'WITH {FRAG}, {_sweep_sql("f")} SELECT chrom, start, "end", value FROM ru WHERE "end" IS NOT NULL AND value <> 0')
def coverage_sweep(spark, sf_dir):
    return coverage.pile_up(_fragments(spark, sf_dir))


def _coverage_sql(factor: str, bin_size: int = 1, by: str = "chrom") -> str:
    fit = f'b AS (SELECT chrom, start // {bin_size} * {bin_size} AS start, ("end" + {bin_size - 1}) // {bin_size} * {bin_size} AS "end", strand FROM f)'
    return f"""WITH {FRAG}, {FSIZES}, {fit}, {_sweep_sql("b", by)},
cl AS (SELECT ru.* REPLACE (least("end", size) AS "end") FROM ru JOIN fs USING (chrom) WHERE "end" IS NOT NULL AND value <> 0 AND start < size)
SELECT {by}, start, "end", value / {factor} AS value FROM cl"""


def _covered(method: str | None, bin_size: int = 1, by: list[str] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = _fragments(spark, sf_dir)
        return coverage.coverage(f, _fragment_sizes(f), bin_size, method, by)

    return run


_LENGTH = '(SELECT sum("end" - start)::DOUBLE FROM f)'
QUERIES["coverage_cpm"], ORACLE_SQL["coverage_cpm"] = _covered("CPM"), _coverage_sql(f"({_LENGTH} / 1000000.0::DOUBLE)")
QUERIES["coverage_rpkm"], ORACLE_SQL["coverage_rpkm"] = _covered("RPKM", 10), _coverage_sql(f"({_LENGTH} * 10 / 1000000000.0::DOUBLE)", 10)
QUERIES["coverage_bpm"], ORACLE_SQL["coverage_bpm"] = _covered("BPM", 10), _coverage_sql('((SELECT sum(value * (("end" - start) // 10)) FROM cl) / 1000000.0::DOUBLE)', 10)
QUERIES["coverage_stranded"] = _covered("CPM", 1, ["strand"])
ORACLE_SQL["coverage_stranded"] = _coverage_sql('((SELECT sum(g."end" - g.start)::DOUBLE FROM f g WHERE g.strand = cl.strand) / 1000000.0::DOUBLE)', 1, "chrom, strand")


@_query(f"""WITH {FRAG}, {FSIZES}, {_sweep_sql("f")},
r AS (SELECT ru.* REPLACE (least("end", size) AS "end"), size FROM ru JOIN fs USING (chrom) WHERE "end" IS NOT NULL AND value <> 0 AND start < size),
base AS (SELECT chrom, size, unnest(generate_series(start, "end" - 1)) AS pos, value FROM r),
spread AS (SELECT chrom, pos + k AS pos, value, size FROM base, (SELECT unnest(generate_series(-2, 2)) AS k))
SELECT chrom, pos, round(sum(value) / 5, 6) AS value FROM spread WHERE pos >= 0 AND pos < size GROUP BY chrom, pos""")
def smooth_box(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    sizes = _fragment_sizes(f)
    runs = coverage.smooth_box(ranges.clip(coverage.pile_up(f), sizes), sizes, 5)
    return runs.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), F.round("value", 6).alias("value"))


_RUNS = f'{FRAG}, {_sweep_sql("f")}, r AS (SELECT * FROM ru WHERE "end" IS NOT NULL AND value <> 0)'


@_query(f"""WITH {_RUNS}, g AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r)
SELECT chrom, start, "end", sum(CASE WHEN far + 1 > start - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g""")
def gap_islands(spark, sf_dir):
    return ranges.gap_islands(coverage.pile_up(_fragments(spark, sf_dir)), 1, 1).select("chrom", "start", "end", F.col("island").cast("long").alias("island"))


REGION = "p AS (SELECT substr('ANR', (p_partkey % 3)::INT + 1, 1) AS chrom, p_partkey * 11 % 20000 AS start, p_partkey * 11 % 20000 + p_size AS \"end\" FROM part)"


def _part_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("p_partkey") * 11 % 20000
    return _read(spark, sf_dir, "part").select(F.substring(F.lit("ANR"), (F.col("p_partkey") % 3).cast("int") + 1, F.lit(1)).alias("chrom"), start.alias("start"), (start + F.col("p_size")).alias("end"))


@_query(f'WITH {FRAG}, {REGION} SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.chrom = f.chrom AND p.start < f."end" AND f.start < p."end")')
def blacklist_anti(spark, sf_dir):
    return ranges.difference(_fragments(spark, sf_dir), _part_regions(spark, sf_dir), "overlap", 256)


@_query(f'WITH {FRAG}, {REGION} SELECT f.chrom, strand, count(*) AS pairs, sum(least(f."end", p."end") - greatest(f.start, p.start))::BIGINT AS shared FROM f JOIN p ON p.chrom = f.chrom AND p.start < f."end" AND f.start < p."end" GROUP BY 1, 2')
def overlap_join(spark, sf_dir):
    both = ranges.overlap_join(_fragments(spark, sf_dir), _part_regions(spark, sf_dir), 256)
    return both.groupBy("chrom", "strand").agg(F.count("*").alias("pairs"), F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))


_META = lambda name, test: f"EXISTS (SELECT 1 FROM {name} WHERE {name}.chrom = f.chrom AND {name}.start < f.\"end\" AND f.start < {name}.\"end\" AND {test})"


@_query(f"""WITH {FRAG}, {FSIZES}, {REGION}, {_sweep_sql("f")}, k AS (SELECT sum("end" - start)::DOUBLE / 1000000.0::DOUBLE AS k FROM f WHERE {_META('p', 'p."end" - p.start <= 25')} AND NOT {_META('p', 'p."end" - p.start > 40')})
SELECT chrom, start, least("end", size) AS "end", value / k AS value FROM ru JOIN fs USING (chrom), k WHERE "end" IS NOT NULL AND value <> 0 AND start < size""")
def norm_include_exclude(spark, sf_dir):
    f, p = _fragments(spark, sf_dir), _part_regions(spark, sf_dir)
    return coverage.coverage(f, _fragment_sizes(f), include=p.where("`end` - start <= 25"), exclude=p.where("`end` - start > 40"))


ORDER = 'o AS (SELECT o_orderstatus AS chrom, o_custkey * 10 AS start, o_custkey * 10 + 100 AS "end", o_orderpriority AS priority, o_orderkey FROM orders)'


def _order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("chrom"), (F.col("o_custkey") * 10).alias("start"), (F.col("o_custkey") * 10 + 100).alias("end"), F.col("o_orderpriority").alias("priority"), "o_orderkey")


_URGENT = "(chrom, start, \"end\") {} (SELECT (chrom, start, \"end\") FROM o WHERE priority = '1-URGENT')"


@_query(f'WITH {ORDER} SELECT chrom, start, "end", o_orderkey FROM o WHERE {_URGENT.format("IN")}')
def segments_intersection(spark, sf_dir):
    o = _order_ranges(spark, sf_dir)
    return ranges.intersection(o, o.where("priority = '1-URGENT'")).select("chrom", "start", "end", "o_orderkey")


@_query(f'WITH {ORDER} SELECT chrom, start, "end", o_orderkey FROM o WHERE {_URGENT.format("NOT IN")}')
def segments_difference(spark, sf_dir):
    o = _order_ranges(spark, sf_dir)
    return ranges.difference(o, o.where("priority = '1-URGENT'")).select("chrom", "start", "end", "o_orderkey")


@_query(f'WITH {ORDER} SELECT chrom, start, "end", min(o_orderkey) AS ord FROM o GROUP BY 1, 2, 3')
def distinct_segments(spark, sf_dir):
    return ranges.first_seen(_order_ranges(spark, sf_dir), "o_orderkey").withColumnRenamed("o_orderkey", "ord")


@_query("SELECT l_returnflag AS chrom, row_number() OVER (ORDER BY max(l_partkey) DESC, l_returnflag) AS place, max(l_partkey) AS size FROM lineitem GROUP BY 1")
def length_sorted_chroms(spark, sf_dir):
    return ranges.by_length(_read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chrom")).agg(F.max("l_partkey").alias("size")))


@_query("SELECT l_returnflag AS chrom, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1")
def first_seen_chroms(spark, sf_dir):
    return ranges.first_seen_chroms(_read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")))


# Batches


def _batch_sql(batch: int, workers: int, splits: int) -> str:
    return f"""WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS g FROM embeddings), w AS (SELECT vec_id, g, unnest(generate_series(0, {splits - 1})) AS w FROM s),
p AS (SELECT vec_id, w, g // {batch} % {workers} AS worker, (g // {batch} // {workers} * {batch} + g % {batch}) * {splits} + w AS place FROM w)
SELECT vec_id, w::INT AS split_idx, dense_rank() OVER (ORDER BY place // {batch}, worker) - 1 AS batch_id, (place % {batch})::INT AS pos_in_batch FROM p"""


def _batched(spark: SparkSession, sf_dir: str, batch: int, workers: int, splits: int) -> DataFrame:
    rows = ranges.ordinal(_read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    rows = rows.withColumn("split_idx", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return batching.assign_batches(rows, _read(spark, sf_dir, "embeddings").count(), batch, workers, splits, "ord", "split_idx").drop("ord")


@_query(_batch_sql(32, 1, 1))
def batch_assign(spark, sf_dir):
    return _batched(spark, sf_dir, 32, 1, 1)


@_query(_batch_sql(8, 3, 4))
def batch_split_workers(spark, sf_dir):
    return _batched(spark, sf_dir, 8, 3, 4)


@_query("SELECT doc_id, doc_id // 48 AS batch_id, (doc_id % 48)::INT AS pos_in_batch FROM documents")
def rebatch(spark, sf_dir):
    return batching.rebatch(_read(spark, sf_dir, "documents").select("doc_id"), 48, "doc_id")


@_query("""SELECT row_number() OVER (ORDER BY batch_id, loader) - 1 AS turn, batch_id, loader, rows FROM (
SELECT doc_id // 48 AS batch_id, 0 AS loader, count(*) AS rows FROM documents GROUP BY 1 UNION ALL SELECT vec_id // 32, 1, count(*) FROM embeddings GROUP BY 1)""")
def cat_round_robin(spark, sf_dir):
    docs = batching.rebatch(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx")), 48)
    vecs = batching.rebatch(_read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx")), 32)
    both = batching.interleave([docs, vecs]).groupBy("batch_id", "loader").agg(F.count("*").alias("rows"))
    return ranges.ordinal(both.withColumn("key", F.col("batch_id") * 2 + F.col("loader")), "key", "turn").drop("key")


# Sequences

_CLEAN = "regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g')"


@_query(f"SELECT doc_id, translate({_CLEAN}, 'ACGTN', '01234') AS codes FROM documents")
def nucleotide_encode(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", nucleotide.encode(nucleotide.clean("text")).alias("codes"))


@_query(f"SELECT doc_id, {_CLEAN} AS seq FROM documents")
def seq_roundtrip(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", nucleotide.encode(nucleotide.clean("text")).alias("c")).select("doc_id", nucleotide.decode("c").alias("seq"))


@_query(f"""WITH d AS (SELECT doc_id, {_CLEAN} AS s FROM documents), w AS (SELECT doc_id, s, unnest(generate_series(0, len(s) - 1, 512)) AS start FROM d WHERE len(s) > 0)
SELECT doc_id * 1000 + start // 512 AS seg_idx, rpad(repeat('N', greatest(0, 16 - start)::INT) || substr(s, greatest(start - 16, 0)::INT + 1, (start + 528 - greatest(start - 16, 0))::INT), 544, 'N') AS seq FROM w""")
def seq_window_cut(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chrom"), nucleotide.clean("text").alias("seq"))
    chunks = fasta.chunked(docs, 1000)
    segments = ranges.tile(docs.select("chrom", F.length("seq").cast("long").alias("size")), 512)
    segments = segments.withColumn("seg_idx", (F.col("chrom").cast("long") * 1000 + F.floor(F.col("start") / 512)).cast("long"))
    return fasta.cut_windows(segments, chunks, 512, 16, 1000)


# Annotation

_EXON = "x AS (SELECT DISTINCT o_custkey AS gene_id, o_orderkey % 1000 AS start, o_orderkey % 1000 + 10 + o_orderkey % 7 AS \"end\" FROM orders)"


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = F.when(F.col("c_acctbal") > 5000, "+").when(F.col("c_acctbal") > 0, "-").otherwise(".")
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gene_id"), F.col("c_name").alias("gene_name"), (F.col("c_custkey") * 100).alias("start"), (F.col("c_custkey") * 100 + 50).alias("end"), strand.alias("strand"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("gene_type"))


@_query(f"""WITH {_EXON}, l AS (SELECT gene_id, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS exons FROM x GROUP BY 1)
SELECT c_custkey AS gene_id, exons FROM customer LEFT JOIN l ON gene_id = c_custkey""")
def gene_exons(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gene_id"), (F.col("o_orderkey") % 1000).alias("start"), (F.col("o_orderkey") % 1000 + 10 + F.col("o_orderkey") % 7).alias("end"))
    out = _genes(spark, sf_dir).select("gene_id").join(annotation.exon_sets(rows), "gene_id", "left")
    return out.select("gene_id", F.array_join(F.transform("exons", lambda e: F.format_string("%d-%d", e["start"], e["end"])), ",").alias("exons"))


@_query("SELECT c_custkey AS gene_id, CASE WHEN c_acctbal > 5000 THEN c_custkey * 100 WHEN c_acctbal > 0 THEN c_custkey * 100 + 49 END AS tss FROM customer")
def gene_tss(spark, sf_dir):
    return _genes(spark, sf_dir).select("gene_id", annotation.tss().alias("tss"))


@_query("SELECT c_nationkey AS gene_id, arg_max(c_name, c_custkey) AS gene_name, min(c_custkey) AS line FROM customer GROUP BY 1")
def gene_dedup_last(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("gene_id"), F.col("c_name").alias("gene_name"), F.col("c_custkey").alias("line"))
    return annotation.last_wins(rows, "gene_id")


@_query("SELECT c_custkey AS gene_id, nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' AS is_coding FROM customer")
def coding_flag(spark, sf_dir):
    return _genes(spark, sf_dir).select("gene_id", annotation.is_coding(F.col("gene_type"), "MACHINERY").alias("is_coding"))


# Alignments

_FLAG = "(l_linenumber % 2 * 16 + CASE WHEN l_suppkey % 11 = 0 THEN 4 WHEN l_suppkey % 13 = 0 THEN 256 WHEN l_suppkey % 17 = 0 THEN 2048 WHEN l_suppkey % 3 = 0 THEN 1025 ELSE 0 END)"
_READ = f"r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS chrom, l_partkey + 1 AS pos, {_FLAG} AS flag, l_quantity::BIGINT AS m, l_suppkey % 9 AS n FROM lineitem)"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.expr(_FLAG).cast("int")
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") + 1).alias("pos"), flag.alias("flag"), F.col("l_quantity").cast("long").alias("m"), (F.col("l_suppkey") % 9).alias("n"))
    return rows.withColumn("cigar", F.format_string("5S%dM2I%dD100N20M4H", F.col("m"), F.col("n")))


@_query(f"WITH {_READ} SELECT l_orderkey, l_linenumber, flag::INT AS flag FROM r WHERE flag & 2308 = 0")
def bam_flag_filter(spark, sf_dir):
    return coverage.usable(_reads(spark, sf_dir)).select("l_orderkey", "l_linenumber", "flag")


@_query(f"WITH {_READ} SELECT count(*) AS total, count(*) FILTER (flag & 4 <> 0) AS unmapped, count(*) FILTER (flag & 256 <> 0) AS secondary, count(*) FILTER (flag & 2048 <> 0) AS supplementary, count(*) FILTER (flag & 1 <> 0) AS paired FROM r")
def bam_read_stats(spark, sf_dir):
    return coverage.read_stats(_reads(spark, sf_dir))


@_query(f"""WITH {_READ}, u AS (SELECT chrom, CASE WHEN flag & 16 <> 0 THEN pos + m + n + 119 ELSE pos END AS start, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM r WHERE flag & 2308 = 0)
SELECT chrom, start, start + 1 AS "end", strand FROM u""")
def cigar_insertion(spark, sf_dir):
    return coverage.insertions(_reads(spark, sf_dir))


@_query(f"""WITH {_READ}, u AS (SELECT chrom, pos, m, n, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM r WHERE flag & 2308 = 0)
SELECT chrom, pos AS start, pos + m + n AS "end", strand FROM u UNION ALL SELECT chrom, pos + m + n + 100, pos + m + n + 120, strand FROM u""")
def cigar_blocks(spark, sf_dir):
    return coverage.blocks(_reads(spark, sf_dir))
