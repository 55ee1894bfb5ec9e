"""URL block and allow rules by hashed host-suffix / path-prefix expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.workspace import Workspace

#: Rules up to this number are broadcast; longer lists are joined by a shuffle.
BROADCAST_RULES = 10_000
#: Hex digits of the digest that the join is on.
SHORT = 8


def url_host(url: str) -> F.Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    A rule is (verdict, host, path); it fits a url whose host is the rule's or a
    subdomain of it and whose path starts with the rule's.  The rule with the
    longest host and path together wins, then the longer host, then ``block``.

    Each url is expanded to the expressions host suffix + path prefix, for the
    numbers of labels and the path lengths that the rules have, so the expansion
    is bounded by the rules and not by the url.  Expressions meet the rules by an
    equi-join on the first digits of their SHA-256; the full digests confirm.

    Defined cases: a url that is null or has no ``://`` has empty host and path and
    gets the default; repeated rows each get the same answer; an empty rule list
    gives the default everywhere; other columns are not read; an empty table gives
    an empty one.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "urls")
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    pages = pages.select("id", "url", url_host("url").alias("host"), url_path("url").alias("path"))
    schema = "rule string, rule_verdict string, host_length int, length int"
    table = spark.createDataFrame([(h + p, v, len(h), len(h) + len(p)) for v, h, p in rules], schema)
    table = table.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    suffixes = F.array_compact(F.array(*[F.when(F.size(F.split("host", r"\.", -1)) >= n, F.substring_index("host", ".", -n)) for n in labels])) if labels else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    urls = pages.where("host != ''").select("id", "url", "host", "path").distinct()
    expressions = urls.select("id", "url", F.explode(F.array_distinct(suffixes)).alias("suffix"), "path").select("id", "url", "suffix", F.explode(prefixes).alias("prefix"))
    hashed = expressions.select("id", "url", F.sha2(F.concat("suffix", "prefix"), 256).alias("full"), F.length("suffix").alias("host_length"))
    met = hashed.withColumn("short", F.substring("full", 1, SHORT)).join(table, ["short", "host_length"]).where("full = digest")
    best = met.groupBy("id", "url").agg(F.max(F.struct("length", "host_length", (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")).alias("best"))
    best = ws.table(best.select("id", "url", "best.rule", "best.rule_verdict"))
    out = pages.alias("p").join(best.alias("b"), F.col("p.id").eqNullSafe(F.col("b.id")) & (F.col("p.url") == F.col("b.url")), "left")
    return out.select(F.col("p.id").alias(id_col), "p.host", "p.path", "b.rule", F.coalesce("b.rule_verdict", F.lit(default)).alias("verdict"))
