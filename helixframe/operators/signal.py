"""Signal tracks as runs (track, chrom, start, end, value); what no run covers is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.arrays import scatter
from helixframe.functions.numeric import bf16, finite_or_zero, log1p


def clean_import(runs: DataFrame) -> DataFrame:
    """NaN and infinite values as 0."""
    return runs.withColumn("value", finite_or_zero(F.col("value")).cast("float"))


def normalise_total(runs: DataFrame, factor: float, by: list[str] | None = None) -> DataFrame:
    """Values over (total / factor), the total being over all chromosomes of a track."""
    by = ["track"] if by is None else by
    total = runs.groupBy(*by).agg(F.sum(F.col("value").cast("double") * (F.col("end") - F.col("start"))).alias("_total"))
    both = runs.join(F.broadcast(total) if not by else total, by) if by else runs.crossJoin(F.broadcast(total))
    return both.withColumn("value", (F.col("value").cast("double") / (F.col("_total") / factor)).cast("float")).drop("_total")


def track_stats(runs: DataFrame, by: list[str] | None = None, length: int | None = None) -> DataFrame:
    """min, max, sum, mean, variance and their like over base pairs with finite values.

    With ``length``, the base pairs of the genome, those that no run covers count as 0.

    ``stddev_compat`` is the population variance (what some stores keep under the name of a
    standard deviation); ``stddev`` is its root.
    """
    v, n = F.col("value").cast("double"), (F.col("end") - F.col("start")).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    square = (F.col("value").cast("float") * F.col("value").cast("float")).cast("double")
    out = runs.where(finite).groupBy(*(["track"] if by is None else by)).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v * n).alias("sum"), F.sum(square * n).alias("_squares"), F.sum(n).alias("n")
    )
    if length is not None:
        bare = F.col("n") < length
        low, high = (F.when(bare, f(c, F.lit(0.0))).otherwise(F.col(c)).alias(c) for f, c in ((F.least, "min"), (F.greatest, "max")))
        out = out.select(*[c for c in out.columns if c not in ("min", "max", "n")], low, high, F.greatest("n", F.lit(float(length))).alias("n"))
    mean = F.col("sum") / F.col("n")
    out = out.withColumn("mean", mean).withColumn("variance", F.col("_squares") / F.col("n") - F.col("mean") * F.col("mean"))
    return out.withColumn("stddev", F.sqrt(F.greatest("variance", F.lit(0.0)))).withColumn("stddev_compat", F.col("variance")).drop("_squares")


def verify_sum(stats: DataFrame, kept: DataFrame, by: str = "track") -> DataFrame:
    """Relative difference of the sums of two statistics tables."""
    return stats.select(by, "sum").join(kept.select(by, F.col("sum").alias("_kept")), by).select(by, (F.abs(F.col("sum") - F.col("_kept")) / F.col("_kept")).alias("difference"))


def bin_sums(segments: DataFrame, runs: DataFrame, window: int, padding: int, resolution: int, by: list[str] | None = None) -> DataFrame:
    """(seg_idx, by..., bin, mean): bf16 means of bf16 values over the bins of padded windows; only bins with a run.

    Windows and runs meet in buckets as wide as a padded window, and runs are cut at
    the bucket's bounds, so nothing counts twice and one long run is shared out.
    """
    by = ["track"] if by is None else by
    total = window + 2 * padding
    if total % resolution or window % resolution or padding % resolution:
        raise ValueError("window and padding must be multiples of the resolution")
    at = lambda a, b: F.explode(F.sequence(F.floor(a / total).cast("long"), F.floor((b - 1) / total).cast("long")))
    windows = segments.select("seg_idx", "chrom", (F.col("start") - padding).alias("w")).withColumn("bucket", at(F.col("w"), F.col("w") + total))
    pieces = runs.where("`end` > start").select(*by, "chrom", "start", "end", bf16(F.col("value")).cast("double").alias("v")).withColumn("bucket", at(F.col("start"), F.col("end")))
    pieces = pieces.withColumn("lo", F.greatest(F.col("start"), F.col("bucket") * total)).withColumn("hi", F.least(F.col("end"), (F.col("bucket") + 1) * total)).drop("start", "end")
    both = windows.join(pieces, ["chrom", "bucket"]).withColumn("lo", F.greatest(F.col("lo") - F.col("w"), F.lit(0))).withColumn("hi", F.least(F.col("hi") - F.col("w"), F.lit(total))).where("lo < hi")
    bins = both.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / resolution).cast("int"), F.floor((F.col("hi") - 1) / resolution).cast("int"))))
    width = F.least(F.col("hi"), (F.col("bin") + 1) * resolution) - F.greatest(F.col("lo"), F.col("bin") * resolution)
    return bins.groupBy("seg_idx", *by, "bin").agg(F.sum(F.col("v") * width).alias("s")).select("seg_idx", *by, "bin", bf16(F.col("s") / resolution).alias("mean"))


def dense(binned: DataFrame, segments: DataFrame, keys: DataFrame, length: int, by: str = "track_idx") -> DataFrame:
    """(seg_idx, track_idx, values): an array of ``length`` bins for every segment and key, 0 where no run was."""
    have = binned.groupBy("seg_idx", by).agg(F.collect_list(F.struct("bin", "mean")).alias("m"))
    every = segments.select("seg_idx").crossJoin(F.broadcast(keys.select(by)))  # keys are the few tracks of one call
    zero = F.lit(0.0).cast("float")
    filled = scatter(F.col("m"), length, "bin", "mean")
    return every.join(have, ["seg_idx", by], "left").select("seg_idx", by, F.when(F.col("m").isNull(), F.array_repeat(zero, length)).otherwise(filled).alias("values"))


def histogram(values: DataFrame, bins: int = 50, minimum: float | None = None, log: bool = False, column: str = "value") -> DataFrame:
    """(bin, bin_start, bin_end, count) of equal bins from the smallest to the largest value; empty bins are left out.

    A value goes to floor((v - lo) / width); the largest falls beyond the last bin and is
    not counted.  Values below ``minimum`` go first, then ``log`` takes ln(v + 1).  If all
    values are equal they are in bin 0, of width 0.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    if minimum is not None:
        v = v.where(F.col("v") >= minimum)
    if log:
        v = v.select(log1p(F.col("v")).alias("v"))
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    placed = v.crossJoin(F.broadcast(span)).withColumn("bin", F.when(F.col("width") == 0, 0).otherwise(F.floor((F.col("v") - F.col("lo")) / F.nullif("width", F.lit(0.0)))).cast("long"))
    placed = placed.where(F.col("bin") < bins)
    return placed.groupBy("bin", "lo", "width").agg(F.count("*").alias("count")).select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "count")
