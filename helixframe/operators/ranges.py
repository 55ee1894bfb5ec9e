"""Genomic ranges (chrom, start, end), 0-based and half-open, and joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["chrom", "start", "end"]


def format_region() -> Column:
    return F.format_string("%s:%d-%d", "chrom", "start", "end")


def parse_regions(df: DataFrame, column: str = "region") -> DataFrame:
    """``chrom:start-end`` strings as columns; anything else is an error."""
    part = lambda i: F.regexp_extract(column, r"^(.+):(\d+)-(\d+)$", i)
    bad = F.raise_error(F.concat(F.lit("not a region: "), F.coalesce(F.col(column), F.lit("null"))))
    ok = F.col(column).rlike(r"^.+:\d+-\d+$")
    return df.withColumn("chrom", F.when(ok, part(1)).otherwise(bad.cast("string"))).withColumn("start", part(2).cast("long")).withColumn("end", part(3).cast("long"))


def regions(spark: SparkSession, items: list[str]) -> DataFrame:
    """A list of region strings as ranges, with their place ``ord`` in the list."""
    return parse_regions(spark.createDataFrame(list(enumerate(items)), "ord long, region string")).select("ord", *KEY)


def tile(sizes: DataFrame, window: int, step: int | None = None) -> DataFrame:
    """Windows from 0 in steps over every chromosome of (chrom, size); the last ones end at its size."""
    step = window if step is None else step
    if window <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    starts = sizes.where("size > 0").select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("start"))
    return starts.select("chrom", "start", F.least(F.col("start") + window, F.col("size")).alias("end"))


def expand(df: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """Ranges shorter than ``window`` grow to it around their middle, from 0 on; ends stop at the chromosome's.

    A chromosome without a size is an error.
    """
    out = df.join(sizes.select("chrom", F.col("size").alias("_size")), "chrom", "left")
    short = F.col("end") - F.col("start") < window
    start = F.greatest(F.lit(0), F.col("start") - F.floor((window - (F.col("end") - F.col("start"))) / 2))
    size = F.when(F.col("_size").isNull(), F.raise_error(F.concat(F.lit("no such chromosome: "), "chrom")).cast("long")).otherwise(F.col("_size"))
    out = out.withColumn("_start", F.when(short, start).otherwise(F.col("start")).cast("long")).withColumn("_end", F.when(short, F.col("_start") + window).otherwise(F.col("end")))
    return out.withColumn("end", F.least("_end", size).cast("long")).withColumn("start", F.col("_start")).drop("_start", "_end", "_size")


def first_seen(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Each range once, at its first place."""
    return df.groupBy(*KEY).agg(F.min(ord_col).alias(ord_col))


def clip(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ranges cut at their chromosome's end; those that start at or beyond it, or on an unknown one, go."""
    out = df.join(sizes.select("chrom", F.col("size").alias("_size")), "chrom").where("start < _size")
    return out.withColumn("end", F.least("end", "_size")).drop("_size")


def fit_to_bin(df: DataFrame, bin_size: int) -> DataFrame:
    """Starts down and ends up to multiples of ``bin_size``."""
    if bin_size <= 1:
        return df
    return df.withColumn("start", (F.floor(F.col("start") / bin_size) * bin_size).cast("long")).withColumn("end", (F.ceil(F.col("end") / bin_size) * bin_size).cast("long"))


def intersection(df: DataFrame, other: DataFrame, how: str = "exact", bucket: int = 65_536) -> DataFrame:
    """The ranges that ``other`` holds too, or, with ``how="overlap"``, that overlap one of them."""
    return df.join(other.select(*KEY), KEY, "left_semi") if how == "exact" else _overlapping(df, other, bucket, "left_semi")


def difference(df: DataFrame, other: DataFrame, how: str = "exact", bucket: int = 65_536) -> DataFrame:
    """The ranges that ``other`` does not hold, or, with ``how="overlap"``, that overlap none of them."""
    return df.join(other.select(*KEY), KEY, "left_anti") if how == "exact" else _overlapping(df, other, bucket, "left_anti")


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor((F.greatest(end, start + 1) - 1) / width).cast("long")))


def _overlapping(df: DataFrame, other: DataFrame, width: int, how: str) -> DataFrame:
    hit = _reach(df, {"_far": other}, width)
    return df.join(hit, (F.col("chrom") == F.col("_chrom")) & (F.col("end") == F.col("_to")) & (F.col("_far") > F.col("start")), how)


def mark_overlaps(df: DataFrame, others: dict[str, DataFrame], width: int = 65_536) -> DataFrame:
    """Adds a boolean by name for each of ``others``: whether a range overlaps one of its ranges."""
    hit = _reach(df, {f"_far_{name}": other for name, other in others.items()}, width)
    both = df.join(hit, (F.col("chrom") == F.col("_chrom")) & (F.col("end") == F.col("_to")), "left")
    return both.select(*df.columns, *[F.coalesce(F.col(f"_far_{name}") > F.col("start"), F.lit(False)).alias(name) for name in others])


def _reach(df: DataFrame, others: dict[str, DataFrame], width: int) -> DataFrame:
    """(_chrom, _to, a column for each of ``others``): the furthest end of its ranges that start before ``_to``.

    A range overlaps one of a table if the furthest end of those that start before its own end
    lies beyond its start, so no pairs are made: distinct ends of ``df`` and distinct starts meet in
    order of place, and work grows with the rows however many overlap.  Furthest ends are taken
    inside slices of ``width`` bases and over the slices before; a slice holds a place at most once
    from each table.  Ends at which no range of ``df`` overlaps are left out.
    """
    long = lambda c: F.col(c).cast("long")
    slice_ = F.floor(F.col("_at") / width).cast("long").alias("_slice")
    known = lambda t: t.where(" AND ".join(f"`{c}` IS NOT NULL" for c in KEY)).select("chrom", long("start").alias("start"), long("end").alias("end"))
    mine = known(df).select("chrom", "start", (F.col("end") - 1).alias("_at"))
    starts = None
    for name, other in others.items():
        far = known(other).groupBy("chrom", F.col("start").alias("_at")).agg(F.max("end").alias(name))
        starts = far if starts is None else starts.unionByName(far, allowMissingColumns=True)
    furthest = [F.max(name).alias(name) for name in others]
    slices = mine.select("chrom", slice_).distinct().unionByName(starts.select("chrom", slice_, *others), allowMissingColumns=True).groupBy("chrom", "_slice").agg(*furthest)
    before = W.partitionBy("chrom").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select("chrom", (F.col("_slice") * width).alias("_at"), *[F.max(name).over(before).alias(name) for name in others])
    ends = mine.groupBy("chrom", "_at").agg(F.min("start").alias("_least"))
    events = ends.unionByName(starts, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True).select("*", slice_)
    so_far = W.partitionBy("_slice", "chrom").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)  # with all of one place
    reach = events.select(F.col("chrom").alias("_chrom"), (F.col("_at") + 1).alias("_to"), "_least", *[F.max(name).over(so_far).alias(name) for name in others])
    return reach.where(" OR ".join(f"`{name}` > _least" for name in others)).drop("_least")


def overlap_join(left: DataFrame, right: DataFrame, width: int = 65_536) -> DataFrame:
    """Pairs of ranges that overlap, each once: the columns of ``left`` and ``r_start``, ``r_end`` and others of ``right``.

    Both sides go to buckets of ``width`` base pairs and meet by an equi-join on
    (chrom, bucket), so work is shared by place and not by chromosome; a pair is kept in
    the bucket where the later of the two starts lies.
    """
    a = left.withColumn("_bucket", _buckets(F.col("start"), F.col("end"), width))
    names = [c for c in right.columns if c != "chrom"]
    b = right.select(F.col("chrom"), *[F.col(c).alias(f"r_{c}") for c in names]).withColumn("_bucket", _buckets(F.col("r_start"), F.col("r_end"), width))
    both = a.join(b, ["chrom", "_bucket"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    return both.where(F.floor(F.greatest("start", "r_start") / width) == F.col("_bucket")).drop("_bucket")


def prefix_sums(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, slice_: Column) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of a group up to this one in ``order``.

    Two levels: sums inside slices of a group, and over its slices, so a large group is no
    single task.  ``slice_`` is a whole number that does not fall along ``order``.
    """
    sliced = df.withColumn("_slice", slice_).withColumn("_value", value)
    totals = sliced.groupBy(*by, "_slice").agg(F.sum("_value").alias("_total"))
    base = totals.select(*by, "_slice", (F.sum("_total").over(W.partitionBy(*by).orderBy("_slice")) - F.col("_total")).alias("_base"))
    inside = F.sum("_value").over(W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return sliced.join(base, [*by, "_slice"]).withColumn(name, F.col("_base") + inside).drop("_slice", "_value", "_base")


def gap_islands(df: DataFrame, left: int, right: int, slice_width: int = 1 << 20) -> DataFrame:
    """``island`` numbers runs of neighbours: a new one starts unless the furthest end so far + right exceeds start - left.

    The furthest end is taken inside slices of a chromosome and over the slices before.
    """
    slice_ = F.floor(F.col("start") / slice_width).cast("long")
    sliced = df.withColumn("_slice", slice_)
    ends = sliced.groupBy("chrom", "_slice").agg(F.max("end").alias("_end"))
    base = ends.select("chrom", "_slice", F.max("_end").over(W.partitionBy("chrom").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_far"))
    inside = F.max("end").over(W.partitionBy("chrom", "_slice").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    both = sliced.join(base, ["chrom", "_slice"]).withColumn("_far", F.greatest("_far", inside))  # skips nulls
    fresh = F.coalesce((F.col("_far") + right <= F.col("start") - left).cast("int"), F.lit(1))
    marked = both.withColumn("_new", fresh).drop("_slice", "_far")
    return prefix_sums(marked, ["chrom"], ["start", "end"], F.col("_new"), "island", slice_).drop("_new")


def by_length(sizes: DataFrame) -> DataFrame:
    """Adds ``place`` to (chrom, size): from 1 by falling size, of equal ones by name.  One row a chromosome."""
    return sizes.withColumn("place", F.row_number().over(W.orderBy(F.desc("size"), "chrom")).cast("long"))


def first_seen_chroms(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Each chromosome with the first place at which it is named."""
    return df.groupBy("chrom").agg(F.min(ord_col).alias("first"))


def ordinal(df: DataFrame, key: str, name: str = "ord", width: int = 65_536, then: list[str] | None = None) -> DataFrame:
    """Consecutive numbers from 0 by ascending ``key`` (a whole number), without sorting all rows in one task.

    Rows are counted by slices of the key; only the slices are summed in order.  Rows of
    equal key stand in the order of ``then``.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(key) / width).cast("long"))
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    base = counts.select("_slice", (F.sum("_n").over(W.orderBy("_slice")) - F.col("_n")).alias("_base"))
    at = F.row_number().over(W.partitionBy("_slice").orderBy(key, *(then or []))) - 1
    return sliced.join(base, "_slice").withColumn(name, (F.col("_base") + at).cast("long")).drop("_slice", "_base")
