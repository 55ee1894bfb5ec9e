"""Alignments to coverage: CIGAR, insertions, sweep, normalisation, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators.ranges import clip, difference, fit_to_bin, mark_overlaps, prefix_sums

UNMAPPED, SECONDARY, SUPPLEMENTARY, REVERSE, PAIRED = 0x4, 0x100, 0x800, 0x10, 0x1


def usable(reads: DataFrame) -> DataFrame:
    """Without unmapped, secondary and supplementary records; duplicates and poor ones stay."""
    return reads.where(F.col("flag").bitwiseAND(UNMAPPED | SECONDARY | SUPPLEMENTARY) == 0)


def read_stats(reads: DataFrame) -> DataFrame:
    has = lambda bit: F.count_if(F.col("flag").bitwiseAND(bit) != 0)
    return reads.agg(F.count("*").alias("total"), has(UNMAPPED).alias("unmapped"), has(SECONDARY).alias("secondary"), has(SUPPLEMENTARY).alias("supplementary"), has(PAIRED).alias("paired"))


def cigar_ops(cigar: str = "cigar") -> Column:
    """array<struct<n, op>> of a CIGAR string; an operation other than M I D N S H = X is an error."""
    bad = F.raise_error(F.concat(F.lit("unsupported CIGAR: "), cigar)).cast("array<struct<n:bigint,op:string>>")
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[A-Z=])"), 1), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))
    return F.when(F.col(cigar).rlike(r"^(\d+[MIDNSH=X])+$"), ops).otherwise(bad)


def spliced(pos: str = "pos", cigar: str = "cigar") -> Column:
    """array<struct<start, end>> of the aligned segments: M D = X advance, N splits, I takes no room, S and H clip."""
    zero = F.lit(0).cast("bigint")
    state = F.struct(F.col(pos).cast("bigint").alias("at"), F.col(pos).cast("bigint").alias("begin"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        gap = x["op"] == "N"
        moved = s["at"] + F.when(x["op"].isin("M", "D", "=", "X", "N"), x["n"]).otherwise(zero)
        closed = F.when(gap, F.concat(s["done"], F.array(F.struct(s["begin"].alias("start"), s["at"].alias("end"))))).otherwise(s["done"])
        return F.struct(moved.alias("at"), F.when(gap, moved).otherwise(s["begin"]).alias("begin"), closed.alias("done"))

    return F.aggregate(cigar_ops(cigar), state, step, lambda s: F.concat(s["done"], F.array(F.struct(s["begin"].alias("start"), s["at"].alias("end")))))


def clips(cigar: str = "cigar") -> tuple[Column, Column]:
    """Clipped lengths (S and H) at the left and the right end."""
    total = lambda pattern: F.aggregate(F.regexp_extract_all(F.regexp_extract(cigar, pattern, 0), F.lit(r"(\d+)"), 1), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return total(r"^(\d+[SH])+"), F.when(F.col(cigar).rlike("[MIDN=X]"), total(r"(\d+[SH])+$")).otherwise(F.lit(0).cast("bigint"))


def insertions(reads: DataFrame, one_based_compat: bool = True) -> DataFrame:
    """The 5' base of each usable read as (chrom, start, end, strand).

    Positions of alignments count from 1.  By default they are taken as they are,
    so ranges lie one to the right of the 0-based ones; ``one_based_compat=False`` gives those.
    """
    rows = usable(reads).withColumn("_s", spliced())
    shift = 0 if one_based_compat else 1
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    start = F.when(reverse, F.element_at("_s", -1)["end"] - 1).otherwise(F.element_at("_s", 1)["start"]) - shift
    return rows.select("chrom", start.alias("start"), (start + 1).alias("end"), F.when(reverse, "-").otherwise("+").alias("strand"))


def blocks(reads: DataFrame, one_based_compat: bool = True) -> DataFrame:
    """One range for each aligned segment of each usable read."""
    shift = 0 if one_based_compat else 1
    rows = usable(reads).select("chrom", "flag", F.explode(spliced()).alias("s"))
    return rows.select("chrom", (F.col("s.start") - shift).alias("start"), (F.col("s.end") - shift).alias("end"), F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+").alias("strand"))


def pile_up(fragments: DataFrame, by: list[str] | None = None, slice_width: int = 1 << 20) -> DataFrame:
    """(by..., chrom, start, end, value): disjoint runs of the number of fragments over each base; no runs of 0.

    Every fragment is +1 at its start and -1 at its end.  Events at one base are added up
    map-side first, and depths are summed in two levels, inside slices of a chromosome and
    over the slices, so a long or deep chromosome is no single task.
    """
    by = [*(by or []), "chrom"]
    events = fragments.where("`end` > start").select(*by, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.pos", "e.d")
    return _runs(events.groupBy(*by, "pos").agg(F.sum("d").cast("double").alias("d")).where("d != 0"), by, slice_width).where("value != 0")


def _runs(steps: DataFrame, by: list[str], slice_width: int) -> DataFrame:
    """Runs of constant value from steps (by..., pos, d): between two positions with a step lies the sum of those before.

    The join below takes no nulls.  They go first, as a filter that Spark infers on one of its sides
    alone makes two plans of ``steps``, which are then made twice.
    """
    steps = steps.withColumn("_slice", F.floor(F.col("pos") / slice_width).cast("long")).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, "pos", "_slice"]))
    totals = steps.groupBy(*by, "_slice").agg(F.sum("d").alias("_t"), F.min("pos").alias("_p"))
    over = W.partitionBy(*by).orderBy("_slice")
    base = totals.select(*by, "_slice", (F.sum("_t").over(over) - F.col("_t")).alias("_base"), F.lead("_p").over(over).alias("_next"))
    inside = W.partitionBy(*by, "_slice").orderBy("pos")
    both = steps.join(base, [*by, "_slice"])
    value = F.col("_base") + F.sum("d").over(inside)
    return both.select(*by, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(inside), "_next").alias("end"), value.alias("value")).where("`end` IS NOT NULL")


def norm_factor(method: str | None, bin_size: int, length: Column, weighted: Column | None = None) -> Column:
    """What coverage is divided by.  ``length``: base pairs of the counted fragments; ``weighted``: sum of value * floor(run / bin)."""
    if method is None:
        return F.lit(1.0)
    if method == "RPKM":
        return length * bin_size / 1e9
    if method == "CPM":
        return length / 1e6
    if method == "BPM":
        return weighted / 1e6
    if method == "RPGC":
        raise NotImplementedError("RPGC")
    raise ValueError(f"no such normalisation: {method}")


def coverage(fragments: DataFrame, sizes: DataFrame, bin_size: int = 1, method: str | None = "CPM", by: list[str] | None = None, blacklist: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, smooth: int | None = None) -> DataFrame:
    """(by..., chrom, start, end, value) of normalised coverage, cut at the chromosomes' ends.

    Fragments that overlap ``blacklist`` go.  The normalising length is that of the fragments as
    they come, before they are fitted to bins or cut; of those that overlap ``exclude`` none count,
    and with ``include`` only those that overlap it.  ``by`` (such as strand) normalises each group by itself.
    """
    by = by or []
    rows = fragments if blacklist is None else difference(fragments, blacklist, "overlap")
    counted = rows
    marks = {name: other for name, other in (("_out", exclude), ("_in", include)) if other is not None}
    if marks:
        counted = mark_overlaps(rows, marks).where(" AND ".join("NOT _out" if name == "_out" else name for name in marks))
    runs = clip(pile_up(fit_to_bin(rows, bin_size), by), sizes)
    if method == "BPM":
        total = runs.groupBy(*by).agg(F.sum(F.col("value") * F.floor((F.col("end") - F.col("start")) / bin_size)).alias("_w")).withColumn("_l", F.lit(0.0))
    else:
        total = counted.groupBy(*by).agg(F.sum((F.col("end") - F.col("start")).cast("double")).alias("_l")).withColumn("_w", F.lit(0.0))
    if smooth:  # a mean of normalised values is the normalised mean, so the totals above are those of plain coverage
        runs = smooth_box(runs, sizes, smooth, by)
    both = runs.join(total, by) if by else runs.crossJoin(F.broadcast(total))  # one row
    return both.withColumn("value", F.col("value") / norm_factor(method, bin_size, F.col("_l"), F.col("_w"))).select(*by, "chrom", "start", "end", "value")


def smooth_box(runs: DataFrame, sizes: DataFrame, width: int, by: list[str] | None = None, slice_width: int = 1 << 20) -> DataFrame:
    """Moving mean over ``width`` bases: at i the sum of values in [i - right, i + left] over ``width``, also at the edges.

    A run is a trapezoid of the moving sum, which second differences at four positions
    give.  They are summed to slopes, and the slopes' rises to the sum at each bend, so
    what is summed has a row a bend; bases of a slope become rows of their own at the very end.
    """
    if width <= 1:
        return runs
    by = [*(by or []), "chrom"]
    left = (width - 1) // 2
    right = width - 1 - left
    m = F.least(F.col("end") - F.col("start"), F.lit(width))
    s, e = F.col("start") - left, F.col("end") + right
    v = F.col("value").cast("double")
    at = F.array(F.struct(s.alias("pos"), v.alias("d")), F.struct((s + m).alias("pos"), (-v).alias("d")), F.struct((e - m + 1).alias("pos"), (-v).alias("d")), F.struct((e + 1).alias("pos"), v.alias("d")))
    second = runs.select(*by, F.explode(at).alias("x")).groupBy(*by, F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    slopes = _runs(second, by, slice_width).withColumnRenamed("value", "slope")
    rise = F.col("slope") * (F.col("end") - F.col("start"))
    bends = prefix_sums(slopes, by, ["start"], rise, "_top", F.floor(F.col("start") / slice_width).cast("long"))
    below = F.col("_top") - rise
    flat = F.array(F.struct("start", "end", below.alias("sum")))
    sloped = F.transform(F.sequence(F.col("start"), F.col("end") - 1), lambda p: F.struct(p.alias("start"), (p + 1).alias("end"), (below + F.col("slope") * (p - F.col("start") + 1)).alias("sum")))
    out = bends.select(*by, F.explode(F.when(F.abs("slope") < 1e-12, flat).otherwise(sloped)).alias("x")).select(*by, "x.start", "x.end", (F.col("x.sum") / width).alias("value"))
    out = out.withColumn("start", F.greatest("start", F.lit(0))).where("`end` > start AND abs(value) > 1e-12")
    return clip(out, sizes)
