"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Random numbers are whole numbers below 2^52, taken from an MD5 of id and text.
_BITS = 52
_KEY = ["tag", "size", "u"]


@dataclass(frozen=True)
class MixOptions:
    """``weights`` repeat over the sources in code point order, null last; ``most`` is the largest multiple of a source.

    ``slots`` (a power of two) is the number of slices of the random order that are summed before
    any of them is opened; a slice of over ``open_rows`` rows is sliced again.
    """

    weights: Sequence[int] = (5, 2, 1)
    most: int = 3
    seed: str = "mix"
    slots: int = 4096
    open_rows: int = 20_000


def _numbered(df: DataFrame, order: str, ws: Workspace) -> DataFrame:
    """Adds ``number`` from 0 in the order of a column, by ranges of it: only the ranges are summed in one task."""
    placed = ws.table(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_base"))
    return placed.join(base, "_part").withColumn("number", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_n", "_base")


def targets(sizes: DataFrame, ws: Workspace, o: MixOptions) -> DataFrame:
    """(tag, source_size, target) of (tag, source_size), the order of tags being that of sources.

    Weights share all words.  A source whose share exceeds ``most`` times its words stops there, and what it
    leaves is shared again, until none is above.  A round needs two sums.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in o.weights]), (F.col("number") % len(o.weights) + 1).cast("int")).cast("long")
    one = ws.table(_numbered(sizes, "tag", ws).select("tag", "source_size", weight.alias("weight"), (F.col("source_size") * o.most).alias("cap")))
    total, weights = (x or 0 for x in one.agg(F.sum("source_size"), F.sum("weight")).first())
    share = total / weights if weights else 0.0
    while True:
        over = F.col("cap").cast("double") < F.lit(share) * F.col("weight").cast("double")
        capped, open_ = one.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        again = (total - capped) / open_ if open_ else share
        if again == share:
            break
        share = again
    return one.select("tag", "source_size", F.least(F.col("cap").cast("double"), F.lit(share) * F.col("weight").cast("double")).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, o: MixOptions) -> DataFrame:
    """``d`` (the whole row), ``tag`` of its source, ``size`` in words, and its random number ``u``."""
    text, source = docs[text_col].cast("string"), docs[source_col].cast("string")
    digest = F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))), F.lit(f":{o.seed}")))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("d"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("tag"), size.alias("size"), F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long").alias("u")
    )


def _odds(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(tag, cut, scale, budget): inclusion odds of the documents of each source that misses words.

    A document's chance is ``scale`` times the number of binary digits of its size, ``scale`` being such that
    the words expected are those missing.  Documents of ``cut`` digits or more, for which that is 1
    or above, are taken for certain, and ``budget`` is what is missing beside them.
    """
    levels = groups.where("size > 0").groupBy("tag", F.length(F.bin("size")).alias("g")).agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    rows = levels.join(shares.where("missing > 0").select("tag", "missing"), "tag").groupBy("tag", "missing").agg(F.sort_array(F.collect_list(F.struct("g", "words")), asc=False).alias("levels"))
    every = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["g"] * x["words"])
    start = F.struct(F.lit(0).cast("long").alias("above"), every.alias("rest"), F.lit(64).alias("cut"), F.lit(True).alias("more"))

    def step(s: Column, x: Column) -> Column:
        sure = s["more"] & (x["g"].cast("double") * ((F.col("missing") - s["above"]) / s["rest"]) >= 1)
        return F.struct((s["above"] + F.when(sure, x["words"]).otherwise(0)).alias("above"), (s["rest"] - F.when(sure, x["g"] * x["words"]).otherwise(0)).alias("rest"), F.when(sure, x["g"]).otherwise(s["cut"]).alias("cut"), sure.alias("more"))

    folded = rows.select("tag", "missing", F.aggregate("levels", start, step).alias("s"))
    budget = F.col("missing") - F.col("s.above")
    return folded.select("tag", "s.cut", F.when(F.col("s.rest") > 0, budget / F.nullif(F.col("s.rest"), F.lit(0))).otherwise(0.0).alias("scale"), budget.alias("budget"))


def _place(scale: Column, size: Column, u: Column) -> Column:
    """The place of a document in the order, in (0, 1): its rank q / (1 + q), q being random odds over inclusion odds."""
    p = scale * F.length(F.bin(size)).cast("double")
    r = (u + 0.5) / float(1 << _BITS)
    q = (r / (1 - r)) / (p / (1 - p))
    return q / (1 + q)


def _first(rows: DataFrame, by: list[str], ws: Workspace, o: MixOptions) -> tuple[DataFrame, DataFrame]:
    """Groups of equal documents in the order of (place, u, size), while their words fit the budget of their ``by``.

    Takes (by, size, u, n, place, budget), and gives (by, edge, left): what is taken lies at or before
    ``edge``, and ``left`` words are still missing; and (by, size, u, n, took): the group at the edge of which a part
    is taken.  Slices of the order are summed, and only the slice in which the budget ends is opened.
    """
    rows = rows.withColumn("_f", F.col("place")).withColumn("_low", F.lit(0.0))
    ends: list[DataFrame] = []
    width = 1.0
    beyond = F.struct(F.lit(2.0).alias("place"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("size"))
    while True:
        width /= o.slots
        rows = rows.withColumn("_slot", F.floor(F.col("_f") * o.slots).cast("long"))
        sums = rows.groupBy(*by, "_slot").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows"), F.first("budget").alias("budget"))
        before = F.sum("words").over(W.partitionBy(*by).orderBy("_slot")) - F.col("words")
        found = sums.withColumn("before", before).groupBy(*by).agg(F.min(F.when(F.col("before") + F.col("words") > F.col("budget"), F.struct("_slot", "before", "rows"))).alias("e"), F.sum("words").alias("words"), F.first("budget").alias("budget"))
        found = ws.table(found)
        ends.append(found.where("e IS NULL").select(*by, beyond.alias("edge"), (F.col("budget") - F.col("words")).alias("left")))
        edge = found.where("e IS NOT NULL").select(*by, F.col("e._slot").alias("_slot"), F.col("e.before").alias("_before"))
        rows = rows.join(edge, [*by, "_slot"]).withColumn("budget", F.col("budget") - F.col("_before"))
        rows = rows.withColumn("_low", F.col("_low") + F.col("_slot") * width).withColumn("_f", F.col("_f") * o.slots - F.col("_slot")).drop("_slot", "_before")
        rows = ws.table(rows)
        if (found.agg(F.max("e.rows")).first()[0] or 0) <= o.open_rows or width * o.slots**-1 < 2.0**-_BITS:
            break
    order = W.partitionBy(*by).orderBy("place", "u", "size").rowsBetween(W.unboundedPreceding, 0)
    before = F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n")
    took = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("budget") - before) / F.col("size"))))
    opened = ws.table(rows.withColumn("took", took.cast("long")))
    low = F.struct(F.col("_low").alias("place"), F.lit(-1).cast("long").alias("u"), F.lit(-1).cast("long").alias("size"))
    whole = F.max(F.when(F.col("took") == F.col("n"), F.struct("place", "u", "size")))
    last = opened.groupBy(*by).agg(F.coalesce(whole, F.first(low)).alias("edge"), (F.first("budget") - F.sum(F.col("size") * F.col("took"))).alias("left"))
    for end in ends:
        last = last.unionByName(end)
    names = [c for c in ("size", "u", "n", "took") if c not in by]
    return ws.table(last), opened.where("took > 0 AND took < n").select(*by, *names)


def _fill(left: DataFrame, ends: DataFrame) -> DataFrame:
    """(tag, size, budget): words of the largest sizes that still fit, from the largest down, until nothing left fits."""
    sizes = left.join(ends.select("tag", "left"), "tag").where("size <= left").groupBy("tag", "size").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    rows = sizes.groupBy("tag", "left").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    pick = "struct<size:bigint,words:bigint>"

    def step(s: Column, x: Column) -> Column:
        words = F.least(x["n"], F.floor(s["left"] / x["size"])) * x["size"]
        return F.struct((s["left"] - words).alias("left"), F.when(words > 0, F.concat(s["picks"], F.array(F.struct(x["size"].alias("size"), words.alias("words"))))).otherwise(s["picks"]).alias("picks"))

    start = F.struct(F.col("left").alias("left"), F.array().cast(f"array<{pick}>").alias("picks"))
    return rows.select("tag", F.explode(F.aggregate("sizes", start, step, lambda s: s["picks"])).alias("p")).select("tag", "p.size", F.col("p.words").cast("double").alias("budget"))


def _plan(keyed: DataFrame, ws: Workspace, o: MixOptions) -> tuple[DataFrame, DataFrame]:
    """By source what it takes and where its order ends, and the groups of equal documents for which that does not say it."""
    groups = ws.table(keyed.groupBy(*_KEY).agg(F.count("*").alias("n")))
    shares = targets(groups.groupBy("tag").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), ws, o)
    copies = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    shares = ws.table(shares.withColumn("copies", copies).withColumn("missing", F.col("target") - F.col("copies") * F.col("source_size")))
    odds = ws.table(_odds(groups, shares))
    open_ = groups.where("size > 0").join(odds, "tag").where(F.length(F.bin("size")) < F.col("cut"))
    open_ = ws.table(open_.select(*_KEY, "n", _place(F.col("scale"), F.col("size"), F.col("u")).alias("place"), "budget"))
    ends, part = _first(open_, ["tag"], ws, o)
    part = ws.table(part)
    # What the order leaves out, less the part taken of the group at its edge.
    rest = open_.join(ends, "tag").where(F.struct("place", "u", "size") > F.col("edge")).join(part.select(*_KEY, "took"), _KEY, "left")
    rest = ws.table(rest.select(*_KEY, F.col("n").alias("of"), (F.col("n") - F.coalesce("took", F.lit(0))).alias("n"), "place"))
    wanted = ws.table(_fill(rest, ends))
    rest = ws.table(rest.join(wanted, ["tag", "size"]))
    more, more_part = _first(rest, ["tag", "size"], ws, o)
    inside = rest.join(more, ["tag", "size"]).where(F.struct("place", "u", "size") <= F.col("edge")).select(*_KEY, F.col("n").alias("took"))
    odd = part.select(*_KEY, "took").unionByName(inside).unionByName(more_part.select(*_KEY, "took")).groupBy(*_KEY).agg(F.sum("took").alias("took"))
    odd = ws.table(odd.join(groups, _KEY))
    return ws.table(shares.join(odds.drop("budget"), "tag", "left").join(ends, "tag", "left")), odd


def _times(docs: DataFrame, ws: Workspace, o: MixOptions, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``d`` (the row), ``source, size, source_size, target`` and ``times``, how often the mix takes it."""
    keyed = _keyed(docs, id_col, text_col, source_col, o)
    shares, odd = _plan(keyed.drop("d"), ws, o)
    both = keyed.join(shares, "tag")
    ordered = F.struct(_place(F.col("scale"), F.col("size"), F.col("u")).alias("place"), "u", "size") <= F.col("edge")
    taken = (F.col("size") > 0) & F.coalesce((F.length(F.bin("size")) >= F.col("cut")) | ordered, F.lit(False))
    partial = odd.where("took < n")
    names = ["d", "source", "size", "source_size", "target", "copies"]
    out = both.join(odd, _KEY, "left").where("took IS NULL OR took >= n")
    out = out.select(*names, F.when(taken | F.col("took").isNotNull(), 1).otherwise(0).alias("extra"))
    if partial.limit(1).count():
        # Equal documents of which a part is taken are numbered, by tasks and then over tasks.
        some = ws.table(both.join(partial, _KEY).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_at", 33))
        base = some.groupBy(*_KEY, "_part").agg(F.count("*").alias("_n"))
        base = base.select(*_KEY, "_part", (F.sum("_n").over(W.partitionBy(*_KEY).orderBy("_part")) - F.col("_n")).alias("_base"))
        at = F.col("_base") + F.row_number().over(W.partitionBy(*_KEY, "_part").orderBy("_at"))
        out = out.unionByName(some.join(base, [*_KEY, "_part"]).select(*names, (at <= F.col("took")).cast("int").alias("extra")))
    return out.select("d", "source", "size", "source_size", "target", (F.col("copies") + F.col("extra")).alias("times"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", options: MixOptions | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, mix_source``.

    ``size`` counts the words of the text.  A source whose target is f times its
    words takes every document floor(f) times for certain.  The words still missing are a sample of fixed
    size in words with unequal chances: a document's chance p grows with the number of binary digits
    of its size, and those for which it would be 1 or more are taken whole.  The others rank by random odds u / (1 - u) over
    inclusion odds p / (1 - p) and are taken in that order while they fit.  What is missing after that, less than
    one document, is filled from the largest sizes down that still fit, each in the same order, until none does.  ``taken`` is
    size times copies.

    The order is never sorted as a whole (see ``_first``), and equal documents are one group with a
    count, so neither a source nor a document with a third of all rows is a single task.  Random
    numbers come from id and text alone, so reruns and lost executors change nothing.

    Defined cases: a null or empty text has size 0 and takes 0; a null source is a
    source of its own, last in order; a null id has a random number by its text; of repeated rows as many
    as their group takes count once more, no matter which; other columns are not read; an empty
    table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "mix")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    out = _times(rows, ws, options or MixOptions(), "id", "text", "source")
    return ws.finish(out.select(F.col("d.id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), F.col("source").alias("mix_source")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", options: MixOptions | None = None) -> DataFrame:
    """The documents, each as often as ``mix_sources`` takes it, with all their columns, whatever these are called.

    Texts are not shuffled: each row is judged by what its source takes.  Defined cases are those of
    ``mix_sources``; a document without words is in no mix.
    """
    out = _times(docs, Workspace(docs.sparkSession, "mix"), options or MixOptions(), id_col, text_col, source_col)
    return out.where("size > 0 AND times > 0").select(F.explode(F.array_repeat("d", F.col("times").cast("int"))).alias("d")).select("d.*")
