import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import arrays
from helixframe.operators import annotation, batching, coverage, ranges, signal


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_regions_and_tiles(spark):
    r = ranges.regions(spark, ["chr1:5-9", "chr:x:0-3"])
    assert rows_of(r, "ord", "chrom", "start", "end") == [(0, "chr1", 5, 9), (1, "chr:x", 0, 3)]
    assert rows_of(r.select(ranges.format_region().alias("t")), "t") == [("chr1:5-9",), ("chr:x:0-3",)]
    with pytest.raises(Exception, match="not a region"):
        ranges.regions(spark, ["chr1"]).collect()
    sizes = spark.createDataFrame([("chr1", 1024), ("chr2", 7919)], "chrom string, size long")
    tiles = ranges.tile(sizes, 128)
    assert tiles.count() == 70
    assert tiles.where("chrom = 'chr2'").agg(F.max("start"), F.max("end")).first()[:] == (7808, 7919)
    with pytest.raises(ValueError):
        ranges.tile(sizes, 128, 0)


def test_expand(spark):
    sizes = spark.createDataFrame([("chr11", 135_086_622)], "chrom string, size long")
    r = ranges.regions(spark, ["chr11:35041782-35238390", "chr11:35200000-35300000"])
    assert rows_of(ranges.expand(r, sizes, 196_608), "start", "end") == [(35041782, 35238390), (35151696, 35348304)]
    with pytest.raises(Exception, match="no such chromosome"):
        ranges.expand(ranges.regions(spark, ["chrZ:1-2"]), sizes, 10).collect()


def test_overlaps_once(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(1, 90)) for _ in range(n)]
    a, b = make(80), make(70)
    schema = "chrom string, start long, end long"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((p[0], p[1], p[2], q[1], q[2]) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    assert rows_of(ranges.overlap_join(x, y, 16), "chrom", "start", "end", "r_start", "r_end") == want
    hit = {w[:3] for w in want}
    assert rows_of(ranges.intersection(x, y, "overlap", 16), "chrom", "start", "end") == sorted(p for p in a if p in hit)
    assert rows_of(ranges.difference(x, y, "overlap", 16), "chrom", "start", "end") == sorted(p for p in a if p not in hit)


@pytest.mark.parametrize("width", [4, 16, 65_536])
def test_overlaps_of_odd_ranges(spark, width):
    """Empty, reversed, negative, repeated, very long and unknown ranges, by the definition."""
    rng = random.Random(6)
    make = lambda n: [(rng.choice("abc"), s := rng.randrange(-60, 400), s + rng.choice([-3, 0, 0, 1, 2, 9, 40])) for _ in range(n)]
    a = make(120) + [("a", 390, 395)] * 3 + [(None, 1, 9), ("a", None, 9), ("a", 1, None), ("z", 1, 9)]
    b, c = make(25) + [(None, 1, 9), ("b", None, 9), ("b", 1, None)], [("a", 100, 380), ("y", 1, 9)]
    schema = "chrom string, start long, end int"
    x, y, z = (spark.createDataFrame(rows, schema) for rows in (a, b, c))
    meets = lambda p, other: None not in p and any(None not in q and p[0] == q[0] and p[1] < q[2] and q[1] < p[2] for q in other)
    got = ranges.mark_overlaps(x.withColumn("more", F.lit(1)), {"y": y, "z": z}, width).select("chrom", "start", "end", "more", "y", "z").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*p, 1, meets(p, b), meets(p, c))) for p in a)
    for how, keep in ((ranges.intersection, True), (ranges.difference, False)):
        assert sorted(map(repr, map(tuple, how(x, y, "overlap", width).select("chrom", "start", "end").collect()))) == sorted(repr(p) for p in a if meets(p, b) == keep)


def test_overlaps_make_no_pairs(spark):
    """40,000 ranges of one place against as many, 1.6e9 pairs: seconds, where making the pairs takes many minutes."""
    rows = spark.range(40_000).selectExpr("'c' AS chrom", "id % 20000 AS start", "id % 20000 + 20000 + id div 20000 AS end")
    began = time.time()
    assert ranges.intersection(rows, rows, "overlap").count() == 40_000
    sizes = spark.createDataFrame([("c", 50_000)], "chrom string, size long")
    assert coverage.coverage(rows, sizes, include=rows, exclude=rows.where("start < 0")).agg(F.sum(F.col("value") * (F.col("end") - F.col("start")))).first()[0] == pytest.approx(1e6)
    assert time.time() - began < 40


def test_pile_up_and_smooth(spark):
    rng = random.Random(5)
    frags = [("c", s := rng.randrange(200), s + rng.randrange(1, 30)) for _ in range(60)]
    df = spark.createDataFrame(frags, "chrom string, start long, end long")
    depth = np.zeros(300)
    for _, s, e in frags:
        depth[s:e] += 1
    got = np.zeros(300)
    for s, e, v in rows_of(coverage.pile_up(df, slice_width=32), "start", "end", "value"):
        assert v > 0
        got[s:e] = v
    assert (got == depth).all()
    sizes = spark.createDataFrame([("c", 225)], "chrom string, size long")
    for width in (2, 5, 40):
        left = (width - 1) // 2
        right = width - 1 - left
        cut = depth.copy()
        cut[225:] = 0
        want = np.array([sum(cut[j] for j in range(max(i - right, 0), min(i + left, 299) + 1)) / width for i in range(225)])
        got = np.zeros(225)
        for s, e, v in rows_of(coverage.smooth_box(ranges.clip(coverage.pile_up(df), sizes), sizes, width, slice_width=32), "start", "end", "value"):
            got[s:e] = v
        assert np.allclose(got, want)


def test_cigar(spark):
    reads = spark.createDataFrame([(0, "c", 11, "8M"), (16, "c", 11, "5S10M2I3D100N20M4H"), (4, "c", 11, "8M"), (0x100, "c", 1, "8M"), (0x800, "c", 1, "8M"), (0x400, "c", 50, "8M")], "flag int, chrom string, pos long, cigar string")
    assert rows_of(coverage.insertions(reads), "start", "end", "strand") == [(11, 12, "+"), (50, 51, "+"), (143, 144, "-")]
    assert rows_of(coverage.insertions(reads, one_based_compat=False), "start") == [(10,), (49,), (142,)]
    assert rows_of(coverage.blocks(reads), "start", "end") == [(11, 19), (11, 24), (50, 58), (124, 144)]
    left, right = coverage.clips()
    assert reads.where("flag = 16").select(left, right).first()[:] == (5, 4)
    assert coverage.read_stats(reads).first().asDict() == {"total": 6, "unmapped": 1, "secondary": 1, "supplementary": 1, "paired": 0}
    with pytest.raises(Exception, match="unsupported CIGAR"):
        reads.withColumn("cigar", F.lit("3P")).select(coverage.spliced()).collect()
    with pytest.raises(NotImplementedError):
        coverage.norm_factor("RPGC", 1, F.lit(1.0))


def test_bins_and_stats(spark):
    runs = spark.createDataFrame([("t", "chr1", i, i + 1, float(i % 8 + 1)) for i in range(64)] + [("t", "chr2", 0, 500, 0.0)], "track string, chrom string, start long, end long, value float")
    segs = spark.createDataFrame([(0, "chr1", 0), (1, "chr1", 32)], "seg_idx long, chrom string, start long")
    got = {(s, b): v for s, b, v in rows_of(signal.bin_sums(segs, runs, 32, 8, 8), "seg_idx", "bin", "mean")}
    assert got == {**{(0, b): 4.5 for b in range(1, 6)}, **{(1, b): 4.5 for b in range(0, 5)}}
    bad = runs.unionByName(spark.createDataFrame([("t", "chr1", 70, 71, float("nan")), ("t", "chr1", 71, 72, float("inf"))], runs.schema))
    stats = signal.track_stats(bad).first()
    assert (stats["min"], stats["max"], stats["sum"], stats["n"]) == (0.0, 8.0, 288.0, 564.0)
    assert stats["stddev"] == pytest.approx(np.std([i % 8 + 1 for i in range(64)] + [0] * 500))
    assert rows_of(signal.clean_import(bad).where("start >= 70"), "value") == [(0.0,), (0.0,)]
    assert signal.normalise_total(runs, 288.0).agg(F.sum(F.col("value") * (F.col("end") - F.col("start")))).first()[0] == pytest.approx(288.0)
    flat = signal.histogram(spark.createDataFrame([(3.0,)] * 4, "value double"), 5).collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(0, 4)]


def simulate(n, workers, batch, splits):
    """The order of batches as a plain program would make it."""
    own = [[] for _ in range(workers)]
    for i in range(n):
        own[i // batch % workers] += [(i, k) for k in range(splits)]
    lists = [[x[j : j + batch] for j in range(0, len(x), batch)] for x in own]
    out = []
    for r in range(max(map(len, lists), default=0)):
        out += [x[r] for x in lists if r < len(x)]
    return {e: (b, p) for b, x in enumerate(out) for p, e in enumerate(x)}


@pytest.mark.parametrize("n,workers,batch,splits", [(0, 2, 3, 1), (7, 1, 3, 1), (29, 3, 4, 2), (100, 3, 1, 1), (23, 4, 5, 3)])
def test_batches(spark, n, workers, batch, splits):
    rows = spark.createDataFrame([(i, k) for i in range(n) for k in range(splits)], "ord long, split int")
    got = batching.assign_batches(rows, n, batch, workers, splits, "ord", "split")
    assert {(r["ord"], r["split"]): (r["batch_id"], r["pos_in_batch"]) for r in got.collect()} == simulate(n, workers, batch, splits)


def test_shift(spark):
    got = {r[0] for r in spark.range(3000).select(batching.random_shift(F.col("id"), 8, 4, 1)).collect()}
    assert got == {-8, -4, 0, 4, 8}


def test_genes_last_wins(spark):
    gff = spark.createDataFrame([
        (0, "c", "gene", 11, 20, "+", {"gene_id": "g", "gene_name": "old"}),
        (1, "c", "gene", 31, 40, ".", {"gene_id": "h", "gene_name": "H", "gene_type": "protein_coding"}),
        (2, "c", "gene", 11, 25, "-", {"gene_id": "g", "gene_name": "new", "gene_type": "lncRNA"}),
        (3, "c", "exon", 15, 20, "-", {"gene_id": "g"}),
        (4, "c", "exon", 11, 12, "-", {"gene_id": "g"}),
        (5, "c", "exon", 15, 20, "-", {"gene_id": "g"}),
    ], "line long, chrom string, type string, left long, right long, strand string, attributes map<string,string>")
    g, h = annotation.read_genes(gff).orderBy("line").collect()
    assert (g["gene_name"], g["start"], g["end"], g["tss"], g["is_coding"], g["exons"]) == ("new", 10, 25, 24, False, [(10, 12), (14, 20)])
    assert (h["strand"], h["tss"], h["is_coding"], h["exons"]) == (None, None, True, None)
    with pytest.raises(Exception, match="missing"):
        annotation.read_transcripts(gff.withColumn("type", F.lit("transcript"))).collect()


def test_islands_over_slices(spark):
    """Slices of a few bases give the islands of a walk in order."""
    rng = random.Random(4)
    rows = [(c, s, s + rng.randrange(1, 30)) for c in "ab" for s in sorted(rng.randrange(900) for _ in range(60))]
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    got = {(r["chrom"], r["start"], r["end"]): r["island"] for r in ranges.gap_islands(df, 2, 3, slice_width=16).collect()}
    for c in "ab":
        island, far = 0, None
        for s, e in sorted({(s, e) for x, s, e in rows if x == c}):
            island += far is None or far + 3 <= s - 2
            far = max(far or 0, e)
            assert got[c, s, e] >= island  # equal ranges count their islands once
        assert max(v for k, v in got.items() if k[0] == c) == island


def test_epochs_and_seeds_are_unrelated(spark):
    """No order is a rotation of another, and shifts of two epochs do not go together."""
    rows = spark.range(3000).withColumnRenamed("id", "k")
    order = lambda seed, epoch: [r["k"] for r in batching.shuffled(rows, "k", seed, epoch).orderBy("ord").collect()]
    base = order(7, 0)
    assert base == order(7, 0) and sorted(base) == list(range(3000))
    for seed, epoch in ((7, 1), (7, 2), (99, 0)):
        other = order(seed, epoch)
        at = other.index(base[0])
        assert sum(x == y for x, y in zip(base, other[at:] + other[:at], strict=True)) < 30
    far = spark.range(5).selectExpr("id * 1000003 + 1 AS k")
    assert len({r[0] for r in far.select(batching.draw(F.col("k"), 7)).collect()}) == 5
    shifts = np.array([[r[0] for r in rows.orderBy("k").select(batching.random_shift(F.col("k"), 64, 1, 7, e)).collect()] for e in range(3)])
    assert abs(np.corrcoef(shifts)[np.triu_indices(3, 1)]).max() < 0.08 and shifts.min() == -64 and shifts.max() == 64
    assert len(set((shifts[0] - shifts[1]).tolist())) > 100


@pytest.mark.parametrize("bins", [8_192, 65_536])
def test_window_reads_grow_with_the_window(spark, bins):
    """Re-binning, splitting and filling of long windows: seconds, where a quadratic plan would take many minutes."""
    rows = spark.range(4).select("id", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (i % 7).cast("float")).alias("v"))
    window = arrays.split(arrays.read_window("v", bins, 0, 1, 4), 16)
    began = time.time()
    got = rows.select(F.posexplode(window).alias("at", "p")).agg(F.sum(F.aggregate("p", F.lit(0.0), lambda a, x: a + x.cast("double")))).first()[0]
    assert abs(got - 4 * sum(i % 7 for i in range(bins)) / 4) < 0.01 * got and time.time() - began < 20
    segments = rows.select(F.col("id").alias("seg_idx"))
    binned = segments.select("seg_idx", F.lit(0).alias("track_idx"), F.explode(F.sequence(F.lit(3), F.lit(bins - 3), F.lit(2))).alias("bin")).withColumn("mean", F.col("bin").cast("float"))
    made = signal.dense(binned, segments, spark.createDataFrame([(0,)], "track_idx int"), bins).first()["values"]
    assert len(made) == bins and all(v == (i if i % 2 and 3 <= i <= bins - 3 else 0) for i, v in enumerate(made))
