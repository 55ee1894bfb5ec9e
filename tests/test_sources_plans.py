import gzip
import random
import struct
import time

import numpy as np
import pytest

from helixframe.operators import coverage
from helixframe.plans.loader import ArrayLoader, CatLoader, Loader, LoaderMap
from helixframe.plans.store import DatasetBuilder, Store
from helixframe.sources import bam, bigwig, fasta, gff
from helixframe.sources.signal_store import SignalStore, import_runs


def test_fasta(spark, tmp_path):
    path = tmp_path / "g.fa.gz"
    path.write_bytes(gzip.compress(b">chr2 second\nACG\nTTT\n>chr1\r\nNNacgt\r\n"))
    chunks = fasta.read_fasta(spark, str(path), 4)
    assert sorted(tuple(r) for r in chunks.collect()) == [("chr1", 0, "NNac"), ("chr1", 1, "gt"), ("chr2", 0, "ACGT"), ("chr2", 1, "TT")]
    assert [tuple(r) for r in fasta.chrom_sizes(chunks).collect()] == [("chr1", 6), ("chr2", 6)]
    segs = spark.createDataFrame([(0, "chr2", 0), (1, "chr2", 4), (2, "chr2", 90)], "seg_idx long, chrom string, start long")
    assert [r["seq"] for r in fasta.cut_windows(segs, chunks, 4, 1, 4).orderBy("seg_idx").collect()] == ["NACGTT", "TTTNNN"[:1] + "TTNNN", "NNNNNN"]


def test_gff(spark, tmp_path):
    path = tmp_path / "a.gff3.gz"
    row = "c\tx\tgene\t5\t9\t.\t+\t.\tgene_id=g;gene_name=a%2Cb+c; gene_type=protein_coding\n"
    path.write_bytes(gzip.compress(b"##gff-version 3\n") + gzip.compress(row.encode()))
    got = gff.read_gff(spark, str(path)).collect()
    assert len(got) == 1 and got[0]["attributes"] == {"gene_id": "g", "gene_name": "a,b+c", "gene_type": "protein_coding"}


def test_bam(spark, tmp_path):
    def record(name, flag, ref, pos, cigar):
        raw = name.encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(raw), 60, 0, len(cigar), flag, 0, -1, -1, 0) + raw + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 7) + b"@broken" + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    path = tmp_path / "r.bam"
    path.write_bytes(gzip.compress(head + record("a", 0, 0, 10, [(8, "M")])) + gzip.compress(record("b", 4, -1, -1, [])))
    assert [tuple(r) for r in bam.read_bam(spark, str(path)).collect()] == [("a", 0, "c1", 11, 60, "8M"), ("b", 4, None, 0, 60, "*")]
    assert [tuple(r) for r in bam.bam_sizes(spark, str(path)).collect()] == [("c1", 1000)]


def test_bigwig_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, s, s + 3, float(rng.randrange(100))) for c in ("chr1", "chr10", "chr2") for s in range(0, 3000, 4)]
    runs = spark.createDataFrame(rows, "chrom string, start long, end long, value float")
    sizes = spark.createDataFrame([("chr1", 5000), ("chr10", 5000), ("chr2", 5000)], "chrom string, size long")
    path = str(tmp_path / "s.bw")
    bigwig.write_bigwig(runs, sizes, path, per_block=2)
    assert sorted(tuple(r) for r in bigwig.read_bigwig(spark, path).collect()) == sorted(rows)
    assert bigwig.bigwig_sizes(spark, path).count() == 3
    assert bigwig.is_url("https://a.example/x.bw") and not bigwig.is_url("/tmp/x.bw")


def test_signal_store(spark, tmp_path):
    path = str(tmp_path / "store")
    runs = spark.createDataFrame([("c1", 0, 4, 1.0), ("c1", 4, 5, float("nan")), ("c2", 0, 2, 3.0)], "chrom string, start long, end long, value float")
    store = SignalStore(spark, path, "w")
    import_runs(runs, store, "t", norm_factor=100.0)
    opened = SignalStore(spark, path)
    assert opened.keys() == ["c1", "c2"] and "c1" in opened and "c9" not in opened
    assert opened.attr("sum", "t") == pytest.approx(100.0) and opened.verify().first()["difference"] < 1e-6
    with pytest.raises(FileExistsError):
        SignalStore(spark, path, "w")
    with pytest.raises(ValueError):
        SignalStore(spark, path, "a")
    with pytest.raises(PermissionError):
        opened.add(runs)


@pytest.fixture(scope="module")
def genome(spark, tmp_path_factory):
    """chr1 of 1,024 letters with 1..8 cycling, chr2 of 919 zeros."""
    root = tmp_path_factory.mktemp("genome")
    rng = random.Random(2)
    seqs = {"chr1": "".join(rng.choices("ACGT", k=1024)), "chr2": "".join(rng.choices("ACGT", k=919))}
    (root / "g.fa").write_text("".join(f">{k}\n{v}\n" for k, v in seqs.items()))
    one = spark.createDataFrame([("chr1", i, i + 1, float(i % 8 + 1)) for i in range(1024)] + [("chr2", 0, 919, 0.0)], "chrom string, start long, end long, value float")
    noise = {c: [rng.uniform(-10_000, 10_000) for _ in s] for c, s in seqs.items()}
    two = spark.createDataFrame([(c, i, i + 1, v) for c, vs in noise.items() for i, v in enumerate(vs)], "chrom string, start long, end long, value float")

    def build(window, resolution, **more):
        where = str(root / f"d{window}-{resolution}-{len(more)}")
        b = DatasetBuilder(spark, where, str(root / "g.fa"), window, resolution=resolution, padding=8, **more)
        b.add_runs("data1", one)
        b.add_runs("data2", two)
        b.finish()
        return where

    return seqs, noise, build, {}


def built(genome, window, resolution):
    _, _, build, done = genome
    if (window, resolution) not in done:
        done[window, resolution] = build(window, resolution)
    return done[window, resolution]


def test_loader_means_and_clamp(spark, genome):
    where = built(genome, 128, 8)
    loader = Loader(spark, where, batch_size=5)
    out = list(loader)
    assert len(loader) == len(out) == 4 and sum(len(v) for _, v in out) == 16
    values = np.concatenate([v for _, v in out])
    assert (values[:8, :, 0] == 4.5).all() and (values[8:, :, 0] == 0).all()
    assert (np.concatenate([v for _, v in Loader(spark, where, scale=2.0, clamp_max=4.0)])[:8, :, 0] == 4.0).all()
    assert loader.tracks == ["data1", "data2"] and loader.segments[-1] == "chr2:896-919"
    assert "16 segments" in repr(loader)


def test_loader_round_trip(spark, genome):
    seqs, noise, _, _ = genome
    where = built(genome, 32, 1)
    for batch, jobs in ((3, 1), (7, 3)):
        out = list(Loader(spark, where, batch_size=batch, n_jobs=jobs, seq_as_string=True))
        letters = "".join(s for ss, _ in out for s in ss)
        assert letters[:1024] == seqs["chr1"] and letters[1024:1943] == seqs["chr2"]
        flat = np.concatenate([v for _, v in out])[:, :, 1].ravel()
        assert np.abs(flat[:1024] - noise["chr1"]).max() < 0.005 * 10_000
    trimmed = np.concatenate([v for _, v in Loader(spark, where, target_length=24)])
    whole = np.concatenate([v for _, v in Loader(spark, where)])
    assert (trimmed == whole[:, 4:28]).all()
    split = np.concatenate([v for _, v in Loader(spark, where, window_size=16, target_length=8)])
    assert (split == whole.reshape(-1, 16, 2)[:, 4:12]).all()


def test_aggregate_at_read(spark, genome):
    a = np.concatenate([v for _, v in Loader(spark, built(genome, 32, 4))])
    b = np.concatenate([v for _, v in Loader(spark, built(genome, 32, 1), resolution=4)])
    assert (a[:, :, 0] == b[:, :, 0]).all()


def test_shift_moves_both(spark, genome):
    seqs, noise, _, _ = genome
    loader = Loader(spark, built(genome, 32, 1), random_shift=4, seq_as_string=True)
    padded, values = "N" * 8 + seqs["chr1"] + "N" * 40, np.concatenate((np.zeros(8), noise["chr1"], np.zeros(40)))
    seen = set()
    rows = loader.batches().where("seg_idx < 32").orderBy("seg_idx").collect()
    for r in rows:
        at = r["seg_idx"] * 32 + 8
        shifts = [s for s in range(-4, 5) if padded[at + s : at + s + 32] == r["seq"]]
        assert any(np.abs(values[at + s : at + s + 32] - np.array(r["values"][1])).max() <= 50 for s in shifts)
        seen.update(shifts)
    assert len(seen) > 3


def test_subsets_index_and_maps(spark, genome):
    where = built(genome, 128, 8)
    loader = Loader(spark, where)
    some = loader.intersection(["chr1:0-128", "chr1:1-128", "chr2:896-919"])
    assert some.segments == ["chr1:0-128", "chr2:896-919"] and len(loader.difference(["chr1:0-128"]).segments) == 15
    assert len(loader.intersection(["chr1:100-130"], how="overlap").segments) == 2
    seq, values = loader.data["chr1:128-256", "data1"]
    assert len(seq[0]) == 128 and values.shape == (1, 16, 1) and (values == 4.5).all()
    assert loader.data[1, ["data2", "data1"]][1].shape == (1, 16, 2)
    with pytest.raises(KeyError):
        loader.data["chr9:0-1", "data1"]
    both = LoaderMap({"a": loader, "b": Loader(spark, where, batch_size=3)})
    assert both.batch_size == 3 and both.n_tracks == {"a": 2, "b": 2}
    seqs, cubes = next(iter(both))
    assert len(seqs) == 3 and (cubes["a"] == cubes["b"]).all()
    with pytest.raises(ValueError, match="segments"):
        LoaderMap({"a": loader, "b": some})
    cat = CatLoader([both.intersection(["chr1:0-128"]), both])
    assert len(cat) == 7 and [len(s) for s, _ in cat] == [1, 3, 3, 3, 3, 3, 1]
    shuffled = [s for ss, _ in Loader(spark, where, shuffle=True, seq_as_string=True) for s in ss]
    plain = [s for ss, _ in Loader(spark, where, seq_as_string=True) for s in ss]
    assert sorted(shuffled) == sorted(plain) and shuffled != plain
    assert loader.hist(bins=4, limit=1).count() >= 1


def test_validation(spark, genome, tmp_path):
    where = built(genome, 128, 8)
    for bad in ({"random_shift": 9}, {"resolution": 12}, {"target_length": 12}, {"window_size": 48}, {"target_length": 256}, {"window_size": 64, "target_length": 128}):
        with pytest.raises(ValueError):
            Loader(spark, where, **bad)
    with pytest.raises(ValueError):
        DatasetBuilder(spark, str(tmp_path / "x"), "nowhere.fa", 100, resolution=32)
    with pytest.raises(ValueError):
        LoaderMap({})
    with pytest.raises(ValueError):
        CatLoader([])


def test_builder_rules(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1\nACGTACGTAC\n>c2\nAC\n")
    b = DatasetBuilder(spark, str(tmp_path / "d"), str(tmp_path / "g.fa"), 4, resolution=1, segments=["c1:2-4", "c2:0-2", "c1:1-5"])
    assert b.segments() == ["c1:1-5", "c2:0-2"]
    part = spark.createDataFrame([("c1", 0, 10, 1.0)], "chrom string, start long, end long, value float")
    with pytest.raises(ValueError, match="lacks c2"):
        b.add_runs("t", part)
    both = part.union(spark.createDataFrame([("c2", 0, 2, float("nan"))], part.schema))
    b.add_runs("t", both)
    with pytest.raises(ValueError, match="already"):
        b.add_runs("t", both)
    b.finish()
    with pytest.raises(RuntimeError):
        b.finish()
    (seqs, values), = list(Loader(spark, str(tmp_path / "d"), seq_as_string=True))
    assert seqs == ["CGTA", "ACNN"] and values[:, :, 0].tolist() == [[1, 1, 1, 1], [0, 0, 0, 0]]


def test_arrays(spark, tmp_path):
    data = [(np.arange(22, dtype=float).reshape(11, 2) + i, np.full((11, 1, 3), i)) for i in range(7)]
    loader = ArrayLoader(spark, data, str(tmp_path / "a"), batch_size=3)
    out = list(ArrayLoader.open(spark, str(tmp_path / "a"), 3))
    assert len(loader) == len(out) == 26 and len(out[-1][0]) == 2
    assert (np.concatenate([x for x, _ in out]) == np.concatenate([x for x, _ in data])).all()
    assert out[0][1].shape == (3, 1, 3)
    with pytest.raises(ValueError):
        ArrayLoader(spark, [(np.zeros((2, 2)), np.zeros(2)), (np.zeros((2, 3)), np.zeros(2))], str(tmp_path / "b"))


def test_streamed_coverage(spark, tmp_path):
    from helixframe.streaming.coverage import binned_counts

    source = str(tmp_path / "in")
    spark.sql("SELECT 'c' AS chrom, id * 10 AS start, id * 10 + 10 AS end, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts FROM range(40)").write.parquet(source)
    stream = binned_counts(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), 100)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("binned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("SELECT bin, fragments FROM binned").collect()) == [(0, 10), (1, 10), (2, 10), (3, 10)]


def test_windows_cost_their_own_letters(spark):
    """40,000 short windows of one chunk: seconds, where reading the whole chunk for each takes over half a minute."""
    seq = "".join("ACGTN"[(7 * p + p // 3) % 5] for p in range(fasta.CHUNK))
    chunks = spark.createDataFrame([("c", 0, seq)], "chrom string, chunk_id long, seq string")
    segments = spark.range(0, 40_000, 1, 1).selectExpr("id AS seg_idx", "'c' AS chrom", "id + 25000 AS start")
    began = time.time()
    got = fasta.cut_windows(segments, chunks, 32, 4).selectExpr("count(*)", "min(length(seq))", "max(length(seq))", "max_by(seq, seg_idx)", "min_by(seq, seg_idx)").first()
    assert time.time() - began < 15
    assert got[:] == (40_000, 40, 40, seq[64_995:65_035], seq[24_996:25_036])


def test_runs_of_a_track_are_made_once(spark, tmp_path):
    """Neither the sweep nor the check for chromosomes makes the rows below it again."""
    seen = spark.sparkContext.accumulator(0)

    def row(i):
        seen.add(1)
        return "c", i * 3 % 900, i * 3 % 900 + 7

    fragments = spark.createDataFrame(spark.sparkContext.parallelize(range(400), 2).map(row), "chrom string, start long, end long")
    depth = np.zeros(907)
    for i in range(400):
        depth[i * 3 % 900 : i * 3 % 900 + 7] += 1
    got = np.zeros(907)
    for r in coverage.pile_up(fragments, slice_width=64).collect():
        got[r["start"] : r["end"]] = r["value"]
    assert (got == depth).all() and seen.value == 400
    path = tmp_path / "g.fa"
    path.write_text(">c\n" + "ACGTA" * 200 + "\n")
    builder = DatasetBuilder(spark, f"file://{tmp_path}/once", str(path), 100, resolution=4)
    builder.add_runs("t", coverage.pile_up(fragments))
    assert seen.value == 800
    with pytest.raises(ValueError, match="lacks c"):
        builder.add_runs("none", coverage.pile_up(fragments.where("start < 0")))
    builder.finish()
    assert not list((tmp_path / "once").glob("_runs/*"))
    values = Store(spark, f"file://{tmp_path}/once").read().orderBy("seg_idx").collect()
    assert np.allclose(np.concatenate([r["values"][0] for r in values])[:226], depth[:904].reshape(-1, 4).mean(1))
