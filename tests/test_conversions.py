"""Files in several splits, and the calls that go from one file to another."""

import gzip
import http.server
import random
import struct
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.plans.convert import bam_cov, bw_to_store
from helixframe.plans.loader import CatLoader, Loader, LoaderMap
from helixframe.plans.store import DatasetBuilder
from helixframe.sources import bam, bigwig, fasta
from helixframe.sources.signal_store import SignalStore, import_runs


def bgzf(data: bytes, block: int) -> bytes:
    """Data in BGZF blocks of ``block`` bytes, and the empty block at the end."""
    out = b""
    for at in [*range(0, len(data), block), len(data)]:
        part = data[at : at + block]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam_bytes(rows, refs):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
    for name, size in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for name, flag, ref, pos, mapq, cigar in rows:
        raw = name.encode() + b"\0"
        seq = sum(n for n, o in cigar if o in "MIS=X")
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(raw), mapq, 0, len(cigar), flag, seq, -1, -1, 0) + raw + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        body += bytes((seq + 1) // 2) + bytes(seq)
        head += struct.pack("<i", len(body)) + body
    return head


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        m, n = rng.randrange(20, 90), rng.randrange(1, 60)
        cigar = [(m, "M")] if rng.random() < 0.7 else [(5, "S"), (m, "M"), (n, "N"), (m, "M")]
        rows.append((f"read{i}", rng.choice([0, 16, 0, 16, 4, 256, 1024, 2048, 1]), rng.randrange(2), rng.randrange(0, 5000), rng.randrange(60), cigar))
    rows[2000] = ("long", 0, 0, 10, 9, [(50_000, "M")])  # spans many blocks and whole splits
    return rows


REFS = [("chr1", 60_000), ("chr2", 6000)]


def test_bam_in_splits(spark, tmp_path, reads):
    path = tmp_path / "r.bam"
    path.write_bytes(bgzf(bam_bytes(reads, REFS), 3000))
    want = [(n, f, REFS[r][0], p + 1, q, "".join(f"{k}{o}" for k, o in c)) for n, f, r, p, q, c in reads]
    for split in (1500, 9000, 1 << 25):
        got = bam.read_bam(spark, str(path), split)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert bam.read_bam(spark, str(path), 9000).rdd.getNumPartitions() > 5


def brute_coverage(reads, strand=None):
    depth = {name: np.zeros(size) for name, size in REFS}
    total = 0
    for _, flag, ref, pos, _, cigar in reads:
        reverse = bool(flag & 16)
        if flag & 0x904 or (strand is not None and strand != "+-"[reverse]):
            continue
        end = pos + 1 + sum(n for n, o in cigar if o in "MDN=X")
        at = end - 1 if reverse else pos + 1
        total += 1
        if at < len(depth[REFS[ref][0]]):
            depth[REFS[ref][0]][at] += 1
    return {k: v / (total / 1e6) for k, v in depth.items()}


def dense(rows):
    out = {name: np.zeros(size) for name, size in REFS}
    for r in rows:
        out[r["chrom"]][r["start"] : r["end"]] = r["value"]
    return out


def test_bam_cov(spark, tmp_path, reads):
    path = str(tmp_path / "r.bam")
    (tmp_path / "r.bam").write_bytes(bgzf(bam_bytes(reads, REFS), 3000))
    counts = bam_cov(spark, path, str(tmp_path / "all.bw"))
    assert counts["total"] == 4000 and counts["unmapped"] == sum(bool(r[1] & 4) for r in reads)
    with pytest.raises(ValueError):
        bam_cov(spark, path, str(tmp_path / "x.bw"), stranded=True)
    bam_cov(spark, path, str(tmp_path / "f.bw"), output2=str(tmp_path / "r.bw"), stranded=True)
    for name, strand in (("all", None), ("f", "+"), ("r", "-")):
        got = dense(bigwig.read_bigwig(spark, str(tmp_path / f"{name}.bw")).collect())
        want = brute_coverage(reads, strand)
        assert all(np.allclose(got[k], want[k], rtol=1e-6) for k in got)


def test_bigwig_in_splits_and_by_url(spark, tmp_path):
    rows = [(c, s, s + 2, float(s % 9)) for c in ("a", "b") for s in range(0, 4000, 4)]
    runs = spark.createDataFrame(rows, "chrom string, start long, end long, value float")
    sizes = spark.createDataFrame([("a", 4100), ("b", 4100)], "chrom string, size long")
    path = str(tmp_path / "s.bw")
    bigwig.write_bigwig(runs, sizes, path, per_block=16)
    spark.dataSource.register(bigwig.BigWigSource)
    split = spark.read.format("helix_bigwig").option("split", "500").load(path)
    assert sorted(map(tuple, split.collect())) == sorted(rows) and split.rdd.getNumPartitions() > 8
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        store = bw_to_store(spark, f"http://127.0.0.1:{server.server_port}/s.bw", str(tmp_path / "store"), norm_factor=1000.0, spool=str(tmp_path / "spool.bw"))
    finally:
        server.shutdown()
    stats = store.attrs().first()
    assert stats["n"] == 8200 and stats["min"] == 0 and stats["sum"] == pytest.approx(1000, rel=1e-4) and stats["mean"] == pytest.approx(1000 / 8200, rel=1e-4)
    assert store.codec in ("zstd", "gzip") and 0 < store.compression_ratio(sizes) < 1
    with pytest.raises(ValueError):
        bigwig.read_bigwig(spark, "http://127.0.0.1:1/s.bw")


def test_codecs_and_tolerance(spark, tmp_path):
    runs = spark.createDataFrame([("c1", i, i + 1, i / 7) for i in range(500)], "chrom string, start long, end long, value float")
    for codec in ("none", "snappy", "zstd"):
        store = SignalStore(spark, str(tmp_path / codec), "w")
        import_runs(runs, store, "t", tolerance=0.5, codec=codec)
        assert all(abs(r["value"] - r["start"] / 7) <= 0.5 and r["value"] == int(r["value"]) for r in store.runs().collect())
    assert SignalStore(spark, str(tmp_path / "none")).compression_ratio() > SignalStore(spark, str(tmp_path / "zstd")).compression_ratio()


def test_fasta_in_splits_and_index(spark, tmp_path):
    rng = random.Random(5)
    seqs = {f"s{i}": "".join(rng.choices("ACGTN", k=k)) for i, k in enumerate((0, 1, 59, 60, 61, 5000, 777, 12_000))}
    text = "".join(f">{n} of {i}\n" + "".join(s[a : a + 60] + "\n" for a in range(0, len(s), 60)) for i, (n, s) in enumerate(seqs.items()))
    path = tmp_path / "g.fa"
    path.write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got: dict[str, list] = {}
            for r in fasta.read_fasta(spark, str(path), 100).collect():
                got.setdefault(r["chrom"], []).append((r["chunk_id"], r["seq"]))
            assert {n: "".join(x for _, x in sorted(c)) for n, c in got.items()} == seqs
            assert all(len(x) == 100 for c in got.values() for _, x in sorted(c)[:-1])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "g.fa.fai").write_text("s5\t5000\t1\t60\t61\ns7\t12000\t9\t60\t61\n")
    assert sorted(map(tuple, fasta.sizes(spark, str(path)).collect())) == [("s5", 5000), ("s7", 12_000)]


def test_epochs_move_on(spark, tmp_path):
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress(b">c\n" + b"ACGT" * 200))
    builder = DatasetBuilder(spark, str(tmp_path / "d"), str(tmp_path / "g.fa.gz"), 16, resolution=1)
    runs = spark.range(800).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.floor(F.col("id") / 16).cast("float").alias("value"))
    builder.add_runs("t", runs)
    with pytest.raises(NotImplementedError):
        builder.add_file("h", "x.w5z")
    builder.finish()
    windows = lambda batches: [int(v[0, 0]) for _, values in batches for v in values]
    still = Loader(spark, str(tmp_path / "d"))
    assert windows(still) == windows(still) == list(range(50))
    loader = Loader(spark, str(tmp_path / "d"), shuffle=True)
    first, copied, second = windows(loader), loader.copy(), windows(loader)
    assert sorted(first) == sorted(second) == list(range(50)) and first != second
    assert windows(copied) == second and windows(loader.epoch(0)) == first
    cat = CatLoader([LoaderMap({"x": Loader(spark, str(tmp_path / "d"), shuffle=True)})])
    turns = lambda batches: [int(v[0, 0]) for _, named in batches for v in named["x"]]
    assert turns(cat) == first and turns(cat) == second and turns(cat.epoch(0)) == first and "LoaderMap" in repr(cat)
