"""BigWig files: runs of values, read by chromosome and written, from the public format description."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.sources.files import open_stream

MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
#: Compressed bytes of a split.
SPLIT = 1 << 23
SCHEMA = "chrom string, start bigint, end bigint, value float"
_ARROW = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float32())])


def is_url(src: str) -> bool:
    parts = urlsplit(src)
    return bool(parts.scheme) and bool(parts.netloc)


class BigWig:
    """An open file: its chromosomes, and the runs of its data blocks."""

    def __init__(self, path: str):
        self.file = open_stream(path)
        head = self.file.read(64)
        magic = struct.unpack_from("<I", head)[0]
        self.order = "<" if magic == MAGIC else ">"
        if struct.unpack_from(f"{self.order}I", head)[0] != MAGIC:
            raise ValueError("not a BigWig file")
        _, _, _, tree, _, index, _, _, _, _, self.buffer = struct.unpack_from(f"{self.order}IHHQQQHHQQI", head)
        self.index_at = index
        self.chroms: dict[str, tuple[int, int]] = {}
        self._walk_chroms(tree)

    def _read(self, at: int, fmt: str) -> tuple:
        self.file.seek(at)
        return struct.unpack(self.order + fmt, self.file.read(struct.calcsize(self.order + fmt)))

    def _walk_chroms(self, at: int) -> None:
        magic, _, key, _, _, _ = self._read(at, "IIIIQQ")
        if magic != TREE_MAGIC:
            raise ValueError("bad chromosome tree")
        nodes = [at + 32]
        while nodes:
            here = nodes.pop()
            leaf, _, n = self._read(here, "BBH")
            for i in range(n):
                if leaf:
                    name, number, size = self._read(here + 4 + i * (key + 8), f"{key}sII")
                    self.chroms[name.rstrip(b"\0").decode()] = number, size
                else:
                    nodes.append(self._read(here + 4 + i * (key + 8), f"{key}sQ")[1])

    def blocks(self, number: int) -> Iterator[tuple[int, int]]:
        """Offset and size of the data blocks that touch a chromosome, in order."""
        found, nodes = [], [self.index_at + 48]
        while nodes:
            here = nodes.pop()
            leaf, _, n = self._read(here, "BBH")
            for i in range(n):
                if leaf:
                    c0, _, c1, _, offset, size = self._read(here + 4 + i * 32, "IIIIQQ")
                    if c0 <= number <= c1:
                        found.append((offset, size))
                else:
                    c0, _, c1, _, offset = self._read(here + 4 + i * 24, "IIIIQ")
                    if c0 <= number <= c1:
                        nodes.append(offset)
        return iter(sorted(found))

    def runs(self, blocks: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(chromosome's number, starts, ends, values) of data blocks, read as whole arrays."""
        o = self.order
        for offset, size in blocks:
            self.file.seek(offset)
            raw = self.file.read(size)
            raw = zlib.decompress(raw) if self.buffer else raw
            number, start, _, step, span, kind, _, n = struct.unpack_from(f"{o}IIIIIBBH", raw)
            if kind == 1:
                rows = np.frombuffer(raw, np.dtype([("s", f"{o}u4"), ("e", f"{o}u4"), ("v", f"{o}f4")]), n, 24)
                starts, ends, values = rows["s"], rows["e"], rows["v"]
            elif kind == 2:
                rows = np.frombuffer(raw, np.dtype([("s", f"{o}u4"), ("v", f"{o}f4")]), n, 24)
                starts, ends, values = rows["s"], rows["s"].astype(np.int64) + span, rows["v"]
            else:
                starts, values = start + np.arange(n, dtype=np.int64) * step, np.frombuffer(raw, f"{o}f4", n, 24)
                ends = starts + span
            yield number, starts.astype(np.int64), ends.astype(np.int64), values.astype(np.float32)


class BigWigReader(DataSourceReader):
    """Splits of ``split`` compressed bytes of neighbouring data blocks, longest chromosome first."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        file = BigWig(self.path)
        out: list[InputPartition] = []
        for name, (number, _) in sorted(file.chroms.items(), key=lambda c: -c[1][1]):
            held, size = [], 0
            for block in file.blocks(number):
                held.append(block)
                size += block[1]
                if size >= self.split:
                    out.append(InputPartition((name, number, held)))
                    held, size = [], 0
            if held:
                out.append(InputPartition((name, number, held)))
        return out or [InputPartition(("", 0, []))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, number, blocks = partition.value
        if not blocks:
            return
        for at in range(0, len(blocks), 64):
            parts = [p[1:] for p in BigWig(self.path).runs(blocks[at : at + 64]) if p[0] == number]
            if parts:
                starts, ends, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                chrom = pa.array([name], pa.string()).take(pa.array(np.zeros(len(starts), np.int32)))
                yield pa.RecordBatch.from_arrays([chrom, pa.array(starts), pa.array(ends), pa.array(values)], schema=_ARROW)


class BigWigSource(DataSource):
    """``spark.read.format("helix_bigwig").option("split", bytes).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "helix_bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options["path"], int(self.options.get("split", SPLIT)))


def fetch(url: str, target: str) -> str:
    """Download ``url`` to ``target``; the server has to tell the length."""
    from urllib.request import urlopen

    with urlopen(url) as response, open(target, "wb") as out:
        if response.headers.get("Content-Length") is None:
            raise ValueError(f"no content length: {url}")
        while part := response.read(1 << 20):
            out.write(part)
    return target


def read_bigwig(spark: SparkSession, path: str, spool: str | None = None) -> DataFrame:
    """Runs of a file, or of a URL, which is first fetched to ``spool`` (a path that executors see too)."""
    if is_url(path):
        if spool is None:
            raise ValueError("a URL needs a spool path")
        path = fetch(path, spool)
    spark.dataSource.register(BigWigSource)
    return spark.read.format("helix_bigwig").load(path)


def bigwig_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(n, s) for n, (_, s) in BigWig(path).chroms.items()], "chrom string, size long")


def write_bigwig(runs: DataFrame, sizes: DataFrame, path: str, per_block: int = 1024) -> None:
    """One file from sorted runs, streamed to the driver partition by partition; for exchange, not for scale."""
    lengths = {r["chrom"]: r["size"] for r in sizes.collect()}
    names = sorted(lengths)
    key = max((len(n.encode()) for n in names), default=1)
    number = {n: i for i, n in enumerate(names)}
    with open(path, "wb") as out:
        out.write(bytes(64))
        tree_at = out.tell()
        out.write(struct.pack("<IIIIQQ", TREE_MAGIC, max(len(names), 1), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names)))
        for n in names:
            out.write(struct.pack(f"<{key}sII", n.encode(), number[n], lengths[n]))
        data_at = out.tell()
        out.write(bytes(8))
        blocks: list[tuple[int, int, int, int, int]] = []
        held: list[tuple[int, int, float]] = []
        last = None
        largest = 0

        def close() -> None:
            nonlocal largest
            if held:
                c = number[last]
                raw = struct.pack("<IIIIIBBH", c, held[0][0], held[-1][1], 0, 0, 1, 0, len(held)) + b"".join(struct.pack("<IIf", *h) for h in held)
                largest = max(largest, len(raw))
                packed = zlib.compress(raw)
                blocks.append((c, held[0][0], held[-1][1], out.tell(), len(packed)))
                out.write(packed)
                held.clear()

        for r in runs.select("chrom", "start", "end", "value").orderBy("chrom", "start").toLocalIterator(prefetchPartitions=True):
            if r["chrom"] != last or len(held) == per_block:
                close()
                last = r["chrom"]
            held.append((r["start"], r["end"], float(r["value"])))
        close()
        index_at = out.tell()
        level = [(c, s, c, e, at, size) for c, s, e, at, size in blocks]
        head = (level[0][0], level[0][1], level[-1][2], max(x[3] for x in level)) if level else (0, 0, 0, 0)
        out.write(struct.pack("<IIQIIIIQII", INDEX_MAGIC, 256, len(blocks), *head, index_at, 1, 0))
        _write_index(out, level)
        out.seek(data_at)
        out.write(struct.pack("<Q", len(blocks)))
        out.seek(0)
        out.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, largest, 0))


def _write_index(out, entries: list[tuple], fan: int = 256) -> None:
    """An R-tree, root first: nodes of one level stand together, and each knows where its children will be."""
    levels = [[entries[i : i + fan] for i in range(0, len(entries), fan)] or [[]]]
    while len(levels[0]) > 1:
        spans = [(n[0][0], n[0][1], n[-1][2], max(x[3] for x in n)) for n in levels[0]]
        levels.insert(0, [spans[i : i + fan] for i in range(0, len(spans), fan)])
    at = out.tell()
    sizes = [[4 + len(n) * (32 if k == len(levels) - 1 else 24) for n in nodes] for k, nodes in enumerate(levels)]
    starts = []
    for row in sizes:
        starts.append([])
        for s in row:
            starts[-1].append(at)
            at += s
    for k, nodes in enumerate(levels):
        child = 0
        for node in nodes:
            leaf = k == len(levels) - 1
            out.write(struct.pack("<BBH", int(leaf), 0, len(node)))
            for x in node:
                if leaf:
                    out.write(struct.pack("<IIIIQQ", *x))
                else:
                    out.write(struct.pack("<IIIIQ", *x, starts[k + 1][child]))
                    child += 1
