"""BAM records through Spark's Python data source API, from the public format description."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.sources.files import open_stream, stream_size

SCHEMA = "qname string, flag int, chrom string, pos bigint, mapq int, cigar string"
_ARROW = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string())])
#: Compressed bytes of a split.
SPLIT = 1 << 25
#: Letters of CIGAR operations by code.
CIGAR_OPS = "MIDNSHP=X"


def read_references(stream) -> list[tuple[str, int]]:
    """Names and lengths of the reference dictionary; the SAM text before it is skipped unread."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    (text,) = struct.unpack("<i", stream.read(4))
    stream.read(text)
    (n,) = struct.unpack("<i", stream.read(4))
    out = []
    for _ in range(n):
        (size,) = struct.unpack("<i", stream.read(4))
        name = stream.read(size)[:-1].decode()
        out.append((name, struct.unpack("<i", stream.read(4))[0]))
    return out


def block_size(head: bytes) -> int:
    """Compressed size of the BGZF block that begins with ``head``, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    (extra,) = struct.unpack_from("<H", head, 10)
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _first_block(stream, at: int, end: int) -> int:
    """Offset of the first BGZF block in [at, end): its header, and that of the block after it; else ``end``."""
    while at < end:
        stream.seek(at)
        data = stream.read(1 << 17)
        found = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= found < end - at:
            size = block_size(data[found : found + 64])
            if size:
                stream.seek(at + found + size)
                after = stream.read(64)
                if not after or block_size(after):
                    return at + found
            found = data.find(b"\x1f\x8b\x08\x04", found + 1)
        if len(data) < 1 << 17:
            break
        at += len(data) - 3
    return end


class Blocks:
    """The inflated bytes from one BGZF block on, with the file offset that each block came from."""

    def __init__(self, stream, at: int):
        self.stream, self.next, self.data, self.starts = stream, at, bytearray(), []

    def more(self) -> bool:
        """Append the next block; false at the end of the file."""
        self.stream.seek(self.next)
        head = self.stream.read(64)
        size = block_size(head)
        if not size:
            return False
        raw = head[:size] + self.stream.read(max(0, size - len(head)))
        self.starts.append((len(self.data), self.next))
        self.data += zlib.decompress(raw, 31)
        self.next += size
        return True

    def need(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def drop(self, n: int) -> None:
        """Forget the first ``n`` bytes."""
        del self.data[:n]
        while len(self.starts) > 1 and self.starts[1][0] <= n:
            self.starts.pop(0)
        self.starts = [(max(0, a - n), b) for a, b in self.starts]

    def offset(self, at: int) -> int:
        """File offset of the block that holds byte ``at``."""
        return next(b for a, b in reversed(self.starts) if a <= at)


def _plausible(blocks: Blocks, at: int, refs: int, chain: int = 6) -> bool:
    """Whether a chain of well-formed records (or the end of the file) begins at ``at``."""
    for _ in range(chain):
        if not blocks.need(at + 36):
            return len(blocks.data) == at
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", blocks.data, at)
        fits = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq if l_seq >= 0 else 1 << 40
        if not (fits <= size < 1 << 28 and -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and l_name >= 1):
            return False
        if not blocks.need(at + 4 + size) or blocks.data[at + 36 + l_name - 1] != 0:
            return False
        at += 4 + size
    return True


def _strings(cigars: list[bytes], seen: dict[bytes, str]) -> list[str]:
    """CIGAR text; each distinct one is written once."""
    for raw in cigars:
        if raw not in seen:
            codes = np.frombuffer(raw, "<u4")
            seen[raw] = "".join(f"{c >> 4}{CIGAR_OPS[c & 15]}" for c in codes.tolist()) or "*"
    return [seen[raw] for raw in cigars]


def to_arrow(data: bytes, starts: list[int], names: np.ndarray, seen: dict[bytes, str]) -> pa.RecordBatch:
    """Columns of the records that begin (with their size) at ``starts``: fixed fields are gathered in one step."""
    at = np.array(starts, np.int64)
    raw = np.frombuffer(data, np.uint8)
    fixed = raw[at[:, None] + np.arange(4, 24)].copy().view(np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4")])).ravel()
    name_end = at + 36 + fixed["l_name"].astype(np.int64)
    cigar_end = name_end + 4 * fixed["n_cigar"].astype(np.int64)
    qnames = [data[a:b].decode() for a, b in zip((at + 36).tolist(), (name_end - 1).tolist(), strict=True)]
    cigars = _strings([bytes(data[a:b]) for a, b in zip(name_end.tolist(), cigar_end.tolist(), strict=True)], seen)
    pos = fixed["pos"].astype(np.int64)
    columns = (pa.array(qnames, pa.string()), pa.array(fixed["flag"].astype(np.int32)), pa.array(names[fixed["ref"]], pa.string()), pa.array(np.where(pos >= 0, pos + 1, 0)), pa.array(fixed["mapq"].astype(np.int32)), pa.array(cigars, pa.string()))
    return pa.RecordBatch.from_arrays(list(columns), schema=_ARROW)


class BamReader(DataSourceReader):
    """A file is read in splits of ``split`` bytes.  A record belongs to the split that holds the start of its BGZF block.

    A file of plain gzip has no such blocks and is one split.
    """

    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with open_stream(path) as stream:
                size, split = stream_size(stream), self.split
                if not block_size(stream.read(64)):
                    split = max(size, 1)
            out += [InputPartition((path, at, min(at + split, size))) for at in range(0, max(size, 1), split)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, begin, end = partition.value
        with open_stream(path) as stream:
            if not block_size(stream.read(64)):
                stream.seek(0)
                with gzip.GzipFile(fileobj=stream) as plain:
                    names = [n for n, _ in read_references(plain)]
                    yield from self._records(_Whole(plain), names, None)
                return
            stream.seek(0)
            with gzip.GzipFile(fileobj=stream) as plain:
                names = [n for n, _ in read_references(plain)]
                head = plain.tell()
            if begin == 0:
                blocks = Blocks(stream, 0)
                blocks.need(head)
                blocks.drop(head)
            else:
                first = _first_block(stream, begin, end)
                blocks = Blocks(stream, first)
                if first >= end or not self._align(blocks, len(names), end):
                    return
            yield from self._records(blocks, names, end)

    @staticmethod
    def _align(blocks: Blocks, refs: int, end: int) -> bool:
        """Drop what belongs to a record of the split before; false if no record begins in this split."""
        at = 0
        while blocks.need(at + 1) and blocks.offset(at) < end:
            if _plausible(blocks, at, refs):
                blocks.drop(at)
                return True
            at += 1
        return False

    @staticmethod
    def _records(blocks, names: list[str], end: int | None) -> Iterator[pa.RecordBatch]:
        table, seen = np.array([*names, None], object), {}  # a reference of -1 is the last: none
        while True:
            starts, at = [], 0
            while len(starts) < 10_000 and blocks.need(at + 4) and (end is None or blocks.offset(at) < end):
                (size,) = struct.unpack_from("<i", blocks.data, at)
                if not blocks.need(at + 4 + size):
                    raise ValueError("the file ends inside a record")
                starts.append(at)
                at += 4 + size
            if not starts:
                return
            yield to_arrow(bytes(blocks.data[:at]), starts, table, seen)
            blocks.drop(at)


class _Whole:
    """A plain stream under the interface of ``Blocks``."""

    def __init__(self, stream):
        self.stream, self.data = stream, bytearray()

    def need(self, n: int) -> bool:
        while len(self.data) < n:
            part = self.stream.read(1 << 20)
            if not part:
                return False
            self.data += part
        return True

    def drop(self, n: int) -> None:
        del self.data[:n]


class BamSource(DataSource):
    """``spark.read.format("helix_bam").option("split", bytes).load(path)``; several paths stand with commas between."""

    @classmethod
    def name(cls) -> str:
        return "helix_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader([p for p in self.options["path"].split(",") if p], int(self.options.get("split", SPLIT)))


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Alignment records with positions from 1, as in SAM."""
    spark.dataSource.register(BamSource)
    return spark.read.format("helix_bam").option("split", str(split)).load(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The same columns of SAM text."""
    lines = spark.read.text(path).where("value NOT LIKE '@%' AND value != ''")
    f = "split(value, '\\t')"
    return lines.selectExpr(f"{f}[0] AS qname", f"cast({f}[1] AS int) AS flag", f"nullif({f}[2], '*') AS chrom", f"cast({f}[3] AS bigint) AS pos", f"cast({f}[4] AS int) AS mapq", f"{f}[5] AS cigar")


def bam_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size) of the reference dictionary."""
    with open_stream(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
        return spark.createDataFrame(read_references(stream), "chrom string, size long")
