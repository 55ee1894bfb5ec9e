"""Token ids in files of fixed-width bit packing.

A shard holds the documents of one range of ids, in ascending order, as blocks
of whole documents.  A block is one record:

    shard, block        where it stands
    start               ids of the shard before it
    doc_ids, lengths    its documents and the number of ids of each
    payload             "HXTB", version (1 byte), bits (1 byte), 2 zero bytes,
                        number of ids (4 bytes, little-endian), then all ids,
                        each in ``bits`` bits, lowest bit first, then 8 zero bytes

Id i of a block lies at bit i * bits, so any range is read without what stands
before it.  Records are kept in Parquet, which every store that Spark writes to
can hold, and whose committer survives lost executors; the ranges of ``shard``
and ``start`` in its footers find a block without reading others.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm import text as tx
from helixframe.llm.bpe import byte_alphabet

MAGIC = b"HXTB"
_HEAD = struct.Struct("<4sBBHI")
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Text bytes encoded at once; the more, the fewer distinct words in each.
SLICE_BYTES = 1 << 23


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """A payload of the ids.  Eight ids fill ``bits`` bytes, so each of the eight places has its own shift."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    groups = -(-len(ids) // 8)
    eights = np.zeros((groups, 8), np.uint64)
    eights.ravel()[: len(ids)] = ids
    body = np.zeros((groups, bits + 8), np.uint8)
    for place in range(8):
        byte, shift = divmod(place * bits, 8)
        moved = eights[:, place] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            body[:, byte + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return _HEAD.pack(MAGIC, 1, bits, 0, len(ids)) + body[:, :bits].tobytes()[: -(-len(ids) * bits // 8)] + bytes(8)


def unpack(payload: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids begin..end of a payload, without touching the others."""
    magic, version, bits, _, n = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    begin = min(begin, n)
    end = max(begin, n if end is None else min(end, n))
    first, groups = begin // 8, -(-end // 8) - begin // 8
    at = _HEAD.size + first * bits
    raw = np.frombuffer(payload[at : at + groups * bits].ljust(groups * bits, b"\0"), np.uint8).reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for place in range(8):
        byte, shift = divmod(place * bits, 8)
        word = np.zeros(groups, np.uint64)
        for k in range((shift + bits + 7) // 8):
            word |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, place] = (word >> np.uint64(shift)) & mask
    return out.ravel()[begin - 8 * first : end - 8 * first]


#: The pieces of a byte-level tokenizer, and the same for code points below 256 in plain ``re``.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file, added tokens included."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return 1 + max(chain(spec["model"]["vocab"].values(), (x["id"] for x in spec["added_tokens"])), default=0)


def cuts_as_here(path: str) -> bool:
    """Whether a tokenizer file cuts texts by ``PIECES`` and nothing else, so that pieces can be asked for one by one."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    marks = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"])
    return bool(plain and spec.get("normalizer") is None and not marks)


def _latin_pieces() -> re.Pattern:
    import unicodedata

    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t-\r\x20\x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{kinds['L']}]+| ?[{kinds['N']}]+| ?[^{space}{kinds['L']}{kinds['N']}]+|[{space}]+(?![^{space}])|[{space}]+")


#: A blank with white space, or an end of the text, on both sides (RE2).  At all other blanks a cut by ``PIECES`` begins a
#: piece with the blank, or a run of white space ends before it, so the words between them can be cut one by one.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LOOSE = rf"(?:\A|[{_SPACE}]) (?:[{_SPACE}]|\z)"
#: The character that stands for each byte; 0xFF, which UTF-8 never has, parts pieces.
_ALPHABET = np.array([*map(ord, byte_alphabet()[:255]), ord("\n")], "<u2")


class Kept:
    """Ids by text, in two generations, so what is asked for again outlives a full cache; long texts are not kept."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def look_up(self, texts: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """Ids of each text; ``make`` is asked once for those that are not kept."""
        got = list(map(self.new.get, texts))
        lacking = [i for i, ids in enumerate(got) if ids is None]
        if lacking:
            fresh = {texts[i]: self.old.get(texts[i]) for i in lacking}
            ask = [t for t, ids in fresh.items() if ids is None]
            if ask:
                fresh.update(zip(ask, make(ask), strict=True))
            for i in lacking:
                got[i] = fresh[texts[i]]
            if len(self.new) + len(fresh) > self.size // 2:
                self.old, self.new = self.new, {}
            self.new.update((t, ids) for t, ids in fresh.items() if len(t) <= 64)
        return got


class LibraryEncoder:
    """A file of the tokenizers library, asked once for each distinct piece of text if it cuts them as here, else text by text.

    Texts are first split at blanks by Arrow, so that only the distinct words of a call, each with the blank
    before it, become Python strings and are cut to pieces.  Ids are kept as little-endian 32-bit bytes.
    """

    def __init__(self, path: str, kept: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library would only wait on one another
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = cuts_as_here(path)
        self.pieces, self.latin, self.wide = regex.compile(PIECES), _latin_pieces(), re.compile("[^\x00-\xff]")
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)  # the same model, for pieces in the letters of its vocabulary, a line each
        self.model.pre_tokenizer = Split("\n", "removed")
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(1 + max(vocabulary.values(), default=0), np.int64)
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.kept = Kept(kept)

    def _cut(self, text: str) -> list[str]:
        return (self.latin if text.isascii() or not self.wide.search(text) else self.pieces).findall(text)

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces from the library, by one call of its model for all; a piece ends where the lengths of tokens say."""
        raw = np.frombuffer(b"\xff".join(map(str.encode, pieces)), np.uint8)
        ids = np.array(self.model.encode_batch_fast([_ALPHABET[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")
        parted = np.append(np.flatnonzero(raw == 0xFF), len(raw)) - np.arange(len(pieces))
        told = np.cumsum(self.lengths[ids])
        ends = np.searchsorted(told, parted)
        if not len(ids) or told[-1] != parted[-1] or (told[ends] != parted).any():
            return [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
        data, ends = ids.tobytes(), (4 * ends + 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _joined(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of texts that are cut to pieces."""
        got = iter(self.kept.look_up(list(chain.from_iterable(cut)), self._of_pieces))
        return [b"".join(islice(got, len(pieces))) for pieces in cut]

    def _cut_words(self, words: pa.Array) -> tuple[list[str], np.ndarray]:
        """Pieces of words, each with a blank before it, and the number of pieces of each.

        Words that begin with no white space are cut as one text, in which only their first pieces hold a blank.
        """
        if not len(words):
            return [], np.zeros(0, np.int64)
        pieces = self._cut(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))[0].as_py())
        first = np.fromiter((p[0] == " " for p in pieces), bool, len(pieces))
        return pieces, np.diff(np.append(np.flatnonzero(first), len(pieces)))

    def _of_words(self, words: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the pieces of words, each with a blank before it, kind by kind; pieces of each word; the place of each word in that order."""
        edge = pc.match_substring_regex(words, rf"\A(?:[{_SPACE}]|\z)").to_numpy(zero_copy_only=False)
        wide = pc.match_substring_regex(words, r"[^\x{00}-\x{ff}]").to_numpy(zero_copy_only=False)
        kinds = [np.flatnonzero(x) for x in (edge, wide & ~edge, ~(edge | wide))]
        alone = [self._cut(" " + w) for w in words.take(pa.array(kinds[0])).to_pylist()]
        cut = [(list(chain.from_iterable(alone)), np.fromiter(map(len, alone), np.int64, len(alone))), *(self._cut_words(words.take(pa.array(k))) for k in kinds[1:])]
        ids = self.kept.look_up(list(chain.from_iterable(pieces for pieces, _ in cut)), self._of_pieces)
        return ids, np.concatenate([n for _, n in cut]), np.argsort(np.concatenate(kinds))

    def _plain(self, column: pa.Array) -> list[bytes]:
        """Ids of texts without loose blanks."""
        split = pc.split_pattern(column, " ")
        words, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = words.dictionary_encode()
        ids, pieces, place = self._of_words(coded.dictionary)
        heads = self._joined([self._cut(w) for w in words.take(pa.array(bounds[:-1])).to_pylist()])
        ends = np.cumsum(np.fromiter(map(len, chain(ids, heads)), np.int64, len(ids) + len(heads)))
        offsets = np.append(0, ends)[np.cumsum(np.concatenate(([0], pieces, np.ones(len(heads), np.int64))))]
        at = place[coded.indices.to_numpy()]
        at[bounds[:-1]] = len(pieces) + np.arange(len(heads))  # the first words, which have no blank before them
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(chain(ids, heads)))])
        data, sizes = known.take(pa.array(at)).buffers()[2], np.append(0, np.cumsum(np.diff(offsets)[at]))[bounds].tolist()
        return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

    def encode_many(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text, four bytes each; a column has no nulls."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole, loose = np.full(len(column), not self.by_piece), pc.match_substring_regex(column, _LOOSE).to_numpy(zero_copy_only=False)
        for mark in self.marks:
            whole |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)

        def put(rows: np.ndarray, encode: Callable[[pa.Array], list[bytes]]) -> None:
            at = np.flatnonzero(rows)
            if len(at):
                for i, ids in zip(at.tolist(), encode(column.take(pa.array(at))), strict=True):
                    out[i] = ids

        put(whole, lambda some: [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some.to_pylist()])
        put(loose & ~whole, lambda some: self._joined([self._cut(t) for t in some.to_pylist()]))
        put(~(loose | whole), self._plain)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
BLOCK_SCHEMA = "shard int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _writer(path: str, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        library = encoder(path)
        docs: list = []
        held: list[bytes] = []
        end = struct.pack("<I", end_id)

        def close() -> pa.RecordBatch:
            nonlocal block, start, docs, held
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = [len(x) // 4 for x in held]
            out = pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "start": start, "n_ids": len(ids), "doc_ids": docs, "lengths": lengths, "payload": pack(ids, bits)}], _BLOCK)
            block, start, docs, held = block + 1, start + len(ids), [], []
            return out

        size = 0
        for batch in batches:
            for first, last in tx.slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1).slice(first, last - first)
                for doc, ids in zip(batch.column(0).slice(first, last - first).to_pylist(), library.encode_many(texts), strict=True):
                    docs.append(doc)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield close()
                        size = 0
        if held:
            yield close()

    return run


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts, append ``end_id`` to each, and write them to ``out`` in ascending order of ids.

    An id takes the fewest bits that hold the vocabulary of the file at ``path``, and ``end_id``.
    Ranges of ids come from Spark's sampling, so no task gets more than its share,
    and ties (repeated ids, null ids, which come first) are dealt by their text.
    A null text counts as empty; only the two columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    bits = width(max(vocabulary_size(path), end_id + 1))
    ordered.mapInArrow(_writer(path, bits, end_id), BLOCK_SCHEMA).write.parquet(out)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Of each block: shard, document, start and number of ids by document; the bounds of the documents' ids; the ids."""
    for batch in batches:
        for shard, start, docs, lengths, payload in zip(*(batch.column(c) for c in ("shard", "start", "doc_ids", "lengths", "payload")), strict=True):
            n = np.array(lengths.as_py(), np.int64)
            ends = np.cumsum(n)
            columns = [pa.array(np.full(len(n), shard.as_py()), pa.int32()), docs.values, pa.array(start.as_py() + ends - n), pa.array(n)]
            yield columns, np.concatenate(([0], ends)), unpack(payload.as_py())


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns, bounds, ids in _unpacked(batches):
        parts = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([*columns, parts], ["shard", "doc_id", "start", "n_tokens", "ids"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns, bounds, ids in _unpacked(batches):
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def _bases(blocks: DataFrame) -> DataFrame:
    """(shard, base): the ids of all shards before.  One row a shard is summed in order."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))


def read_token_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(start, ids): the ids at places begin..end of all files, a row for each block that has some; ``start`` is the place of the first.

    Only blocks that overlap are read, and of them only the groups of eight ids around the range are unpacked.
    Places beyond the last id are left out.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    near = _bases(blocks).where(F.col("base") < end)
    rows = blocks.select("shard", "start", "n_ids", "payload").join(near, "shard").withColumn("at", F.col("base") + F.col("start"))
    rows = rows.where((F.col("at") < end) & (F.col("at") + F.col("n_ids") > begin)).select("at", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = unpack(payload.as_py(), max(0, begin - at), end - at)
                yield pa.RecordBatch.from_arrays([pa.array([max(at, begin)], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["start", "ids"])

    return rows.mapInArrow(run, "start long, ids array<long>")


def read_token_files(spark: SparkSession, path: str, summary: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids`` (with ``summary`` their CRC-32 in place of the ids).

    ``start`` counts the ids of all documents before, over all shards.  Only one
    row a shard is summed in order.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    base = _bases(blocks)
    names = "ids_crc32 long" if summary else "ids array<long>"
    docs = blocks.select("shard", "start", "doc_ids", "lengths", "payload").mapInArrow(_summaries if summary else _reader, f"shard int, doc_id long, start long, n_tokens long, {names}")
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", names.split()[0])
