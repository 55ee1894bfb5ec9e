"""Byte-pair encoding with word ends, by a priority queue over a linked symbol list."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import text as tx

_WIDE = re.compile("[^\x00-\xff]")
#: Words whose ids a Python worker keeps.
CACHE = 250_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


#: The word pattern of the file, and the types of its normalizers, for which the code below stands.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def _latin_words() -> re.Pattern:
    """The word pattern of the file for texts of code points below 256, where plain ``re`` can name the classes."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t-\r\x20\x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{space}{kinds['L']}{kinds['N']}]+")


class WordIds(dict):
    """Ids of words seen, in two generations: what is asked for again outlives a full cache."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.size // 2:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class WordBPE:
    """A tokenizer file whose text is NFC, lower case, with runs of white space as one blank; another file is an error."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != NORMALIZERS or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"not a tokenizer file of this kind: {path}")
        self.vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.merges: dict[int, tuple[int, int]] = {}  # a pair of ids: its rank and the id it becomes
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.vocab[left] << 32 | self.vocab[right], (rank, self.vocab[left + right]))
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.latin_words = _latin_words() if split["pattern"]["Regex"] == WORDS else self.words
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + end] for c in alphabet]
        self.cache = WordIds(self.merge, CACHE)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank, and of those the leftmost, merges until none is left.

        Symbols form a doubly linked list.  The queue holds rank and position in one
        number; an entry whose symbols have changed since is stale and skipped.
        """
        raw = word.encode()
        n = len(raw)
        symbols = [self.first[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        queue = [got[0] << 32 | i for i in range(n - 1) if (got := merges.get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            got = merges.get(symbols[i] << 32 | symbols[j])
            if not got or got[0] != entry >> 32:
                continue
            symbols[i], symbols[j] = got[1], -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if got := merges.get(symbols[i] << 32 | symbols[j]):
                    heapq.heappush(queue, got[0] << 32 | i)
            if (j := before[i]) >= 0 and (got := merges.get(symbols[j] << 32 | symbols[i])):
                heapq.heappush(queue, got[0] << 32 | j)
        return tuple(s for s in symbols if s >= 0)

    def encode(self, text: str) -> list[int]:
        if "<|" not in text:
            return self._plain(text)
        parts = self.specials.split(text)
        return [i for part in parts for i in ([self.added[part]] if part in self.added else self._plain(part))]

    def _plain(self, text: str) -> list[int]:
        text = self.normalized(text)
        words = (self.latin_words if text.isascii() or not _WIDE.search(text) else self.words).findall(text)
        return list(chain.from_iterable(map(self.cache.__getitem__, words)))

    def normalized(self, text: str) -> str:
        if not text.isascii():
            # Lower case letter by letter: a final sigma is no special case.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, set side by side with blanks between (the file names no decoder)."""
        tokens = self.tokens
        return " ".join(map(tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def _runner(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for begin, end in tx.slices(batch.column(1)):
                ids = [bpe.encode(text or "") for text in batch.column(1).slice(begin, end - begin).to_pylist()]
                flat = np.fromiter(chain.from_iterable(ids), np.int32)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(map(bpe.decode, ids), pa.string())], ["id", "ids", "decoded"])

    return run


def bpe_encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: ``doc_id, ids, decoded``.

    Defined cases: a null or empty text has no ids and decodes to an empty one; the
    strings of special tokens in a text become their ids; long texts are encoded
    whole; repeated rows and null ids are kept as they are; other columns are not
    read; an empty table gives an empty one.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>, decoded string"
    return kept.mapInArrow(_runner(path), schema).withColumnRenamed("id", id_col)
