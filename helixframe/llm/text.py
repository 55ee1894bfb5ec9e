"""Vectorised word and shingle hashing over Arrow string buffers.

Words are runs of anything but ASCII white space ([^\\x20\\x09-\\x0D]+), with
A-Z lower-cased.  A word's hash is a polynomial over random 64-bit byte codes,
taken from one running sum over the whole buffer, so that no Python object is
made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes handled at once; bounds the temporary arrays of a Python worker.
SLICE_BYTES = 1 << 18

_rng = np.random.default_rng(20240101)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_CODE[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: U64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, U64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(int(have[done - 1]) * int(base) & (1 << 64) - 1)
            done += step
        _powers[str(base)] = have
    return have[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``limit`` bytes each; a longer text stands alone."""
    sizes = np.zeros(len(column), np.int64)
    if len(column):
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += int(size)
    if begin < len(column):
        yield begin, len(column)
    pa.default_memory_pool().release_unused()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (with the total last)."""
    inside = ~space[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans."""
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_CODE[raw] * _power(_BASE, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(U64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the index of each row's first word."""
    raw, offsets = buffer_of(column)
    starts, ends, first = word_bounds(raw, offsets)
    return span_hashes(raw, starts, ends), first


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words as one run where there are fewer."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = words[: n - size + 1].copy()
    for k in range(1, size):
        out = mix(out * _BASE + words[k : n - size + 1 + k])
    return out if size > 1 else mix(out)
