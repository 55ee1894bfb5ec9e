"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A hash function rotates a vector by three rounds of random signs and a fast
Walsh-Hadamard transform, and takes the signed index of the largest coordinate.
A table's bucket joins a few such functions; multiprobe also enters the next
likeliest buckets.  Vectors that share a bucket are compared exactly, in double
precision, inside the bucket; large buckets are compared block against block.  What leaves a bucket is one row per linked vector (its
count and one link), never the pairs: a pair that shares several buckets counts
in the first of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.text import mix
from helixframe.llm.workspace import Workspace


@dataclass(frozen=True)
class CrossPolytopeOptions:
    """``miss``: share of pairs just at the threshold that may be missed; the number of tables follows from it.

    ``probes`` buckets a table are entered for each vector; ``block`` bounds the
    vectors that one task compares with as many others; ``load`` is the number of
    unrelated vectors a bucket should hold, from which the functions a table follow, up to ``most_functions``
    (beyond that buckets fill and are compared in more blocks; the links found are the same).
    """

    threshold: float = 0.95
    miss: float = 1e-4
    probes: int = 3
    block: int = 1024
    load: float = 2.0
    most_functions: int = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths.

    Coordinates lie one after the other in memory, each of all rows, so that sums run over long stretches.
    """
    n, d = x.shape
    x = np.ascontiguousarray(x.T)
    h = 1
    while h < d:
        x = x.reshape(d // (2 * h), 2, h, n)
        y = np.empty_like(x)
        np.add(x[:, 0], x[:, 1], out=y[:, 0])
        np.subtract(x[:, 0], x[:, 1], out=y[:, 1])
        x = y
        h *= 2
    return (x.reshape(d, n) / math.sqrt(d)).T


@lru_cache
def _signs(dim: int, function: int) -> np.ndarray:
    padded = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng((dim, function, 77)).choice((-1.0, 1.0), (3, padded))


def rotated(x: np.ndarray, function: int) -> np.ndarray:
    signs = _signs(x.shape[1], function)
    out = np.zeros((signs.shape[1], len(x))).T
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return np.ascontiguousarray(out)


def largest(size: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values (none negative) of each row, in order; ties to the first place."""
    left, rows = size.copy(), np.arange(len(size))
    out = np.empty((len(size), k), np.int64)
    for i in range(k):
        out[:, i] = left.argmax(1)
        left[rows, out[:, i]] = -1
    return out


def bucket_keys(x: np.ndarray, tables: int, functions: int, probes: int) -> np.ndarray:
    """Keys (row, table, probe) of unit vectors; probe 0 is the bucket of the vector itself."""
    n, dim = x.shape
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        keys = np.full((n, 1), dim * 1_000_003 + t, np.int64).astype(np.uint64)
        costs = np.zeros((n, 1))
        for f in range(functions):
            y = rotated(x, t * functions + f)
            size = np.abs(y)
            top = largest(size, min(probes, y.shape[1]))
            got = np.take_along_axis(size, top, 1)
            code = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            cost = (got[:, :1] - got) ** 2
            all_costs = (costs[:, :, None] + cost[:, None, :]).reshape(n, -1)
            all_keys = mix(keys[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + code[:, None, :].astype(np.uint64)).reshape(n, -1)
            best = np.argsort(all_costs, axis=1, kind="stable")[:, :probes]
            costs, keys = np.take_along_axis(all_costs, best, 1), np.take_along_axis(all_keys, best, 1)
        out[:, t] = keys.view(np.int64)[:, np.minimum(np.arange(probes), keys.shape[1] - 1)]
    return out


@lru_cache
def tables_needed(dim: int, functions: int, o: CrossPolytopeOptions) -> int:
    """Tables at which pairs of random directions at the threshold are missed with probability ``miss``, by simulation."""
    rng = np.random.default_rng(11)
    a = rng.normal(size=(3000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = o.threshold * a + math.sqrt(1 - o.threshold**2) * b
    x, y = (bucket_keys(v, 1, functions, o.probes)[:, 0] for v in (a, b))
    met = (x[:, :, None] == y[:, None, :]).any((1, 2)).mean()
    return max(1, math.ceil(math.log(o.miss) / math.log(max(1e-9, 1 - min(met, 1 - 1e-9)))))


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as doubles, and the offsets of its rows."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return column.values.to_numpy(zero_copy_only=False), offsets


def _vectors(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double of some rows of a list column, all of one length."""
    values, offsets = _floats(column)
    x = values[offsets[rows][:, None] + np.arange(dim)]
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hasher(functions: int, o: CrossPolytopeOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                dims = np.diff(_floats(part.column(1))[1])
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    keys = bucket_keys(_vectors(part.column(1), rows, int(dim)), tables_needed(int(dim), functions, o), functions, o.probes).reshape(len(rows), -1)
                    ends = np.arange(len(rows) + 1, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(ends * keys.shape[1], pa.int32()), pa.array(keys.ravel()))], ["c", "keys"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


@dataclass
class _Rows:
    """Members of whole buckets (or block pairs): ``begin`` bounds the buckets, ``keys`` are padded lists of all buckets of a row."""

    begin: np.ndarray
    key: np.ndarray
    c: np.ndarray
    copies: np.ndarray
    side: np.ndarray
    x: np.ndarray
    keys: np.ndarray


#: Buckets of up to so many members are compared together, pair by pair; larger ones by a matrix product each.
SMALL = 48
_NONE = np.iinfo(np.int64).max


def _near_pairs(r: _Rows, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket that are near enough, each once."""
    size = np.diff(r.begin)
    one = np.array([(r.side[b:e] == 2).all() for b, e in zip(r.begin[:-1], r.begin[1:], strict=True)], bool)
    for m in np.unique(size[one & (size <= SMALL)]):
        if m < 2:
            continue
        first = r.begin[:-1][one & (size == m)]
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 16) // len(i))
        for at in range(0, len(first), step):
            a, b = ((first[at : at + step, None] + k).ravel() for k in (i, j))
            near = np.einsum("ij,ij->i", r.x[a], r.x[b]) >= threshold
            yield a[near], b[near]
    for g in np.flatnonzero(~(one & (size <= SMALL))):
        rows = np.arange(r.begin[g], r.begin[g + 1])
        left, right = rows[r.side[rows] != 1], rows[r.side[rows] != 0]
        for at in range(0, len(left), 512):
            i, j = np.nonzero(r.x[left[at : at + 512]] @ r.x[right].T >= threshold)
            a, b = left[at : at + 512][i], right[j]
            keep = r.c[a] < r.c[b] if one[g] else r.c[a] != r.c[b]
            yield a[keep], b[keep]


def _compare(r: _Rows, threshold: float) -> list[np.ndarray] | None:
    """Linked members: (class, smallest class reached in its bucket, links counted here).

    A pair that shares several buckets counts in the one of smallest key.
    """
    links, found = np.zeros(len(r.c), np.int64), []
    for a, b in _near_pairs(r, threshold):
        for at in range(0, len(a), 1 << 14):
            p, q = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            here, smaller = r.key[p], np.zeros(len(p), bool)
            for k in range(r.keys.shape[1]):
                mine = r.keys[p, k]
                rows = np.flatnonzero((mine < here) & ~smaller)
                if not len(rows):
                    break  # the lists ascend
                smaller[rows] = (r.keys[q[rows]] == mine[rows, None]).any(1)
            p, q = p[~smaller], q[~smaller]
            np.add.at(links, p, r.copies[q])
            np.add.at(links, q, r.copies[p])
            found.append((p, q))
    if not found:
        return None
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    # Within a bucket rows ascend by class, so the smallest row reached is the smallest class.
    root = _roots(len(r.c), a, b)
    out = np.flatnonzero(links > 0)
    return [r.c[out], r.c[root[out]], links[out]]


def _comparer(threshold: float, most: int = 4096):
    """Rows sorted by (key, p, q, c) in lots of whole buckets; a bucket may run over several batches."""

    def made(parts: list[pa.RecordBatch]) -> Iterator[_Rows]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        key, p, q, c, copies, side = (whole.column(i).to_numpy() for i in range(6))
        dims = np.diff(_floats(whole.column(6).chunk(0))[1])
        head = np.stack([key, p, q])
        cuts = np.concatenate(([0], np.flatnonzero((head[:, 1:] != head[:, :-1]).any(0)) + 1, [len(key)]))
        lists = whole.column(7).chunk(0)
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        counts = np.diff(ends)
        keys = np.full((len(key), counts.max()), _NONE)
        keys[np.repeat(np.arange(len(key)), counts), np.arange(len(flat[ends[0] : ends[-1]])) - np.repeat(ends[:-1] - ends[0], counts)] = flat[ends[0] : ends[-1]]
        for dim in np.unique(dims):  # vectors of one bucket have one length
            groups = np.flatnonzero(dims[cuts[:-1]] == dim)
            rows = np.concatenate([np.arange(cuts[g], cuts[g + 1]) for g in groups])
            begin = np.concatenate(([0], np.cumsum(np.diff(cuts)[groups])))
            yield _Rows(begin, key[rows], c[rows], copies[rows], side[rows], _vectors(whole.column(6).chunk(0), rows, int(dim)), keys[rows])

    def lots(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if held and n >= most:
                last = np.array([held[-1].column(i)[-1].as_py() for i in range(3)])
                other = np.flatnonzero((head != last[:, None]).any(0))
                if len(other):  # the bucket that was open ends in this batch
                    if other[0]:
                        held.append(batch.slice(0, other[0]))
                    yield held
                    held, n, batch = [], 0, batch.slice(other[0])
            held.append(batch)
            n += batch.num_rows
        if held:
            yield held

    def run(batches):
        for held in lots(batches):
            for rows in made(held):
                got = _compare(rows, threshold)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["c", "other", "links"])

    return run


def valid_vector(column: str) -> F.Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def numbers(df: DataFrame, column: str) -> F.Column:
    """A vector column as floats, where it holds such, else as doubles."""
    kind = df.schema[column].dataType.simpleString()
    return df[column] if kind == "array<float>" else df[column].cast("array<double>")


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", options: CrossPolytopeOptions | None = None) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Links are pairs with cosine at or above the threshold.  ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reached.

    Only class numbers and keys are dealt to buckets.  Buckets that hold the same classes, as those of a group of near
    copies mostly do, are one; vectors travel to what is left, and to no bucket that they are alone in.

    Defined cases: vectors null, empty, zero or with null or non-finite components
    link with nothing (0 links, their own component); equal vectors link with one
    another, repeated rows included, and are compared with the rest once; vectors of
    different lengths never link; of an id repeated with other vectors each row is judged by its own;
    a row with a null id is never compared and has 0 links and a null component; an empty table gives an empty one.
    """
    o = options or CrossPolytopeOptions()
    spark = rows.sparkSession
    ws = Workspace(spark, "embedding")
    rows = rows.select(rows[id_col].cast("long").alias("id"), numbers(rows, vector_col).alias("v"))
    rows = rows.withColumn("ok", valid_vector("v") & F.col("id").isNotNull())
    classes = rows.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = ws.table(classes.select(F.monotonically_increasing_id().alias("c"), "id", "copies", "v"))
    n, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    functions = 1
    while dim and (n or 0) * o.probes / (2 * (1 << max(1, (dim - 1).bit_length()))) ** functions > o.load and functions < o.most_functions:
        functions += 1
    hashed = ws.table(classes.select("c", "v").mapInArrow(_hasher(functions, o), "c long, keys array<long>"))
    entries = hashed.select("c", F.explode(F.array_distinct("keys")).alias("key"))
    # A bucket's members are told by their number, two sums of their hashes, and the outermost of them.
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("f"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("g"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    kept = sizes.where("n > 1").groupBy("n", "f", "g", "lo", "hi").agg(F.min("key").alias("key"))
    member = ws.table(entries.join(kept.select("key", F.ceil(F.col("n") / o.block).cast("int").alias("blocks")), "key").select("c", "key", "blocks"))
    known = member.groupBy("c").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    about = ws.table(known.join(classes.select("c", "copies", "v"), "c").select("c", "copies", "v", "keys"))
    mine = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    placed = member.select("c", "key", "blocks", mine.alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    placed = placed.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "c", side.alias("side")).join(about, "c")
    placed = placed.select("key", "p", "q", "c", "copies", "side", "v", "keys")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = placed.repartition(partitions, "key", "p", "q").sortWithinPartitions("key", "p", "q", "c").mapInArrow(_comparer(o.threshold), "c long, other long, links long")
    found = ws.table(found.groupBy("c", "other").agg(F.sum("links").alias("links")))
    label = ws.table(components(found.select(F.col("c").alias("a"), F.col("other").alias("b")), ws))
    linked = ws.table(found.groupBy("c").agg(F.sum("links").alias("links")))
    owner = classes.join(linked, "c", "left").join(label.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    owner = ws.table(owner.select("v", "id", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("ok")))
    least = owner.groupBy("component").agg(F.min("id").alias("least"))
    owner = owner.join(least, "component").select("v", "ok", "n_links", "least")
    out = rows.join(owner, ["v", "ok"], "left")
    component = F.coalesce("least", "id")
    return ws.finish(out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")))
