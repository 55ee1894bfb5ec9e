"""Near-duplicate documents by MinHash bands with sequential Bayesian verification.

The plan, for texts of any number:

1. ``sketch``: one pass over the texts gives each document the size and a
   128-bit digest of its shingle set, its band keys and a short signature.
2. Documents with equal sets form a class; only one of each class goes on.
3. Classes that share a band key are candidates.  In each bucket every member
   is first paired with the bucket's smallest id, so a bucket of m members gives
   m - 1 pairs, not m^2 / 2.
4. Pairs are pruned batch by batch on their signatures, as soon as the posterior
   probability of a similarity at or above the threshold falls below the chosen
   miss probability; survivors are confirmed on full shingle sets.
5. Buckets whose members are by now in one component are settled.  In the
   others, pairs of different components are compared inside the bucket,
   block against block, so no bucket has to fit in one task and no pair of
   equal component is tested again; survivors are confirmed as in 4.

Exact copies, near copies in thousands and very common passages thus cost
rows in proportion to their documents.  No bucket is capped or dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import text as tx
from helixframe.llm.components import components
from helixframe.llm.workspace import Workspace


@dataclass(frozen=True)
class MinHashOptions:
    """``threshold_pct``: link if 100 * intersection >= threshold_pct * union.

    With ``bands`` of ``rows`` hashes a pair at similarity s shares no band with
    probability (1 - s^rows)^bands: 7e-6 at 0.8 by default.  ``miss`` is the
    probability at which a pair is given up by its posterior.  ``block`` bounds
    the members that one task compares with as many others, ``block_shingles`` their shingles (but for one
    document alone).
    """

    shingle: int = 5
    threshold_pct: int = 80
    bands: int = 30
    rows: int = 5
    signature: int = 128
    batch: int = 32
    miss: float = 1e-7
    block: int = 1024
    block_shingles: int = 1 << 20


@lru_cache
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7_2024)
    return rng.integers(0, 1 << 31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.int64).astype(np.uint32)


def minhashes(values: np.ndarray, n: int) -> np.ndarray:
    """``n`` 32-bit MinHash values of a set of 64-bit hashes."""
    mul, add = _coefficients(n)
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        part = mul[:, None] * short[None, at : at + 1024]
        part += add[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document."""
    got = np.sort(tx.shingles(words, size))
    return got[np.concatenate(([True], got[1:] != got[:-1]))] if len(got) else got


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart: two sums of differently mixed members."""
    with np.errstate(over="ignore"):
        parts = (tx.mix(values).sum(dtype=np.uint64), tx.mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return tuple(int(x.astype(np.int64)) for x in parts)


SKETCH = "id long, hash long, n_shingles long, hi long, lo long, bands array<long>, sig binary"


def _sketcher(o: MinHashOptions):
    salt = tx.mix(np.arange(1, o.bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tx.slices(batch.column(1)):
                words, first = tx.word_hashes(batch.column(1).slice(begin, end - begin))
                rows = {k: [] for k in ("n", "hi", "lo", "bands", "sig")}
                for i in range(end - begin):
                    got = shingle_set(words[first[i] : first[i + 1]], o.shingle)
                    rows["n"].append(len(got))
                    if not len(got):
                        for k in ("hi", "lo", "bands", "sig"):
                            rows[k].append(None)
                        continue
                    hi, lo = set_digest(got)
                    mins = minhashes(got, max(o.bands * o.rows, o.signature))
                    key = salt.copy()
                    for column in mins[: o.bands * o.rows].reshape(o.bands, o.rows).T:
                        key = tx.mix(key * np.uint64(0x2545F4914F6CDD1D) + column.astype(np.uint64))
                    rows["hi"].append(hi)
                    rows["lo"].append(lo)
                    rows["bands"].append(key.view(np.int64))
                    rows["sig"].append(mins[: o.signature].astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), batch.column(2).slice(begin, end - begin), pa.array(rows["n"], pa.int64()), pa.array(rows["hi"], pa.int64()), pa.array(rows["lo"], pa.int64()), pa.array(rows["bands"], pa.list_(pa.int64())), pa.array(rows["sig"], pa.binary())],
                    ["id", "hash", "n_shingles", "hi", "lo", "bands", "sig"],
                )

    return run


@lru_cache
def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of ``n`` equal hashes at which a pair stays a candidate.

    With a uniform prior the posterior after m matches is Beta(m + 1, n - m + 1),
    and the chance that the similarity is at least t is that of at most m
    successes in n + 1 trials of probability t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survives(a: np.ndarray, b: np.ndarray, o: MinHashOptions) -> np.ndarray:
    """Which rows of two signature matrices pass every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for at in range(0, o.signature, o.batch):
        got = (a[alive, at : at + o.batch] == b[alive, at : at + o.batch]).sum(axis=1)
        matches = matches + got
        keep = matches >= least_matches(min(at + o.batch, o.signature), o.threshold_pct / 100, o.miss)
        alive, matches = alive[keep], matches[keep]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array, o: MinHashOptions) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).reshape(len(column), o.signature)


def _pruner(o: MinHashOptions):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(survives(_matrix(batch.column(2), o), _matrix(batch.column(3), o), o)))

    return run


def _sets(o: MinHashOptions):
    def run(batches):
        for batch in batches:
            for begin, end in tx.slices(batch.column(1)):
                words, first = tx.word_hashes(batch.column(1).slice(begin, end - begin))
                sets = [shingle_set(words[first[i] : first[i + 1]], o.shingle).tobytes() for i in range(end - begin)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sets, pa.binary())], ["id", "members"])

    return run


def _confirmer(o: MinHashOptions):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = sorted((len(x), len(y)))
                if 100 * least >= o.threshold_pct * most:
                    both = np.sort(np.concatenate((x, y)))
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= o.threshold_pct * (least + most - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _near(pdf: pd.DataFrame, o: MinHashOptions) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a bucket (or block pair), later members of other components that its signature may match.

    A pair that shares several buckets is left to the first of its bands.
    """
    ids, comps, side = pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["side"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), o.signature)
    bands = np.stack(pdf["bands"].to_list())
    key = pdf["key"].iat[0]
    right = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1):
        near = right[comps[right] != comps[i]]
        near = near[ids[near] > ids[i]] if side[i] == 2 else near
        if len(near):
            near = near[survives(np.broadcast_to(sig[i], (len(near), o.signature)), sig[near], o)]
            first = (bands[near] == bands[i]).argmax(axis=1)
            near = near[bands[i][first] == key]
            if len(near):
                yield i, near


def _likely_members(o: MinHashOptions):
    """The members of a bucket that have a candidate in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(pdf), bool)
        for i, near in _near(pdf, o):
            hit[i] = True
            hit[near] = True
        return pdf.loc[hit, ["key", "p", "q", "side", "id", "component", "sig", "bands"]]

    return run


def _links_across(o: MinHashOptions):
    """Links between components inside one bucket, confirmed on full sets; a forest of them, not every pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["members"]]
        size = np.array([len(x) for x in sets])
        distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        flag = np.zeros(len(distinct), bool)
        # Components known before and found here, so that a pair they hold together is not tested.
        _, group = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        found = []
        for i, near in _near(pdf, o):
            near = near[group[near] != group[i]]
            near = near[100 * np.minimum(size[near], size[i]) >= o.threshold_pct * np.maximum(size[near], size[i])]
            if not len(near):
                continue
            flag[flat[ends[i] - size[i] : ends[i]]] = True
            common = np.array([int(flag[flat[ends[j] - size[j] : ends[j]]].sum()) for j in near])
            flag[flat[ends[i] - size[i] : ends[i]]] = False
            for j in near[100 * common >= o.threshold_pct * (size[i] + size[near] - common)]:
                if group[j] != group[i]:
                    found.append((ids[i], ids[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, ws: Workspace, o: MinHashOptions) -> DataFrame:
    """The pairs that the full shingle sets confirm."""
    sets = ws.table(sets.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(_confirmer(o), "a long, b long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("hash"))


def _judge(texts: DataFrame, ws: Workspace, o: MinHashOptions) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (hi, lo, doc, hash, id, component, least): the classes with their representatives.

    ``component`` is the smallest class number that a class reaches by links and ``least`` the smallest doc in it.
    """
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = texts.mapInArrow(_sketcher(o), SKETCH).withColumnRenamed("id", "doc")
    sketch = ws.table(sketch.withColumn("row", F.monotonically_increasing_id()))
    classes = sketch.where("hi IS NOT NULL AND doc IS NOT NULL").groupBy("hi", "lo").agg(F.min(F.struct("doc", "row", "hash")).alias("r"))
    classes = ws.table(classes.select("hi", "lo", "r.doc", "r.row", "r.hash", F.monotonically_increasing_id().alias("id")))
    chosen = sketch.select("row", "n_shingles", "bands", "sig").join(classes.select("row", "id"), "row")

    # Buckets with more than one class, and the star of each.
    members = chosen.select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    count = F.ceil(F.greatest(F.col("n") / o.block, F.col("shingles") / o.block_shingles)).cast("int")
    buckets = ws.table(buckets.where("least < most").select("key", "least", "n", F.least(count, F.col("n")).cast("int").alias("blocks")))
    members = ws.table(members.select("id", "key").join(buckets, "key"))
    star = ws.table(members.where("id > least").groupBy("id", "least").agg(F.count("*").alias("votes")))
    sigs = ws.table(chosen.select("id", "sig", "bands").join(members.select("id").distinct(), "id", "left_semi"))
    # The shingle sets of all members, made once.  A row is found by its id and a hash of its text, so an id repeated with
    # other texts does not multiply.  Members are as many as documents allow: no size of them is broadcast.
    found = texts.join(classes.select("id", "doc", "hash").join(sigs.select("id"), "id").hint("merge"), ["doc", "hash"]).select("id", "text")
    if sketch.where("doc IS NOT NULL").groupBy("doc", "hash").count().where("count > 1").limit(1).count():
        found = found.dropDuplicates(["id"])
    sets = ws.table(found.mapInArrow(_sets(o), "id long, members binary"))
    sig_a, sig_b = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in ("a", "b"))

    def pruned(pairs: DataFrame) -> DataFrame:
        return pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_pruner(o), "a long, b long")

    likely = ws.table(pruned(star.select(F.col("least").alias("a"), F.col("id").alias("b"))))
    # First each class with the smallest it is likely near to; then what that leaves apart.
    first = ws.table(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = ws.table(_confirm(first, sets, ws, o))
    label = ws.table(components(links, ws))

    def lifted(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
        for x in names:
            known = label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
            pairs = pairs.join(known, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
        return pairs

    def relabel(found: DataFrame) -> DataFrame:
        """The labels after links between components were found."""
        coarse = ws.table(components(lifted(found, ("a", "b")).select("ca", "cb"), ws, "ca", "cb"))
        fine = label.unionByName(coarse.select("node", F.col("node").alias("component")).join(label.select("node"), "node", "left_anti"))
        up = coarse.select(F.col("node").alias("component"), F.col("component").alias("top"))
        return ws.table(fine.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")))

    rest = ws.table(lifted(likely.join(first, ["a", "b"], "left_anti"), ("a", "b")).where("ca != cb").select("a", "b"))
    more = ws.table(_confirm(rest, sets, ws, o))
    label = relabel(more)

    # Buckets that hold more than one component, compared across components.  Pairs of blocks are dealt
    # to a stated number of tasks, as their work is out of proportion to their bytes.
    known = label.select(F.col("node").alias("id"), "component")
    members = ws.table(members.join(known, "id", "left").select("key", "id", "n", "blocks", F.coalesce("component", "id").alias("component")))
    mixed = ws.table(members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    open_ = members.join(mixed, "key", "left_semi").where("n > 2")
    blocked = open_.select("key", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "id", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    about = ws.table(sigs.join(known, "id", "left").select("id", "sig", "bands", F.coalesce("component", "id").alias("component")))
    cells = blocked.join(about, "id").repartition(partitions, "key", "p", "q")
    likely = ws.table(cells.groupBy("key", "p", "q").applyInPandas(_likely_members(o), "key long, p int, q int, side int, id long, component long, sig binary, bands array<long>"))
    links = likely.join(sets, "id").repartition(partitions, "key", "p", "q").groupBy("key", "p", "q").applyInPandas(_links_across(o), "a long, b long")
    label = relabel(ws.table(links))

    owner = classes.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = ws.table(owner.groupBy("component").agg(F.min("doc").alias("least")))
    return sketch, ws.table(owner.join(least, "component").select("hi", "lo", "doc", "hash", "id", "component", "least"))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: MinHashOptions | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id that the document reaches by links, itself
    included, and ``kept`` tells whether it is that id.  Defined cases: a text that
    is null or has no word has an empty set and links with nothing; one with
    fewer words than a shingle takes is one shingle of all its words; repeated rows
    share their component; a row with a null id takes no part in linking, and its
    component is that of its copies, else null; of an id repeated with other texts each row is
    judged by its own text.  Of the columns only those two are read, so others
    may have any name.  An empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    sketch, classes = _judge(_texts(docs, id_col, text_col), ws, options or MinHashOptions())
    out = sketch.select("doc", "n_shingles", "hi", "lo").join(classes.select("hi", "lo", "least"), ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc")).otherwise(F.col("least"))
    return ws.finish(out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: MinHashOptions | None = None) -> DataFrame:
    """The documents with all their columns, one of each group of near copies: that of smallest id.

    Rows are told apart by id and text, so of an id repeated with unlike texts every text stays.
    Defined cases: texts without a word all stay; of rows equal in id and text one stays, no matter which;
    a row with a null id goes if a row with an id has the same shingles, and of several without an
    id and with the same shingles one stays; columns of any name are kept; an empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    sketch, classes = _judge(_texts(docs, id_col, text_col), ws, options or MinHashOptions())
    winners = classes.groupBy("component").agg(F.min(F.struct("doc", "id", "hash")).alias("w")).select("w.doc", "w.hash")
    bare = sketch.where("hi IS NOT NULL AND doc IS NULL").join(classes.select("hi", "lo"), ["hi", "lo"], "left_anti")
    bare = bare.groupBy("hi", "lo").agg(F.min("hash").alias("hash")).select(F.lit(None).cast("long").alias("doc"), "hash")
    # How often each winner stands among the rows; texts without a word are not counted and all stay.
    seen = sketch.where("hi IS NOT NULL").groupBy("doc", "hash").agg(F.count("*").alias("rows"))
    key = lambda d: [F.coalesce(d, F.lit(0)).alias("k"), d.isNull().alias("bare"), "hash"]
    kept = winners.unionByName(bare).select(*key(F.col("doc"))).join(seen.select(*key(F.col("doc")), "rows"), ["k", "bare", "hash"])
    kept = kept.unionByName(sketch.where("hi IS NULL").select(*key(F.col("doc")), F.lit(1).cast("long").alias("rows")).distinct())
    kept = ws.table(kept)
    text = docs[text_col].cast("string")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs[id_col].cast("long").alias("doc"), F.xxhash64(text).alias("hash"))
    met = packed.select("d", *key(F.col("doc"))).join(kept, ["k", "bare", "hash"])
    out = met.where("rows = 1").select("d")
    if kept.where("rows > 1").limit(1).count():
        out = out.unionByName(met.where("rows > 1").dropDuplicates(["k", "bare", "hash"]).select("d"))
    return out.select("d.*")
