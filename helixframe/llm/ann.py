"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph; the graph is cut into
balanced parts, and a small softmax classifier learns to tell a vector's part.
It deals out all rows, and routes a query to as many of its likeliest parts as a
trial on the sample needs for the recall asked for.  Rows of those parts are
ranked by exact distance, queries in blocks against rows in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.embed_dedup import _floats, numbers, valid_vector
from helixframe.llm.workspace import Workspace


@dataclass(frozen=True)
class AnnOptions:
    """``sample_rows`` bounds the rows of one vector length that the partition is learned from; all rows are indexed.

    The number of parts grows with the rows, one for each ``part_rows``, between ``parts`` and what the sample
    can tell apart (one for each 50 of its rows).  ``recall`` is what the trial on the sample has to
    reach.  ``block`` is the number of rows of a part that one task ranks against ``queries`` queries.
    Lengths beyond the ``learned`` most common have one part, which every query of theirs visits.
    """

    k: int = 10
    sample_rows: int = 12_000
    parts: int = 16
    part_rows: int = 4096
    learned: int = 16
    graph_neighbours: int = 10
    recall: float = 0.97
    steps: int = 200
    block: int = 8192
    queries: int = 4096
    seed: int = 9


@dataclass(frozen=True)
class Router:
    """Softmax weights over standardised vectors with a bias, and how many parts a query visits."""

    centre: np.ndarray
    scale: float
    weights: np.ndarray
    visits: int

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(((x - self.centre) / self.scale, np.ones((len(x), 1))), axis=1) @ self.weights


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    norm = (x**2).sum(1)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        far = norm[None, :] - 2 * part @ x.T
        far[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        if k > 0:
            out[at : at + 1024] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A part for each row, all of nearly equal size, with few graph edges between parts.

    Halving along the direction of most spread gives a balanced start; then rows move
    to the part that most of their neighbours (both ways) are in, by greatest gain
    first, while the part has room for one in twenty above the even share.
    """
    part = np.zeros(len(x), np.int64)
    for level in range(max(0, (parts - 1).bit_length())):
        new = part * 2
        for p in range(1 << level):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                y = x[rows] - x[rows].mean(0)
                direction = rng.normal(size=x.shape[1])
                for _ in range(8):
                    direction = y.T @ (y @ direction)
                    direction /= max(np.linalg.norm(direction), 1e-300)
                new[rows[np.argsort(y @ direction, kind="stable")[len(rows) // 2 :]]] += 1
        part = new
    part %= parts
    n = len(x)
    room = int(np.ceil(n / parts * 1.05))
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room and rng.random() < 0.5:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, o: AnnOptions, rows: int = 0) -> Router:
    """Fit the router of ``rows`` rows on the sample ``x`` and set its visits by a trial on rows left out."""
    rng = np.random.default_rng(o.seed)
    parts = max(1, min(max(o.parts, -(-rows // o.part_rows)), len(x) // 50))
    centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = float(max(np.sqrt(((x - centre) ** 2).mean()), 1e-12)) if len(x) else 1.0
    if parts == 1:
        return Router(centre, scale, np.zeros((x.shape[1] + 1, 1)), 1)
    trial = rng.permutation(len(x))[: min(500, len(x) // 10)]
    left = np.setdiff1d(np.arange(len(x)), trial)
    graph = neighbour_graph(x[left], o.graph_neighbours)
    part = balanced_parts(x[left], graph, parts, rng)
    # A row's target spreads over its own part and those of its neighbours.
    goal = np.zeros((len(left), parts))
    goal[np.arange(len(left)), part] += 1
    np.add.at(goal, (np.repeat(np.arange(len(left)), graph.shape[1]), part[graph.ravel()]), 1 / max(1, graph.shape[1]))
    goal /= goal.sum(1, keepdims=True)
    z = np.concatenate(((x[left] - centre) / scale, np.ones((len(left), 1))), axis=1)
    w, first, second = np.zeros((z.shape[1], parts)), 0.0, 0.0
    for step in range(1, o.steps + 1):
        odds = z @ w
        odds = np.exp(odds - odds.max(1, keepdims=True))
        grad = z.T @ (odds / odds.sum(1, keepdims=True) - goal) / len(z) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    router = Router(centre, scale, w, parts)
    placed = router.odds(x[left]).argmax(1)
    rank = (-router.odds(x[trial])).argsort(1).argsort(1)
    far = (x[left] ** 2).sum(1)[None, :] - 2 * x[trial] @ x[left].T
    near = np.argsort(far, axis=1)[:, : o.k]
    needed = np.take_along_axis(rank, placed[near], 1) + 1
    share = [(needed <= v).mean() for v in range(1, parts + 1)]
    return Router(centre, scale, w, next(v for v, s in enumerate(share, 1) if s >= o.recall or v == parts))


def _matrix(column: pa.Array) -> np.ndarray:
    values, offsets = _floats(column)
    return values[offsets[0] : offsets[-1]].reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _dealer(routers: dict[int, Router], queries: bool):
    """(n, dim, part) of each row: its part, or as a query all parts that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                dims = np.diff(_floats(rows.column(1))[1])
                for dim in np.unique(dims):
                    own = pa.array(np.flatnonzero(dims == dim))
                    router, numbers = routers.get(int(dim)), rows.column(0).take(own)
                    if router is None:
                        best = np.zeros((len(own), 1), np.int32)
                    else:
                        odds = router.odds(_matrix(rows.column(1).take(own)))
                        best = np.argsort(-odds, axis=1, kind="stable")[:, : router.visits if queries else 1].astype(np.int32)
                    index = pa.array(np.repeat(np.arange(len(own)), best.shape[1]))
                    yield pa.RecordBatch.from_arrays([numbers.take(index), pa.array(np.full(len(index), dim, np.int32)), pa.array(best.ravel())], ["n", "dim", "part"])

    return run


def _ranker(k: int):
    """The k nearest rows to each query of a block, from one block of a part."""

    def run(left, right):
        import pandas as pd

        empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values(["id", "n"], kind="stable")
        x = np.stack(right["v"].to_list()).astype(np.float64)
        ids, numbers, norm = right["id"].to_numpy(), right["n"].to_numpy(), (x**2).sum(1)
        own, own_id = left["n"].to_numpy(), left["id"].to_numpy()
        out = []
        for at in range(0, len(left), 256):
            q = np.stack(left["v"].iloc[at : at + 256].to_list()).astype(np.float64)
            rough = norm[None, :] - 2 * q @ x.T
            for i in range(len(q)):
                other = np.flatnonzero(numbers != own[at + i])
                if len(other) > 4 * k:  # rough distances leave a margin for rounding; exact ones decide
                    near = rough[i, other]
                    bound = np.partition(near, k - 1)[k - 1]
                    other = other[near <= bound + 1e-9 * (1 + abs(bound) + (q[i] ** 2).sum() + norm.max())]
                exact = np.sqrt(((x[other] - q[i]) ** 2).sum(1))
                best = np.lexsort((numbers[other], ids[other], exact))[:k]
                out.append((np.full(len(best), own[at + i]), np.full(len(best), own_id[at + i]), ids[other][best], numbers[other][best], exact[best]))
        return pd.DataFrame(dict(zip(empty.columns, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def nearest(rows: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", options: AnnOptions | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows found for each query row, by Euclidean distance.

    ``is_query`` is a condition on the id column.  Parts hold row numbers; a vector travels once to its part, and a
    query's to the parts it visits.  Defined cases: vectors null,
    empty, zero or with null or non-finite components, and null ids, are neither query nor
    candidate; vectors of different lengths are never compared, and each length has a partition of its
    own; ties go to the smaller id; rows equal in id and vector are one row; of rows with one id and different vectors
    each is a candidate, also to the others, and each is a query with ranks of its own;
    fewer candidates than k give fewer rows; an empty table gives an empty one.
    """
    o = options or AnnOptions()
    spark = rows.sparkSession
    ws = Workspace(spark, "ann")
    valid = rows.select(rows[id_col].cast("long").alias("id"), numbers(rows, vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = valid.where(valid_vector("v") & F.col("id").isNotNull()).groupBy("id", "v").agg(F.max("asks").alias("asks"))
    valid = ws.table(valid.select(F.monotonically_increasing_id().alias("n"), "id", "v", "asks"))
    sizes = valid.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dim").limit(o.learned).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    routers = {}
    for size in sizes:
        share = min(1.0, o.sample_rows / size["rows"])
        drawn = valid.where((F.size("v") == size["dim"]) & (F.pmod(F.xxhash64("id", "v", F.lit(o.seed)), F.lit(1 << 30)) < int(share * (1 << 30))))
        got = drawn.select("id", "n", F.col("v").cast("array<double>").alias("v")).toArrow().sort_by([("id", "ascending"), ("n", "ascending")])
        routers[size["dim"]] = learn(_matrix(got.column("v").combine_chunks()), o, size["rows"])
    dealt = "n long, dim int, part int"
    index = ws.table(valid.select("n", "v").mapInArrow(_dealer(routers, False), dealt))
    asked = ws.table(valid.where("asks").select("n", "v").mapInArrow(_dealer(routers, True), dealt))
    # Both sides are cut into blocks by hash; every block of queries meets every block of its part.
    part = ["dim", "part"]
    held = index.groupBy(*part).agg(F.ceil(F.count("*") / o.block).cast("int").alias("row_blocks"))
    asking = asked.groupBy(*part).agg(F.ceil(F.count("*") / o.queries).cast("int").alias("query_blocks"))
    blocks = ws.table(held.join(asking, part))
    own = lambda n: F.pmod(F.xxhash64("n"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = index.join(blocks, part).select("n", *part, own("row_blocks").alias("r"), every("query_blocks").alias("q"))
    questions = asked.join(blocks, part).select("n", *part, own("query_blocks").alias("q"), every("row_blocks").alias("r"))
    cell = [*part, "q", "r"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Each side reads the vectors under names of its own, so that the plan can tell the two apart.
    vectors = lambda: valid.select(*[F.col(c).alias(c) for c in ("n", "id", "v")])
    left, right = (x.join(vectors(), "n").repartition(partitions, *cell) for x in (questions, cells))
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_ranker(o.k), "q long, query_id long, vec_id long, n long, score double")
    found = ws.table(found)
    # The k best of each query are kept before and after the shuffle (a window group limit).
    order = W.partitionBy("q").orderBy("score", "vec_id", "n")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= o.k).select("query_id", "rank", "vec_id", "score")
    return ws.finish(out)
