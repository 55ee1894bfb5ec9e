"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.workspace import Workspace


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, ws: Workspace, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node it reaches.

    Each round first points every larger neighbour at the smallest node around
    (large star), then every node at its smallest smaller neighbour (small
    star).  The number of rounds grows with the logarithm of the largest
    component, and the links never leave the executors: the driver sees a count
    and a checksum a round.  Minima are aggregated map-side and written before
    they are joined, so a node with very many links only widens a join, which
    adaptive execution splits.  Nulls link nothing; self links and repeats
    have no effect; an empty table gives an empty one.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")  # drops nulls too
    edges, path = ws.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = _stamp(edges)
    for _ in range(max_rounds):
        if not stamp[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = ws.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large, large_path = ws.write(large)
        small, small_path = ws.write(large.groupBy("a").agg(F.min("b").alias("m")))
        star = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        old, (edges, path) = path, ws.write(star)
        for gone in (old, least_path, large_path, small_path):
            ws.remove(gone)
        last, stamp = stamp, _stamp(edges)
        if last == stamp:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
