"""Order of batches: workers, rounds, shuffles, shifts, and unions of loaders.  All are arithmetic on ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ranges import ordinal


def worker_counts(n: int, workers: int, batch_size: int) -> list[int]:
    """Elements that each worker gets when element i goes to worker floor(i / batch_size) mod workers."""
    full, rest = divmod(n, batch_size * workers)
    return [full * batch_size + min(max(rest - t * batch_size, 0), batch_size) for t in range(workers)]


def number_of_batches(n: int, splits: int, batch_size: int) -> int:
    return -(-n * splits // batch_size)


def assign_batches(df: DataFrame, n: int, batch_size: int, workers: int = 1, splits: int = 1, ordinal: str = "ord", split_idx: str | None = None) -> DataFrame:
    """Adds ``batch_id`` and ``pos_in_batch``.

    Elements are dealt to workers batch by batch; each worker cuts its elements' splits into
    batches, and rounds take one batch from every worker that has one left.  So with several
    workers and splits a short batch may come before the end.
    """
    g = F.col(ordinal)
    w = F.col(split_idx) if split_idx else F.lit(0)
    turn = F.floor(g / batch_size)
    worker = (turn % workers).cast("int")
    place = (F.floor(turn / workers) * batch_size + g % batch_size) * splits + w
    rounds = F.floor(place / batch_size)
    counts = [-(-c * splits // batch_size) for c in worker_counts(n, workers, batch_size)]
    before = F.lit(0)
    for t, c in enumerate(counts):
        before = before + F.least(rounds, F.lit(c)) + F.when((F.lit(t) < worker) & (F.lit(c) > rounds), 1).otherwise(0)
    return df.withColumn("batch_id", before.cast("long")).withColumn("pos_in_batch", (place % batch_size).cast("int"))


def rebatch(df: DataFrame, batch_size: int, row_idx: str = "row_idx") -> DataFrame:
    """Consecutive rows in batches; the last may be short."""
    return df.withColumn("batch_id", F.floor(F.col(row_idx) / batch_size).cast("long")).withColumn("pos_in_batch", (F.col(row_idx) % batch_size).cast("int"))


#: Bits of a random draw: 13 hexadecimal digits of an MD5, which SQL engines agree on.
DRAW_BITS = 52


def draw(key: Column, seed: int, epoch: int = 0) -> Column:
    """A whole number below 2^52 for each key, fixed by key, seed and epoch and unrelated between any two of them."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}:{epoch}"))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int = 0, name: str = "ord") -> DataFrame:
    """Consecutive numbers from 0 in a random order of the rows, another for each seed and epoch."""
    drawn = rows.withColumn("_draw", draw(F.col(key), seed, epoch))
    return ordinal(drawn, "_draw", name, width=1 << 42, then=[key]).drop("_draw")


def random_shift(key: Column, width: int, resolution: int, seed: int, epoch: int = 0) -> Column:
    """A shift in [-width, width], cut towards 0 to a multiple of the resolution."""
    u = draw(key, seed, epoch) % (2 * width + 1) - width
    return (F.signum(u) * F.floor(F.abs(u) / resolution) * resolution).cast("int")


def interleave(parts: Sequence[DataFrame], batch_id: str = "batch_id") -> DataFrame:
    """Batches of several loaders in turn, those at their end left out; ``loader`` is the place in the list.

    The order is (batch_id, loader): with one batch of each at a time that is the same
    as going round and dropping loaders that have ended.
    """
    if not parts:
        raise ValueError("no loader")
    out = parts[0].withColumn("loader", F.lit(0))
    for i, more in enumerate(parts[1:], 1):
        out = out.unionByName(more.withColumn("loader", F.lit(i)), allowMissingColumns=True)
    return out
