"""Loaders: batches of windows from one store, from several that share windows, or from several in turn."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import nucleotide
from helixframe.operators import batching, ranges, signal
from helixframe.plans.store import ReadOptions, Store


def _codes(seqs: Sequence[str]) -> np.ndarray:
    table = np.full(256, 4, np.uint8)
    for i, letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
        table[[ord(x) for x in letters]] = i
    return table[np.array([np.frombuffer(s.encode(), np.uint8) for s in seqs])]


class Loader:
    """Batches of (sequences, values of shape rows x bins x tracks), in a fixed order for each epoch.

    ``for`` over a loader with ``shuffle`` goes on to the next epoch each time; ``epoch(n)`` gives
    a chosen one.  A copy goes on from where its original stands.
    """

    def __init__(self, spark: SparkSession, location: str, *, batch_size: int = 8, resolution: int | None = None, target_length: int | None = None, scale: float | None = None, clamp_max: float | None = None, window_size: int | None = None, shuffle: bool = False, random_shift: int = 0, seq_as_string: bool = False, n_jobs: int = 1, random_seed: int = 2025):
        self.spark = spark
        self.store = Store(spark, location, ReadOptions(random_shift, resolution, target_length, window_size, scale, clamp_max, random_seed))
        self.batch_size, self.shuffle, self.seq_as_string, self.n_jobs, self.seed = batch_size, shuffle, seq_as_string, n_jobs, random_seed
        self.subset: DataFrame | None = None
        self.next_epoch = 0

    def copy(self) -> Loader:
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        return out

    def _with(self, **changes) -> Loader:
        out = self.copy()
        out.__dict__.update(changes)
        return out

    @property
    def tracks(self) -> list[str]:
        return list(self.store.track_names)

    def segment_rows(self) -> DataFrame:
        return self.store.segments() if self.subset is None else self.subset

    @property
    def segments(self) -> list[str]:
        return [r[0] for r in self.segment_rows().orderBy("seg_idx").select(ranges.format_region()).collect()]

    @property
    def window_size(self) -> int:
        return self.store.split_size

    @property
    def target_length(self) -> int:
        return self.store.target_length

    @property
    def resolution(self) -> int:
        return self.store.resolution

    @property
    def data(self) -> Indexer:
        return Indexer(self)

    def intersection(self, regions: Iterable[str] | DataFrame, how: str = "exact") -> Loader:
        """Only the windows that are (or, with ``how="overlap"``, overlap) one of the regions."""
        return self._with(subset=ranges.intersection(self.segment_rows(), self._regions(regions), how))

    def difference(self, regions: Iterable[str] | DataFrame, how: str = "exact") -> Loader:
        return self._with(subset=ranges.difference(self.segment_rows(), self._regions(regions), how))

    def _regions(self, regions: Iterable[str] | DataFrame) -> DataFrame:
        return regions if isinstance(regions, DataFrame) else ranges.regions(self.spark, list(regions))

    def order(self, epoch: int = 0) -> DataFrame:
        """(seg_idx, ord): the place of each window in the epoch."""
        rows = self.segment_rows().select("seg_idx")
        if not self.shuffle:
            return ranges.ordinal(rows, "seg_idx")
        return batching.shuffled(rows, "seg_idx", self.seed, epoch)

    def batches(self, epoch: int = 0, tracks: list[int] | None = None) -> DataFrame:
        """(batch_id, pos_in_batch, seg_idx, split_idx, seq, values), in no particular row order."""
        order = self.order(epoch)
        rows = self.store.read(self.segment_rows(), tracks, epoch).join(order, "seg_idx")
        return batching.assign_batches(rows, self.num_segments(), self.batch_size, self.n_jobs, self.store.splits, "ord", "split_idx").drop("ord")

    def num_segments(self) -> int:
        return self.segment_rows().count()

    def __len__(self) -> int:
        return batching.number_of_batches(self.num_segments(), self.store.splits, self.batch_size)

    def epoch(self, epoch: int = 0) -> Iterator[tuple]:
        for rows in _in_batches(self.batches(epoch)):
            yield self._seqs(rows), _cube([r["values"] for r in rows])

    def _seqs(self, rows) -> list[str] | np.ndarray:
        seqs = [r["seq"].upper() for r in rows]
        return seqs if self.seq_as_string else _codes(seqs)

    def advance(self) -> int:
        """The epoch of the iteration that begins now: with ``shuffle`` each has a new one, without it all are alike."""
        now = self.next_epoch
        self.next_epoch += int(self.shuffle)
        return now

    def __iter__(self) -> Iterator[tuple]:
        return self.epoch(self.advance())

    def hist(self, bins: int = 10_000, limit: int = 100, min: float | None = None, log: bool = False, savefig: str | None = None) -> DataFrame:  # noqa: A002
        """Histogram of the values of the first ``limit`` batches."""
        rows = self.batches().where(F.col("batch_id") < limit).select(F.explode(F.flatten("values")).alias("value"))
        out = signal.histogram(rows, bins, min, log)
        if savefig:
            pdf = out.orderBy("bin").toPandas()
            _plot(lambda ax: ax.plot((pdf.bin_start + pdf.bin_end) / 2, pdf["count"]), savefig)
        return out

    def plot(self, region: str, tracks: str | list[str], savefig: str | None = None) -> dict[str, np.ndarray]:
        """Values of one region by track, drawn if ``savefig`` is given."""
        names = [tracks] if isinstance(tracks, str) else list(tracks)
        _, values = self.data[region, names]
        out = {n: values[:, :, i].ravel() for i, n in enumerate(names)}
        if savefig:
            _plot(lambda ax: [ax.fill_between(range(len(v)), v, label=n) for n, v in out.items()], savefig)
        return out

    def __repr__(self) -> str:
        return f"Loader({self.num_segments()} segments x {len(self.tracks)} tracks, window {self.window_size}, resolution {self.resolution}, batch {self.batch_size}, target {self.target_length}, padding {self.store.padding})"


def _plot(draw, path: str) -> None:
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots()
    draw(axes)
    figure.savefig(path)


def _in_batches(df: DataFrame) -> Iterator[list]:
    """Rows batch by batch, streamed from the executors in order."""
    held, last = [], None
    for row in df.orderBy("batch_id", "pos_in_batch").toLocalIterator(prefetchPartitions=True):
        if last is not None and row["batch_id"] != last:
            yield held
            held = []
        last = row["batch_id"]
        held.append(row)
    if held:
        yield held


def _cube(values: list) -> np.ndarray:
    return np.array(values, np.float32).transpose(0, 2, 1) if values and values[0] is not None else np.zeros((len(values), 0, 0), np.float32)


class Indexer:
    """``loader.data[region or ordinal, track(s)]``: (sequences, values); tracks by name or number, one or a list."""

    def __init__(self, loader: Loader):
        self.loader = loader

    def __getitem__(self, key: tuple) -> tuple[list[str], np.ndarray]:
        where, tracks = key
        rows = self.loader.store.point(where, tracks).orderBy("split_idx").collect()
        if not rows:
            raise KeyError(where)
        return [r["seq"].upper() for r in rows], _cube([r["values"] for r in rows])


class LoaderMap:
    """Loaders of the same windows side by side: batches of (sequences, {name: values})."""

    def __init__(self, loaders: dict[str, Loader], *, batch_size: int | None = None, target_length: int | None = None, window_size: int | None = None, seq_as_string: bool = False):
        if not loaders:
            raise ValueError("no loader")
        self.loaders = {}
        changes = {k: v for k, v in (("window_size", window_size), ("target_length", target_length)) if v is not None}
        for name, loader in loaders.items():
            self.loaders[name] = loader._with(store=loader.store.with_options(**changes) if changes else loader.store, seq_as_string=seq_as_string)
        first = next(iter(self.loaders.values()))
        self.batch_size = batch_size or min(x.batch_size for x in self.loaders.values())
        for loader in self.loaders.values():
            if loader.window_size != first.window_size:
                raise ValueError("window sizes differ")
            a, b = (x.segment_rows().select("seg_idx", *ranges.KEY) for x in (first, loader))
            if loader is not first and (a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count()):
                raise ValueError("segments differ")

    def keys(self) -> list[str]:
        return list(self.loaders)

    @property
    def n_tracks(self) -> dict[str, int]:
        return {k: len(v.tracks) for k, v in self.loaders.items()}

    @property
    def segments(self) -> list[str]:
        return next(iter(self.loaders.values())).segments

    def _each(self, change) -> LoaderMap:
        out = object.__new__(LoaderMap)
        out.loaders, out.batch_size = {k: change(v) for k, v in self.loaders.items()}, self.batch_size
        return out

    def intersection(self, regions: Iterable[str], how: str = "exact") -> LoaderMap:
        return self._each(lambda x: x.intersection(regions, how))

    def difference(self, regions: Iterable[str], how: str = "exact") -> LoaderMap:
        return self._each(lambda x: x.difference(regions, how))

    def batches(self, epoch: int = 0) -> DataFrame:
        """(batch_id, pos_in_batch, seg_idx, split_idx, seq, values_<name>...), joined on the window."""
        first, *rest = self.loaders.items()
        out = first[1]._with(batch_size=self.batch_size).batches(epoch).withColumnRenamed("values", f"values_{first[0]}")
        for name, loader in rest:
            side = loader.store.read(loader.segment_rows(), None, epoch).select("seg_idx", "split_idx", F.col("seq").alias("_seq"), F.col("values").alias(f"values_{name}"))
            out = out.join(side, ["seg_idx", "split_idx"])
            same = F.upper("seq") == F.upper("_seq")
            out = out.withColumn("seq", F.when(same, F.col("seq")).otherwise(F.raise_error(F.lit("sequences differ")).cast("string"))).drop("_seq")
        return out

    def __len__(self) -> int:
        return len(next(iter(self.loaders.values()))._with(batch_size=self.batch_size))

    def epoch(self, epoch: int = 0) -> Iterator[tuple]:
        first = next(iter(self.loaders.values()))
        for rows in _in_batches(self.batches(epoch)):
            yield first._seqs(rows), {k: _cube([r[f"values_{k}"] for r in rows]) for k in self.loaders}

    def advance(self) -> int:
        """The epoch of the first loader, which orders all; the others go along."""
        return [loader.advance() for loader in self.loaders.values()][0]

    def __iter__(self) -> Iterator[tuple]:
        return self.epoch(self.advance())

    def __repr__(self) -> str:
        return f"LoaderMap({', '.join(self.loaders)}; batch {self.batch_size})"


class CatLoader:
    """LoaderMaps in turn, one batch of each, until all have ended."""

    def __init__(self, maps: Sequence[LoaderMap], *, batch_size: int | None = None, shuffle: bool | None = None):
        if not maps:
            raise ValueError("no loader")
        self.maps = []
        for m in maps:
            changes = {"shuffle": shuffle} if shuffle is not None else {}
            out = m._each(lambda x, c=changes: x._with(**c))
            out.batch_size = batch_size or m.batch_size
            self.maps.append(out)

    @property
    def n_tracks(self) -> dict[str, int]:
        return {k: v for m in self.maps for k, v in m.n_tracks.items()}

    def __len__(self) -> int:
        return sum(len(m) for m in self.maps)

    def batches(self, epoch: int = 0) -> DataFrame:
        return batching.interleave([m.batches(epoch) for m in self.maps])

    def epoch(self, epoch: int = 0) -> Iterator[tuple]:
        return self._in_turn([m.epoch(epoch) for m in self.maps])

    def __iter__(self) -> Iterator[tuple]:
        return self._in_turn([iter(m) for m in self.maps])

    def _in_turn(self, turns: list[Iterator[tuple]]) -> Iterator[tuple]:
        while turns:
            for turn in list(turns):
                try:
                    yield next(turn)
                except StopIteration:
                    turns.remove(turn)

    def __repr__(self) -> str:
        return f"CatLoader({'; '.join(map(repr, self.maps))})"


def _array_rows(at: int, x: np.ndarray, y: np.ndarray) -> pa.Table:
    """Rows of one piece as a table, made from the arrays' own buffers."""

    def lists(rows: np.ndarray, kind) -> pa.Array:
        flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel(), kind))

    columns = {"row_idx": pa.array(np.arange(at, at + len(x))), "input": lists(x, pa.float32()), "target": lists(y, pa.float32())}
    for name, part in (("input_shape", x), ("target_shape", y)):
        columns[name] = lists(np.tile(np.array(part.shape[1:], np.int32), (len(part), 1)).reshape(len(part), part.ndim - 1), pa.int32())
    return pa.table(columns)


class ArrayLoader:
    """A cache of (input, target) arrays of any shape, read back in batches along the first axis."""

    def __init__(self, spark: SparkSession, data: Iterable[tuple[np.ndarray, np.ndarray]], location: str, batch_size: int = 32):
        part, first, at = 0, None, 0
        for x, y in data:
            x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
            if len(x) != len(y):
                raise ValueError("input and target have different lengths")
            shapes = x.shape[1:], y.shape[1:]
            if first is not None and shapes != first:
                raise ValueError("row shapes differ")
            first = shapes
            spark.createDataFrame(_array_rows(at, x, y)).coalesce(1).write.mode("errorifexists" if part == 0 else "append").option("compression", "zstd").parquet(location)
            at, part = at + len(x), part + 1
        if first is None:
            raise ValueError("no data")
        self._load(spark, location, batch_size)

    def _load(self, spark: SparkSession, location: str, batch_size: int) -> None:
        self.rows, self.batch_size = spark.read.parquet(location), batch_size

    @classmethod
    def open(cls, spark: SparkSession, location: str, batch_size: int = 32) -> ArrayLoader:
        out = object.__new__(cls)
        out._load(spark, location, batch_size)
        return out

    def batches(self) -> DataFrame:
        return batching.rebatch(self.rows, self.batch_size)

    def __len__(self) -> int:
        return -(-self.rows.count() // self.batch_size)

    def __repr__(self) -> str:
        return f"ArrayLoader({self.rows.count()} rows, batch {self.batch_size})"

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in _in_batches(self.batches()):
            yield tuple(np.array([r[k] for r in rows], np.float32).reshape(len(rows), *rows[0][f"{k}_shape"]) for k in ("input", "target"))


def encoded(df: DataFrame, column: str = "seq") -> DataFrame:
    """Sequences as digits of codes."""
    return df.withColumn(column, nucleotide.encode(column))
