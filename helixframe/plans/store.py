"""Building and reading a dataset of windows: sequences and binned values of many tracks.

A store is a folder of Parquet tables:

    meta       one row: window, resolution, padding
    segments   seg_idx, chrom, start, end
    tracks     track_idx, track
    seq        seg_idx, seq (the padded window)
    values     seg_idx, values (bf16 in FLOAT), by track_idx as directories
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import arrays
from helixframe.operators import ranges, signal
from helixframe.operators.batching import random_shift
from helixframe.sources import fasta
from helixframe.sources.files import exists as _exists
from helixframe.sources.files import remove


class DatasetBuilder:
    """Tile a genome (or take a list of regions), then add tracks, then ``finish``."""

    def __init__(self, spark: SparkSession, location: str, genome_fasta: str, window_size: int, *, segments: list[str] | None = None, step_size: int | None = None, resolution: int = 32, padding: int = 0, chroms: list[str] | None = None):
        if window_size <= 0 or resolution <= 0 or window_size % resolution:
            raise ValueError("window_size must be a multiple of resolution")
        if padding < 0 or padding % resolution:
            raise ValueError("padding must be a multiple of resolution")
        if _exists(spark, location):
            raise FileExistsError(location)
        self.spark, self.location = spark, location
        self.window_size, self.resolution, self.padding = window_size, resolution, padding
        chunks, self.sizes = fasta.read_fasta(spark, genome_fasta), fasta.sizes(spark, genome_fasta)
        if chroms is not None:
            chunks, self.sizes = (x.where(F.col("chrom").isin(chroms)) for x in (chunks, self.sizes))
        if segments is not None:
            wanted = ranges.first_seen(ranges.expand(ranges.regions(spark, segments), self.sizes, window_size))
            plan = ranges.ordinal(wanted, "ord", "seg_idx")
        else:
            plan = self._numbered(ranges.tile(self.sizes, window_size, step_size), step_size or window_size)
        plan = plan.select(F.col("seg_idx").cast("long").alias("seg_idx"), "chrom", "start", "end")
        plan.write.parquet(f"{location}/segments")
        self._segments = spark.read.parquet(f"{location}/segments")
        fasta.cut_windows(self._segments, chunks, window_size, padding).sortWithinPartitions("seg_idx").write.option("compression", "zstd").parquet(f"{location}/seq")
        self._tracks: list[str] = []
        self._done = False

    def _numbered(self, tiles: DataFrame, step: int) -> DataFrame:
        """Numbers of tiles by arithmetic: those of earlier chromosomes (by name) come first."""
        from pyspark.sql import Window as W

        per = self.sizes.select("chrom", F.ceil(F.col("size") / step).cast("long").alias("n"))
        base = per.select("chrom", (F.sum("n").over(W.orderBy("chrom")) - F.col("n")).alias("base"))  # one row a chromosome
        return tiles.join(base, "chrom").withColumn("seg_idx", F.col("base") + F.floor(F.col("start") / step))

    def _open(self) -> None:
        if self._done:
            raise RuntimeError("the dataset is finished")

    def tracks(self) -> list[str]:
        self._open()
        return list(self._tracks)

    def segments(self) -> list[str]:
        self._open()
        return [r[0] for r in self._segments.orderBy("seg_idx").select(ranges.format_region()).collect()]

    def add_runs(self, key: str, runs: DataFrame) -> None:
        """Add one track of runs (chrom, start, end, value); a track that lacks a chromosome of the windows is an error."""
        self._open()
        if key in self._tracks:
            raise ValueError(f"track {key} is there already")
        idx = len(self._tracks)
        made = f"{self.location}/_runs/track_idx={idx}"  # runs may cost much, and are read for the check and for the values
        try:
            runs.select("chrom", "start", "end", "value").write.mode("overwrite").option("compression", "zstd").parquet(made)
            self._add_values(key, idx, self.spark.read.parquet(made))
        finally:
            remove(self.spark, made)
        self._tracks.append(key)

    def _add_values(self, key: str, idx: int, runs: DataFrame) -> None:
        lacking = self._segments.select("chrom").distinct().join(runs.select("chrom").distinct(), "chrom", "left_anti").limit(1).collect()
        if lacking:
            raise ValueError(f"track {key} lacks {lacking[0][0]}")
        length = (self.window_size + 2 * self.padding) // self.resolution
        binned = signal.bin_sums(self._segments, runs.withColumn("track_idx", F.lit(idx)), self.window_size, self.padding, self.resolution, by=["track_idx"])
        keys = self.spark.range(1).select(F.lit(idx).alias("track_idx"))
        signal.dense(binned, self._segments, keys, length).select("seg_idx", "values").sortWithinPartitions("seg_idx").write.option("compression", "zstd").parquet(f"{self.location}/values/track_idx={idx}")

    def add_file(self, key: str, path: str) -> None:
        """Add a track from a signal store (its first track), a BigWig file, or Parquet runs."""
        from helixframe.sources.bigwig import read_bigwig

        if path.lower().endswith((".h5", ".hdf5", ".w5z")):
            raise NotImplementedError(f"HDF5 needs a library that is not there; convert {path} to a signal store first")
        if path.lower().endswith((".bw", ".bigwig")):
            runs = read_bigwig(self.spark, path)
        elif _exists(self.spark, f"{path}/runs"):
            from helixframe.sources.signal_store import SignalStore

            store = SignalStore(self.spark, path)
            runs = store.runs().where(F.col("track") == store.tracks()[0])
        else:
            runs = self.spark.read.parquet(path)
        self.add_runs(key, runs)

    def add_files(self, files: dict[str, str]) -> None:
        for key, path in files.items():
            self.add_file(key, path)

    def finish(self) -> None:
        """Write the metadata last: a store without it is not complete."""
        self._open()
        if self._segments.limit(1).count() == 0:
            raise ValueError("no segments")
        self.spark.createDataFrame(list(enumerate(self._tracks)), "track_idx int, track string").write.parquet(f"{self.location}/tracks")
        self.spark.createDataFrame([(self.window_size, self.resolution, self.padding)], "window int, resolution int, padding int").coalesce(1).write.parquet(f"{self.location}/meta")
        self._done = True


@dataclass(frozen=True)
class ReadOptions:
    """How windows are read; lengths are in base pairs."""

    random_shift: int = 0
    resolution: int | None = None
    target_length: int | None = None
    window_size: int | None = None
    scale: float | None = None
    clamp_max: float | None = None
    random_seed: int = 2025


class Store:
    """An opened dataset; ``read`` gives its windows as a DataFrame."""

    def __init__(self, spark: SparkSession, location: str, options: ReadOptions | None = None):
        self.spark, self.location, self.options = spark, location, options or ReadOptions()
        meta = spark.read.parquet(f"{location}/meta").first()
        self.window, self.base_resolution, self.padding = meta["window"], meta["resolution"], meta["padding"]
        self.track_names = [r["track"] for r in spark.read.parquet(f"{location}/tracks").orderBy("track_idx").collect()]
        self._check()

    def _check(self) -> None:
        o = self.options
        if o.random_shift > self.padding:
            raise ValueError("random_shift exceeds the padding")
        if self.resolution % self.base_resolution:
            raise ValueError("resolution must be a multiple of the stored one")
        if self.window % self.resolution:
            raise ValueError("the stored window must be a multiple of resolution")
        if o.window_size is not None and (o.window_size <= 0 or o.window_size % self.resolution or self.window % o.window_size):
            raise ValueError("window_size must be a multiple of resolution and divide the stored window")
        if o.target_length is not None and (o.target_length <= 0 or o.target_length % self.resolution or o.target_length > self.split_size):
            raise ValueError("target_length must be a multiple of resolution and at most the window")

    def with_options(self, **changes) -> Store:
        out = object.__new__(Store)
        out.__dict__.update(self.__dict__)
        out.options = replace(self.options, **changes)
        out._check()
        return out

    @property
    def resolution(self) -> int:
        return self.options.resolution or self.base_resolution

    @property
    def split_size(self) -> int:
        return self.options.window_size or self.window

    @property
    def target_length(self) -> int:
        return self.options.target_length or self.split_size

    @property
    def splits(self) -> int:
        return self.window // self.split_size

    def segments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.location}/segments")

    def _shift(self, epoch: int) -> Column:
        o = self.options
        return random_shift(F.col("seg_idx"), o.random_shift, self.base_resolution, o.random_seed, epoch) if o.random_shift else F.lit(0)

    def sequences(self, segments: DataFrame, epoch: int = 0) -> DataFrame:
        """(seg_idx, split_idx, seq) of the unpadded, shifted windows, whole whatever the target length."""
        seq = self.spark.read.parquet(f"{self.location}/seq").join(segments.select("seg_idx"), "seg_idx", "left_semi")
        body = seq.select("seg_idx", F.substring(F.col("seq"), (F.lit(self.padding) + self._shift(epoch) + 1).cast("int"), F.lit(self.window)).alias("seq"))
        pieces = F.array(*[F.substring("seq", i * self.split_size + 1, self.split_size) for i in range(self.splits)])
        return body.select("seg_idx", F.posexplode(pieces).alias("split_idx", "seq"))

    def values(self, segments: DataFrame, tracks: list[int] | None = None, epoch: int = 0) -> DataFrame:
        """(seg_idx, split_idx, track_idx, values): shift, then bins, splits, trim, and last NaN, scale and clamp."""
        if not self.track_names:
            return self.spark.createDataFrame([], "seg_idx long, split_idx int, track_idx int, values array<float>")
        rows = self.spark.read.parquet(f"{self.location}/values")
        if tracks is not None:
            rows = rows.where(F.col("track_idx").isin(tracks))
        rows = rows.join(segments.select("seg_idx"), "seg_idx", "left_semi")
        o, res = self.options, self.resolution
        window = arrays.read_window("values", self.window, self.padding, self.base_resolution, res, self._shift(epoch))
        pieces = rows.select("seg_idx", "track_idx", F.posexplode(arrays.split(window, self.split_size // res)).alias("split_idx", "v"))
        trimmed = arrays.trim("v", self.target_length // res, self.split_size // res)
        return pieces.select("seg_idx", "split_idx", "track_idx", arrays.transform_values(trimmed, o.scale, o.clamp_max).alias("values"))

    def read(self, segments: DataFrame | None = None, tracks: list[int] | None = None, epoch: int = 0) -> DataFrame:
        """(seg_idx, split_idx, seq, values): one array a track, in the order of track_idx."""
        segments = self.segments() if segments is None else segments
        stacked = self.values(segments, tracks, epoch).groupBy("seg_idx", "split_idx").agg(arrays.stack_tracks("track_idx", "values").alias("values"))
        return self.sequences(segments, epoch).join(stacked, ["seg_idx", "split_idx"], "left")

    def point(self, where: str | int, tracks: str | int | list) -> DataFrame:
        """(seg_idx, split_idx, seq, values) of one window, by region or number; an array a track, as asked for.

        Tracks are named or numbered, one or a list, in any order and as often as wanted.
        A window that the store does not hold gives no row.
        """
        wanted = [tracks] if isinstance(tracks, (str, int)) else list(tracks)
        idx = [self.track_names.index(t) if isinstance(t, str) else int(t) for t in wanted]
        if isinstance(where, str):
            segments = ranges.intersection(self.segments(), ranges.regions(self.spark, [where]))
        else:
            segments = self.segments().where(F.col("seg_idx") == int(where))
        place = {t: i for i, t in enumerate(sorted(set(idx)))}
        picked = F.array(*[F.get("values", F.lit(place[t])) for t in idx])
        return self.read(segments, list(place)).withColumn("values", picked)

    def counts(self, segments: DataFrame | None = None) -> DataFrame:
        """(track_idx, track, segments): how many windows each track has values for."""
        segments = self.segments() if segments is None else segments
        rows = self.spark.read.parquet(f"{self.location}/values").select("seg_idx", "track_idx").join(segments.select("seg_idx"), "seg_idx", "left_semi")
        names = self.spark.read.parquet(f"{self.location}/tracks")
        return names.join(rows.groupBy("track_idx").agg(F.count("*").alias("segments")), "track_idx", "left")
