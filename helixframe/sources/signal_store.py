"""A store of whole-genome signals in Parquet: runs by track and chromosome, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.signal import clean_import, normalise_total, track_stats, verify_sum
from helixframe.sources.files import exists, remove, stored_bytes

#: What is tried where the choice is left to the store.
CODECS = ("zstd", "gzip")


class SignalStore:
    """``SignalStore(spark, path, mode)``: mode "w" makes a new store and refuses an existing one, "r" opens one."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r"):
        if mode not in ("r", "w"):
            raise ValueError("mode must be r or w")
        self.spark, self.path, self.mode = spark, path, mode
        self.codec: str | None = None
        there = exists(spark, path)
        if mode == "w" and there:
            raise FileExistsError(path)
        if mode == "r" and not there:
            raise FileNotFoundError(path)

    def add(self, runs: DataFrame, tolerance: float = 0.0, codec: str | None = "zstd") -> None:
        """Append runs (track, chrom, start, end, value); values are kept, or rounded to steps of twice ``tolerance``.

        ``codec`` is one of Parquet's.  None tries those of ``CODECS`` on the first chromosome (by name)
        that is added, keeps the smaller, the first of equal ones, and stays with it.
        """
        if self.mode != "w":
            raise PermissionError("opened for reading")
        if tolerance > 0:
            runs = runs.withColumn("value", (F.round(F.col("value").cast("double") / (2 * tolerance)) * (2 * tolerance)).cast("float"))
        rows = runs.select("track", "chrom", "start", "end", F.col("value").cast("float").alias("value"))
        rows = rows.repartition("track", "chrom").sortWithinPartitions("track", "chrom", "start")
        if codec is None:
            codec = self.codec = self.codec or self._smallest(rows)
        rows.write.mode("append").option("compression", codec).partitionBy("track", "chrom").parquet(f"{self.path}/runs")

    def _smallest(self, rows: DataFrame) -> str:
        first = rows.agg(F.min("chrom")).first()[0]
        if first is None:
            return CODECS[0]
        sizes = {}
        for codec in CODECS:
            trial = f"{self.path}/_trial_{codec}"
            rows.where(F.col("chrom") == first).select("start", "end", "value").write.option("compression", codec).parquet(trial)
            sizes[codec] = stored_bytes(self.spark, trial)
            remove(self.spark, trial)
        return min(CODECS, key=sizes.get)

    def compression_ratio(self, sizes: DataFrame | None = None) -> float | None:
        """Stored bytes over four bytes a base pair of (chrom, size), or of what lies before the last run; null if there is none."""
        if sizes is None:
            sizes = self.runs().groupBy("track", "chrom").agg(F.max("end").alias("size"))
        else:
            sizes = sizes.crossJoin(self.runs().select("track").distinct())
        bases = sizes.agg(F.sum("size")).first()[0]
        return stored_bytes(self.spark, f"{self.path}/runs") / (4 * bases) if bases else None

    def runs(self) -> DataFrame:
        """Directory pruning picks tracks and chromosomes."""
        return self.spark.read.schema("start long, end long, value float, track string, chrom string").parquet(f"{self.path}/runs").select("track", "chrom", "start", "end", "value")

    def get(self, chrom: str, track: str | None = None) -> DataFrame:
        rows = self.runs().where(F.col("chrom") == chrom)
        return rows if track is None else rows.where(F.col("track") == track)

    def keys(self) -> list[str]:
        return sorted(r[0] for r in self.runs().select("chrom").distinct().collect())

    def tracks(self) -> list[str]:
        return sorted(r[0] for r in self.runs().select("track").distinct().collect())

    def __contains__(self, chrom: str) -> bool:
        return self.get(chrom).limit(1).count() > 0

    def compute_stat(self, length: int | None = None) -> DataFrame:
        """Statistics of each track over its runs, or over ``length`` base pairs, where no run is 0."""
        return track_stats(self.runs(), length=length)

    def update_stat(self, length: int | None = None) -> None:
        self.compute_stat(length).write.mode("overwrite").parquet(f"{self.path}/stats")

    def attrs(self) -> DataFrame:
        """The statistics as last written: one row a track."""
        return self.spark.read.parquet(f"{self.path}/stats")

    def attr(self, name: str, track: str) -> float:
        return self.attrs().where(F.col("track") == track).select(name).first()[0]

    def list_attrs(self) -> list[str]:
        return [c for c in self.attrs().columns if c != "track"]

    def verify(self) -> DataFrame:
        """Relative difference of each track's sum to the one written."""
        return verify_sum(self.compute_stat(), self.attrs())

    def __repr__(self) -> str:
        return f"SignalStore({self.path}, chromosomes: {', '.join(self.keys())})"


def import_runs(runs: DataFrame, store: SignalStore, track: str, norm_factor: float | None = None, tolerance: float = 0.0, codec: str | None = "zstd", length: int | None = None) -> None:
    """Clean runs of one track, normalise them to a total if asked, and add them with their statistics."""
    rows = clean_import(runs).withColumn("track", F.lit(track))
    if norm_factor is not None:
        rows = normalise_total(rows, norm_factor)
    store.add(rows, tolerance, codec)
    store.update_stat(length)
