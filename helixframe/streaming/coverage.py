"""Coverage events from a stream of fragments: counts by chromosome, bin and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_counts(fragments: DataFrame, bin_size: int, time: str = "ts", window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window, chrom, bin, fragments): each fragment counts in the bin of its middle; late rows beyond ``lateness`` are dropped."""
    middle = F.floor((F.col("start") + F.col("end")) / 2 / bin_size).cast("long")
    return fragments.withWatermark(time, lateness).groupBy(F.window(time, window), "chrom", middle.alias("bin")).agg(F.count("*").alias("fragments"))
