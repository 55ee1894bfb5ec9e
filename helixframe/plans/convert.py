"""One call from a file to another: alignments to coverage, coverage to a signal store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import coverage
from helixframe.sources import bam, bigwig
from helixframe.sources.signal_store import SignalStore, import_runs


def bam_coverage(spark: SparkSession, path: str, method: str | None = "CPM", bin_size: int = 1, stranded: bool = False, one_based_compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """Runs of normalised coverage by the 5' bases of a BAM file's usable reads (with ``strand`` if stranded), and the chromosomes' sizes."""
    sizes = bam.bam_sizes(spark, path)
    cuts = coverage.insertions(bam.read_bam(spark, path), one_based_compat)
    return coverage.coverage(cuts, sizes, bin_size, method, ["strand"] if stranded else None), sizes


def bam_cov(spark: SparkSession, input: str, output: str, *, output2: str | None = None, stranded: bool = False) -> dict[str, int]:  # noqa: A002
    """Write the CPM coverage of a BAM file as BigWig and return the counts of its records.

    With ``stranded``, reads forward go to ``output`` and reverse ones to ``output2``, each strand
    normalised by itself; a missing ``output2`` is an error.
    """
    if stranded and output2 is None:
        raise ValueError("output2 is needed when stranded")
    runs, sizes = bam_coverage(spark, input, stranded=stranded)
    if stranded:
        for strand, target in (("+", output), ("-", output2)):
            bigwig.write_bigwig(runs.where(F.col("strand") == strand), sizes, target)
    else:
        bigwig.write_bigwig(runs, sizes, output)
    return coverage.read_stats(bam.read_bam(spark, input)).first().asDict()


def bw_to_store(spark: SparkSession, input: str, output: str, *, track: str = "signal", codec: str | None = None, tolerance: float = 0.0, norm_factor: float | None = None, spool: str | None = None) -> SignalStore:  # noqa: A002
    """A new signal store of one track from a BigWig file or URL, with its statistics over all base pairs.

    NaN and infinite values become 0; ``norm_factor`` scales the track to that total; ``codec`` None
    tries several and keeps the smallest.
    """
    store = SignalStore(spark, output, "w")
    runs = bigwig.read_bigwig(spark, input, spool)
    sizes = bigwig.bigwig_sizes(spark, spool if bigwig.is_url(input) else input)
    length = sizes.agg(F.sum("size")).first()[0] or 0
    import_runs(runs, store, track, norm_factor, tolerance, codec, length)
    return store
