"""FASTA as a table of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.sources.files import exists

#: Letters of a chunk.
CHUNK = 65_536


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk_id, seq): sequences cut into chunks; names end at the first white space; ``.gz`` is read as it is.

    Lines are read in splits of the file.  Each split counts its letters under each header; only those
    counts, a row for every header and split, are summed in order, and lines then know their place
    in their sequence.  So no task and no row holds a whole chromosome.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    head = F.col("value").startswith(">")
    part = W.partitionBy("file", "block")
    lines = lines.withColumn("name", F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1))).withColumn("letters", F.when(head, F.lit("")).otherwise(F.regexp_replace("value", r"\s+", "")))
    lines = lines.withColumn("size", F.length("letters").cast("long")).withColumn("record", F.sum(head.cast("long")).over(part.orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    lines = lines.withColumn("at", F.sum("size").over(W.partitionBy("file", "block", "record").orderBy("line").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    pieces = lines.groupBy("file", "block", "record").agg(F.max("name").alias("name"), F.sum("size").alias("size"))
    order = W.partitionBy("file").orderBy("block", "record").rowsBetween(W.unboundedPreceding, 0)
    pieces = pieces.withColumn("chrom", F.last("name", ignorenulls=True).over(order)).withColumn("number", F.count("name").over(order))
    before = F.sum("size").over(W.partitionBy("file", "number").orderBy("block", "record").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    pieces = pieces.where("chrom IS NOT NULL").select("file", "block", "record", "chrom", before.alias("before"))
    placed = lines.join(pieces, ["file", "block", "record"]).select("chrom", "letters", "size", (F.col("before") + F.col("at")).alias("at"), "name")
    # A header stands for an empty piece, so a sequence without letters has a chunk too.
    cut = placed.where("size > 0 OR name IS NOT NULL").select("chrom", "at", F.explode(_cuts("letters", F.col("at"), chunk)).alias("p"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "p.seq")))
    return cut.groupBy("chrom", "p.chunk_id").agg(F.array_join(F.transform(ordered, lambda p: p["seq"]), "").alias("seq"))


def _cuts(seq: str, at: Column, chunk: int) -> Column:
    """The parts of ASCII letters that stand from ``at`` on, by chunk.  As bytes, so that a cut costs what it takes out."""
    last = at + F.greatest(F.length(seq), F.lit(1)) - 1
    ids = F.sequence(F.floor(at / chunk).cast("long"), F.floor(last / chunk).cast("long"))

    def one(raw: Column) -> Column:
        lo = lambda i: F.greatest(i * chunk - at, F.lit(0))
        hi = lambda i: (i + 1) * chunk - at
        return F.transform(ids, lambda i: F.struct(i.alias("chunk_id"), F.substring(raw, (lo(i) + 1).cast("int"), F.least(hi(i) - lo(i), F.lit(chunk)).cast("int")).cast("string").alias("seq")))

    return F.element_at(F.transform(F.array(F.col(seq).cast("binary")), one), 1)


def chunked(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chrom, seq) rows as chunks."""
    return lines.select("chrom", F.explode(_cuts("seq", F.lit(0).cast("long"), chunk)).alias("p")).select("chrom", "p.chunk_id", "p.seq")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size) of a ``.fai`` file."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("chrom string, size long").csv(path)
    return rows.where("chrom IS NOT NULL")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size) from the index beside the file (``<path>.fai``) if there is one, else from the file."""
    if exists(spark, f"{path}.fai"):
        return read_index(spark, f"{path}.fai")
    return read_fasta(spark, path).groupBy("chrom").agg(F.sum(F.length("seq")).alias("size"))


def chrom_sizes(chunks: DataFrame) -> DataFrame:
    """(chrom, size) in the order of names."""
    return chunks.groupBy("chrom").agg(F.sum(F.length("seq")).alias("size")).orderBy("chrom")


def cut_windows(segments: DataFrame, chunks: DataFrame, window: int, padding: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(seg_idx, seq): letters of each padded window, N where the chromosome has none.

    Windows meet the chunks they touch by an equi-join on (chrom, chunk_id).  Chunks go there as
    bytes with their length, so a window does not read its whole chunk.
    """
    total = window + 2 * padding
    w = segments.select("seg_idx", "chrom", (F.col("start") - padding).alias("w"))
    touched = F.sequence(F.floor(F.greatest("w", F.lit(0)) / chunk).cast("long"), F.floor(F.greatest(F.col("w") + (total - 1), F.lit(0)) / chunk).cast("long"))
    raw = F.col("seq").cast("binary")
    met = w.withColumn("chunk_id", F.explode(touched)).join(chunks.select("chrom", "chunk_id", raw.alias("raw"), F.length(raw).alias("letters")), ["chrom", "chunk_id"], "left")
    base = F.col("chunk_id") * chunk
    lo, hi = F.greatest(F.col("w"), base), F.least(F.col("w") + total, base + F.col("letters"))
    piece = F.when(hi > lo, F.struct(lo.alias("lo"), F.substring(F.col("raw"), (lo - base + 1).cast("int"), (hi - lo).cast("int")).cast("string").alias("piece")))
    cut = met.select("seg_idx", "w", piece.alias("piece"))  # before they are gathered, so that chunks do not go there
    both = cut.groupBy("seg_idx", "w").agg(F.sort_array(F.collect_list("piece")).alias("ps"))  # nulls are not collected
    body = F.array_join(F.transform("ps", lambda p: p["piece"]), "")
    left = F.coalesce(F.get("ps", F.lit(0))["lo"] - F.col("w"), F.lit(0))
    return both.select("seg_idx", F.rpad(F.concat(F.repeat(F.lit("N"), left.cast("int")), body), total, "N").alias("seq"))
