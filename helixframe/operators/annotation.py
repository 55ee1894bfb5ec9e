"""Genes and transcripts from rows of a GFF file (as ``sources.gff`` reads it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _need(key: str) -> Column:
    value = F.try_element_at("attributes", F.lit(key))
    return F.when(value.isNull(), F.raise_error(F.lit(f"attribute {key} is missing"))).otherwise(value)


def is_coding(kind: Column, coding: str = "protein_coding") -> Column:
    """Whether the type is that of coding genes; null without a type."""
    return kind == coding


def _coding(key: str) -> Column:
    return is_coding(F.try_element_at("attributes", F.lit(key)))


def _place() -> list[Column]:
    return ["chrom", (F.col("left") - 1).alias("start"), F.col("right").alias("end"), F.when(F.col("strand").isin("+", "-"), F.col("strand")).alias("strand")]


def tss(strand: str = "strand", start: str = "start", end: str = "end") -> Column:
    """Transcription start: the first base on +, the last on -, else null."""
    return F.when(F.col(strand) == "+", F.col(start)).when(F.col(strand) == "-", F.col(end) - 1)


def exon_sets(exons: DataFrame, key: str = "gene_id") -> DataFrame:
    """(gene_id, exons): distinct exons in order."""
    return exons.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))


def last_wins(rows: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Of rows with one key the last, at the place of the first."""
    fields = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*fields), line).alias("r"), F.min(line).alias("_place"))
    return one.select(key, *[F.col(f"r.{c}").alias(c) for c in fields if c != line], F.col("_place").alias(line))


def read_genes(gff: DataFrame, gene_name_key: str = "gene_name", gene_id_key: str = "gene_id") -> DataFrame:
    """(line, gene_name, gene_id, is_coding, chrom, start, end, strand, tss, exons) in the order of the file.

    ``exons`` is null for a gene without any; ``is_coding`` is null without a gene_type.
    """
    genes = gff.where(F.col("type") == "gene").select("line", _need(gene_name_key).alias("gene_name"), _need(gene_id_key).alias("gene_id"), _coding("gene_type").alias("is_coding"), *_place())
    exons = gff.where(F.col("type") == "exon").select(_need(gene_id_key).alias("gene_id"), (F.col("left") - 1).alias("start"), F.col("right").alias("end"))
    out = last_wins(genes, "gene_id").join(exon_sets(exons), "gene_id", "left")
    return out.select("line", "gene_name", "gene_id", "is_coding", "chrom", "start", "end", "strand", tss().alias("tss"), "exons")


def read_transcripts(gff: DataFrame, transcript_name_key: str = "transcript_name", transcript_id_key: str = "transcript_id", gene_name_key: str = "gene_name", gene_id_key: str = "gene_id") -> DataFrame:
    """(line, transcript_name, transcript_id, gene_name, gene_id, is_coding, chrom, start, end, strand, tss)."""
    rows = gff.where(F.col("type") == "transcript")
    out = rows.select("line", F.try_element_at("attributes", F.lit(transcript_name_key)).alias("transcript_name"), _need(transcript_id_key).alias("transcript_id"), _need(gene_name_key).alias("gene_name"), _need(gene_id_key).alias("gene_id"), _coding("transcript_type").alias("is_coding"), *_place())
    return out.withColumn("tss", tss())
