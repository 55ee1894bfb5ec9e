"""Nucleotide strings and codes: A 0, C 1, G 2, T 3, N 4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(seq: Column | str) -> Column:
    """Digits 0 to 4; case is ignored and any other letter is an error."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.when(s.rlike("[^ACGTNacgtn]"), F.raise_error(F.concat(F.lit("not a nucleotide: "), F.substring(F.regexp_extract(s, "[^ACGTNacgtn]", 0), 1, 1))).cast("string")).otherwise(F.translate(s, "ACGTNacgtn", "0123401234"))


def decode(codes: Column | str) -> Column:
    return F.translate(codes, "01234", "ACGTN")


def clean(text: Column | str) -> Column:
    """Any text as nucleotides: acgtn in upper case, and N for every other character."""
    return F.regexp_replace(F.translate(text, "acgtn", "ACGTN"), "[^ACGTN]", "N")


def code_array(codes: Column | str) -> Column:
    return F.transform(F.split(codes, ""), lambda c: c.cast("tinyint"))


def pad_to(seq: Column | str, left: Column, length: int) -> Column:
    """``seq`` after ``left`` N, filled with N to ``length``."""
    return F.rpad(F.concat(F.repeat(F.lit("N"), left.cast("int")), F.col(seq) if isinstance(seq, str) else seq), length, "N")
