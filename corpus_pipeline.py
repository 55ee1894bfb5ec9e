"""A training-corpus pipeline over ``documents``: five stages, each an operator of ``helixframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns their tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid, toxicity
from helixframe.llm.bpe import bpe_encode_decode
from helixframe.llm.minhash import MinHashOptions, drop_near_duplicates
from helixframe.llm.mixing import mixed_documents
from helixframe.llm.workspace import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those unlike every language that the rows' own ``lang`` teaches."""
    return langid.drop_rejected(docs, langid.fit(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic by a model of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of smallest id, of each group of near copies (five words, 0.8)."""
    return drop_near_duplicates(docs, options=MinHashOptions())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each document."""
    got = bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity_filter),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next, which then removes it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    ws = Workspace(spark, "pipeline")
    for _, stage in STAGES:
        docs, path = ws.write(stage(spark, docs, sf_dir))
        if before is not None:
            ws.remove(before)
        before = path
    return docs
