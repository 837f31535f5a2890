"""A training-text pipeline of five stages over ``documents``.

Each stage takes the documents that its predecessor kept and returns their columns; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadwake.llm import jaccard_join, mixing, ordinal, pieces, pii
from leadwake.llm.common import load
from leadwake.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model rejects go; those it can't judge stay."""
    return ordinal.classify(docs, ordinal.graded(load(spark, sf_dir, "labels"))).filter("coalesce(kept, true)").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard similarity the one with the smallest id stays; documents without words
    stay, and rows without an id."""
    found = jaccard_join.join(docs.select("doc_id", "text"))
    gone = materialize(found.filter("component_id < doc_id").select("doc_id").distinct())
    return jaccard_join.without(docs, gone)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; n_chars follows the new text."""
    found = pii.redacted(docs)
    columns = {"text": F.col("redacted"), "n_chars": F.when(F.col("redacted").isNotNull(), F.length("redacted")).cast("long")}
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with begin and end), n_tokens."""
    return pieces.encode(docs, pieces.default_model()).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Hashed features, fitted models and the merge encoding are outside of SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
