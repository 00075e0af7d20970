"""The corpus pipeline: quality, exact copies, near copies, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofmill.llm import exact_dedup, packing, quality, secrets, simhash
from proofmill.llm.common import discard, passing, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, the row of the smallest id stays."""
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text by a mark; every document stays."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in fixed windows."""
    return packing.piece_rows(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each result is written and read again. What a stage
    wrote on its way, and the result before it, is deleted then."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
        if last is not None:
            discard(last)
        last = docs
    return docs
