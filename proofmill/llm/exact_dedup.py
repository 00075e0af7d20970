"""Exact duplicates by two passes of Bloom filtering; built-in functions only.

Pass one marks the cells of a fixed bitmap that two or more texts hit. Only texts in such a
cell reach pass two, a second bitmap under an independent hash. A text in a repeated cell of
both may have a copy; those rows alone are shuffled and compared by SHA-256. All others have
no copy for sure and pass straight through. The filters have a fixed size, so the broadcast
never grows; past some 10^8 rows they fill up and more rows take the exact path, which stays
right at every size.

Defined cases: null text counts as empty text; empty texts are equal to each other; a null id
is smaller than any other; rows that repeat both text and largest id are one document, all of
them flagged ``kept`` in ``groups`` and exactly one of them left by ``deduplicate``; an empty
table gives an empty result; other columns never clash, as only ``doc_id`` and ``text`` are
read under names of this module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .common import text_of, written

_SEEDS = (17, 71)
_HIT = ("__copy_hit_1", "__copy_hit_2")


def _may_repeat(rows: DataFrame, keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Rows with both hit columns; ``keys`` has the key column of every row once."""
    first = bloom.repeated(keys, key, _SEEDS[0], bits)
    left = bloom.probe(keys, first, key, _SEEDS[0], _HIT[0], bits).where(F.col(_HIT[0]))
    second = bloom.repeated(left, key, _SEEDS[1], bits)
    return bloom.probe(bloom.probe(rows, first, key, _SEEDS[0], _HIT[0], bits),
                       second, key, _SEEDS[1], _HIT[1], bits)


def groups(docs: DataFrame, bits: int = bloom.BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(docs.select(
        "doc_id", F.unhex(F.sha2(text_of(), 256)).alias("digest")), "digests")
    marked = _may_repeat(digests, digests, F.col("digest"), bits)
    maybe = marked.where(F.col(_HIT[0]) & F.col(_HIT[1])).select("doc_id", "digest")
    alone = marked.where(~(F.col(_HIT[0]) & F.col(_HIT[1]))).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest")
    sizes = maybe.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    together = maybe.join(sizes, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return alone.unionByName(together).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, bits: int = bloom.BITS) -> DataFrame:
    """The documents with one row of each text, the one of the largest id; all columns kept.

    Only rows whose text may repeat are shuffled; copies are reduced map-side.
    """
    columns = docs.columns
    key = F.xxhash64(F.lit(3), text_of())
    keys = docs.select(key.alias("__copy_key"))
    rows = docs.withColumn("__copy_key", key)
    marked = _may_repeat(rows, keys, F.col("__copy_key"), bits)
    both = F.col(_HIT[0]) & F.col(_HIT[1])
    packed = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__copy_row")
    best = (marked.where(both).select(F.sha2(text_of(), 256).alias("__copy_digest"), packed)
            .groupBy("__copy_digest")
            .agg(F.max_by("__copy_row", F.struct("__copy_row.doc_id")).alias("__copy_row")))
    return marked.where(~both).select(*[F.col(f"`{c}`") for c in columns]).unionByName(
        best.select("__copy_row.*"))
