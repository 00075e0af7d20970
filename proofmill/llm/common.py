"""Small helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, python_workers

#: Rows per Arrow batch where a row holds a whole text, so a batch of long texts stays small.
TEXT_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(rows: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder; later plans start there."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    table._written_at = path
    if _passing:
        _passing[-1].append(table)
    return table


_passing: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at the end of the block, the tables that ``written`` made in it, but for those given
    to the function that the block gets. What is still needed has to be written or collected by then."""
    made, kept = [], []
    _passing.append(made)
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _passing.remove(made)
        for table in made:
            if not any(table is k for k in kept):
                discard(table)


def discard(rows: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing reads it any more."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(rows._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts).cast("int")


def python_ready(spark: SparkSession) -> None:
    """Prepares Python on the executors: this package is sent along once per application, so
    workers can import it wherever they start, and Arrow batches hold at most TEXT_ROWS rows, from
    here on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    python_workers(spark)


def clear_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of documents with one clear label.

    Repeated labels of a document that agree count once; a document whose labels disagree is
    left out, as are null ids and labels other than 0 and 1.
    """
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
            .agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
            .where("_lo = _hi").select("doc_id", F.col("_lo").cast("int").alias(label)))


def sample_by(rows: DataFrame, column: str, per_value: int, seed: int = 0) -> tuple[DataFrame, dict]:
    """About ``per_value`` rows of each value of ``column``, and the count of every value.

    A row is taken if the hash of its id falls below ``per_value`` over its value's count, so
    the choice needs no sort, depends on no partitioning, and has that size at any input size.
    """
    counts = {r[column]: r["n"] for r in rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    chance = F.lit(0.0)
    for value, n in sorted(counts.items()):
        chance = F.when(F.col(column) == value, F.lit(min(1.0, per_value / n))).otherwise(chance)
    return rows.where(place < chance), counts


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of equal ``key`` from batches sorted by it; a run may span batches."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        keys = rows[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(rows)]
        for start, end in zip(edges, edges[1:]):
            piece = rows.iloc[start:end]
            if held and held[0][key].iat[0] != piece[key].iat[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
