"""Running sums within keys, where one key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import python_ready, written


def running_sums(rows: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """Adds ``<value>_before`` and ``<value>_sum`` to the rows: the sums over the rows of the same
    key that come before in ``order``, and with the row's own value. Sums are int64 and wrap.

    The rows are sorted by range of key and order, so a key of any size is spread over as many
    partitions as it needs. Each partition is summed in one pass; then the partitions' last keys
    and sums (one row each, on the driver) tell where a key that goes on has to start. ``key`` is a
    long without nulls, the order within a key must be total, the values are longs.
    """
    python_ready(rows.sparkSession)
    n_columns = len(rows.columns)
    at_key, at_values = rows.columns.index(key), [rows.columns.index(v) for v in values]
    before = [T.StructField(f"{v}_before", T.LongType()) for v in values]
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()),
                           T.StructField("__at", T.LongType()), *before])

    def numbers(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, carry = TaskContext.get().partitionId(), 0, None, np.zeros((len(values), 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own = numbers(batch, [at_key])[0], numbers(batch, at_values)
            fresh = np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1]))
            sums = np.concatenate([np.zeros((len(values), 1), np.int64), np.cumsum(own, axis=1)], axis=1)
            starts = np.concatenate(([0], np.flatnonzero(fresh[1:]) + 1))
            run = np.searchsorted(starts, np.arange(len(keys)), "right") - 1
            ahead = sums[:, :-1] - sums[:, starts[run]]
            if not fresh[0]:
                ahead[:, run == 0] += carry
            carry = ahead[:, -1:] + own[:, -1:]
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part, np.int32)),
                 pa.array(np.arange(at, at + len(keys))), *[pa.array(a) for a in ahead]],
                names=[f.name for f in schema.fields])
            at += len(keys)

    placed = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    summed = written(placed.mapInArrow(within, schema), "running")
    totals = F.struct(F.col(key).alias("key"), *[(F.col(f"{v}_before").cast("decimal(38,0)") + F.col(v)).alias(v) for v in values])
    ends = summed.groupBy("__part").agg(F.min_by(key, "__at").alias("first"), F.max_by(totals, "__at").alias("last"))
    parts, firsts, shifts, key_now, sum_now = [], [], [], None, [0] * len(values)
    for row in sorted(ends.collect(), key=lambda r: r["__part"]):
        shift = sum_now if row["first"] == key_now else [0] * len(values)
        parts.append(row["__part"]), firsts.append(row["first"]), shifts.append(shift)
        own = [int(row["last"][v]) for v in values]
        goes_on = row["last"]["key"] == row["first"]
        key_now, sum_now = row["last"]["key"], [_wrap(a + b) for a, b in zip(own, shift)] if goes_on else list(map(_wrap, own))
    part_ids, first_keys = np.array(parts, np.int64), np.array(firsts, np.int64)
    offsets = np.array(shifts, np.int64).reshape(len(parts), len(values)).T
    out = T.StructType([*rows.schema.fields, *before, *[T.StructField(f"{v}_sum", T.LongType()) for v in values]])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(part_ids, numbers(batch, [n_columns])[0])
            same = numbers(batch, [at_key])[0] == first_keys[at]
            ahead = numbers(batch, list(range(n_columns + 2, n_columns + 2 + len(values)))) + offsets[:, at] * same
            with_own = ahead + numbers(batch, at_values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_columns], *map(pa.array, ahead), *map(pa.array, with_own)],
                names=[f.name for f in out.fields])

    return summed.mapInArrow(shifted, out)


def _wrap(number: int) -> int:
    """The number as a signed 64-bit one."""
    return (number + (1 << 63)) % (1 << 64) - (1 << 63)
