"""Registry of queries and their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def joined(array: Column | str) -> Column:
    """An array as one comparable text."""
    return F.array_join(array, "|")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
