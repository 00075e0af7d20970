"""Columns that are computed exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and join conditions read instead of re-evaluating.

    A filter on an ordinary derived column is pushed below its projection, which copies the
    expression into the filter, and copies multiply for columns built on columns. A
    one-element ``explode`` keeps the row as it is and nothing is pushed through it.
    """
    for name, value in columns.items():
        kept = [F.col(f"`{c}`") for c in rows.columns if c != name]
        rows = rows.select(*kept, F.explode(F.array(value)).alias(name))
    return rows


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, for use inside functions over arrays.

    An expression written inside such a function is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
