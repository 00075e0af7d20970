"""Registered queries against their oracles, and independence of the partitioning."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from proofmill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("supplier", "events", "documents", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    return rows_of(df.columns, df.collect())


def oracle_rows(name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    return rows_of([d[0] for d in res.description], res.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["arm_leaderboard", "find_duplicates", "replay_windows_wide", "paired_bootstrap",
                                  "train_valid_split", "benchmark_line_overlap", "effect_gaps"])
def test_results_match_and_ignore_partition_counts(spark, name):
    want = oracle_rows(name)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert spark_rows(spark, name) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
