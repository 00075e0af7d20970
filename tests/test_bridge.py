"""Tables with odd rows: what is derived from them is whole, and equals the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows_of

import __spark_entry__ as entry
from proofmill.operators import training as T
from proofmill.plans import bridge as B

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents (id, text) with a label for each."""
    def write(rows):
        at = str(tmp_path_factory.mktemp("tables"))
        spark.createDataFrame(rows, "doc_id long, text string").select(
            "doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"),
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)], LABELS).coalesce(1).write.parquet(f"{at}/labels.parquet")
        return at
    return write


def spark_rows(spark, name, at):
    df = entry.queries()[name](spark, at)
    return rows_of(df.columns, df.collect())


@pytest.fixture(scope="module")
def without_lines(tables):
    return tables([(i, text) for i, text in enumerate(["one line", "two\nlines", *[""] * 12, "\n\n\n", "\n", "last  line"])])


@pytest.mark.parametrize("name", ["arm_leaderboard", "grounding", "detector_verdict", "judge_prompts", "mcnemar"])
def test_documents_without_lines_have_outputs(spark, without_lines, name):
    con = duckdb.connect(config={"error_on_division_by_zero": "false"})  # else the SQL stops at these rows
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{without_lines}/{t}.parquet/*.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert want and spark_rows(spark, name, without_lines) == want


def test_a_claim_without_lines_is_dropped(spark, tables):
    """The SQL's null would pass as cited."""
    at = tables([(i, "") for i in range(12)])
    claims = T.check_attempts(B.attempts(spark, at), B.scenarios(spark, at)).filter("analysis.evidence_found").collect()
    assert claims and {tuple(r["failures"]["citation"]) for r in claims} == {("empty_citation",)}


def test_without_lines_nothing_is_cited(spark, without_lines):
    got = {r["doc_id"] for r in B.outputs(spark, without_lines).filter("raw LIKE '%evidenceLine\":\"[%'").collect()}
    assert got == {0, 1, 16}


def test_ids_of_all_64_bits(spark, tables):
    ids = [2**63 - 1, -2**63, 2**62 + 5, -(2**62) - 5, 7, -7]
    at = tables([(i, "a b\nc d") for i in ids])
    got = {(int(r["scenario"].removeprefix("monitor-doc-")), r["run"], r["trial"]): (r["judge_raw"], r["latency_ms"])
           for r in B.trials(spark, at).collect()}
    assert got == {(i, arm, t): (B.JUDGE_ANSWERS[(i * 5 + t * 3 + a) % len(B.JUDGE_ANSWERS)], (i * 13 + t) % 500)
                   for i in ids for a, arm in enumerate(B.ARMS) for t in range(1, 6)}
    lists = {(r["doc_id"], r["sample_idx"]) for r in B.outputs(spark, at).filter("arm = 'base' AND raw = '[1, 2]'").collect()}
    assert lists == {(i, k) for i in ids for k in B.SAMPLES if (i * 7 + (k + 1) * 3) % 12 == 6}


def test_stamps_of_a_very_long_document(spark):
    at = 600_000
    row = spark.range(1).select(B.log_format(F.array_repeat(F.lit("x"), at + 1), F.lit(2), F.lit(1).cast("long")).alias("l"))
    stamp = row.select(F.get("l", F.lit(at)).substr(2, 19).alias("s"), F.date_format(
        F.timestamp_seconds(F.lit(1767225600 + 86400 + at * 4000)), "yyyy-MM-dd HH:mm:ss").alias("want")).first()
    assert stamp["s"] == stamp["want"][:19]
