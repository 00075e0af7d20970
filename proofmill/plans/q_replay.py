"""Queries: replay of logs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M, outputs as O, replay as R
from ..streaming import jobs
from . import bridge as B
from .oracle import signature, sql
from .registry import query, r6, scratch


@query("error_lines", sql("SELECT seq, ts_ns FROM b_error", "b_error"))
def error_lines(spark, sf):
    return R.error_lines(B.log_lines(spark, sf)).select("seq", "ts_ns")


@query("normalize_line", sql("SELECT seq, shown FROM b_error", "b_error"))
def normalize_line(spark, sf):
    return R.error_lines(B.log_lines(spark, sf)).select("seq", X.normalize_line(F.col("line")).alias("shown"))


@query("line_family", sql("SELECT seq, family, split_part(family, ':', 1) AS coarse FROM b_error", "b_error"))
def line_family(spark, sf):
    rows = R.error_lines(B.log_lines(spark, sf)).select("seq", X.line_family(F.col("line")).alias("family"))
    return rows.withColumn("coarse", X.coarse_family(F.col("family")))


def _windows(seconds: int, limit: int) -> str:
    return f"""k AS (SELECT *, ts_ns // {seconds * 10**9} AS bucket, row_number() OVER (PARTITION BY ts_ns // {seconds * 10**9} ORDER BY ts_ns DESC, seq) AS rn
  FROM b_error QUALIFY rn <= {limit}),
fam AS (SELECT bucket, family, count(*) AS n, min(rn) AS first_rn FROM k GROUP BY 1, 2),
win AS (SELECT row_number() OVER (ORDER BY bucket) - 1 AS index, bucket, (bucket + 1) * {seconds * 10**9} AS end_ns,
  string_agg(shown, chr(10) ORDER BY rn) AS samples, count(*) AS n_lines,
  (SELECT family FROM fam f WHERE f.bucket = k.bucket ORDER BY n DESC, first_rn LIMIT 1) AS family FROM k GROUP BY bucket)"""


_OUT = "SELECT index, CAST(end_ns AS BIGINT) AS end_ns, md5(samples) AS samples, CAST(n_lines AS INTEGER) AS n_lines, family FROM win"


def _shown(windows):
    return windows.select("index", "end_ns", F.md5(F.array_join("samples", "\n")).alias("samples"),
                          F.size("samples").alias("n_lines"), "family")


@query("replay_windows", sql(f"WITH {_windows(1800, 20)} {_OUT}", "b_error"))
def replay_windows(spark, sf):
    return _shown(R.build_windows(B.log_lines(spark, sf)))


@query("replay_windows_wide", sql(f"WITH {_windows(43200, 20)} {_OUT}", "b_error"))
def replay_windows_wide(spark, sf):
    """Half-day windows, so that the limit and the tie rule come into play."""
    return _shown(R.build_windows(B.log_lines(spark, sf), width_seconds=43200))


@query("render_rules", sql("SELECT name, severity, summary, description FROM b_last_rule", "b_last_rule"))
def render_rules(spark, sf):
    return R.render_rules(B.rules(spark, sf))


_SCENARIOS = f"""{_windows(1800, 20)},
pool AS (SELECT coarse, matched, name, row_number() OVER (PARTITION BY coarse, matched ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY coarse, matched) AS size
  FROM (VALUES ('c.global.redis.EventDispatcher', true, 0, 'RedisStreamConsumptionStalled'), ('c.global.redis.EventDispatcher', true, 1, 'RedisStreamE2eLatencyHigh'),
    ('c.web.exception.RestExceptionHandler', true, 0, 'WsConnectionFailuresHigh'), ('c.r.i.w.PlayerDisconnectionService', true, 0, 'WsConnectionFailuresHigh'),
    ('', false, 0, 'CircuitBreakerOpen'), ('', false, 1, 'AppInstanceDown')) x(coarse, matched, ord, name) WHERE name IN (SELECT name FROM b_last_rule)),
want AS (SELECT win.*, split_part(family, ':', 1) AS coarse, true AS matched FROM win UNION ALL SELECT win.*, '', false FROM win),
sc AS (SELECT printf('replay-%s-%03d', CASE WHEN matched THEN 'pos' ELSE 'neg' END, index) AS name, name AS alertname, index, matched, samples, n_lines, bucket
  FROM want JOIN pool USING (coarse, matched) WHERE index % size = pos)"""


def _scenarios(spark, sf):
    return R.to_scenarios(R.build_windows(B.log_lines(spark, sf)), B.rules(spark, sf))


@query("replay_scenarios", sql(f"""WITH {_SCENARIOS}
SELECT sc.name, sc.alertname, r.severity, r.summary, r.description, md5(samples) AS samples, CASE WHEN matched THEN '' ELSE '아니오' END AS expected,
  'replay-' || CASE WHEN matched THEN 'pos' ELSE 'neg' END || '-' || index AS fingerprint, r.severity AS label_severity
FROM sc JOIN b_last_rule r ON r.name = sc.alertname""", "b_error", "b_last_rule"))
def replay_scenarios(spark, sf):
    a = F.col("alert")
    return _scenarios(spark, sf).select(
        "name", a["alertname"].alias("alertname"), a["severity"].alias("severity"), a["summary"].alias("summary"),
        a["description"].alias("description"), F.md5(F.array_join("log_samples", "\n")).alias("samples"),
        "expected", a["fingerprint"].alias("fingerprint"), a["labels"]["severity"].alias("label_severity"))


def _replay_outputs(scenarios):
    """Answers of two arms to the replayed scenarios: a citation, a made-up one, or none."""
    arms = F.array(F.struct(F.lit("api").alias("arm"), F.lit(0).alias("a")),
                   F.struct(F.lit("local").alias("arm"), F.lit(1).alias("a")))
    rows = scenarios.withColumn("x", F.explode(arms))
    case = F.pmod(F.col("index") * 3 + F.col("x.a") * (F.col("index") % 2 + 1)
                  + F.col("negative").cast("int"), F.lit(5))
    cited = F.get("log_samples", F.lit(0))
    answer = lambda line, claim: F.to_json(F.struct(
        F.lit("s").alias("summary"), F.lit(claim).alias("evidenceFound"), line.alias("evidenceLine")))
    raw = (F.when(case < 2, answer(cited, True)).when(case == 2, answer(F.lit("made up"), True))
           .when(case == 3, answer(F.lit(""), False)).otherwise(F.lit("no json")))
    return rows.select(F.col("x.arm").alias("arm"), F.col("name").alias("scenario"), raw.alias("raw"))


def _replay_outcomes(spark, sf):
    s = _scenarios(spark, sf)
    rows = O.parse_outputs(_replay_outputs(s), lenient=False).join(
        s.select(F.col("name").alias("scenario"), "log_samples", "negative"), "scenario")
    return O.ground(rows).select("arm", "scenario", "negative", "parse_failed", "claimed", "grounded")


_OUTCOME = f"""WITH {_SCENARIOS}, oc AS (SELECT name, matched, arm, (index * 3 + a * (index % 2 + 1) + CASE WHEN matched THEN 0 ELSE 1 END) % 5 AS c
  FROM sc, (VALUES ('api', 0), ('local', 1)) x(arm, a)),
j AS (SELECT l.matched, l.c AS lc, r.c AS rc, (l.c < 2) = (r.c < 2) AS same, l.name FROM oc l JOIN oc r ON l.name = r.name AND l.arm = 'api' AND r.arm = 'local')"""


@query("replay_agreement", sql(_OUTCOME + """
SELECT coalesce(CASE WHEN matched THEN 'positive' WHEN NOT matched THEN 'negative' END, 'all') AS sign, count(*) AS n_left, count(*) AS n_both,
  count(*) FILTER (lc = 4) AS left_parse_failures, count(*) FILTER (rc = 4) AS right_parse_failures, count(*) FILTER (lc < 3) AS left_claims, count(*) FILTER (rc < 3) AS right_claims,
  count(*) FILTER (lc < 2) AS left_grounded, count(*) FILTER (rc < 2) AS right_grounded, count(*) FILTER (same) AS agree, count(*) FILTER (NOT same) AS differ,
  round(100.0::DOUBLE * count(*) FILTER (same) / count(*), 6) AS agreement_pct FROM j GROUP BY ROLLUP (matched)""", "b_error", "b_last_rule"))
def replay_agreement(spark, sf):
    return M.replay_agreement(_replay_outcomes(spark, sf), "api", "local").withColumn("agreement_pct", r6("agreement_pct"))


@query("replay_disagreements", sql(_OUTCOME + " SELECT name AS scenario FROM j WHERE NOT same", "b_error", "b_last_rule"))
def replay_disagreements(spark, sf):
    return M.disagreements(_replay_outcomes(spark, sf), "api", "local")


# ---- streams ---------------------------------------------------------------------------------


def _event_stream(spark, sf):
    """Events as a file stream, shaped into log lines by the same bridge."""
    schema = B.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(writer) -> None:
    """Process what there is and stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query("stream_replay_windows", sql(f"WITH {_windows(1800, 20)} {_OUT}", "b_error"))
def stream_replay_windows(spark, sf):
    """All windows: those the watermark has closed, and those still open when the stream stops."""
    lines = B.log_lines_of(_event_stream(spark, sf))
    path, progress = scratch(spark, "windows"), scratch(spark, "windows-progress")
    _drain(jobs.live_windows(lines).writeStream.format("parquet").outputMode("append")
           .option("path", path).option("checkpointLocation", progress))
    closed = spark.read.schema("bucket long, rn int, line string, n long").parquet(path)
    return _shown(jobs.windows_from_lines(closed.unionByName(jobs.open_windows(spark, progress))))


@query("stream_late_lines", sql("""
WITH m AS (SELECT max(ts_ns) - 600000000000 AS mark FROM b_error)
SELECT bucket, count(*) AS lines FROM (SELECT ts_ns // 1800000000000 AS bucket FROM b_error, m WHERE (ts_ns // 1800000000000 + 1) * 1800000000000 <= mark) GROUP BY bucket""", "b_error"))
def stream_late_lines(spark, sf):
    """All lines fed once more, after the stream has closed its windows: what came too late for each."""
    lines = B.table(spark, sf, "events")
    feed, path, progress = (scratch(spark, x) for x in ("late-feed", "late-windows", "late-progress"))
    for _ in range(2):
        lines.write.mode("append").parquet(feed)
        stream = B.log_lines_of(spark.readStream.schema(lines.schema).parquet(feed))
        _drain(jobs.live_windows(stream).writeStream.format("parquet").outputMode("append")
               .option("path", path).option("checkpointLocation", progress))
    return jobs.late_lines(spark.read.schema("bucket long, rn int, line string, n long").parquet(path))


@query("stream_candidate_intake", sql(f"""
SELECT name, seq FROM (SELECT name, seq, row_number() OVER (PARTITION BY sig ORDER BY seq % 3, seq) AS rn FROM (SELECT name, seq, {signature()} AS sig FROM b_scenario)) WHERE rn = 1""", "b_scenario"))
def stream_candidate_intake(spark, sf):
    """Three batches with a restart before each: rows by seq modulo three."""
    s = B.scenarios(spark, sf).select("seq", "name", "alert", "log_samples")
    feed, path, progress = (scratch(spark, x) for x in ("feed", "accepted", "intake-progress"))
    for batch in range(3):
        s.where(F.col("seq") % 3 == batch).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(s.schema).parquet(feed)
        _drain(jobs.candidate_intake(stream, path, progress))
    return jobs.accepted(spark, path).select("name", "seq")


@query("stream_trials", sql("""
SELECT run, count(*) AS trials, count(*) FILTER (verdict = 'PASS') AS passes, count(*) FILTER (failed) AS errors FROM b_result GROUP BY run""", "b_result"))
def stream_trials(spark, sf):
    feed, path = scratch(spark, "trial-feed"), scratch(spark, "trial-facts")
    B.trials(spark, sf).write.parquet(feed)
    stream = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
    _drain(jobs.score_trials(stream, B.scenarios(spark, sf), path, scratch(spark, "trial-progress")))
    return spark.read.parquet(path).groupBy("run").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(F.col("verdict") == "PASS").alias("passes"),
        F.count_if(F.col("error").isNotNull()).alias("errors"))
