"""Queries: training sets, preference pairs, splits, length guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M, outputs as O, training as T
from ..sources import readers, sinks
from . import bridge as B
from .oracle import sql
from .q_outputs import _ids
from .registry import query, r6, scratch


def _scored(spark, sf, arm="trained"):
    """One arm's outputs with their rewards."""
    outs = B.outputs(spark, sf).filter(F.col("arm") == arm).select("arm", "scenario", "sample_idx", "raw")
    rows = O.attach_scenarios(O.parse_outputs(outs), B.scenarios(spark, sf))
    return O.with_reward(rows).select("scenario", "sample_idx", "raw", "reward")


_PICK = """SELECT *, max(reward) FILTER (sample_idx = -1) OVER (PARTITION BY scenario) AS greedy,
  row_number() OVER (PARTITION BY scenario ORDER BY reward DESC, CASE WHEN sample_idx < 0 THEN 99 ELSE sample_idx END) AS best_rn,
  row_number() OVER (PARTITION BY scenario ORDER BY reward, CASE WHEN sample_idx < 0 THEN 99 ELSE sample_idx END) AS worst_rn
  FROM b_fact WHERE arm = 'base'"""
_BEST = f"""SELECT p.scenario, p.sample_idx, p.reward, p.reward > p.greedy AS beats_greedy,
  CASE WHEN s.quality IS NULL THEN 'no_scenario' WHEN p.reward < 0.999 THEN 'below_min_reward' WHEN p.parse_failed THEN 'parse_failed' ELSE 'accepted' END AS reason
  FROM ({_PICK}) p JOIN b_scenario s ON s.name = p.scenario WHERE best_rn = 1"""


def _best(spark, sf):
    """Scenarios of the labelled documents only, so that some samples have none."""
    return T.best_of_n(_scored(spark, sf, "base"), B.scenarios(spark, sf).filter("labelled"))


@query("best_of_n", sql(f"SELECT scenario, sample_idx, round(reward, 6) AS reward, beats_greedy, reason FROM ({_BEST})", "b_fact", "b_scenario"))
def best_of_n(spark, sf):
    return _best(spark, sf).select("scenario", "sample_idx", r6("reward").alias("reward"), "beats_greedy", "reason")


@query("rft_build", sql(f"""
SELECT b.scenario AS name, md5(c."user") AS prompt, 3 AS turns, s.expects_yes
FROM ({_BEST}) b JOIN b_chat c USING (scenario) JOIN b_scenario s ON s.name = b.scenario WHERE reason = 'accepted'""",
    "b_fact", "b_scenario", "b_chat"))
def rft_build(spark, sf):
    rows = T.rft_build(_scored(spark, sf, "base"), B.scenarios(spark, sf).filter("labelled"), B.SYSTEM)
    return rows.select("name", F.md5("prompt").alias("prompt"), F.size("messages").alias("turns"), "expects_yes")


@query("rft_stats", sql(f"""
SELECT reason, count(*) AS n, count(*) FILTER (reason = 'accepted' AND beats_greedy) AS beats_greedy FROM ({_BEST}) GROUP BY reason""", "b_fact", "b_scenario"))
def rft_stats(spark, sf):
    return T.rft_stats(_best(spark, sf))


_TEACHER = """SELECT 'monitor-doc-' || doc_id AS scenario, 'teacher-' || CASE WHEN toxic = 1 THEN 1 ELSE 0 END || '-' || doc_id AS assistant FROM labels"""


@query("teacher_by_prompt", sql(_TEACHER))
def teacher_by_prompt(spark, sf):
    return T.teacher_by_prompt(B.teacher_chat(spark, sf), B.scenarios(spark, sf))


_PREF = f"""SELECT p.scenario, p.expects_yes, CASE WHEN t.assistant IS NULL THEN 'no_teacher' WHEN 1.0::DOUBLE - p.reward < 0.2::DOUBLE THEN 'small_margin' ELSE 'accepted' END AS reason,
  t.assistant AS chosen, p.sample_idx, p.c, 1.0::DOUBLE - p.reward AS margin FROM ({_PICK}) p LEFT JOIN ({_TEACHER}) t ON t.scenario = p.scenario WHERE worst_rn = 1"""


def _pref(spark, sf):
    s = B.scenarios(spark, sf)
    return T.preference_pairs(_scored(spark, sf, "base"), T.teacher_by_prompt(B.teacher_chat(spark, sf), s), s)


@query("preference_pairs", sql(f"""
SELECT scenario, expects_yes, reason, md5(k."user") AS prompt, chosen, c = 6 AS rejected_is_list, round(margin, 6) AS margin
FROM ({_PREF}) JOIN (SELECT scenario, "user" FROM b_chat) k USING (scenario)""", "b_fact", "b_chat"))
def preference_pairs(spark, sf):
    return _pref(spark, sf).select("scenario", "expects_yes", "reason", F.md5("prompt").alias("prompt"), "chosen",
                                   (F.col("rejected") == "[1, 2]").alias("rejected_is_list"), r6("margin").alias("margin"))


@query("preference_stats", sql(f"""
SELECT reason, CASE WHEN expects_yes THEN 'yes' ELSE 'no' END AS verdict, count(*) AS n FROM ({_PREF}) GROUP BY 1, 2""", "b_fact"))
def preference_stats(spark, sf):
    return T.preference_stats(_pref(spark, sf))


@query("verdict_skew_guard", sql(f"""
WITH k AS (SELECT avg(expects_yes::INT) AS kept_yes, count(*) AS kept FROM ({_PREF}) WHERE reason = 'accepted'),
p AS (SELECT avg(expects_yes::INT) AS pool_yes, count(*) AS pool FROM b_scenario)
SELECT kept, pool, round(kept_yes, 6) AS kept_yes, round(pool_yes, 6) AS pool_yes, round(abs(kept_yes - pool_yes), 6) AS skew, abs(kept_yes - pool_yes) > 0.15 AS stop FROM k, p""",
    "b_fact", "b_scenario"))
def verdict_skew_guard(spark, sf):
    return T.verdict_skew_guard(_pref(spark, sf), B.scenarios(spark, sf)).withColumns(
        {c: r6(c) for c in ("kept_yes", "pool_yes", "skew")})


# ---- teacher attempts ----------------------------------------------------------------------

# A bare object only: fenced, wrapped and broken answers are teacher failures here.
_ATTEMPT = f"""SELECT *, c IN (4, 5, 6, 8) AS bad,
  CASE WHEN bad THEN NULL WHEN claimed AND cause = '' THEN 'schema' WHEN claimed <> expects_yes THEN 'verdict'
    WHEN claimed AND NOT list_contains(log_samples, fixed) THEN 'citation' WHEN NOT claimed AND cause <> '' THEN 'no-cause'
    WHEN {_ids("(summary || chr(10) || cause)")} <> '' THEN 'identifier' END AS rule
FROM (SELECT a.arm, a.scenario, a.doc_id, a.sample_idx + 1 AS attempt, a.c, a.expects_yes, a.c IN (0, 1, 2, 4, 7, 8, 9) AS claimed, a.summary, a.cause, s.log_samples,
    s.summary AS s_summary,
    array_to_string(s.log_samples, chr(10)) || chr(10) || s.summary || chr(10) || s.description || chr(10) || s.alertname || chr(10) || s.job
      || CASE WHEN s.alertname = 'IpBanRateSpike' THEN ' ip-blocking' ELSE '' END AS hay,
    CASE WHEN trim(a.evidence_line) <> '' AND NOT list_contains(s.log_samples, trim(a.evidence_line))
        AND len(list_filter(s.log_samples, lambda x: contains(x, trim(a.evidence_line)))) = 1
      THEN list_filter(s.log_samples, lambda x: contains(x, trim(a.evidence_line)))[1] ELSE trim(a.evidence_line) END AS fixed
  FROM b_analysis a JOIN b_scenario s ON s.name = a.scenario WHERE a.arm = 'trained' AND a.sample_idx < 1)"""
_SELECT = f"""WITH t AS ({_ATTEMPT}), g AS (SELECT scenario, expects_yes, min(attempt) FILTER (bad) AS b, min(attempt) FILTER (NOT bad AND rule IS NULL) AS s,
  arg_max(coalesce(rule, ''), attempt) AS last_rule FROM t GROUP BY 1, 2),
d AS (SELECT scenario, expects_yes, coalesce(s, 9) < coalesce(b, 9) AS accepted, CASE WHEN coalesce(s, 9) < coalesce(b, 9) THEN s END AS attempt,
  CASE WHEN coalesce(s, 9) < coalesce(b, 9) THEN NULL WHEN b IS NOT NULL THEN 'teacher' ELSE last_rule END AS drop_rule FROM g)"""


def _selected(spark, sf):
    return T.select_attempt(T.check_attempts(B.attempts(spark, sf), B.scenarios(spark, sf)))


@query("select_attempt", sql(_SELECT + " SELECT scenario, accepted, attempt, drop_rule FROM d", "b_analysis", "b_scenario"))
def select_attempt(spark, sf):
    return _selected(spark, sf)


@query("build_stats", sql(_SELECT + " SELECT CASE WHEN accepted THEN 'accepted' ELSE drop_rule END AS outcome, count(*) AS n FROM d GROUP BY 1", "b_analysis", "b_scenario"))
def build_stats(spark, sf):
    return T.build_stats(_selected(spark, sf))


def _built(spark, sf):
    return T.sft_build(B.attempts(spark, sf), B.scenarios(spark, sf), B.SYSTEM)


@query("sft_build", sql(_SELECT + """
SELECT d.scenario AS name, md5(c."user") AS prompt, md5(CASE WHEN t.claimed THEN t.fixed ELSE any_value(t.fixed) END) AS evidence, 3 AS turns, d.expects_yes
FROM d JOIN t ON t.scenario = d.scenario AND t.attempt = d.attempt JOIN b_chat c ON c.scenario = d.scenario WHERE accepted
GROUP BY d.scenario, c."user", t.claimed, t.fixed, d.expects_yes""", "b_analysis", "b_scenario", "b_chat"))
def sft_build(spark, sf):
    return _built(spark, sf).select(
        "name", F.md5("prompt").alias("prompt"),
        F.md5(F.get_json_object("assistant", "$.evidenceLine")).alias("evidence"),
        F.size("messages").alias("turns"), "expects_yes")


_SPLIT = """SELECT name, expects_yes, CASE WHEN row_number() OVER (ORDER BY md5('20260826:' || name)) <= greatest(1, CAST(floor(count(*) OVER () * 0.15::DOUBLE) AS BIGINT))
  THEN 'valid' ELSE 'train' END AS split FROM b_scenario"""


@query("train_valid_split", sql(f"SELECT name, split FROM ({_SPLIT})", "b_scenario"))
def train_valid_split(spark, sf):
    return T.train_valid_split(B.scenarios(spark, sf).select("name")).select("name", "split")


@query("mix_ratio", sql("""
WITH n AS (SELECT count(*) FILTER (expects_yes) AS y, count(*) FILTER (NOT expects_yes) AS n FROM b_scenario),
t AS (SELECT least(floor(y / 0.3::DOUBLE), floor(n / (1 - 0.3::DOUBLE))) AS total FROM n)
SELECT name, expects_yes FROM (SELECT name, expects_yes, row_number() OVER (PARTITION BY expects_yes ORDER BY md5('20260826:' || name)) AS rn FROM b_scenario), t
WHERE rn <= CASE WHEN expects_yes THEN floor(total * 0.3::DOUBLE + 1e-9) ELSE floor(total * 0.7::DOUBLE + 1e-9) END""", "b_scenario"))
def mix_ratio(spark, sf):
    rows = O.with_expectation(B.scenarios(spark, sf)).select("name", "expects_yes")
    return T.mix_ratio(rows, 0.3)


@query("chat_sink", sql(_SELECT + """, k AS (SELECT scenario FROM d WHERE accepted),
r AS (SELECT row_number() OVER (ORDER BY md5('20260826:' || scenario)) AS rn, count(*) OVER () AS n FROM k)
SELECT CASE WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'valid' ELSE 'train' END AS split, count(*) AS lines FROM r GROUP BY 1""", "b_analysis", "b_scenario"))
def chat_sink(spark, sf):
    path = scratch(spark, "chat")
    sinks.write_chat(T.train_valid_split(_built(spark, sf)), path)
    return readers.load_chat(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("lines"))


# ---- length guard over conversations ---------------------------------------------------------


@query("length_report", sql("""
WITH l AS (SELECT conv_id, sum(len(text)) AS length, sum(len(regexp_split_to_array(trim(text), '\\s+'))) AS words FROM conversations GROUP BY 1)
SELECT 'chars' AS unit, count(*) AS total, CAST(max(length) AS BIGINT) AS longest, count(*) FILTER (length > 2000) AS over_limit, CAST(ceil(max(length) / 128.0) * 128 AS BIGINT) AS recommended_limit FROM l
UNION ALL SELECT 'words', count(*), CAST(max(words) AS BIGINT), count(*) FILTER (words > 2000), CAST(ceil(max(words) / 128.0) * 128 AS BIGINT) FROM l"""))
def length_report(spark, sf):
    c = B.table(spark, sf, "conversations")
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("long")
    lengths = c.groupBy("conv_id").agg(
        F.sum(F.length("text").cast("long")).alias("chars"), F.sum(words).alias("words"))
    long = lengths.select(F.explode(F.create_map(
        F.lit("chars"), F.col("chars"), F.lit("words"), F.col("words"))).alias("unit", "length"))
    return M.length_report(long, 2000, ("unit",))


# ---- preference training log -------------------------------------------------------------------


@query("preference_metrics", sql("""
WITH g AS (SELECT 'r' || (event_id % 4) AS run, event_id // 4 + 1 AS step, value / 3.0::DOUBLE - event_id % 7 AS margin FROM events),
l AS (SELECT *, greatest(-0.1::DOUBLE * margin, 0) + ln(1 + exp(-abs(0.1::DOUBLE * margin))) AS loss FROM g),
w AS (SELECT *, avg(loss) OVER (PARTITION BY run ORDER BY step ROWS 9 PRECEDING) AS recent FROM l)
SELECT run, step, round(loss, 6) AS loss, margin > 0 AS prefers_chosen, round(recent, 6) AS recent_loss, step % 10 = 0 AND recent < 0.3 AS collapsed FROM w"""))
def preference_metrics(spark, sf):
    """A training log out of events: four runs, one step after the other."""
    e = B.table(spark, sf, "events")
    id_ = F.col("event_id")
    log = e.select(
        F.concat(F.lit("r"), (id_ % 4).cast("string")).alias("run"),
        (F.floor(id_ / 4) + 1).alias("step"),
        (F.col("value") / F.lit(3.0)).alias("policy_chosen"), F.lit(0.0).alias("ref_chosen"),
        (id_ % 7).cast("double").alias("policy_rejected"), F.lit(0.0).alias("ref_rejected"))
    out = T.preference_metrics(log, collapse_at=0.3, block=100)
    return out.withColumns({c: r6(c) for c in ("loss", "recent_loss")})
