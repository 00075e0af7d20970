"""Queries: aggregates, paired comparison, power, ROC, probes and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as K
from ..operators import metrics as M, outputs as O, probes as PR, stats as S
from ..session import reused
from . import bridge as B
from .oracle import q, sql
from .q_outputs import fact
from .registry import query, r6


def _results(spark, sf):
    return O.trial_results(B.trials(spark, sf), B.scenarios(spark, sf))


_STATS = """SELECT run, scenario, count(*) AS trials, count(*) FILTER (verdict = 'PASS') AS passes,
  round(avg(accuracy), 6) AS mean_accuracy, round(avg(groundedness), 6) AS mean_groundedness,
  count(*) FILTER (hallucination_detected) AS hallucinations, count(*) FILTER (failed) AS errors,
  round(count(*) FILTER (verdict = 'PASS') / count(*)::DOUBLE, 6) AS pass_rate FROM b_result GROUP BY run, scenario"""


@query("scenario_stats", sql(_STATS, "b_result"))
def scenario_stats(spark, sf):
    return M.scenario_stats(_results(spark, sf)).withColumns(
        {c: r6(c) for c in ("mean_accuracy", "mean_groundedness", "pass_rate")})


@query("run_totals", sql(f"""
SELECT run, count(*) AS scenarios, CAST(sum(trials) AS BIGINT) AS trials, CAST(sum(passes) AS BIGINT) AS passes,
  count(*) FILTER (passes = trials) AS always_pass, round(sum(passes) / sum(trials)::DOUBLE, 6) AS pass_rate
FROM ({_STATS}) GROUP BY run""", "b_result"))
def run_totals(spark, sf):
    return M.run_totals(M.scenario_stats(_results(spark, sf))).withColumn("pass_rate", r6("pass_rate"))


@query("failure_stability", sql(f"""
SELECT run, count(*) FILTER (passes = 0) AS always_fail, count(*) FILTER (passes > 0 AND passes < trials) AS mixed,
  count(*) FILTER (passes = trials) AS always_pass FROM ({_STATS}) GROUP BY run""", "b_result"))
def failure_stability(spark, sf):
    return M.failure_stability(M.scenario_stats(_results(spark, sf)))


@query("endpoint_report", sql("""
SELECT arm, count(*) FILTER (expects_yes) AS positives, count(*) FILTER (NOT expects_yes) AS negatives,
  count(*) FILTER (expects_yes AND claimed) AS claimed_on_positives, count(*) FILTER (expects_yes AND grounded) AS citation_pass,
  count(*) FILTER (expects_yes AND claimed AND strict_ok) AS citation_pass_strict,
  count(*) FILTER (NOT expects_yes AND claimed) AS false_claims, count(*) FILTER (NOT expects_yes AND grounded) AS false_positives,
  count(*) FILTER (parse_failed) AS parse_failures,
  round(count(*) FILTER (expects_yes AND grounded) / (count(*) FILTER (expects_yes))::DOUBLE
    - count(*) FILTER (NOT expects_yes AND grounded) / (count(*) FILTER (NOT expects_yes))::DOUBLE, 6) AS discrimination
FROM b_fact WHERE sample_idx = -1 GROUP BY arm""", "b_fact"))
def endpoint_report(spark, sf):
    return M.endpoint_report(fact(spark, sf)).withColumn("discrimination", r6("discrimination"))


@query("arm_leaderboard", sql("""
WITH p AS (SELECT arm, scenario, max(reward) FILTER (sample_idx = -1) AS greedy, max(reward) AS best FROM b_fact GROUP BY arm, scenario),
m AS (SELECT arm, avg(greedy) AS g, avg(best) AS b FROM p GROUP BY arm)
SELECT m.arm, round(any_value(g), 6) AS greedy_mean, round(any_value(b), 6) AS best_mean, round(any_value(b) - any_value(g), 6) AS headroom,
  count(*) FILTER (expects_yes AND grounded) AS citation_pass, count(*) FILTER (expects_yes) AS positives,
  count(*) FILTER (NOT expects_yes AND grounded) AS false_positives, count(*) FILTER (NOT expects_yes) AS negatives,
  count(*) FILTER (parse_failed) AS parse_failures
FROM m JOIN b_fact f ON f.arm = m.arm WHERE f.sample_idx = -1 GROUP BY m.arm""", "b_fact"))
def arm_leaderboard(spark, sf):
    return M.arm_leaderboard(fact(spark, sf)).withColumns(
        {c: r6(c) for c in ("greedy_mean", "best_mean", "headroom")})


@query("best_of_n_scores", sql("""
SELECT arm, scenario, round(max(reward) FILTER (sample_idx = -1), 6) AS greedy, round(max(reward), 6) AS best,
  count(*) FILTER (sample_idx >= 0) AS samples, count(*) FILTER (sample_idx >= 0 AND reward >= 0.999) AS perfect,
  round(count(*) FILTER (sample_idx >= 0 AND reward >= 0.999) / (count(*) FILTER (sample_idx >= 0))::DOUBLE, 6) AS perfect_rate
FROM b_fact GROUP BY arm, scenario""", "b_fact"))
def best_of_n_scores(spark, sf):
    return M.best_of_n_scores(fact(spark, sf)).withColumns(
        {c: r6(c) for c in ("greedy", "best", "perfect_rate")})


@query("stratified_scores", sql("""
SELECT CASE WHEN len(log_samples) <= 2 THEN '1-2' WHEN len(log_samples) <= 6 THEN '3-6' ELSE '7+' END AS stratum, arm,
  count(*) AS n, round(avg(reward), 6) AS mean_reward, count(*) FILTER (expects_yes AND grounded) AS citation_pass,
  count(*) FILTER (NOT expects_yes AND grounded) AS false_positives
FROM b_fact WHERE sample_idx = -1 GROUP BY ALL""", "b_fact"))
def stratified_scores(spark, sf):
    s = B.scenarios(spark, sf).select(F.col("name").alias("scenario"), F.size("log_samples").alias("n_lines"))
    rows = fact(spark, sf).join(s, "scenario")
    n = F.col("n_lines")
    stratum = F.when(n <= 2, "1-2").when(n <= 6, "3-6").otherwise("7+")
    return M.stratified_scores(rows, stratum).withColumn("mean_reward", r6("mean_reward"))


@query("stratified_origin", sql("""
SELECT s.source AS stratum, arm, count(*) AS n, round(avg(reward), 6) AS mean_reward, count(*) FILTER (f.expects_yes AND grounded) AS citation_pass,
  count(*) FILTER (NOT f.expects_yes AND grounded) AS false_positives
FROM b_fact f JOIN (SELECT name, source FROM b_scenario) s ON s.name = f.scenario WHERE sample_idx = -1 GROUP BY ALL""", "b_fact", "b_scenario"))
def stratified_origin(spark, sf):
    s = B.scenarios(spark, sf).select(F.col("name").alias("scenario"), "source")
    return M.stratified_scores(fact(spark, sf).join(s, "scenario"), F.col("source")).withColumn("mean_reward", r6("mean_reward"))


@query("outputs_without_scenario", sql("""
SELECT arm, count(*) AS outputs, count(DISTINCT scenario) AS names FROM b_fact
WHERE scenario IN (SELECT name FROM b_scenario WHERE quality IS NULL) GROUP BY arm""", "b_fact", "b_scenario"))
def outputs_without_scenario(spark, sf):
    """Outputs of all scenarios against those that carry a label."""
    gold, _ = B.golden_and_candidates(spark, sf)
    return O.outputs_without_scenario(B.outputs(spark, sf), gold)


# ---- paired comparison ---------------------------------------------------------------


@query("load_arm", sql("SELECT scenario, round(reward, 6) AS score FROM b_fact WHERE arm = 'trained' AND sample_idx = -1", "b_fact"))
def load_arm(spark, sf):
    return S.load_arm(fact(spark, sf), "trained").withColumn("score", r6("score"))


def _pairs(spark, sf):
    return S.paired_scores(fact(spark, sf), "base", "trained")


_PAIRS = """SELECT a.scenario, a.reward AS a, b.reward AS b, b.reward - a.reward AS diff, a.alertname AS cluster
  FROM (SELECT * FROM b_fact WHERE arm = 'base' AND sample_idx = -1) a
  JOIN (SELECT * FROM b_fact WHERE arm = 'trained' AND sample_idx = -1) b USING (scenario)"""


_DIFF = f"SELECT scenario, cluster, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff FROM ({_PAIRS})"


@query("paired_diff", sql(_DIFF, "b_fact"))
def paired_diff(spark, sf):
    """Two score tables and a cluster table, as they come from separate runs."""
    f = fact(spark, sf)
    clusters = B.scenarios(spark, sf).select(
        F.col("name").alias("scenario"), F.col("alert.alertname").alias("cluster"))
    pairs = S.paired_diff(S.load_arm(f, "base"), S.load_arm(f, "trained"), clusters)
    return pairs.select("scenario", "cluster", *[r6(c).alias(c) for c in ("a", "b", "diff")])


@query("paired_scores", sql(_DIFF, "b_fact"))
def paired_scores(spark, sf):
    return _pairs(spark, sf).select("scenario", "cluster", *[r6(c).alias(c) for c in ("a", "b", "diff")])


@query("cluster_sizes", sql("SELECT alertname AS cluster, count(*) AS size FROM b_scenario GROUP BY 1", "b_scenario"))
def cluster_sizes(spark, sf):
    return S.cluster_sizes(B.scenarios(spark, sf).select(F.col("alert.alertname").alias("cluster")))


_COUNTS = """SELECT CASE WHEN l.expects_yes THEN 'positive' ELSE 'negative' END AS sign,
  count(*) FILTER (r.grounded <> l.grounded AND r.grounded = l.expects_yes) AS better,
  count(*) FILTER (r.grounded <> l.grounded AND r.grounded <> l.expects_yes) AS worse,
  count(*) FILTER (r.grounded IS NULL OR r.grounded = l.grounded) AS same
FROM (SELECT * FROM b_fact WHERE arm = 'base' AND sample_idx = -1) l
LEFT JOIN (SELECT * FROM b_fact WHERE arm = 'trained' AND sample_idx = -1) r USING (scenario) GROUP BY 1"""


@query("paired_counts", sql(_COUNTS, "b_fact"))
def paired_counts(spark, sf):
    return S.paired_counts(fact(spark, sf), "base", "trained")


@query("mcnemar", sql(f"""
WITH c AS ({_COUNTS}), n AS (SELECT better, worse, better + worse AS n, least(better, worse) AS k FROM c
    UNION ALL SELECT 0, 0, 0, 0),
t AS (SELECT n.better, n.worse, CASE WHEN n.n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0 * list_sum(list_transform(range(0, n.k + 1),
  lambda i: exp(lgamma(n.n + 1.0) - lgamma(i + 1.0) - lgamma(n.n - i + 1.0) - n.n * ln(2.0))))) END AS p FROM n)
SELECT sign, c.better, c.worse, c.same, round(t.p, 6) AS p_value FROM c JOIN (SELECT DISTINCT * FROM t) t ON t.better = c.better AND t.worse = c.worse""", "b_fact"))
def mcnemar(spark, sf):
    return S.mcnemar(S.paired_counts(fact(spark, sf), "base", "trained")).withColumn("p_value", r6("p_value"))


_TWO64 = "18446744073709551616::UHUGEINT"


def _draw(t: str, j: str) -> str:
    """A draw's 64 bits: the counter (t, j) through the finaliser of splitmix64."""
    z = f"(20260901::UHUGEINT + ({t}::UHUGEINT * 4294967296 + {j}::UHUGEINT) * 11400714819323198485::UHUGEINT) % {_TWO64}"
    for shift, factor in ((30, "13787848793156543929"), (27, "10723151780598845931")):
        z = f"list_transform([({z})::UBIGINT], lambda z: xor(z, z >> {shift}))[1]::UHUGEINT * {factor}::UHUGEINT % {_TWO64}"
    return f"list_transform([({z})::UBIGINT], lambda z: xor(z, z >> 31))[1]"


def _boot(unit: str, iters: int) -> str:
    """The bootstrap restated for units that make one leaf: units in hash order, exact percentiles."""
    return f"""
WITH d AS ({_PAIRS}), u AS (SELECT {unit} AS unit, sum(diff) AS s, count(*) AS c FROM d GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY md5(unit)) - 1 AS idx, s, c FROM u),
k AS (SELECT count(*) AS k, sum(c) AS n, sum(s) / sum(c) AS observed FROM u),
w AS (SELECT t, {_draw("t", "j")} % k::UBIGINT AS idx
      FROM k, range(1, {iters} + 1) a(t), range(0, CAST(k.k AS BIGINT)) b(j)),
m AS (SELECT t, sum(s) / sum(c) AS mean FROM w JOIN n USING (idx) GROUP BY t),
r AS (SELECT stddev_samp(mean) AS se, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m),
x AS (SELECT CAST(k.n AS BIGINT) AS n, k.k AS n_clusters, observed, se, ci_low, ci_high, 2.8::DOUBLE * se AS mde FROM k, r)"""


_RESULT = "n, n_clusters, round(observed, 9) AS observed, round(se, 9) AS se, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high"
_ROUNDED = ("observed", "se", "ci_low", "ci_high")


@query("paired_bootstrap", sql(_boot("cluster", 10000) + f" SELECT {_RESULT} FROM x", "b_fact"))
def paired_bootstrap(spark, sf):
    return S.paired_bootstrap(_pairs(spark, sf)).withColumns({c: F.round(c, 9) for c in _ROUNDED})


@query("paired_bootstrap_scenario", sql(_boot("scenario", 200) + f" SELECT {_RESULT} FROM x", "b_fact"))
def paired_bootstrap_scenario(spark, sf):
    """Scenarios as units: as many draws per iteration as scenarios, so fewer iterations."""
    return S.paired_bootstrap(_pairs(spark, sf), "scenario", iters=200).withColumns(
        {c: F.round(c, 9) for c in _ROUNDED})


@query("power_report", sql(_boot("cluster", 10000) + """
SELECT n, n_clusters, round(observed, 6) AS observed, round(mde, 6) AS mde, abs(observed) > mde AS significant,
  CAST(ceil(n_clusters * pow(mde / 0.05::DOUBLE, 2)) AS BIGINT) AS n_needed FROM x""", "b_fact"))
def power_report(spark, sf):
    out = S.with_power(S.paired_bootstrap(_pairs(spark, sf)), effect=0.05)
    return out.select("n", "n_clusters", r6("observed").alias("observed"), r6("mde").alias("mde"),
                      "significant", "n_needed")


_SIZE = "CASE WHEN log_lines <= 2 THEN 'small' WHEN log_lines <= 6 THEN 'medium' ELSE 'large' END"
_BY_SIZE = f"""
WITH d AS (SELECT p.*, {_SIZE} AS size FROM ({_PAIRS}) p JOIN (SELECT name, len(log_samples) AS log_lines FROM b_scenario) s ON s.name = p.scenario),
u AS (SELECT size, cluster AS unit, sum(diff) AS s, count(*) AS c FROM d GROUP BY 1, 2),
n AS (SELECT size, row_number() OVER (PARTITION BY size ORDER BY md5(unit)) - 1 AS idx, s, c FROM u),
k AS (SELECT size, count(*) AS k, sum(c) AS n, sum(s) / sum(c) AS observed FROM u GROUP BY 1),
w AS (SELECT size, t, {_draw("t", "j")} % k::UBIGINT AS idx
      FROM k, range(1, 2001) a(t), range(0, CAST(k.k AS BIGINT)) b(j)),
m AS (SELECT size, t, sum(s) / sum(c) AS mean FROM w JOIN n USING (size, idx) GROUP BY 1, 2),
r AS (SELECT size, 2.8::DOUBLE * stddev_samp(mean) AS mde FROM m GROUP BY 1),
f AS (SELECT {_SIZE} AS size, count(*) FILTER (parse_failed) AS parse_failures FROM (SELECT *, len(log_samples) AS log_lines FROM b_fact WHERE arm = 'trained' AND sample_idx = -1) GROUP BY 1),
x AS (SELECT k.size, observed, mde, parse_failures, CASE WHEN parse_failures > 5 THEN 'hold' WHEN observed > mde THEN 'replicated' ELSE 'not_replicated' END AS decision
      FROM k JOIN r USING (size) JOIN f USING (size))"""


def _size_verdicts(spark, sf):
    n = F.size("log_samples")
    size = B.scenarios(spark, sf).select(
        F.col("name").alias("scenario"),
        F.when(n <= 2, "small").when(n <= 6, "medium").otherwise("large").alias("size"))
    pairs = reused(_pairs(spark, sf).join(size, "scenario"))
    boot = S.paired_bootstrap(pairs, iters=2000, by=["size"])
    failures = pairs.groupBy("size").agg(F.count_if("after_failed").alias("parse_failures"))
    return S.effect_verdict(S.with_power(boot).join(failures, "size"))


@query("effect_verdict", sql(_BY_SIZE + """
SELECT size, round(observed, 6) AS observed, round(mde, 6) AS mde, parse_failures, decision FROM x""", "b_fact", "b_scenario"))
def effect_verdict(spark, sf):
    return _size_verdicts(spark, sf).select(
        "size", r6("observed").alias("observed"), r6("mde").alias("mde"), "parse_failures", "decision")


@query("effect_gaps", sql(_BY_SIZE + """
SELECT a.size AS "left", b.size AS "right", round(b.observed - a.observed, 6) AS gap FROM x a JOIN x b ON a.size < b.size""", "b_fact", "b_scenario"))
def effect_gaps(spark, sf):
    return S.effect_gaps(_size_verdicts(spark, sf), "size").withColumn("gap", r6("gap"))


@query("compare_arms", sql(f"""
SELECT scenario, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff,
  CASE WHEN abs(abs(diff) - 0.5) < 0.06 THEN 'verdict' WHEN abs(abs(diff) - 0.4) < 0.06 THEN 'citation'
    WHEN abs(abs(diff) - 0.9) < 0.06 THEN 'verdict+citation' WHEN abs(abs(diff) - 0.1) < 0.06 THEN 'format' ELSE 'other' END AS component
FROM ({_PAIRS}) WHERE abs(diff) > 1e-9""", "b_fact"))
def compare_arms(spark, sf):
    return S.compare_arms(_pairs(spark, sf)).withColumns({c: r6(c) for c in ("a", "b", "diff")})


@query("failure_overlap", sql("""
WITH f AS (SELECT run, scenario, count(*) FILTER (verdict = 'PASS') = 0 AS failed FROM b_result GROUP BY 1, 2)
SELECT count(*) FILTER (a.failed AND b.failed) AS both_fail, count(*) FILTER (a.failed AND NOT b.failed) AS only_left,
  count(*) FILTER (NOT a.failed AND b.failed) AS only_right, count(*) FILTER (NOT a.failed AND NOT b.failed) AS "none"
FROM f a JOIN f b ON a.scenario = b.scenario AND a.run = 'base' AND b.run = 'trained'""", "b_result"))
def failure_overlap(spark, sf):
    stats = M.scenario_stats(_results(spark, sf))
    return S.failure_overlap(stats.select(
        F.col("run").alias("arm"), "scenario", (F.col("passes") == 0).alias("failed")), "base", "trained")


# ---- ROC -------------------------------------------------------------------------------


def _scored(spark, sf):
    return B.probabilities(spark, sf).select(
        "idx", "label", S.verdict_prob(F.col("true_p"), F.col("false_p")).alias("score"))


@query("verdict_prob", sql("SELECT scenario, round(score, 6) AS p FROM b_prob", "b_prob"))
def verdict_prob(spark, sf):
    return B.probabilities(spark, sf).select(
        "scenario", r6(S.verdict_prob(F.col("true_p"), F.col("false_p"))).alias("p"))


_ROC = """WITH t AS (SELECT count(*) FILTER (label) AS np, count(*) FILTER (NOT label) AS nn FROM b_prob),
r AS (SELECT row_number() OVER w AS pos, score AS threshold, count(*) FILTER (label) OVER w AS tp, count(*) FILTER (NOT label) OVER w AS fp
  FROM b_prob WINDOW w AS (ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING)),
p AS (SELECT 0::BIGINT AS pos, 1.01::DOUBLE AS threshold, 0.0::DOUBLE AS tpr, 0.0::DOUBLE AS fpr
  UNION ALL SELECT pos, threshold, CASE WHEN np = 0 THEN 0 ELSE tp / np::DOUBLE END, CASE WHEN nn = 0 THEN 0 ELSE fp / nn::DOUBLE END FROM r, t)"""


@query("roc_points", sql(_ROC + " SELECT pos, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM p", "b_prob"))
def roc_points(spark, sf):
    return S.roc_points(_scored(spark, sf)).select("pos", *[r6(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("auc", sql("""
SELECT (SELECT count(*) FROM b_prob WHERE label) AS positives, (SELECT count(*) FROM b_prob WHERE NOT label) AS negatives,
  round(sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 6) AS auc
FROM b_prob p, b_prob n WHERE p.label AND NOT n.label""", "b_prob"))
def auc(spark, sf):
    return S.auc(_scored(spark, sf)).withColumn("auc", r6("auc"))


@query("best_threshold", sql(_ROC + " SELECT round(threshold, 6) AS threshold, round(tpr - fpr, 6) AS j FROM p ORDER BY tpr - fpr DESC, pos LIMIT 1", "b_prob"))
def best_threshold(spark, sf):
    return S.best_threshold(S.roc_points(_scored(spark, sf))).select(
        r6("threshold").alias("threshold"), r6("j").alias("j"))


# ---- probes and calibration --------------------------------------------------------------


def _passing(spark, sf):
    t = _results(spark, sf)
    return PR.passing_answers(t.withColumn("file", F.col("run")).withColumn("line_no", F.col("trial")))


_PASSING = "SELECT scenario, arg_min(answer, (run, trial)) AS answer FROM b_result WHERE verdict = 'PASS' GROUP BY 1"


@query("passing_answers", sql(_PASSING, "b_result"))
def passing_answers(spark, sf):
    return _passing(spark, sf)


@query("pick_balanced", sql(f"""
WITH a AS ({_PASSING}), y AS (SELECT scenario FROM a WHERE contains(answer, '근거 발견: 예') ORDER BY 1 LIMIT 20),
n AS (SELECT scenario, row_number() OVER (ORDER BY scenario) AS rn FROM a WHERE contains(answer, '근거 발견: 아니오'))
SELECT scenario, 'yes' AS polarity FROM y
UNION ALL SELECT scenario, 'no' FROM n WHERE rn <= 40 - (SELECT count(*) FROM y)""", "b_result"))
def pick_balanced(spark, sf):
    return PR.pick_balanced(_passing(spark, sf), 40)


_FLAT = f"""SELECT scenario, answer, regexp_extract(answer, '(?m)^요약: (.*)$', 1) AS summary,
  regexp_extract(answer, '(?m)^근거 발견: (예|아니오)$', 1) = '예' AS yes,
  regexp_extract(answer, '(?m)^원인 가설: (.*)$', 1) AS cause, substr(answer, instr(answer, chr(10) || '제안 조치:') + 1) AS actions
FROM ({_PASSING}) WHERE starts_with(answer, '요약: ')"""


@query("flat_answer_parse", sql(f"SELECT scenario, summary, yes, cause, actions FROM ({_FLAT})", "b_result"))
def flat_answer_parse(spark, sf):
    return _passing(spark, sf).select("scenario", PR.flat_parts(F.col("answer")).alias("f")).filter(
        "f IS NOT NULL").select("scenario", "f.*")


_MUT = "(VALUES " + ", ".join(
    f"({q(n)}, {q(v)}, {q(s)}, {q(c) if c else 'NULL'})" for n, v, s, c in K.MUTATIONS) + ") m(mutation, expected_verdict, kind, claim)"
_PROBES = f"""SELECT f.scenario, mutation, expected_verdict, kind,
  '요약: ' || CASE mutation WHEN 'benign-paraphrase' THEN {q(K.PARAPHRASE_START)} || f.summary WHEN 'hedged-summary' THEN f.summary || {q(K.HEDGE_END)} ELSE f.summary END
  || chr(10) || '근거 발견: ' || CASE WHEN yes <> (mutation = 'verdict-flip') THEN '예' ELSE '아니오' END
  || chr(10) || '원인 가설: ' || coalesce(claim, cause) || chr(10)
  || CASE WHEN mutation = 'no-actions' THEN '제안 조치: (없음)' ELSE actions END AS answer
FROM ({_FLAT}) f JOIN b_scenario s ON s.name = f.scenario, {_MUT}
WHERE CASE mutation WHEN 'fabricated-cause' THEN NOT yes WHEN 'component-swap' THEN yes WHEN 'vague-cause' THEN yes
  WHEN 'no-actions' THEN NOT contains(rubric, '언급') AND NOT contains(rubric, '명시') ELSE true END"""


def _probes(spark, sf, which="all"):
    rubrics = B.scenarios(spark, sf).select(F.col("name").alias("scenario"), "rubric")
    return PR.build_probes(_passing(spark, sf).join(rubrics, "scenario"), which)


@query("build_probes", sql(f"SELECT scenario, mutation, expected_verdict, answer FROM ({_PROBES})", "b_result", "b_scenario"))
def build_probes(spark, sf):
    return _probes(spark, sf)


@query("build_probes_gross", sql(f"SELECT scenario, mutation, expected_verdict, answer FROM ({_PROBES}) WHERE kind = 'gross'", "b_result", "b_scenario"))
def build_probes_gross(spark, sf):
    return _probes(spark, sf, "gross")


@query("build_probes_subtle", sql(f"SELECT scenario, mutation, expected_verdict, answer FROM ({_PROBES}) WHERE kind = 'subtle'", "b_result", "b_scenario"))
def build_probes_subtle(spark, sf):
    return _probes(spark, sf, "subtle")


# The probe's own digest stands in for the judge: a verdict per probe, some of them wrong.
_JUDGED = f"SELECT *, CASE WHEN left(md5(answer), 1) IN ('0', '1', '2') THEN CASE expected_verdict WHEN 'PASS' THEN 'FAIL' ELSE 'PASS' END ELSE expected_verdict END AS verdict FROM ({_PROBES})"


def _judged(spark, sf):
    wrong = F.substring(F.md5("answer"), 1, 1).isin("0", "1", "2")
    want = F.col("expected_verdict")
    return _probes(spark, sf).withColumn("verdict", F.when(
        wrong, F.when(want == "PASS", "FAIL").otherwise("PASS")).otherwise(want))


@query("calibration", sql(f"""
SELECT coalesce(mutation, 'all') AS mutation, CASE WHEN min(expected_verdict) = max(expected_verdict) THEN min(expected_verdict) ELSE 'mixed' END AS expected_verdict,
  count(*) AS total, count(*) FILTER (verdict = expected_verdict) AS agreed,
  round(count(*) FILTER (verdict = expected_verdict) / count(*)::DOUBLE, 6) AS agreement,
  count(*) FILTER (expected_verdict = 'FAIL' AND verdict = 'PASS') AS missed,
  count(*) FILTER (expected_verdict = 'PASS' AND verdict = 'FAIL') AS over_strict
FROM ({_JUDGED}) GROUP BY ROLLUP (mutation)""", "b_result", "b_scenario"))
def calibration(spark, sf):
    return M.calibration(_judged(spark, sf)).withColumn("agreement", r6("agreement"))


_FLAG = f"""WITH p AS ({_PROBES}), c AS (SELECT p.scenario, mutation, s.alertname, s.summary AS a_summary, s.description, s.job, s.log_samples,
  regexp_extract(answer, '(?m)^요약: (.*)$', 1) || chr(10) || regexp_extract(answer, '(?m)^원인 가설: (.*)$', 1) || chr(10)
   || substr(answer, instr(answer, chr(10) || '제안 조치:') + 1) AS said FROM p JOIN b_scenario s ON s.name = p.scenario),
h AS (SELECT scenario, mutation, said, array_to_string(log_samples, chr(10)) || chr(10) || a_summary || chr(10) || description || chr(10) || alertname
   || chr(10) || job || CASE WHEN alertname = 'IpBanRateSpike' THEN ' ip-blocking' ELSE '' END AS hay FROM c),
x AS (SELECT mutation, len(list_filter(regexp_extract_all(said, '\\b(?:stream|streamKey)\\s*[=:]?\\s*([a-z]+:[a-z]+|[a-z]{{4,}})\\b', 1)
    || regexp_extract_all(said, '\\b([A-Z][A-Za-z]*(?:Consumer|Processor|Sweeper|Service|Handler|Factory))\\b', 1)
    || regexp_extract_all(said, '\\brecordId[=:]\\s*(\\d{{13}}-\\d+)\\b', 1) || regexp_extract_all(said, '(/rooms(?:/[A-Za-z0-9-]+)*)', 1),
    lambda v: NOT contains(hay, v))) > 0 AS flagged FROM h),
d AS (SELECT count(*) FILTER (mutation = 'component-swap') AS targets, count(*) FILTER (mutation = 'component-swap' AND flagged) AS detected,
  count(*) FILTER (mutation IN ('unmutated', 'benign-paraphrase', 'vague-cause')) AS controls,
  count(*) FILTER (mutation IN ('unmutated', 'benign-paraphrase', 'vague-cause') AND flagged) AS false_alarms FROM x)
SELECT *, round(detected / targets::DOUBLE, 6) AS detection_rate,
  CASE WHEN false_alarms > 0 THEN 'reject' WHEN detected / targets::DOUBLE >= 0.6 THEN 'adopt' ELSE 'hold' END AS decision FROM d"""


@query("detector_verdict", sql(_FLAG, "b_result", "b_scenario"))
def detector_verdict(spark, sf):
    flags = PR.detector_flags(_probes(spark, sf), B.scenarios(spark, sf))
    return M.detector_verdict(flags).withColumn("detection_rate", r6("detection_rate"))


@query("rule_judge_agreement", sql("""
WITH j AS (SELECT f.strict_ok, r.verdict FROM b_fact f JOIN b_result r ON r.run = f.arm AND r.scenario = f.scenario AND r.trial = f.sample_idx + 2)
SELECT count(*) AS total, count(*) FILTER (strict_ok = (verdict = 'PASS')) AS agree,
  count(*) FILTER (NOT strict_ok AND verdict = 'PASS') AS rule_stricter, count(*) FILTER (strict_ok AND verdict <> 'PASS') AS rule_looser,
  round(count(*) FILTER (strict_ok = (verdict = 'PASS')) / count(*)::DOUBLE, 6) AS agreement,
  count(*) FILTER (strict_ok = (verdict = 'PASS')) / count(*)::DOUBLE >= 0.6 AS adopt FROM j""", "b_fact", "b_result"))
def rule_judge_agreement(spark, sf):
    rule = fact(spark, sf).select(
        F.col("arm").alias("run"), "scenario", (F.col("sample_idx") + 2).alias("trial"),
        F.col("strict_ok").alias("rule_ok"))
    rows = rule.join(_results(spark, sf).select("run", "scenario", "trial", "verdict"), ["run", "scenario", "trial"])
    return M.rule_judge_agreement(rows).withColumn("agreement", r6("agreement"))
