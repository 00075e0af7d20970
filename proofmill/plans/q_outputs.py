"""Queries: sources and sinks, prompts, parsing, grounding, verification, reward."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as K
from ..functions import jsontext as J
from ..functions.text import render_rule
from ..operators import metrics as M, outputs as O, prompts as P, replay
from ..session import reused
from ..sources import readers, sinks
from . import bridge as B
from .oracle import JUDGED_FLAG, JUDGED_PASS, judged_number, q, sql
from .registry import joined, query, r6, scratch


def fact(spark, sf):
    return O.score_outputs(B.outputs(spark, sf), B.scenarios(spark, sf))


def _file_rows(df):
    """Scenario rows in the file layout: (file, raw)."""
    text = F.to_json(F.struct(
        "name", "question", "rubric", "source", "alert", F.col("log_samples").alias("logSamples"),
        F.col("log_environment").alias("logEnvironment"), "expected"))
    return df.select(F.concat("name", F.lit(".json")).alias("file"), text.alias("raw"), "seq")


# ---- sources ---------------------------------------------------------------------------


@query("load_scenarios", sql("""
SELECT name, '알림의 원인은?' AS question, alertname, CAST(len(log_samples) AS INTEGER) AS n_lines,
  CAST(list_sum(list_transform(log_samples, lambda x: len(x))) AS BIGINT) AS n_chars, expected, job
FROM b_scenario""", "b_scenario"))
def load_scenarios(spark, sf):
    rows = readers.parse_scenario_files(_file_rows(B.scenarios(spark, sf)))
    return rows.select(
        "name", "question", F.col("alert.alertname"), F.size("log_samples").alias("n_lines"),
        F.aggregate("log_samples", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"),
        "expected", F.col("alert.labels")["job"].alias("job"))


@query("ingest_candidates", sql("""
SELECT CASE WHEN doc_id % 29 = 3 THEN 'file-' || doc_id ELSE name END AS name, doc_id % 29 = 3 AS unreadable,
  CASE WHEN doc_id % 29 = 3 THEN 0 WHEN f = 18 THEN 7 ELSE 8 END AS n_present,
  CASE WHEN doc_id % 29 = 3 THEN NULL ELSE CAST(len(log_samples) AS INTEGER) END AS n_lines
FROM b_candidate""", "b_candidate"))
def ingest_candidates(spark, sf):
    files = _file_rows(B.candidates(spark, sf))
    cut = F.col("seq") % 29 == 3
    files = files.select(
        F.concat(F.lit("file-"), F.col("seq").cast("string"), F.lit(".json")).alias("file"),
        F.when(cut, F.substr("raw", F.lit(1), F.length("raw") - 1)).otherwise(F.col("raw")).alias("raw"))
    rows = readers.parse_scenario_files(files)
    return rows.select(
        F.coalesce("name", F.regexp_replace("file", r"\.json$", "")).alias("name"), "unreadable",
        F.size("present").alias("n_present"), F.size("log_samples").alias("n_lines"))


@query("load_log_lines", sql("SELECT seq, ts_ns, line FROM b_log_line", "b_log_line"))
def load_log_lines(spark, sf):
    rows = B.log_lines(spark, sf)
    text = F.to_json(F.struct(F.col("ts_ns").cast("string").alias("ts"), "line"))
    feed = rows.select(F.col("seq").alias("pos"), F.explode(F.array(text, F.lit(" \t"))).alias("value"))
    return readers.parse_log_lines(feed).select(F.col("pos").alias("seq"), "ts_ns", "line")


@query("log_line_problems", sql("""
SELECT seq, seq % 97 = 0 AS broken, CASE WHEN seq % 97 <> 0 THEN ts_ns END AS ts_ns, CASE WHEN seq % 97 <> 0 THEN line END AS line
FROM b_log_line""", "b_log_line"))
def log_line_problems(spark, sf):
    """Cut-off JSON lines stay as rows that say so."""
    text = F.to_json(F.struct(F.col("ts_ns").cast("string").alias("ts"), "line"))
    feed = B.log_lines(spark, sf).select(F.col("seq").alias("pos"), F.when(
        F.col("seq") % 97 == 0, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("value"))
    return readers.parse_log_lines(feed, keep_broken=True).select(F.col("pos").alias("seq"), "broken", "ts_ns", "line")


@query("scenario_missing_fields", sql("""
SELECT name, CASE seq % 13 WHEN 5 THEN 'alert.severity' WHEN 6 THEN 'question' WHEN 7 THEN 'alert.fingerprint|alert.summary' ELSE '' END AS missing
FROM b_scenario""", "b_scenario"))
def scenario_missing_fields(spark, sf):
    """Files that lack a field, in the alert or beside it."""
    at = lambda *n: (F.col("seq") % 13).isin(*n)
    without = lambda on, value: F.when(~on, value)
    a = F.col("alert")
    rows = B.scenarios(spark, sf).withColumn("alert", a.withField("severity", without(at(5), a["severity"]))
        .withField("fingerprint", without(at(7), a["fingerprint"])).withField("summary", without(at(7), a["summary"])))
    rows = rows.withColumn("question", without(at(6), F.col("question")))
    return readers.parse_scenario_files(_file_rows(rows)).select("name", joined(readers.missing_fields()).alias("missing"))


@query("score_twin_names", sql("""
SELECT arm, count(*) AS n, count(*) FILTER (expects_yes) AS expects_yes, round(sum(reward), 6) AS reward FROM b_fact GROUP BY 1""", "b_fact"))
def score_twin_names(spark, sf):
    """Every scenario has an older twin of its name; the later one counts and outputs do not multiply."""
    s = B.scenarios(spark, sf)
    older = s.withColumns({"seq": F.col("seq") - 10**9, "expected": F.lit(""), "rubric": F.lit("정답")})
    return O.score_outputs(B.outputs(spark, sf), older.unionByName(s)).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("expects_yes").alias("expects_yes"), F.round(F.sum("reward"), 6).alias("reward"))


@query("load_rules", sql("""
SELECT name, CASE WHEN seq % 3 <> 0 THEN severity END AS severity, summary AS rendered FROM b_last_rule""", "b_last_rule"))
def load_rules(spark, sf):
    last = replay.last_rule_per_name(B.rules(spark, sf))
    return last.select("name", "severity", render_rule(F.col("summary")).alias("rendered"))


def _members(spark, sf):
    manifest = B.scenarios(spark, sf).select(F.create_map(
        F.when(F.col("labelled"), "test").otherwise("dev"), F.array("name")).alias("members"))
    return readers.explode_splits(manifest)


@query("split_members", sql("""
SELECT CASE WHEN quality IS NULL THEN 'dev' ELSE 'test' END AS split, name FROM b_scenario""", "b_scenario"))
def split_members(spark, sf):
    return _members(spark, sf)


@query("split_filter", sql("SELECT name, expected FROM b_scenario WHERE quality IS NOT NULL", "b_scenario"))
def split_filter(spark, sf):
    return readers.split_filter(B.scenarios(spark, sf), _members(spark, sf), "test").select("name", "expected")


@query("split_integrity", sql("""
WITH m AS (SELECT CASE WHEN quality IS NULL THEN 'dev' ELSE 'test' END AS split, name FROM b_scenario
  UNION ALL SELECT 'dev', name FROM b_scenario WHERE toxic = 1
  UNION ALL SELECT 'test', name FROM b_benchmark)
SELECT 'in_two_splits' AS problem, name FROM m GROUP BY name HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'unassigned', name FROM b_candidate WHERE name NOT IN (SELECT name FROM m) GROUP BY name
UNION ALL SELECT 'unknown_member', name FROM m WHERE name NOT IN (SELECT name FROM b_candidate) GROUP BY name""",
    "b_scenario", "b_benchmark", "b_candidate"))
def split_integrity(spark, sf):
    from ..operators.dedup import split_integrity as check
    toxic = B.table(spark, sf, "labels").filter("toxic = 1").select(
        F.lit("dev").alias("split"), F.concat(F.lit("monitor-doc-"), F.col("doc_id").cast("string")).alias("name"))
    extra = B.benchmark_scenarios(spark, sf).select(F.lit("test").alias("split"), "name")
    members = _members(spark, sf).unionByName(toxic).unionByName(extra)
    return check(members, B.candidates(spark, sf))


# ---- prompts -----------------------------------------------------------------------------


@query("expects_evidence", sql("SELECT name, expects_yes FROM b_scenario", "b_scenario"))
def expects_evidence(spark, sf):
    return O.with_expectation(B.scenarios(spark, sf)).select("name", "expects_yes")


@query("prompt_table", sql("SELECT scenario AS name, md5(\"user\") AS digest, CAST(len(\"user\") AS INTEGER) AS chars FROM b_chat", "b_chat"))
def prompt_table(spark, sf):
    return P.with_prompt(B.scenarios(spark, sf)).select(
        "name", F.md5("prompt").alias("digest"), F.length("prompt").alias("chars"))


_BASE = "로그를 보고 판정하라.\n\n없는 수치를 지어내지 마라.\n설명 텍스트 없이 JSON만 답하라."
VARIANTS = P.PromptVariants(_BASE, {
    "mechanism": ("\n- 지표를 움직인 주체와 로그의 주체가 같은지 보라.", K.ANALYSER_MARKER),
    "graph": ("\n\n## 구성 요소\n발행과 소비는 다른 구간이다.", None),
    "graph-strict": ("\n\n## 구성 요소\n발행과 소비는 다른 구간이다.\n배제에만 써라.", None),
})


@query("prompt_variants", sql(f"""
WITH v AS (SELECT unnest(['production', 'mechanism', 'graph', 'graph-strict']) AS variant,
  unnest([{q(_BASE)},
    replace({q(_BASE)}, {q(K.ANALYSER_MARKER)}, {q(VARIANTS.rules['mechanism'][0])} || {q(K.ANALYSER_MARKER)}),
    {q(_BASE)} || {q(VARIANTS.rules['graph'][0])}, {q(_BASE)} || {q(VARIANTS.rules['graph-strict'][0])}]) AS system)
SELECT c.scenario AS name, v.variant, md5(v.system) AS system_digest, md5(c."user") AS prompt_digest
FROM b_chat c, v""", "b_chat"))
def prompt_variants(spark, sf):
    return P.prompt_variants(B.scenarios(spark, sf), VARIANTS).select(
        "name", "variant", F.md5("system").alias("system_digest"), F.md5("prompt").alias("prompt_digest"))


@query("judge_prompts", sql(f"""
SELECT t.run, t.scenario, t.trial, md5('[질문]' || chr(10) || '알림의 원인은?' || chr(10) || chr(10) || '[채점 기준]' || chr(10)
  || s.rubric || chr(10) || chr(10) || '[봇의 답변]' || chr(10) || t.answer || chr(10)) AS digest
FROM b_result t JOIN b_scenario s ON s.name = t.scenario""", "b_result", "b_scenario"))
def judge_prompts(spark, sf):
    s = B.scenarios(spark, sf)
    t = O.trial_results(B.trials(spark, sf), s)
    j = t.join(s.select(F.col("name").alias("scenario"), "question", "rubric"), "scenario")
    return j.select("run", "scenario", "trial", F.md5(P.judge_prompt(
        F.col("question"), F.col("rubric"), F.col("answer"))).alias("digest"))


_JUDGE = "답을 채점하라.\n근거를 로그에서 찾아라.\n설명 텍스트 없이 JSON만 답하라."
JUDGE_VARIANTS = P.PromptVariants(_JUDGE, {"specificity": ("\n- 원인이 구체적인지 보라.", K.JUDGE_MARKER)})


@query("judge_variants", sql(f"""
WITH v AS (SELECT unnest(['production', 'specificity']) AS variant,
  unnest([{q(_JUDGE)}, replace({q(_JUDGE)}, {q(K.JUDGE_MARKER)}, {q(JUDGE_VARIANTS.rules['specificity'][0])} || {q(K.JUDGE_MARKER)})]) AS system)
SELECT t.run, t.scenario, t.trial, v.variant, md5(v.system) AS system_digest, md5('[질문]' || chr(10) || '알림의 원인은?' || chr(10)
  || chr(10) || '[채점 기준]' || chr(10) || s.rubric || chr(10) || chr(10) || '[봇의 답변]' || chr(10) || t.answer || chr(10)) AS prompt_digest
FROM b_result t JOIN b_scenario s ON s.name = t.scenario, v""", "b_result", "b_scenario"))
def judge_variants(spark, sf):
    s = B.scenarios(spark, sf)
    t = O.trial_results(B.trials(spark, sf), s).join(
        s.select(F.col("name").alias("scenario"), "question", "rubric"), "scenario")
    return P.judge_variants(t, JUDGE_VARIANTS).select(
        "run", "scenario", "trial", "variant", F.md5("system").alias("system_digest"), F.md5("prompt").alias("prompt_digest"))


@query("screen_prompts", sql("""
SELECT seq, md5('[알림]' || chr(10) || alertname || ' (' || severity || ')' || chr(10) || '요약: ' || summary || chr(10)
  || '설명: ' || description || chr(10) || chr(10) || '[로그]'
  || array_to_string(list_transform(log_samples, lambda x: chr(10) || '- ' || x), '')
  || chr(10) || chr(10) || '[채점 기준]' || chr(10) || rubric || chr(10)) AS digest FROM b_candidate""", "b_candidate"))
def screen_prompts(spark, sf):
    return B.candidates(spark, sf).select("seq", F.md5(P.screen_prompt(
        F.col("alert"), F.col("log_samples"), F.col("rubric"))).alias("digest"))


# ---- parsing and grounding ---------------------------------------------------------------


def _parsed(spark, sf):
    return O.parse_outputs(B.outputs(spark, sf))


KEYS = ("arm", "scenario", "sample_idx")


@query("extract_json", sql("""
SELECT arm, scenario, sample_idx, CASE WHEN c = 6 THEN '[' ELSE '{' END AS opens,
  CASE WHEN c = 6 THEN ']' WHEN c = 5 THEN '"' ELSE '}' END AS closes, c NOT IN (5, 6) AS is_object
FROM b_case""", "b_case"))
def extract_json(spark, sf):
    found = O.extract_objects(B.outputs(spark, sf))
    return found.select(
        *KEYS, F.substring("json", 1, 1).alias("opens"), F.substring("json", -1, 1).alias("closes"),
        J.parse_object(F.col("json")).isNotNull().alias("is_object"))


@query("parse_analysis", sql("""
SELECT arm, scenario, sample_idx, parse_failed,
  CASE WHEN NOT parse_failed THEN summary END AS summary, CASE WHEN NOT parse_failed THEN cause END AS cause,
  CASE WHEN NOT parse_failed THEN array_to_string(actions, '|') END AS actions,
  CASE WHEN NOT parse_failed THEN claimed END AS evidence_found,
  CASE WHEN NOT parse_failed THEN md5(evidence_line) END AS evidence FROM b_analysis""", "b_analysis"))
def parse_analysis(spark, sf):
    a = F.col("analysis")
    return _parsed(spark, sf).select(
        *KEYS, "parse_failed", a["summary"].alias("summary"), a["root_cause_hypothesis"].alias("cause"),
        joined(a["suggested_actions"]).alias("actions"), a["evidence_found"].alias("evidence_found"),
        F.md5(a["evidence_line"]).alias("evidence"))


@query("parse_judge", sql("""
SELECT run, scenario, trial, {acc} AS accuracy, {gro} AS groundedness, {flag} AS hallucination_detected,
  CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN NOT is_judged THEN 'judge answer is not a JSON object' ELSE coalesce(json_extract_string(judged, '$.rationale'), '') END AS rationale
FROM b_trial""".format(acc=judged_number("accuracy"), gro=judged_number("groundedness"), flag=JUDGED_FLAG, ok=JUDGED_PASS), "b_trial"))
def parse_judge(spark, sf):
    return O.parse_scores(B.trials(spark, sf)).select("run", "scenario", "trial", "score.*")


@query("grounding", sql(f"""
SELECT arm, scenario, sample_idx, claimed, grounded,
  CASE WHEN parse_failed THEN NULL WHEN grounded THEN summary ELSE {q(K.NO_EVIDENCE_SUMMARY)} END AS summary,
  CASE WHEN parse_failed THEN NULL WHEN grounded THEN cause ELSE '' END AS cause FROM b_fact""", "b_fact"))
def grounding(spark, sf):
    rows = O.ground(O.attach_scenarios(_parsed(spark, sf), B.scenarios(spark, sf)))
    return rows.select(*KEYS, "claimed", "grounded", F.col("settled.summary").alias("summary"),
                       F.col("settled.root_cause_hypothesis").alias("cause"))


@query("flatten_answer", sql("SELECT run, scenario, trial, CASE WHEN NOT failed THEN answer END AS answer FROM b_result", "b_result"))
def flatten_answer(spark, sf):
    rows = O.ground(O.attach_scenarios(O.parse_outputs(B.trials(spark, sf)), B.scenarios(spark, sf)))
    return rows.select("run", "scenario", "trial", O.flatten_answer(F.col("settled")).alias("answer"))


@query("outcomes", sql("""
SELECT arm, scenario, sample_idx, expects_yes, parse_failed, claimed, grounded FROM b_fact""", "b_fact"))
def outcomes(spark, sf):
    return O.outcomes(B.outputs(spark, sf), B.scenarios(spark, sf))


@query("trial_results", sql("""
SELECT run, scenario, trial, md5(answer) AS answer, accuracy, groundedness, hallucination_detected, verdict, latency_ms, failed
FROM b_result""", "b_result"))
def trial_results(spark, sf):
    rows = O.trial_results(B.trials(spark, sf), B.scenarios(spark, sf))
    return rows.select("run", "scenario", "trial", F.md5("answer").alias("answer"), "accuracy", "groundedness",
                       "hallucination_detected", "verdict", "latency_ms", F.col("error").isNotNull().alias("failed"))


@query("parse_rate", sql("""
SELECT arm, count(*) AS total, count(*) FILTER (NOT parse_failed) AS parsed,
  round(avg(CASE WHEN parse_failed THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS parse_rate FROM b_fact GROUP BY arm""", "b_fact"))
def parse_rate(spark, sf):
    return O.parse_rate(B.outputs(spark, sf), ["arm"]).withColumn("parse_rate", r6("parse_rate"))


# ---- target rules, reward ----------------------------------------------------------------


def _usable(value):
    """The value, null where the output was not usable."""
    return F.when(~F.col("parse_failed"), value)


def _or_failed(reasons):
    """The reasons, or that the output was not usable."""
    return F.when(F.col("parse_failed"), "parse_failed").otherwise(reasons)


def _attached(spark, sf):
    return O.attach_scenarios(_parsed(spark, sf), B.scenarios(spark, sf))


_STRICT = """CASE WHEN NOT claimed OR strict_ok THEN '' WHEN trim(evidence_line) = '' THEN 'empty_citation'
  WHEN grounded THEN 'partial_citation' ELSE 'citation_not_in_logs' END"""
_HAYSTACK = "array_to_string(f.log_samples, chr(10)) || chr(10) || s.summary || chr(10) || s.description || chr(10) || s.alertname || chr(10) || s.job || CASE WHEN s.alertname = 'IpBanRateSpike' THEN ' ip-blocking' ELSE '' END"


def _ids(text: str) -> str:
    pats = [("stream", r"\b(?:stream|streamKey)\s*[=:]?\s*([a-z]+:[a-z]+|[a-z]{4,})\b"),
            ("consumer", r"\b([A-Z][A-Za-z]*(?:Consumer|Processor|Sweeper|Service|Handler|Factory))\b"),
            ("joinCode", r"\bjoinCode[=:]\s*([A-Z0-9]{4})\b"), ("recordId", r"\brecordId[=:]\s*(\d{13}-\d+)\b"),
            ("uri", r"(/rooms(?:/[A-Za-z0-9-]+)*)")]
    parts = [f"list_transform(list_filter(regexp_extract_all({text}, '{p}', 1), lambda v: NOT contains(hay, v)), lambda v: '{n}:' || v)"
             for n, p in pats]
    return "array_to_string(" + " || ".join(parts) + ", '|')"


_ROWS = f"""SELECT f.* EXCLUDE (summary), f.summary AS summary, {_HAYSTACK} AS hay
  FROM b_fact f JOIN b_scenario s ON s.name = f.scenario"""


@query("citation_strict", sql(f"""
SELECT arm, scenario, sample_idx, CASE WHEN parse_failed THEN 'parse_failed' ELSE {_STRICT} END AS reasons FROM b_fact""", "b_fact"))
def citation_strict(spark, sf):
    return _attached(spark, sf).select(*KEYS, _or_failed(joined(
        O.citation_reasons(F.col("analysis"), F.col("log_samples")))).alias("reasons"))


@query("verify_target", sql(f"""
WITH r AS ({_ROWS}), v AS (SELECT *,
  CASE WHEN claimed AND cause = '' THEN 'claim_without_cause' ELSE '' END AS v_schema,
  CASE WHEN claimed <> expects_yes THEN CASE WHEN expects_yes THEN 'expected_yes' ELSE 'expected_no' END ELSE '' END AS v_verdict,
  {_STRICT} AS v_citation, CASE WHEN NOT claimed AND cause <> '' THEN 'cause_without_evidence' ELSE '' END AS v_cause,
  {_ids("(summary || chr(10) || cause)")} AS v_identifier FROM r)
SELECT arm, scenario, sample_idx, {", ".join(f"CASE WHEN NOT parse_failed THEN {c} END AS {c}" for c in ("v_schema", "v_verdict", "v_citation", "v_cause", "v_identifier"))},
  CASE WHEN parse_failed THEN 'parse_failed' WHEN v_schema <> '' THEN 'schema' WHEN v_verdict <> '' THEN 'verdict' WHEN v_citation <> '' THEN 'citation'
    WHEN v_cause <> '' THEN 'no-cause' WHEN v_identifier <> '' THEN 'identifier' END AS first_rule FROM v""", "b_fact", "b_scenario"))
def verify_target(spark, sf):
    get = lambda rule: _usable(joined(F.col("failures")[rule]))
    return O.verify_target(_attached(spark, sf)).select(
        *KEYS, get("schema").alias("v_schema"), get("verdict").alias("v_verdict"), get("citation").alias("v_citation"),
        get("no-cause").alias("v_cause"), get("identifier").alias("v_identifier"),
        _or_failed(F.col("first_rule")).alias("first_rule"))


def _identifier_query(check):
    def run(spark, sf):
        return _attached(spark, sf).select(*KEYS, _or_failed(joined(check(
            F.col("analysis"), F.col("log_samples"), F.col("alert")))).alias("reasons"))
    return run


query("identifiers_grounded", sql(f"""WITH r AS ({_ROWS})
SELECT arm, scenario, sample_idx, CASE WHEN parse_failed THEN 'parse_failed' ELSE {_ids("(summary || chr(10) || cause)")} END AS reasons FROM r""", "b_fact", "b_scenario"))(
    _identifier_query(O.identifiers_grounded))
query("fabricated_identifiers", sql(f"""WITH r AS ({_ROWS})
SELECT arm, scenario, sample_idx, CASE WHEN parse_failed THEN 'parse_failed'
  ELSE {_ids("(summary || chr(10) || cause || chr(10) || array_to_string(actions, chr(10)))")} END AS reasons FROM r""",
    "b_fact", "b_scenario"))(_identifier_query(O.no_fabricated_identifiers))


@query("repair_citation", sql("""
SELECT arm, scenario, sample_idx,
  CASE WHEN NOT parse_failed THEN md5(CASE WHEN n <> '' AND NOT list_contains(log_samples, n) AND len(h) = 1 THEN h[1] ELSE evidence_line END) END AS line,
  CASE WHEN NOT parse_failed THEN n <> '' AND NOT list_contains(log_samples, n) AND len(h) = 1 END AS repaired
FROM (SELECT *, trim(evidence_line) AS n, list_filter(log_samples, lambda x: contains(x, trim(evidence_line))) AS h
      FROM b_fact)""", "b_fact"))
def repair_citation(spark, sf):
    rows = _attached(spark, sf).withColumn("fixed", O.repair_citation(F.col("analysis"), F.col("log_samples")))
    return rows.select(*KEYS, _usable(F.md5("fixed.evidence_line")).alias("line"),
                       _usable(F.col("fixed.evidence_line") != F.col("analysis.evidence_line")).alias("repaired"))


_EVIDENCE_CLASSES = r"\b([A-Z][A-Za-z0-9]*(?:Consumer|Processor|Worker|Sweeper|Service|Handler|Factory|Manager|Starter|Recovery|Dispatcher|Filter|Store))\b"


def _evidence_ids(line: str) -> str:
    logger = rf"regexp_extract({line}, '---\s*\[[^\]]*\]\s*(\S+)\s*:', 1)"
    thread = rf"regexp_extract({line}, '---\s*\[\s*redis-stream-thread-pool-([a-z:]+?)\d*\s*\]', 1)"
    return (f"list_sort(list_distinct(list_filter([{logger}, regexp_extract({logger}, '([^.]*)$', 1), {thread}] "
            f"|| regexp_extract_all({line}, '{_EVIDENCE_CLASSES}', 1), lambda x: len(x) >= 4)))")


@query("evidence_identifiers", sql(f"""
SELECT name, i, array_to_string({_evidence_ids("line")}, '|') AS names
FROM (SELECT name, unnest(log_samples) AS line, unnest(range(len(log_samples))) AS i FROM b_scenario)""", "b_scenario"))
def evidence_identifiers(spark, sf):
    lines = B.scenarios(spark, sf).select("name", F.posexplode("log_samples").alias("i", "line"))
    return lines.select("name", F.col("i").cast("long").alias("i"), joined(
        F.array_sort(O.evidence_identifiers(F.col("line")))).alias("names"))


@query("cause_specificity", sql(f"""
SELECT arm, scenario, sample_idx, NOT parse_failed AND (NOT expects_yes OR
  len(list_filter({_evidence_ids("evidence_line")}, lambda x: contains(cause, x))) > 0) AS names_component
FROM b_fact""", "b_fact"))
def cause_specificity(spark, sf):
    return fact(spark, sf).select(*KEYS, "names_component")


@query("reward", sql("SELECT arm, scenario, sample_idx, parse_failed, strict_ok, round(reward, 6) AS reward FROM b_fact", "b_fact"))
def reward(spark, sf):
    return fact(spark, sf).select(*KEYS, "parse_failed", "strict_ok", r6("reward").alias("reward"))


@query("target_json", sql("""
SELECT arm, scenario, sample_idx, parse_failed, json_extract_string(t, '$.summary') AS summary, json_extract_string(t, '$.rootCauseHypothesis') AS cause,
  json_extract_string(t, '$.evidenceFound') AS evidence_found, CAST(json_array_length(t, '$.suggestedActions') AS INTEGER) AS n_actions,
  md5(json_extract_string(t, '$.evidenceLine')) AS evidence, CASE WHEN NOT parse_failed THEN true END AS spaced
FROM (SELECT arm, scenario, sample_idx, parse_failed, CASE WHEN NOT parse_failed THEN to_json({'summary': summary, 'rootCauseHypothesis': cause, 'suggestedActions': actions,
        'evidenceFound': claimed, 'evidenceLine': evidence_line}) END AS t FROM b_analysis)""", "b_analysis"))
def target_json(spark, sf):
    rows = _parsed(spark, sf).withColumn("t", _usable(J.target_json(F.col("analysis"))))
    get = lambda path: F.get_json_object("t", path)
    return rows.select(
        *KEYS, "parse_failed", get("$.summary").alias("summary"), get("$.rootCauseHypothesis").alias("cause"),
        get("$.evidenceFound").alias("evidence_found"),
        F.json_array_length(get("$.suggestedActions")).alias("n_actions"),
        F.md5(get("$.evidenceLine")).alias("evidence"),
        F.col("t").startswith('{"summary": "').alias("spaced"))


@query("chat_samples", sql(f"""
SELECT a.arm, a.sample_idx, c.scenario AS name, a.parse_failed, 3 AS turns, md5({q(B.SYSTEM)}) AS system, md5(c."user") AS user_digest,
  CASE WHEN NOT a.parse_failed THEN a.summary END AS summary
FROM b_chat c JOIN b_analysis a ON a.scenario = c.scenario""", "b_chat", "b_analysis"))
def chat_samples(spark, sf):
    rows = P.chat_samples(_attached(spark, sf), B.SYSTEM)
    m = F.col("messages")
    return rows.select("arm", "sample_idx", F.col("scenario").alias("name"), "parse_failed", F.size(m).alias("turns"),
                       F.md5(m[0]["content"]).alias("system"), F.md5(m[1]["content"]).alias("user_digest"),
                       _usable(F.get_json_object(m[2]["content"], "$.summary")).alias("summary"))


# ---- sinks -------------------------------------------------------------------------------


@query("trial_sink", sql("""
SELECT run, count(*) AS trials, count(*) FILTER (verdict = 'PASS') AS passes FROM b_result GROUP BY run""", "b_result"))
def trial_sink(spark, sf):
    """Two batches, the second one first as a stage that never got committed, and both written again."""
    sink = sinks.trial_sink(spark, scratch(spark, "trials"))
    rows = reused(O.trial_results(B.trials(spark, sf), B.scenarios(spark, sf)))
    sink.stage(rows.where("trial > 1"), "late")
    for _ in range(2):
        sink.write(rows.where("trial <= 1"), "early")
        sink.write(rows.where("trial > 1"), "late")
    return sink.read().groupBy("run").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(F.col("verdict") == "PASS").alias("passes"))


@query("raw_output_fact", sql("""
SELECT arm, count(*) AS n, count(*) FILTER (parse_failed) AS parse_failures, round(sum(reward), 6) AS total FROM b_fact GROUP BY arm""", "b_fact"))
def raw_output_fact(spark, sf):
    sink = sinks.raw_output_sink(spark, scratch(spark, "fact"))
    outs = B.outputs(spark, sf).select("arm", "scenario", "sample_idx", "raw")
    scored = O.with_reward(O.ground(O.attach_scenarios(O.parse_outputs(outs), B.scenarios(spark, sf))))
    parts = [c for c in scored.columns if c.startswith("p_")]
    for _ in range(2):
        sink.write(scored.select(*KEYS, "raw", "reward", "parse_failed", *parts), "outputs")
    return sink.read().groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("parse_failed").alias("parse_failures"),
        r6(F.sum("reward")).alias("total"))


@query("report_rows", sql("""
SELECT arm, printf('%.4f', avg(reward) FILTER (sample_idx = -1)) AS greedy_mean,
  count(*) FILTER (sample_idx = -1 AND expects_yes AND grounded) || '/' || count(*) FILTER (sample_idx = -1 AND expects_yes) AS citation_pass,
  count(*) FILTER (sample_idx = -1 AND NOT expects_yes AND grounded) || '/' || count(*) FILTER (sample_idx = -1 AND NOT expects_yes) AS false_positives
FROM b_fact GROUP BY arm""", "b_fact"))
def report_rows(spark, sf):
    board = M.arm_leaderboard(fact(spark, sf))
    ratio = lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    return board.select("arm", F.format_string("%.4f", "greedy_mean").alias("greedy_mean"),
                        ratio("citation_pass", "positives").alias("citation_pass"),
                        ratio("false_positives", "negatives").alias("false_positives"))


_TODO = "SELECT name, seq FROM b_scenario WHERE name NOT IN (SELECT scenario FROM b_fact WHERE arm = 'base' AND sample_idx = -1 AND NOT parse_failed)"


def _done(spark, sf):
    return _parsed(spark, sf).filter("arm = 'base' AND sample_idx = -1 AND NOT parse_failed").select("scenario")


@query("resume_todo", sql(_TODO, "b_scenario", "b_fact"))
def resume_todo(spark, sf):
    return sinks.todo(B.scenarios(spark, sf), _done(spark, sf)).select("name", "seq")


@query("resume_chunk", sql(_TODO + " ORDER BY seq LIMIT 20", "b_scenario", "b_fact"))
def resume_chunk(spark, sf):
    """The next 20 open scenarios in file order: the chunk size is the feature."""
    return sinks.todo(B.scenarios(spark, sf).select("name", "seq"), _done(spark, sf), 20).select("name", "seq")
