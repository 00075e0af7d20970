"""Model outputs: parse, ground, verify, reward.

Every step adds columns to an outputs table that carries its scenario's columns. Parsing
happens in stages (text -> object text -> variant -> struct) so that no stage is evaluated
more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as K
from ..functions import jsontext as J, text as X
from ..functions.stage import let, once
from ..schemas import RewardSpec

# --------------------------------------------------------------------------------------
# Expectation of a scenario
# --------------------------------------------------------------------------------------


def expects_evidence(expected: Column, rubric: Column) -> Column:
    """Does the scenario expect the verdict yes? The explicit field wins over the rubric,
    of which only the part before the first mention of the right answer is read."""
    stated = F.coalesce(expected, F.lit(""))
    head = F.substring_index(F.coalesce(rubric, F.lit("")), K.RIGHT_WORD, 1)
    return F.when(stated != "", X.strip_ws(stated) == K.YES).otherwise(
        head.contains(K.RUBRIC_YES))


def with_expectation(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumn("expects_yes", expects_evidence(F.col("expected"), F.col("rubric")))


# --------------------------------------------------------------------------------------
# Parsing
# --------------------------------------------------------------------------------------


def extract_objects(outputs: DataFrame, raw: str = "raw", out: str = "json") -> DataFrame:
    return J.with_json(outputs, raw, out)


def parse_outputs(outputs: DataFrame, raw: str = "raw", lenient: bool = True) -> DataFrame:
    """Adds ``analysis`` (null when unusable) and ``parse_failed``.

    ``lenient`` looks for an object inside fences and prose; without it the whole text has
    to be one object.
    """
    find = J.with_json if lenient else J.with_strict_json
    staged = find(outputs, raw, "__json").withColumn("__node", J.parse_object(F.col("__json")))
    parsed = J.with_analysis(staged, "__node", "analysis").drop("__json", "__node")
    return parsed.withColumn("parse_failed", F.col("analysis").isNull())


def parse_scores(judged: DataFrame, raw: str = "judge_raw") -> DataFrame:
    """Adds the judge's ``score`` struct."""
    staged = J.with_strict_json(judged, raw, "__json").withColumn(
        "__node", J.parse_object(F.col("__json")))
    return J.with_score(staged, "__node", "score").drop("__json", "__node")


# --------------------------------------------------------------------------------------
# Grounding
# --------------------------------------------------------------------------------------


def cites_log(evidence: Column, lines: Column) -> Column:
    """Does the citation occur in some line, blanks aside?

    Cheap exact tests come first, over all lines: a citation found stripped or squashed, in a line
    as it is, will also be found in the squashed line. A line without its first or last word cannot
    hold it at all. Without a citation no line is looked at.
    """
    squashed = X.squash_ws(evidence)
    parts = F.struct(
        X.strip_ws(evidence).alias("plain"), squashed.alias("squashed"),
        F.substring_index(squashed, " ", 1).alias("first"),
        F.substring_index(squashed, " ", -1).alias("last"))
    found = let(parts, lambda n: F.when(n["plain"] != "", F.exists(
        lines, lambda line: line.contains(n["plain"]) | line.contains(n["squashed"])) | F.exists(
        lines, lambda line: line.contains(n["first"]) & line.contains(n["last"])
        & X.squash_ws(line).contains(n["squashed"]))))
    return F.coalesce(found, F.lit(False))


GROUNDING_RULES = {"citation-exists": lambda a, logs: cites_log(a["evidence_line"], logs)}


def ground(parsed: DataFrame, rules=None, logs: str = "log_samples") -> DataFrame:
    """Adds ``claimed``, ``grounded`` and the demoted ``settled`` analysis."""
    rules = GROUNDING_RULES if rules is None else rules
    claimed = F.coalesce(F.col("analysis.evidence_found"), F.lit(False))
    holds = claimed
    for rule in rules.values():
        holds = holds & rule(F.col("analysis"), F.col(logs))
    step = once(parsed.withColumn("claimed", claimed), grounded=F.coalesce(holds, F.lit(False)))
    a, g = F.col("analysis"), F.col("grounded")
    return step.withColumn("settled", F.when(a.isNotNull(), F.struct(
        F.when(g, a["summary"]).otherwise(K.NO_EVIDENCE_SUMMARY).alias("summary"),
        F.when(g, a["root_cause_hypothesis"]).otherwise("").alias("root_cause_hypothesis"),
        a["suggested_actions"].alias("suggested_actions"),
        a["evidence_found"].alias("evidence_found"),
        a["evidence_line"].alias("evidence_line"),
        g.alias("grounded"),
    )))


def flatten_answer(settled: Column) -> Column:
    """The text a judge sees; the verdict printed is the grounded one."""
    cause, actions = settled["root_cause_hypothesis"], settled["suggested_actions"]
    return F.concat(
        F.lit(K.SUMMARY_PREFIX), settled["summary"],
        F.lit("\n" + K.VERDICT_PREFIX), F.when(settled["grounded"], K.YES).otherwise(K.NO),
        F.lit("\n" + K.CAUSE_PREFIX), F.when(cause == "", K.NOTHING).otherwise(cause),
        F.lit("\n" + K.ACTIONS_PREFIX),
        F.when(F.size(actions) == 0, f" {K.NOTHING}").otherwise(F.concat(
            F.lit("\n"),
            F.array_join(F.transform(actions, lambda x: F.concat(F.lit("- "), x)), "\n"))),
    )


# --------------------------------------------------------------------------------------
# Target rules: (analysis, scenario row) -> array of reasons, empty when sound
# --------------------------------------------------------------------------------------


def _reasons(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def schema_reasons(a: Column) -> Column:
    return _reasons(
        F.when(X.is_blank(a["summary"]), "empty_summary"),
        F.when(a["evidence_found"] & X.is_blank(a["root_cause_hypothesis"]), "claim_without_cause"),
    )


def verdict_reasons(a: Column, expects_yes: Column) -> Column:
    return _reasons(F.when(
        a["evidence_found"] != expects_yes,
        F.concat(F.lit("expected_"), F.when(expects_yes, "yes").otherwise("no"))))


def citation_reasons(a: Column, lines: Column) -> Column:
    """A claim has to cite one existing log line from end to end."""
    line = X.strip_ws(a["evidence_line"])
    reason = (
        F.when(line == "", "empty_citation")
        .when(F.array_contains(lines, line), F.lit(None))
        .when(~cites_log(a["evidence_line"], lines), "citation_not_in_logs")
        .otherwise("partial_citation")
    )
    return _reasons(F.when(a["evidence_found"], reason))


def cites_whole_line(a: Column, lines: Column) -> Column:
    """Whether ``citation_reasons`` has none: no claim, or one that cites a line end to end."""
    line = X.strip_ws(a["evidence_line"])
    whole = F.coalesce((line != "") & F.array_contains(lines, line), F.lit(False))
    return ~F.coalesce(a["evidence_found"], F.lit(False)) | whole


def cause_reasons(a: Column) -> Column:
    return _reasons(F.when(
        ~a["evidence_found"] & ~X.is_blank(a["root_cause_hypothesis"]), "cause_without_evidence"))


def identifier_reasons(text: Column, lines: Column, alert: Column) -> Column:
    """Identifiers in the text that occur neither in the logs nor in the alert."""
    about = F.concat_ws(
        "\n", alert["summary"], alert["description"], alert["alertname"],
        F.array_join(F.map_values(alert["labels"]), " "))

    def missing(family: str, pattern: str, said: Column, known: Column) -> Column:
        values = F.regexp_extract_all(said, F.lit(X.rx(pattern)), F.lit(1))
        unknown = F.filter(values, lambda v: ~F.lower(v).isin(*K.IDENTIFIER_STOPWORDS)
                           & ~known.contains(v)
                           & ~F.exists(lines, lambda line: line.contains(v)))
        return F.transform(unknown, lambda v: F.concat(F.lit(family + ":"), v))

    return let(F.struct(text.alias("said"), about.alias("known")), lambda x: F.concat(
        *[missing(family, pattern, x["said"], x["known"])
          for family, pattern in K.IDENTIFIER_FAMILIES]))


def identifiers_grounded(a: Column, lines: Column, alert: Column) -> Column:
    return identifier_reasons(
        F.concat_ws("\n", a["summary"], a["root_cause_hypothesis"]), lines, alert)


def no_fabricated_identifiers(a: Column, lines: Column, alert: Column) -> Column:
    """As above, over the actions too."""
    return identifier_reasons(
        F.concat(a["summary"], F.lit("\n"), a["root_cause_hypothesis"],
                 F.array_join(F.transform(a["suggested_actions"],
                                          lambda x: F.concat(F.lit("\n"), x)), "")),
        lines, alert)


TARGET_RULES = {
    "schema": lambda r: schema_reasons(r["analysis"]),
    "verdict": lambda r: verdict_reasons(r["analysis"], r["expects_yes"]),
    "citation": lambda r: citation_reasons(r["analysis"], r["log_samples"]),
    "no-cause": lambda r: cause_reasons(r["analysis"]),
    "identifier": lambda r: identifiers_grounded(r["analysis"], r["log_samples"], r["alert"]),
}


def verify_target(rows: DataFrame, rules=None) -> DataFrame:
    """Adds ``failures`` (rule -> reasons), ``n_reasons`` and ``first_rule`` (null if sound)."""
    rules = TARGET_RULES if rules is None else rules
    view = {c: F.col(c) for c in rows.columns}
    step = once(rows, failures=F.map_from_arrays(
        F.array(*[F.lit(n) for n in rules]), F.array(*[rule(view) for rule in rules.values()])))
    first = F.filter(F.map_entries("failures"), lambda e: F.size(e["value"]) > 0)
    return step.withColumn("n_reasons", F.aggregate(
        F.map_values("failures"), F.lit(0), lambda n, x: n + F.size(x))
    ).withColumn("first_rule", F.get(first, F.lit(0))["key"])


# --------------------------------------------------------------------------------------
# Citation repair, evidence names, reward
# --------------------------------------------------------------------------------------


def repair_citation(a: Column, lines: Column) -> Column:
    """A citation that is part of exactly one line becomes that line."""
    holders = lambda n: F.filter(lines, lambda line: line.contains(n))
    whole = let(X.strip_ws(a["evidence_line"]), lambda n: F.when(
        (n != "") & ~F.array_contains(lines, n),
        let(holders(n), lambda held: F.when(F.size(held) == 1, F.get(held, F.lit(0))))))
    return a.withField("evidence_line", F.coalesce(whole, a["evidence_line"]))


def evidence_identifiers(line: Column) -> Column:
    """Names a log line points at: logger, short class, class-like words, stream keys."""
    logger = F.nullif(F.regexp_extract(line, X.rx(K.EVIDENCE_LOGGER), 1), F.lit(""))
    threads = F.transform(
        F.regexp_extract_all(line, F.lit(X.rx(K.EVIDENCE_THREAD)), F.lit(1)),
        lambda t: F.regexp_extract(X.strip_ws(t), X.rx("^" + K.EVIDENCE_STREAM_THREAD), 1))
    names = F.concat(
        F.array_compact(F.array(logger, F.substring_index(logger, ".", -1))),
        F.regexp_extract_all(line, F.lit(X.rx(K.EVIDENCE_CLASS)), F.lit(1)),
        F.regexp_extract_all(line, F.lit(X.rx(K.EVIDENCE_STREAM_KEY)), F.lit(1)),
        threads,
    )
    return F.array_distinct(F.filter(names, lambda n: F.length(n) >= K.MIN_IDENTIFIER_CHARS))


def names_component(a: Column, expects_yes: Column) -> Column:
    """Does the cause name something the cited line names? Nothing to name on negatives."""
    cause = a["root_cause_hypothesis"]
    return F.when(~expects_yes, True).otherwise(
        F.exists(evidence_identifiers(a["evidence_line"]), lambda n: cause.contains(n)))


def with_reward(rows: DataFrame, spec: RewardSpec = RewardSpec()) -> DataFrame:
    """Adds the reward parts and ``reward`` in 0..1; unusable output scores 0.

    The citation part wants the whole line (strict), unlike ``grounded`` (lenient).
    """
    a, yes = F.col("analysis"), F.col("expects_yes")
    points = lambda ok, weight: F.when(ok, F.lit(weight)).otherwise(F.lit(0.0)) if weight else F.lit(0.0)
    usable = ~F.col("parse_failed")
    step = rows.withColumns({
        "strict_ok": usable & cites_whole_line(a, F.col("log_samples")),
        "names_component": usable & F.coalesce(names_component(a, yes), F.lit(False)),
    })
    step = step.withColumns({
        "p_schema": points(F.size(schema_reasons(a)) == 0, spec.schema),
        "p_verdict": points(a["evidence_found"] == yes, spec.verdict),
        "p_citation": points(~yes | F.col("strict_ok"), spec.citation),
        "p_specificity": points(F.col("names_component"), spec.specificity),
        "p_penalty": -points(F.size(cause_reasons(a)) > 0, spec.cause_without_evidence),
    })
    parts = ["p_schema", "p_verdict", "p_citation", "p_specificity", "p_penalty"]
    failed = F.col("parse_failed")
    step = step.withColumns({
        p: F.when(failed, F.lit(0.0)).otherwise(F.col(p)) for p in parts})
    # added in this order, as float sums depend on it
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p)
    return step.withColumn("reward", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def attach_scenarios(outputs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """outputs x scenario columns by name; outputs without a scenario keep nulls.

    Of scenarios with one name the last by ``seq`` (or ``file``) counts. The grouping has the
    key of the join, so it costs no shuffle of its own.
    """
    s = with_expectation(scenarios) if "expects_yes" not in scenarios.columns else scenarios
    order = next((c for c in ("seq", "file") if c in s.columns), None)
    if order is not None:
        s = s.groupBy("name").agg(F.max_by(F.struct(*[c for c in s.columns if c != "name"]), order).alias("__last")).select(
            "name", "__last.*")
    return outputs.join(s.withColumnRenamed("name", "scenario"), "scenario", "left")


def outputs_without_scenario(outputs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(arm, outputs, names): what ``score_outputs`` leaves out because no scenario has the name."""
    lost = outputs.select("arm", "scenario").join(scenarios.select(F.col("name").alias("scenario")), "scenario", "left_anti")
    per = lost.groupBy("arm", "scenario").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("arm").agg(F.sum("n").alias("outputs"), F.count(F.lit(1)).alias("names"))


def score_outputs(
    outputs: DataFrame, scenarios: DataFrame, spec: RewardSpec = RewardSpec()
) -> DataFrame:
    """The fact table every comparison reads: one row per output, verdicts and parts.

    Outputs are parsed before the join, so that the shuffle carries each answer once and
    log lines only on the scenario side. ``outputs_without_scenario`` counts those left out.
    """
    rows = attach_scenarios(parse_outputs(outputs), scenarios).filter(F.col("expects_yes").isNotNull())
    scored = with_reward(ground(rows), spec)
    return scored.select(
        "arm", "scenario", "sample_idx", F.col("alert.alertname").alias("alertname"),
        "expects_yes", "parse_failed", "claimed", "grounded", "strict_ok", "names_component",
        "p_schema", "p_verdict", "p_citation", "p_specificity", "p_penalty", "reward")


def outcomes(outputs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Sign, parse state, claim and grounding per output."""
    return score_outputs(outputs, scenarios).select(
        "arm", "scenario", "sample_idx", "expects_yes", "parse_failed", "claimed", "grounded")


def trial_results(trials: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Parse, ground, flatten and score each trial; a broken one becomes a FAIL row.

    ``trials`` has run, scenario, trial, raw, judge_raw and latency_ms.
    """
    rows = ground(attach_scenarios(parse_outputs(trials), scenarios))
    rows = parse_scores(rows)
    bad = F.col("parse_failed")
    s = F.col("score")
    return rows.select(
        "run", "scenario", "trial",
        F.when(bad, K.FAILED_ANSWER).otherwise(flatten_answer(F.col("settled"))).alias("answer"),
        F.when(bad, 0).otherwise(s["accuracy"]).alias("accuracy"),
        F.when(bad, 0).otherwise(s["groundedness"]).alias("groundedness"),
        F.when(bad, False).otherwise(s["hallucination_detected"]).alias("hallucination_detected"),
        F.when(bad, "FAIL").otherwise(s["verdict"]).alias("verdict"),
        F.when(bad, "trial failed: answer is not a usable object")
        .otherwise(s["rationale"]).alias("rationale"),
        F.when(bad, 0).otherwise(F.col("latency_ms")).cast("long").alias("latency_ms"),
        F.when(bad, "answer is not a usable object").alias("error"))


def parse_rate(outputs: DataFrame, by: list[str]) -> DataFrame:
    """Share of outputs that parse, per group."""
    return parse_outputs(outputs).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("parse_failed")).alias("parsed"),
        F.avg((~F.col("parse_failed")).cast("double")).alias("parse_rate"))
