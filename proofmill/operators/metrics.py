"""Aggregates over trials, scores, outcomes, probes and build results.

All of them are conditional aggregates with partial aggregation before the shuffle, so a
group that holds a large share of the rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as K
from ..schemas import GREEDY


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def scenario_stats(trials: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Trials, passes, mean scores, hallucinations and errors per scenario."""
    passed = F.col("verdict") == "PASS"
    return trials.groupBy(*by, "scenario").agg(
        F.count(F.lit(1)).alias("trials"),
        n_if(passed).alias("passes"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.avg("groundedness").alias("mean_groundedness"),
        n_if(F.col("hallucination_detected")).alias("hallucinations"),
        n_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
    ).withColumn("pass_rate", F.col("passes") / F.col("trials"))


def run_totals(stats: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Totals over ``scenario_stats`` rows, with scenarios that pass every trial."""
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.sum("trials").alias("trials"),
        F.sum("passes").alias("passes"),
        n_if(F.col("passes") == F.col("trials")).alias("always_pass"),
    ).withColumn("pass_rate", F.try_divide("passes", "trials"))


def failure_stability(stats: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Scenarios that fail in every repeat, in some, in none."""
    passes, trials = F.col("passes"), F.col("trials")
    return stats.groupBy(*by).agg(
        n_if(passes == 0).alias("always_fail"),
        n_if((passes > 0) & (passes < trials)).alias("mixed"),
        n_if(passes == trials).alias("always_pass"))


def endpoint_report(scores: DataFrame) -> DataFrame:
    """Counters per arm over the greedy outputs, both definitions of each endpoint.

    ``false_claims`` counts claims on negatives before grounding, ``false_positives`` after.
    """
    yes, g = F.col("expects_yes"), F.col("grounded")
    out = scores.filter(F.col("sample_idx") == GREEDY).groupBy("arm").agg(
        n_if(yes).alias("positives"),
        n_if(~yes).alias("negatives"),
        n_if(yes & F.col("claimed")).alias("claimed_on_positives"),
        n_if(yes & g).alias("citation_pass"),
        n_if(yes & F.col("claimed") & F.col("strict_ok")).alias("citation_pass_strict"),
        n_if(~yes & F.col("claimed")).alias("false_claims"),
        n_if(~yes & g).alias("false_positives"),
        n_if(F.col("parse_failed")).alias("parse_failures"),
    )
    hit = F.try_divide("citation_pass", "positives")
    false = F.try_divide("false_positives", "negatives")
    return out.withColumn("discrimination", hit - false)


def best_of_n_scores(scores: DataFrame) -> DataFrame:
    """Greedy and best reward per arm and scenario, with the share of perfect samples."""
    sampled = F.col("sample_idx") != GREEDY
    return scores.groupBy("arm", "scenario").agg(
        F.max(F.when(~sampled, F.col("reward"))).alias("greedy"),
        F.max("reward").alias("best"),
        n_if(sampled).alias("samples"),
        n_if(sampled & (F.col("reward") >= K.PERFECT_REWARD)).alias("perfect"),
    ).withColumn("perfect_rate", F.try_divide("perfect", "samples"))


def arm_leaderboard(scores: DataFrame) -> DataFrame:
    """One row per arm: greedy and best mean, headroom, endpoint counts."""
    yes, g = F.col("expects_yes"), F.col("grounded")
    at = F.col("sample_idx") == GREEDY
    # first level per scenario, second level per arm: one shuffle each, both pre-aggregated
    per = scores.groupBy("arm", "scenario").agg(
        F.max(F.when(at, F.col("reward"))).alias("greedy"),
        F.max("reward").alias("best"),
        n_if(at & yes).alias("positives"), n_if(at & ~yes).alias("negatives"),
        n_if(at & yes & g).alias("citation_pass"),
        n_if(at & ~yes & g).alias("false_positives"),
        n_if(at & F.col("parse_failed")).alias("parse_failures"))
    out = per.groupBy("arm").agg(
        F.avg("greedy").alias("greedy_mean"), F.avg("best").alias("best_mean"),
        *[F.sum(c).alias(c) for c in (
            "citation_pass", "positives", "false_positives", "negatives", "parse_failures")])
    return out.withColumn("headroom", F.col("best_mean") - F.col("greedy_mean"))


def _side_by_side(rows: DataFrame, left: str, right: str, columns: list[str]) -> DataFrame:
    """One row per scenario with ``l_`` and ``r_`` columns, null where an arm lacks it.

    One grouping instead of a self-join, so the rows are computed once.
    """
    at = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return rows.filter(F.col("arm").isin(left, right)).groupBy("scenario").agg(
        *[at(arm, c).alias(f"{p}_{c}") for arm, p in ((left, "l"), (right, "r")) for c in columns])


def replay_agreement(outcomes: DataFrame, left: str, right: str) -> DataFrame:
    """Two arms over replayed scenarios: counters per sign, then the agreement row ``all``.

    Right-arm counters only cover scenarios that the left arm has too. Positives carry no
    label, so the agreement says nothing about accuracy.
    """
    both = _side_by_side(outcomes, left, right, ["negative", "parse_failed", "claimed", "grounded"])
    both = both.filter(F.col("l_grounded").isNotNull())
    shared = F.col("r_grounded").isNotNull()
    same = F.col("l_grounded") == F.col("r_grounded")
    counts = {
        "n_left": F.lit(True), "n_both": shared,
        "left_parse_failures": F.col("l_parse_failed"), "right_parse_failures": F.col("r_parse_failed"),
        "left_claims": F.col("l_claimed"), "right_claims": F.col("r_claimed"),
        "left_grounded": F.col("l_grounded"), "right_grounded": F.col("r_grounded"),
        "agree": shared & same, "differ": shared & ~same,
    }
    sign = F.when(F.col("l_negative"), "negative").otherwise("positive")
    out = both.withColumn("sign", sign).rollup("sign").agg(
        *[n_if(c).alias(n) for n, c in counts.items()])
    return out.withColumn("sign", F.coalesce("sign", F.lit("all"))).withColumn(
        "agreement_pct", 100.0 * F.try_divide("agree", "n_both"))


def disagreements(outcomes: DataFrame, left: str, right: str) -> DataFrame:
    """Scenarios on which the two arms ground differently."""
    both = _side_by_side(outcomes, left, right, ["grounded"])
    return both.filter(F.col("l_grounded") != F.col("r_grounded")).select("scenario")


# --------------------------------------------------------------------------------------
# Calibration of a judge, detector verdict
# --------------------------------------------------------------------------------------


def calibration(judged: DataFrame) -> DataFrame:
    """Agreement per mutation and over all: probe expectation against the judge's verdict."""
    want, got = F.col("expected_verdict"), F.col("verdict")
    return judged.rollup("mutation").agg(
        F.min("expected_verdict").alias("lo"), F.max("expected_verdict").alias("hi"),
        F.count(F.lit(1)).alias("total"),
        n_if(want == got).alias("agreed"),
        n_if((want == "FAIL") & (got == "PASS")).alias("missed"),
        n_if((want == "PASS") & (got == "FAIL")).alias("over_strict"),
    ).select(
        F.coalesce("mutation", F.lit("all")).alias("mutation"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("expected_verdict"),
        "total", "agreed", F.try_divide("agreed", "total").alias("agreement"),
        "missed", "over_strict")


def detector_verdict(flags: DataFrame) -> DataFrame:
    """Adopt, hold or reject a detector from its hits on mutations (mutation, flagged)."""
    target = F.col("mutation").isin(*K.DETECTOR_TARGETS)
    control = F.col("mutation").isin(*K.DETECTOR_CONTROLS)
    out = flags.agg(
        n_if(target).alias("targets"), n_if(target & F.col("flagged")).alias("detected"),
        n_if(control).alias("controls"), n_if(control & F.col("flagged")).alias("false_alarms"))
    rate = F.try_divide("detected", "targets")
    return out.withColumn("detection_rate", rate).withColumn(
        "decision", F.when(F.col("false_alarms") > 0, "reject")
        .when(rate >= K.ADOPT_RATE, "adopt").otherwise("hold"))


def rule_judge_agreement(rows: DataFrame) -> DataFrame:
    """Rule result (``rule_ok``) against the judge's verdict, with the direction of misses."""
    ok, passed = F.col("rule_ok"), F.col("verdict") == "PASS"
    out = rows.agg(
        F.count(F.lit(1)).alias("total"), n_if(ok == passed).alias("agree"),
        n_if(~ok & passed).alias("rule_stricter"), n_if(ok & ~passed).alias("rule_looser"))
    rate = F.try_divide("agree", "total")
    return out.withColumn("agreement", rate).withColumn(
        "adopt", F.coalesce(rate >= K.ADOPT_RATE, F.lit(False)))


# --------------------------------------------------------------------------------------
# Counts by reason
# --------------------------------------------------------------------------------------


def filter_stats(validated: DataFrame) -> DataFrame:
    """Totals and drops per validator; a candidate counts once per validator it fails.

    ``validated`` has a ``failures`` map. Rows are (kind, name, n): total, passed, and one
    ``drop`` row per validator.
    """
    failing = F.map_keys(F.map_filter("failures", lambda k, v: F.size(v) > 0))
    entry = lambda kind, name, n: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    entries = F.concat(
        F.array(entry("total", F.lit(""), F.lit(1)),
                entry("passed", F.lit(""), (F.size(failing) == 0).cast("int"))),
        F.transform(failing, lambda name: entry("drop", name, F.lit(1))))
    return validated.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.name").agg(
        F.sum("e.n").alias("n"))


def reason_detail(validated: DataFrame, name: str = "name") -> DataFrame:
    """One row per (candidate, failing validator) with its reasons."""
    return validated.select(name, F.explode("failures").alias("validator", "reasons")).filter(
        F.size("reasons") > 0)


def length_report(lengths: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Total, longest, number over the limit, smallest sufficient limit (``length`` column)."""
    step = K.LENGTH_STEP
    return lengths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.max("length").alias("longest"),
        n_if(F.col("length") > limit).alias("over_limit"),
    ).withColumn(
        "recommended_limit", (F.ceil(F.col("longest") / F.lit(step)) * step).cast("long"))


class SampleTooLong(RuntimeError):
    pass


def enforce_length(lengths: DataFrame, limit: int) -> dict:
    """Raise when a sample is over the limit; samples are never cut or dropped."""
    report = length_report(lengths, limit).first().asDict()  # one aggregate row
    if not report["total"]:
        raise ValueError("no samples to measure")
    if report["over_limit"]:
        raise SampleTooLong(
            f"{report['over_limit']} of {report['total']} samples exceed {limit}; "
            f"raise the limit to {report['recommended_limit']}")
    return report


def stratified_scores(scores: DataFrame, stratum: Column) -> DataFrame:
    """Greedy mean and endpoint counts per stratum and arm."""
    yes, g = F.col("expects_yes"), F.col("grounded")
    return scores.filter(F.col("sample_idx") == GREEDY).groupBy(
        stratum.alias("stratum"), "arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"),
        n_if(yes & g).alias("citation_pass"), n_if(~yes & g).alias("false_positives"))
