"""Mutation probes: known-good answers, changed on purpose, to see whether a judge notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as K
from ..functions import text as X
from ..functions.stage import once
from . import outputs as O


def flat_parts(answer: Column) -> Column:
    """(summary, yes, cause, actions) of a flattened answer, null if a part is missing."""
    line = lambda prefix, body: f"(?dUm)^{X.quote(prefix)}{body}$"
    summary, verdict = line(K.SUMMARY_PREFIX, "(.*)"), line(K.VERDICT_PREFIX, f"({K.YES}|{K.NO})")
    cause = line(K.CAUSE_PREFIX, "(.*)")
    actions = f"(?dUms)^{X.quote(K.ACTIONS_PREFIX)}.*$"
    found = F.lit(True)
    for pattern in (summary, verdict, cause, actions):
        found = found & answer.rlike(pattern)
    return F.when(found, F.struct(
        F.regexp_extract(answer, summary, 1).alias("summary"),
        (F.regexp_extract(answer, verdict, 1) == K.YES).alias("yes"),
        F.regexp_extract(answer, cause, 1).alias("cause"),
        F.regexp_extract(answer, actions, 0).alias("actions")))


def render(summary: Column, yes: Column, cause: Column, actions: Column) -> Column:
    return F.concat(
        F.lit(K.SUMMARY_PREFIX), summary,
        F.lit("\n"), F.when(yes, K.RUBRIC_YES).otherwise(K.RUBRIC_NO),
        F.lit("\n" + K.CAUSE_PREFIX), cause, F.lit("\n"), actions)


def mutations(which: str = "all") -> list[tuple]:
    """The fixed mutations of one set, ``gross`` or ``subtle``, or of all."""
    known = {m[2] for m in K.MUTATIONS} | {"all"}
    if which not in known:
        raise ValueError(f"unknown set {which}, known: {sorted(known)}")
    return [m for m in K.MUTATIONS if which in ("all", m[2])]


def build_probes(answers: DataFrame, which: str = "all", own: dict | None = None) -> DataFrame:
    """One row per answer and applicable mutation: (scenario, mutation, expected_verdict,
    answer). ``answers`` has scenario, answer and rubric.

    The mutation table is a literal array, exploded per answer: no join. ``own`` adds
    mutations: name -> (expected verdict, function of the answer's parts that gives the
    changed answer, or null where it does not apply).
    """
    fixed = _fixed_probes(answers, which)
    if not own:
        return fixed
    flat = once(answers, flat=flat_parts(F.col("answer"))).filter(F.col("flat").isNotNull())
    changed = F.array(*[F.struct(
        F.lit(name).alias("mutation"), F.lit(verdict).alias("expected_verdict"), change(F.col("flat")).alias("answer"))
        for name, (verdict, change) in own.items()])
    added = flat.select("scenario", F.explode(changed).alias("m")).select("scenario", "m.*").filter(F.col("answer").isNotNull())
    return fixed.unionByName(added)


def _fixed_probes(answers: DataFrame, which: str) -> DataFrame:
    table = F.array(*[F.struct(
        F.lit(name).alias("mutation"), F.lit(verdict).alias("expected_verdict"),
        F.lit(claim).cast("string").alias("claim")) for name, verdict, _, claim in mutations(which)])
    flat = once(answers, flat=flat_parts(F.col("answer"))).filter(
        F.col("flat").isNotNull()).withColumn("m", F.explode(table))
    f, name = F.col("flat"), F.col("m.mutation")
    mentions = X.any_of([F.coalesce(F.col("rubric"), F.lit("")).contains(w) for w in K.MENTION_WORDS])
    fits = (
        F.when(name == "fabricated-cause", ~f["yes"])
        .when(name.isin("component-swap", "vague-cause"), f["yes"])
        .when(name == "no-actions", ~mentions)
        .otherwise(True))
    summary = (
        F.when(name == "benign-paraphrase", F.concat(F.lit(K.PARAPHRASE_START), f["summary"]))
        .when(name == "hedged-summary", F.concat(f["summary"], F.lit(K.HEDGE_END)))
        .otherwise(f["summary"]))
    actions = F.when(name == "no-actions", f"{K.ACTIONS_PREFIX} {K.NOTHING}").otherwise(f["actions"])
    return flat.filter(fits).select(
        "scenario", name.alias("mutation"), F.col("m.expected_verdict").alias("expected_verdict"),
        render(summary, F.when(name == "verdict-flip", ~f["yes"]).otherwise(f["yes"]),
               F.coalesce(F.col("m.claim"), f["cause"]), actions).alias("answer"))


def detector_flags(probes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Does the identifier check (with actions, and without) flag each probe?"""
    rows = once(O.attach_scenarios(probes, scenarios), flat=flat_parts(F.col("answer")))
    f = F.col("flat")
    analysis = F.struct(
        f["summary"].alias("summary"), f["cause"].alias("root_cause_hypothesis"),
        F.array(f["actions"]).alias("suggested_actions"))
    rows = rows.filter(f.isNotNull()).withColumn("analysis", analysis)
    a, logs, alert = F.col("analysis"), F.col("log_samples"), F.col("alert")
    return rows.select(
        "scenario", "mutation",
        (F.size(O.no_fabricated_identifiers(a, logs, alert)) > 0).alias("flagged"),
        (F.size(O.identifiers_grounded(a, logs, alert)) > 0).alias("flagged_without_actions"))


def passing_answers(trials: DataFrame) -> DataFrame:
    """First PASS answer per scenario in (file, line_no) order; rows without a verdict
    (files of another layout) are skipped."""
    return trials.filter(F.col("verdict") == "PASS").groupBy("scenario").agg(
        F.min_by("answer", F.struct("file", "line_no")).alias("answer"))


def pick_balanced(answers: DataFrame, limit: int) -> DataFrame:
    """Names of at most ``limit`` answers, half of them with verdict yes, then no.

    The second quota is what the first left over. Both sides are top-k by name, cut before
    the shuffle, so only ``limit`` rows of each per input partition reach one task.
    """
    half = max(1, limit // 2)
    a = F.col("answer")
    sides = F.array_compact(F.array(
        F.when(a.contains(K.RUBRIC_YES), 0), F.when(a.contains(K.RUBRIC_NO), 1)))
    w = Window.partitionBy("side").orderBy("scenario")
    ranked = answers.select("scenario", F.explode(sides).alias("side")).withColumn(
        "rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    kept = ranked.filter((F.col("side") == 1) | (F.col("rn") <= half))
    return kept.orderBy("side", "scenario").limit(limit).select(
        "scenario", F.when(F.col("side") == 0, "yes").otherwise("no").alias("polarity"))
