"""Training sets from verified outputs: selection, preference pairs, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as K
from ..functions.ordering import hash_rank
from ..schemas import GREEDY
from ..session import reused
from . import outputs as O, prompts as P


def _sample_order() -> Column:
    """Samples in order, the greedy answer after all of them."""
    return F.when(F.col("sample_idx") == GREEDY, F.lit(2**31 - 1)).otherwise(F.col("sample_idx"))


def best_and_worst(scored: DataFrame) -> DataFrame:
    """Per scenario the best and the worst output, ties to the earlier sample.

    ``scored`` has scenario, sample_idx, reward and raw. Both are one pre-aggregated
    extreme, so a scenario with very many samples stays cheap.
    """
    order = _sample_order()
    return scored.groupBy("scenario").agg(
        F.max_by(F.struct("sample_idx", "reward", "raw"), F.struct("reward", -order)).alias("best"),
        F.min_by(F.struct("sample_idx", "reward", "raw"), F.struct(F.col("reward"), order)).alias("worst"),
        F.max(F.when(F.col("sample_idx") == GREEDY, F.col("reward"))).alias("greedy"))


def best_of_n(
    scored: DataFrame, scenarios: DataFrame, min_reward: float = K.PERFECT_REWARD
) -> DataFrame:
    """One row per sampled scenario: its best output and why it is kept or not.

    reason: ``accepted``, ``no_scenario``, ``below_min_reward`` or ``parse_failed``.
    """
    picked = best_and_worst(scored).select(
        "scenario", F.col("best.raw").alias("raw"), F.col("best.sample_idx").alias("sample_idx"),
        F.col("best.reward").alias("reward"),
        (F.col("best.reward") > F.col("greedy")).alias("beats_greedy"))
    rows = O.parse_outputs(picked).join(
        scenarios.withColumnRenamed("name", "scenario").withColumn("__known", F.lit(True)),
        "scenario", "left")
    return rows.withColumn("reason", F.when(F.col("__known").isNull(), "no_scenario")
                           .when(F.col("reward") < min_reward, "below_min_reward")
                           .when(F.col("parse_failed"), "parse_failed")
                           .otherwise("accepted")).drop("__known")


def rft_build(scored: DataFrame, scenarios: DataFrame, system: str, min_reward: float = K.PERFECT_REWARD) -> DataFrame:
    """Chat samples of the accepted best outputs: (name, prompt, assistant, messages, expects_yes)."""
    picked = O.with_expectation(best_of_n(scored, scenarios, min_reward).filter(F.col("reason") == "accepted"))
    return P.chat_samples(picked, system).select(
        F.col("scenario").alias("name"), "prompt", "assistant", "messages", "expects_yes")


def rft_stats(picked: DataFrame) -> DataFrame:
    """Counts by reason and how many accepted ones beat the greedy answer."""
    return picked.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("reason") == "accepted") & F.col("beats_greedy")).alias("beats_greedy"))


def teacher_by_prompt(chat: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, assistant): the last chat row whose user text is the scenario's prompt.

    ``chat`` has split_order, line_no, user and assistant. The join key is the digest of the
    text, checked against the text itself.
    """
    last = chat.groupBy(F.sha2("user", 256).alias("k")).agg(
        F.max_by(F.struct("user", "assistant"), F.struct("split_order", "line_no")).alias("t"))
    s = P.with_prompt(scenarios).select(
        F.col("name").alias("scenario"), F.sha2("prompt", 256).alias("k"), "prompt")
    return s.join(last, "k").filter(F.col("prompt") == F.col("t.user")).select(
        "scenario", F.col("t.assistant").alias("assistant"))


def preference_pairs(
    scored: DataFrame, teacher: DataFrame, scenarios: DataFrame,
    min_margin: float = K.MIN_PREFERENCE_MARGIN,
) -> DataFrame:
    """One row per sampled scenario: its prompt, the teacher's answer over the worst sample, or
    a drop reason.

    reason: ``accepted``, ``no_teacher`` or ``small_margin``.
    """
    s = P.with_prompt(O.with_expectation(scenarios)).select(
        F.col("name").alias("scenario"), "expects_yes", "prompt")
    rows = best_and_worst(scored).select("scenario", "worst").join(s, "scenario", "left").join(
        teacher, "scenario", "left")
    reason = (
        F.when(F.col("assistant").isNull() | F.col("expects_yes").isNull(), "no_teacher")
        .when(1.0 - F.col("worst.reward") < min_margin, "small_margin")
        .otherwise("accepted"))
    return rows.select(
        "scenario", "expects_yes", reason.alias("reason"), "prompt",
        F.col("assistant").alias("chosen"), F.col("worst.raw").alias("rejected"),
        (1.0 - F.col("worst.reward")).alias("margin"))


def preference_stats(pairs: DataFrame) -> DataFrame:
    """Counts by reason and verdict of the scenario."""
    return pairs.groupBy(
        "reason", F.when(F.col("expects_yes"), "yes").otherwise("no").alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"))


def verdict_skew_guard(
    pairs: DataFrame, scenarios: DataFrame, max_skew: float = K.MAX_VERDICT_SKEW
) -> DataFrame:
    """Share of yes among kept pairs against the pool; ``stop`` when they drift apart."""
    share = lambda df: df.agg(
        F.avg(F.col("expects_yes").cast("double")).alias("p"), F.count(F.lit(1)).alias("n"),
        F.max(F.lit(1)).alias("__one"))
    kept = share(pairs.filter(F.col("reason") == "accepted"))
    pool = share(O.with_expectation(scenarios))
    out = kept.select("__one", F.col("p").alias("kept_yes"), F.col("n").alias("kept")).join(
        pool.select("__one", F.col("p").alias("pool_yes"), F.col("n").alias("pool")), "__one")
    skew = F.abs(F.col("kept_yes") - F.col("pool_yes"))
    return out.select("kept", "pool", "kept_yes", "pool_yes", skew.alias("skew"),
                      (skew > max_skew).alias("stop"))


# --------------------------------------------------------------------------------------
# Teacher attempts
# --------------------------------------------------------------------------------------


def check_attempts(attempts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Repair and verify each teacher attempt (scenario, attempt, raw)."""
    rows = O.attach_scenarios(O.parse_outputs(attempts, lenient=False), scenarios)
    rows = rows.filter(F.col("expects_yes").isNotNull())
    rows = rows.withColumn("analysis", F.when(
        F.col("analysis").isNotNull(), O.repair_citation(F.col("analysis"), F.col("log_samples"))))
    return O.verify_target(rows)


def select_attempt(checked: DataFrame, retries: int = 1) -> DataFrame:
    """(scenario, accepted, attempt, drop_rule): the first sound attempt wins, an unusable
    one ends the row as ``teacher``, otherwise the last allowed attempt names the rule."""
    allowed = checked.filter(F.col("attempt") <= retries)
    a = F.col("attempt")
    broken, sound = F.col("parse_failed"), ~F.col("parse_failed") & (F.col("n_reasons") == 0)
    per = allowed.groupBy("scenario").agg(
        F.min(F.when(broken, a)).alias("broken_at"), F.min(F.when(sound, a)).alias("sound_at"),
        F.max_by("first_rule", "attempt").alias("last_rule"), F.max("attempt").alias("last"))
    never = F.lit(2**31 - 1)
    ok = F.coalesce("sound_at", never) < F.coalesce("broken_at", never)
    return per.select(
        "scenario", ok.alias("accepted"),
        F.when(ok, F.col("sound_at")).alias("attempt"),
        F.when(ok, None).when(F.col("broken_at").isNotNull(), "teacher")
        .when(F.col("last") == retries, F.col("last_rule")).alias("drop_rule"))


def sft_build(
    attempts: DataFrame, scenarios: DataFrame, system: str, retries: int = 1
) -> DataFrame:
    """Chat samples of the accepted attempts: (name, prompt, assistant, messages, expects_yes)."""
    checked = check_attempts(attempts, scenarios)
    chosen = select_attempt(checked, retries).filter("accepted").select("scenario", "attempt")
    rows = checked.join(chosen, ["scenario", "attempt"])
    return P.chat_samples(rows, system).select(
        F.col("scenario").alias("name"), "prompt", "assistant", "messages", "expects_yes")


def build_stats(selected: DataFrame) -> DataFrame:
    """Outcome counts of a build: accepted, or the rule that dropped the scenario."""
    return selected.groupBy(
        F.when(F.col("accepted"), "accepted").otherwise(
            F.coalesce("drop_rule", F.lit("undecided"))).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------------------
# Splits and mixes: exact sizes, independent of the partitioning
# --------------------------------------------------------------------------------------


def train_valid_split(
    samples: DataFrame, ratio: float = K.VALID_RATIO, seed: int = 20260826
) -> DataFrame:
    """Adds ``split``: the first max(1, floor(n * ratio)) samples in seeded hash order of
    their name are for validation."""
    samples = reused(samples)  # counted, ranked and sized: computed once
    ranked = hash_rank(samples, F.concat_ws(":", F.lit(str(seed)), "name"), "__rank")
    size = samples.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio)))).scalar()
    return ranked.withColumn(
        "split", F.when(F.col("__rank") <= size, "valid").otherwise("train")).drop("__rank")


def mix_ratio(samples: DataFrame, yes_share: float, seed: int = 20260826) -> DataFrame:
    """The largest subset with the wanted share of yes, picked in seeded hash order.

    ``samples`` has name and expects_yes.
    """
    samples = reused(samples)
    ranked = hash_rank(samples, F.concat_ws(":", F.lit(str(seed)), "name"), "__rank", ["expects_yes"])
    yes, no = F.count_if("expects_yes"), F.count_if(~F.col("expects_yes"))
    total = samples.agg(F.least(
        F.floor(yes / F.lit(yes_share)), F.floor(no / F.lit(1 - yes_share)))).scalar()
    share = F.when(F.col("expects_yes"), F.lit(yes_share)).otherwise(F.lit(1 - yes_share))
    return ranked.filter(
        F.col("__rank") <= F.floor(total * share + F.lit(1e-9))).drop("__rank")


# --------------------------------------------------------------------------------------
# Preference training log
# --------------------------------------------------------------------------------------


def preference_loss(margin: Column, beta: float = 0.1) -> Column:
    """softplus(-beta * margin), stable for large values of either sign."""
    x = -F.lit(beta) * margin
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_metrics(
    log: DataFrame, beta: float = 0.1, collapse_at: float = K.LOSS_COLLAPSE, by: str = "run",
    block: int = 100_000,
) -> DataFrame:
    """Loss, preference and the mean loss of the last 10 steps per logged step.

    ``log`` has the run, its step (counted 1, 2, 3, ...) and the four log-probabilities of
    the pair. A run is cut into blocks of steps, each with the 9 steps before it, so a very
    long run is not sorted in one task.
    """
    chosen = F.col("policy_chosen") - F.col("ref_chosen")
    rejected = F.col("policy_rejected") - F.col("ref_rejected")
    out = log.select(
        by, "step", preference_loss(chosen - rejected, beta).alias("loss"),
        (chosen > rejected).alias("prefers_chosen"))
    own = F.floor(F.col("step") / F.lit(block))
    lead = F.floor((F.col("step") + 9) / F.lit(block))
    out = out.withColumn("__own", own).withColumn("__block", F.explode(
        F.array_distinct(F.array(own, lead))))
    recent = Window.partitionBy(by, "__block").orderBy("step").rowsBetween(-9, 0)
    out = out.withColumn("recent_loss", F.avg("loss").over(recent)).filter("__block = __own")
    return out.withColumn(
        "collapsed", (F.pmod("step", F.lit(10)) == 0) & (F.col("recent_loss") < collapse_at)
    ).select(by, "step", "loss", "prefers_chosen", "recent_loss", "collapsed")
