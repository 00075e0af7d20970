"""Paired comparison of arms, bootstrap, power, ROC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as K
from ..functions.ordering import running_totals
from ..schemas import GREEDY
from ..session import python_workers


def load_arm(scores: DataFrame, arm: str) -> DataFrame:
    """(scenario, score) of one arm's greedy answers."""
    return scores.filter((F.col("arm") == arm) & (F.col("sample_idx") == GREEDY)).select(
        "scenario", F.col("reward").alias("score"))


def paired_diff(a: DataFrame, b: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Score pairs by scenario; fails while running if the two sets of scenarios differ."""
    side = lambda df, n: df.select("scenario", "score", F.lit(n).alias("side"))
    at = lambda n: F.max(F.when(F.col("side") == n, F.col("score")))
    both = side(a, "a").unionByName(side(b, "b")).groupBy("scenario").agg(
        at("a").alias("a"), at("b").alias("b"))
    both = both.select("scenario", "a", "b", _checked_diff().alias("diff"))
    if clusters is None:
        return both
    known = both.join(clusters, "scenario", "left")
    return known.withColumn("cluster", F.coalesce("cluster", F.raise_error(
        F.concat(F.lit("scenario without a cluster: "), F.col("scenario"))).cast("string")))


def _checked_diff() -> Column:
    return F.when(
        F.col("a").isNull() | F.col("b").isNull(),
        F.raise_error(F.concat(F.lit("scenario in one arm only: "), F.col("scenario"))).cast("double"),
    ).otherwise(F.col("b") - F.col("a"))


def paired_scores(scores: DataFrame, before: str, after: str) -> DataFrame:
    """Score pairs of two arms of one fact table, which is read once:
    (scenario, cluster, a, b, diff, after_failed)."""
    greedy = scores.filter((F.col("sample_idx") == GREEDY) & F.col("arm").isin(before, after))
    at = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    both = greedy.groupBy("scenario").agg(
        F.max("alertname").alias("cluster"), at(before, "reward").alias("a"),
        at(after, "reward").alias("b"), at(after, "parse_failed").alias("after_failed"))
    return both.select("scenario", "cluster", "a", "b", _checked_diff().alias("diff"), "after_failed")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Scenarios per cluster, largest first."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).orderBy(
        F.desc("size"), "cluster")


def paired_counts(scores: DataFrame, before: str, after: str) -> DataFrame:
    """Better, worse, same per sign. On negatives a grounded claim is an error, so the
    direction flips there. A scenario the later arm lacks counts as the same."""
    greedy = scores.filter((F.col("sample_idx") == GREEDY) & F.col("arm").isin(before, after))
    at = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("grounded")))
    j = greedy.groupBy("scenario").agg(
        F.max("expects_yes").alias("expects_yes"), at(before).alias("was"), at(after).alias("now"),
    ).filter(F.col("was").isNotNull())
    changed = F.coalesce(F.col("was") != F.col("now"), F.lit(False))
    better = changed & (F.col("now") == F.col("expects_yes"))
    return j.groupBy(F.when(F.col("expects_yes"), "positive").otherwise("negative").alias("sign")).agg(
        F.count_if(better).alias("better"),
        F.count_if(changed & ~better).alias("worse"),
        F.count_if(~changed).alias("same"))


def mcnemar_p(better: Column, worse: Column) -> Column:
    """Exact two-sided binomial p-value.

    The largest term, C(n,k) / 2^n, comes from a series for the factorial's logarithm. The
    others are added downward relative to it; beyond 5 sqrt(n) steps they no longer change a
    double, so any number of pairs needs that many steps at most.
    """
    n = (better + worse).cast("double")
    k = F.least(better, worse).cast("double")
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) - n * F.lit(0.6931471805599453))
    last = F.least(k, F.ceil(5 * F.sqrt(n)) + 40).cast("long")

    def add(acc: Column, step: Column) -> Column:
        i = k - step + 1
        term = acc["term"] * i / (n - i + 1)  # C(n,i-1) / C(n,i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    tail = F.aggregate(steps, start, add, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * top * tail))


def _ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, eight places further up, where it is exact to a double."""
    z = x + 9
    below = F.lit(0.0)
    for i in range(1, 9):
        below = below + F.log(x + i)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - below


def mcnemar(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p_value", mcnemar_p(F.col("better"), F.col("worse")))


# --------------------------------------------------------------------------------------
# Paired bootstrap
# --------------------------------------------------------------------------------------


#: Units of a leaf, on average, where there are more than that; draws made at a time.
LEAF = 4096
_DRAWS = 1 << 20
_MASK = (1 << 64) - 1


def paired_bootstrap(
    pairs: DataFrame, unit: str = "cluster", iters: int = 10_000, seed: int = 20260901,
    by: list[str] | None = None, leaf: int = LEAF,
) -> DataFrame:
    """Bootstrap of the mean paired difference, drawing whole units with replacement.

    ``pairs`` has ``diff`` and the ``unit`` column, optionally grouping columns ``by``. Units shrink
    to (sum, count) first and are dealt over leaves by a hash. An iteration's k draws are split over
    the leaves by two levels of multinomials, which every leaf repeats for its own path from
    generators seeded by the node, so leaves agree on the split without meeting. A leaf then draws
    from its own units by a counter-based hash. What is shuffled is one row per iteration and
    partition. Units of up to ``leaf`` make one leaf. Draws depend on seed, iteration and leaf
    alone, so a re-run task makes the same ones.
    """
    python_workers(pairs.sparkSession)
    grouped = bool(by)
    by = by or ["__all"]
    if not grouped:
        pairs = pairs.withColumn("__all", F.lit(0))
    units = pairs.groupBy(*by, unit).agg(F.sum("diff").alias("s"), F.count(F.lit(1)).alias("c"))
    # the count names both columns, so that it and all else read one and the same shuffle
    observed = units.groupBy(*by).agg(
        F.sum("c").alias("n"), F.count_if(F.col("s").isNull() | (F.col("c") > 0)).alias("n_clusters"),
        (F.sum("s") / F.sum("c")).alias("observed"))
    one = (lambda rows: rows) if grouped else F.broadcast  # without groups these have a single row
    fan = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_clusters") / F.lit(leaf)))).cast("long")
    digest = F.md5(F.col(unit).cast("string"))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    dealt = units.join(one(observed.select(*by, "n_clusters")), by).select(
        *by, "n_clusters", fan.alias("__fan"), place.alias("__place"),
        F.struct(digest.alias("digest"), "s", "c").alias("__unit"))
    leaves = dealt.groupBy(
        *by, "n_clusters", "__fan", F.expr("__place % __fan").alias("__top"),
        F.expr("__place div __fan % __fan").alias("__sub")).agg(F.array_sort(F.collect_list("__unit")).alias("__units"))
    leaf_size = F.size("__units").cast("long")
    tops = leaves.groupBy(*by, "__top").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__sub").alias("child"), leaf_size.alias("size")))).alias("__subs"),
        F.sum(leaf_size).alias("__n"))
    roots = tops.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct(F.col("__top").alias("child"), F.col("__n").alias("size")))).alias("__tops"))
    work = leaves.join(tops.drop("__n"), [*by, "__top"]).join(one(roots), by)
    schema = T.StructType([*[work.schema[c] for c in by], T.StructField("__t", T.IntegerType()),
                           T.StructField("__s", T.DoubleType()), T.StructField("__c", T.LongType())])
    sums = work.select(*by, "n_clusters", "__fan", "__top", "__sub", "__tops", "__subs", "__units").mapInArrow(
        _leaf_sums(len(by), iters, seed, schema.names), schema)
    means = sums.groupBy(*by, "__t").agg((F.sum("__s") / F.sum("__c")).alias("__mean"))
    spread = means.groupBy(*by).agg(
        F.stddev_samp("__mean").alias("se"),
        F.percentile("__mean", 0.025).alias("ci_low"), F.percentile("__mean", 0.975).alias("ci_high"))
    if grouped:
        return observed.join(spread, by)
    # two one-row tables side by side, without a join
    both = observed.drop("__all").unionByName(spread.drop("__all"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _leaf_sums(n_by: int, iters: int, seed: int, names: list[str]):
    """A function of Arrow batches of leaves: the drawn sums and counts per iteration, added up over
    the leaves of a group."""
    def split(node: int, n: np.ndarray, sizes: np.ndarray, own: int) -> np.ndarray:
        """The own child's part of each iteration's ``n`` draws."""
        rng = np.random.Generator(np.random.Philox(key=[seed & _MASK, node]))
        step = max(1, _DRAWS // len(sizes))
        return np.concatenate([rng.multinomial(n[lo:lo + step], sizes / sizes.sum())[:, own]
                               for lo in range(0, len(n), step)])

    def drawn(n: np.ndarray, leaf: int, s: np.ndarray, c: np.ndarray):
        base = np.uint64((seed + leaf * 0xD1342543DE82EF95) & _MASK)
        out_s, out_c = np.zeros(iters), np.zeros(iters, np.int64)
        ends = np.cumsum(n)
        lo = 0
        while lo < iters:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _DRAWS, "right")))
            for first in range(0, int(n[lo:hi].max()), _DRAWS):  # an iteration may have many draws
                part = np.minimum(n[lo:hi] - first, _DRAWS).clip(0)
                at = np.repeat(np.arange(hi - lo), part)
                j = first + np.arange(len(at)) - np.repeat(np.cumsum(part) - part, part)
                counter = (at + lo + 1).astype(np.uint64) << np.uint64(32) | j.astype(np.uint64)
                unit = (_mixed(base + counter * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(len(s))).astype(np.int64)
                out_s[lo:hi] += np.bincount(at, s[unit], hi - lo)
                out_c[lo:hi] += np.bincount(at, c[unit], hi - lo).astype(np.int64)
            lo = hi
        return out_s, out_c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush():
            for row, s, c in held.values():
                keys = [x.take(pa.array(np.zeros(iters, np.int64))) for x in row]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(np.arange(1, iters + 1, dtype=np.int32)), pa.array(s), pa.array(c)], names=names)
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                row = [batch.column(i).slice(r, 1) for i in range(n_by)]
                k, fan, top, sub = (batch.column(n_by + i)[r].as_py() for i in range(4))
                tops, subs, units = (batch.column(n_by + i)[r].values for i in (4, 5, 6))
                n = np.full(iters, k, np.int64)
                if fan > 1:
                    own = np.searchsorted(tops.field("child").to_numpy(), top)
                    n = split(0, n, tops.field("size").to_numpy(), own)
                    own = np.searchsorted(subs.field("child").to_numpy(), sub)
                    n = split(1 + top, n, subs.field("size").to_numpy(), own)
                s, c = drawn(n, top * fan + sub, units.field("s").to_numpy(), units.field("c").to_numpy())
                key = tuple(x[0].as_py() for x in row)
                if key in held:
                    held[key][1] += s
                    held[key][2] += c
                else:
                    if len(held) >= 64:
                        yield from flush()
                    held[key] = [row, s, c]
        yield from flush()

    return run


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def with_power(result: DataFrame, effect: float | None = None) -> DataFrame:
    """Adds the minimum detectable effect, the significance verdict and, for an effect to
    be caught, the number of units needed."""
    if effect is not None and effect <= 0:
        raise ValueError("the effect has to be positive")
    out = result.withColumn("mde", F.lit(K.MDE_MULTIPLIER) * F.col("se")).withColumn(
        "significant", F.abs("observed") > F.col("mde"))
    if effect is None:
        return out
    return out.withColumn("n_needed", F.ceil(
        F.col("n_clusters") * F.pow(F.col("mde") / F.lit(effect), F.lit(2.0))).cast("long"))


def effect_verdict(result: DataFrame) -> DataFrame:
    """Replicated, not replicated or on hold, from an effect and its detectable size."""
    verdict = F.when(F.col("observed") > F.col("mde"), "replicated").otherwise("not_replicated")
    if "parse_failures" in result.columns:
        verdict = F.when(F.col("parse_failures") > K.MAX_PARSE_FAILURES, "hold").otherwise(verdict)
    return result.withColumn("decision", verdict)


def effect_gaps(verdicts: DataFrame, key: str) -> DataFrame:
    """Difference of effects for each pair of groups.

    The input is a finished report with one row per compared model size.
    """
    report = verdicts.agg(F.array_sort(F.collect_list(
        F.struct(F.col(key).alias("key"), "observed"))).alias("all"))
    gaps = F.flatten(F.transform("all", lambda a, i: F.transform(
        F.slice("all", i + 2, F.size("all")), lambda b: F.struct(
            a["key"].alias("left"), b["key"].alias("right"),
            (b["observed"] - a["observed"]).alias("gap")))))
    return report.select(F.explode(gaps).alias("g")).select("g.*")


def score_component(gap: Column) -> Column:
    """What a score gap consists of, read off its size."""
    size = F.abs(gap)
    near = lambda x: F.abs(size - F.lit(x)) < 0.06
    return (
        F.when(size < 1e-9, "-").when(near(0.5), "verdict").when(near(0.4), "citation")
        .when(near(0.9), "verdict+citation").when(near(0.1), "format").otherwise("other"))


def compare_arms(pairs: DataFrame) -> DataFrame:
    """Scenarios two arms score differently, largest gap first."""
    return pairs.filter(F.abs("diff") > 1e-9).select(
        "scenario", "a", "b", "diff", score_component(F.col("diff")).alias("component"),
    ).orderBy(F.abs("diff").desc(), "scenario")


def failure_overlap(results: DataFrame, left: str, right: str) -> DataFrame:
    """2x2 counts of failures shared by two arms (arm, scenario, failed)."""
    at = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("failed")))
    both = results.filter(F.col("arm").isin(left, right)).groupBy("scenario").agg(
        at(left).alias("fa"), at(right).alias("fb")).dropna()
    fa, fb = F.col("fa"), F.col("fb")
    return both.agg(
        F.count_if(fa & fb).alias("both_fail"), F.count_if(fa & ~fb).alias("only_left"),
        F.count_if(~fa & fb).alias("only_right"), F.count_if(~fa & ~fb).alias("none"))


# --------------------------------------------------------------------------------------
# ROC
# --------------------------------------------------------------------------------------


def verdict_prob(true_p: Column, false_p: Column) -> Column:
    """Probability of true given that the answer is true or false; 0.5 without either."""
    return F.when(true_p + false_p > 0, true_p / (true_p + false_p)).otherwise(0.5)


def roc_points(rows: DataFrame) -> DataFrame:
    """(pos, threshold, tpr, fpr): one point per row in falling score order, ties by ``idx``,
    after the starting point (1.01, 0, 0). ``rows`` has idx, label and score."""
    walk = running_totals(
        rows.select("idx", "label", "score"), [F.col("score").desc(), F.col("idx").asc()],
        {"tp": F.col("label").cast("long"), "fp": (~F.col("label")).cast("long")},
        [-F.col("score"), F.col("idx")], overall=True)
    share = lambda n: F.coalesce(F.try_divide(F.col(n), F.col(f"{n}_all")), F.lit(0.0))
    points = walk.select(
        (F.col("tp") + F.col("fp")).alias("pos"), F.col("score").cast("double").alias("threshold"),
        share("tp").alias("tpr"), share("fp").alias("fpr"))
    start = rows.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("pos"), F.lit(1.01).alias("threshold"),
        F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return start.unionByName(points)


def best_threshold(points: DataFrame) -> DataFrame:
    """Largest Youden J; the highest threshold wins a tie, (0.5, -1) without points."""
    j = F.col("tpr") - F.col("fpr")
    best = points.agg(F.max(F.struct(j.alias("j"), (-F.col("pos")).alias("p"),
                                     F.col("threshold").alias("threshold"))).alias("m"))
    return best.select(
        F.coalesce("m.threshold", F.lit(0.5)).alias("threshold"),
        F.coalesce("m.j", F.lit(-1.0)).alias("j"))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties at half credit, NaN if a class is missing.

    Counts per distinct score replace pairs of rows; the running count of negatives runs
    over distinct scores.
    """
    per = rows.groupBy("score").agg(
        F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    walk = running_totals(per, [F.col("score").asc()], {"upto": F.col("n")}, [F.col("score")])
    wins = F.col("p") * (F.col("upto") - F.col("n") + F.col("n") / 2.0)
    return walk.agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
        F.coalesce(F.try_divide(F.sum(wins), (F.sum("p") * F.sum("n")).cast("double")),
                   F.lit(float("nan"))).alias("auc"))
