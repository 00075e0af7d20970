import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from proofmill.functions.ordering import hash_rank, running_totals, share_by_key
from proofmill.operators import metrics as M, stats as S


@pytest.mark.parametrize("better,worse,p", [(8, 0, 0.0078), (2, 7, 0.1797), (8, 3, 0.2266), (3, 2, 1.0), (0, 0, 1.0)])
def test_mcnemar_published_values(spark, better, worse, p):
    row = S.mcnemar(spark.createDataFrame([(better, worse)], "better long, worse long")).first()
    assert round(row["p_value"], 4) == p


def test_mcnemar_does_not_underflow(spark):
    row = S.mcnemar(spark.createDataFrame([(3000, 2900)], "better long, worse long")).first()
    assert row["p_value"] == pytest.approx(0.1975, abs=2e-3)


def test_mcnemar_against_exact_sums(spark):
    cases = [(b, w) for b in range(0, 40, 3) for w in range(0, 40, 5)] + [(700, 610), (5000, 5000), (1, 2000)]
    got = {(r["better"], r["worse"]): r["p_value"] for r in S.mcnemar(spark.createDataFrame(cases, "better long, worse long")).collect()}
    for b, w in cases:
        n = b + w
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, w) + 1)) / 2 ** n) if n else 1.0
        assert got[b, w] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_mcnemar_of_billions_of_pairs(spark):
    """Far out, the exact p-value is the normal one with a continuity correction, nearly."""
    half = 3_000_000_000
    for gap in (0, 60_000, 200_000):
        p = S.mcnemar(spark.createDataFrame([(half + gap, half - gap)], "better long, worse long")).first()["p_value"]
        want = min(1.0, math.erfc((2 * gap - 1) / math.sqrt(2 * half) / math.sqrt(2)))
        assert p == pytest.approx(want, rel=2e-3)


def test_draws_reach_units_evenly(spark):
    """Counts of many draws over a few units: a chi-square of k - 1 degrees."""
    s, c = np.eye(7), np.ones(7, np.int64)
    hits = np.zeros(7)
    for unit in range(7):
        rows = spark.createDataFrame([(f"u{i}", float(s[unit][i])) for i in range(7)], "cluster string, diff double")
        hits[unit] = S.paired_bootstrap(rows, iters=500).first()["observed"]
    assert hits.sum() == pytest.approx(1)
    z = S._mixed(np.uint64(5) + np.arange(70_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(7)
    seen = np.bincount(z.astype(int), minlength=7)
    assert ((seen - 10_000) ** 2 / 10_000).sum() < 22.5  # 0.001 of 6 degrees


@pytest.mark.parametrize("leaf", (5, 40, 4096))
def test_leaves_split_the_draws_as_one_urn_would(spark, leaf):
    """Every iteration has k draws in all, and the spread is that of k independent draws."""
    rng = np.random.default_rng(leaf)
    values = rng.normal(size=300) ** 2
    rows = spark.createDataFrame([(f"u{i}", float(v)) for i, v in enumerate(values)], "cluster string, diff double")
    got = [S.paired_bootstrap(rows.repartition(p), iters=1500, leaf=leaf).first() for p in (1, 5)]
    assert got[0]["se"] == pytest.approx(got[1]["se"], abs=1e-12)
    assert (got[0]["n"], got[0]["n_clusters"]) == (300, 300) and got[0]["observed"] == pytest.approx(values.mean())
    assert got[0]["se"] == pytest.approx(values.std() / 300 ** 0.5, rel=0.08)
    assert got[0]["ci_low"] == pytest.approx(values.mean() - 1.96 * values.std() / 300 ** 0.5, rel=0.06)
    constant = rows.withColumn("diff", F.lit(2.0))  # sums over counts are right only if all k draws are there
    row = S.paired_bootstrap(constant, iters=50, leaf=leaf).first()
    assert row["se"] == pytest.approx(0, abs=1e-12) and row["ci_high"] == pytest.approx(2)


def test_groups_are_drawn_each_on_its_own_and_no_draw_is_joined(spark):
    rows = spark.createDataFrame([(g, f"u{i}", float(i % 7) * (g + 1)) for g in (0, 1, 2) for i in range(20 * (g + 1))],
                                 "size int, cluster string, diff double")
    out = S.paired_bootstrap(rows, iters=400, by=["size"], leaf=8)
    got = {r["size"]: r for r in out.collect()}
    for g in (0, 1, 2):
        one = S.paired_bootstrap(rows.where(F.col("size") == g), iters=400, leaf=8).first()
        assert (got[g]["se"], got[g]["ci_low"]) == pytest.approx((one["se"], one["ci_low"]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "idx" not in plan and "InMemoryRelation" not in plan


def test_a_scenario_without_a_cluster_is_an_error(spark):
    a, b = arms(spark, {"x": (0, 1), "y": (1, 1)})
    clusters = spark.createDataFrame([("x", "c")], "scenario string, cluster string")
    assert S.paired_diff(a.filter("scenario = 'x'"), b.filter("scenario = 'x'"), clusters).count() == 1
    with pytest.raises(PySparkException, match="without a cluster: y"):
        S.paired_diff(a, b, clusters).collect()


def arms(spark, pairs):
    mk = lambda i: spark.createDataFrame([(n, float(v[i])) for n, v in pairs.items()], "scenario string, score double")
    return mk(0), mk(1)


def test_constant_difference_has_no_spread(spark):
    a, b = arms(spark, {f"s{i}": (i / 20, i / 20 + 0.25) for i in range(12)})
    clusters = spark.createDataFrame([(f"s{i}", f"c{i % 3}") for i in range(12)], "scenario string, cluster string")
    row = S.with_power(S.paired_bootstrap(S.paired_diff(a, b, clusters), iters=100), effect=0.1).first()
    assert row["n"] == 12 and row["n_clusters"] == 3
    assert row["observed"] == pytest.approx(0.25) and row["se"] == pytest.approx(0, abs=1e-12)
    assert row["ci_low"] == pytest.approx(0.25) and row["significant"]


def test_bootstrap_spread_matches_theory_and_repeats(spark):
    rng = random.Random(3)
    a, b = arms(spark, {f"s{i}": (0.0, rng.random()) for i in range(60)})
    d = S.paired_diff(a, b)
    rows = [S.paired_bootstrap(d.repartition(p), "scenario", iters=800).first() for p in (1, 7)]
    assert rows[0]["se"] == pytest.approx(rows[1]["se"], abs=1e-12)
    sd = d.agg(F.stddev_pop("diff")).first()[0]
    assert rows[0]["se"] == pytest.approx(sd / 60 ** 0.5, rel=0.12)


def test_different_scenario_sets_are_an_error(spark):
    a, b = arms(spark, {"x": (0, 1), "y": (0, 1)})
    with pytest.raises(Exception, match="one arm only"):
        S.paired_diff(a, b.filter("scenario = 'x'")).collect()


def test_effect_must_be_positive(spark):
    with pytest.raises(ValueError):
        S.with_power(spark.range(1), effect=0)


def scored(spark, labels, scores):
    return spark.createDataFrame([(i, bool(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))],
                                 "idx long, label boolean, score double")


def test_auc_from_rank_sums(spark):
    rng = np.random.default_rng(11)
    labels, scores = rng.random(300) < 0.4, np.round(rng.random(300), 1)
    # mean rank of equal scores: how many lie below, and the middle of those alike
    rank = np.array([(scores < s).sum() + ((scores == s).sum() + 1) / 2 for s in scores])
    p, n = labels.sum(), (~labels).sum()
    want = (rank[labels].sum() - p * (p + 1) / 2) / (p * n)
    assert S.auc(scored(spark, labels, scores)).first()["auc"] == pytest.approx(want)


def test_roc_points_and_threshold_by_counting_at_every_cut(spark):
    rng = np.random.default_rng(12)
    scores = rng.permutation(200) / 200
    labels = rng.random(200) < scores
    df = scored(spark, labels, scores)
    got = {round(r["threshold"], 6): (r["tpr"], r["fpr"]) for r in S.roc_points(df).collect()}
    rates = {round(c, 6): ((labels & (scores >= c)).sum() / labels.sum(), (~labels & (scores >= c)).sum() / (~labels).sum())
             for c in [1.01, *scores]}
    assert set(got) == set(rates) and all(got[c] == pytest.approx(rates[c]) for c in rates)
    best = max(rates, key=lambda c: (round(rates[c][0] - rates[c][1], 9), c))
    row = S.best_threshold(S.roc_points(df)).first()
    assert (row["threshold"], row["j"]) == pytest.approx((best, rates[best][0] - rates[best][1]))


def test_one_class_has_no_auc(spark):
    assert math.isnan(S.auc(scored(spark, [1, 1], [0.1, 0.2])).first()["auc"])


def test_ranks_and_totals_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    for parts in (1, 7):
        rows = hash_rank(df.repartition(parts), F.col("name"), "r").collect()
        assert sorted(r["r"] for r in rows) == list(range(1, 501))
        total = running_totals(df.repartition(parts), [F.col("id").desc()], {"t": F.col("id")}).collect()
        want, acc = {}, 0
        for i in range(499, -1, -1):
            acc += i
            want[i] = acc
        assert {r["id"]: r["t"] for r in total} == want


@pytest.mark.parametrize("buckets", (2, 3, 7, 64))
def test_totals_from_sketched_bounds_with_ties_of_any_size(spark, buckets):
    rng = random.Random(buckets)
    rows = [(i, rng.choice([0.5, 0.5, 0.5, 0.5, -1.0, 0.0, -0.0, 2.0, float("inf"), rng.random()]), i % 5) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, score double, v long").repartition(6)
    for sign in (1, -1):
        order = [F.col("score").asc() if sign > 0 else F.col("score").desc(), F.col("id").asc()]
        got = running_totals(df, order, {"t": F.col("v"), "n": F.lit(1)}, [sign * F.col("score"), F.col("id")], buckets, overall=True).collect()
        want, acc = {}, 0
        for n, (i, score, v) in enumerate(sorted(rows, key=lambda r: (sign * r[1], r[0])), 1):
            acc += v
            want[i] = (acc, n)
        assert {r["id"]: (r["t"], r["n"]) for r in got} == want
        assert {(r["t_all"], r["n_all"]) for r in got} == {(acc, 1500)}


def test_totals_of_nulls_nans_and_nothing(spark):
    rows = [(1, None), (2, float("nan")), (3, 1.0), (4, None), (5, 0.0)]
    df = spark.createDataFrame(rows, "id long, score double")
    order = [F.col("score").asc(), F.col("id").asc()]
    got = running_totals(df, order, {"n": F.lit(1)}, [F.col("score"), F.col("id")], 4).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["n"])] == [1, 4, 5, 3, 2]
    assert running_totals(df.where("id > 9"), order, {"n": F.lit(1)}, [F.col("score"), F.col("id")]).collect() == []


def test_a_large_tie_is_dealt_over_many_buckets(spark):
    from proofmill.functions.ordering import _bounds, _bucket
    df = spark.range(6000).select(F.col("id").cast("double").alias("__p_1"), F.when(F.col("id") % 3 > 0, 0.5).otherwise(F.col("id") / 9000.0).alias("__p_0"))
    bounds = df.agg(_bounds("__p_0", 60).alias("__b_0"), _bounds("__p_1", 60).alias("__b_1"))
    placed = df.select("*", *[bounds.select(c).scalar().alias(c) for c in bounds.columns])
    sizes = [r["count"] for r in placed.groupBy(_bucket(2, 60).alias("at")).count().collect()]
    assert len(sizes) > 45 and max(sizes) < 6000 / 60 * 3


def test_roc_plan_deals_rows_once_and_keeps_nothing(spark):
    df = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") % 2 == 0).alias("label"), (F.col("id") / 100.0).alias("score"))
    plan = S.roc_points(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "RepartitionByExpression" not in plan


def test_share_by_key_with_one_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"))
    rows = rows.withColumn("k", F.when(F.col("id") == 7, F.lit(None)).otherwise(F.col("k")))
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    for hot in (1, 5, 1000):
        got = {r["id"]: (r["n"], r["first"]) for r in share_by_key(rows, sums, ["k"], "n", hot).collect()}
        plain = {r["id"]: (r["n"], r["first"]) for r in rows.join(sums, "k", "left").collect()}
        few = sums.where("n > 1 and first < 40")
        thin = {r["id"]: r["first"] for r in share_by_key(rows, few, ["k"], "n", hot, sparse=True).collect()}
        assert thin == {r["id"]: r["first"] for r in rows.join(few, "k", "left").collect()}
        assert got == plain and len(got) == 3000


def test_rows_of_hot_keys_reach_no_exchange(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = share_by_key(rows, sums, ["k"], "n")
    parts = str(out._jdf.queryExecution().sparkPlan()).split("Union")[1]
    done = parts.split("\n:- ")[1].split("\n+- ")[0]  # the first branch: one broadcast join
    assert "BroadcastHashJoin" in done and "SortMergeJoin" not in done and "Exchange hash" not in done.split("TakeOrdered")[0]


def test_paired_counts_flip_on_negatives(spark):
    rows = [(arm, name, -1, yes, g) for name, yes, was, now in [
        ("p1", True, False, True), ("p2", True, True, False), ("n1", False, False, True), ("n2", False, True, False), ("p3", True, True, True)]
        for arm, g in (("a", was), ("b", now))] + [("a", "only", -1, True, True)]
    df = spark.createDataFrame(rows, "arm string, scenario string, sample_idx int, expects_yes boolean, grounded boolean")
    got = {r["sign"]: (r["better"], r["worse"], r["same"]) for r in S.paired_counts(df, "a", "b").collect()}
    assert got == {"positive": (1, 1, 2), "negative": (1, 1, 0)}


def test_scenario_stats_and_totals(spark):
    rows = [("r", "a", 1, 5, 4, False, "PASS", None), ("r", "a", 2, 1, 0, True, "FAIL", "boom"), ("r", "b", 1, 5, 5, False, "PASS", None)]
    t = spark.createDataFrame(rows, "run string, scenario string, trial int, accuracy int, groundedness int, "
                                    "hallucination_detected boolean, verdict string, error string")
    stats = M.scenario_stats(t)
    a = {r["scenario"]: r for r in stats.collect()}["a"]
    assert (a["trials"], a["passes"], a["mean_accuracy"], a["hallucinations"], a["errors"], a["pass_rate"]) == (2, 1, 3.0, 1, 1, 0.5)
    total = M.run_totals(stats).first()
    assert (total["scenarios"], total["trials"], total["always_pass"]) == (2, 3, 1)


def test_length_guard_raises_and_never_drops(spark):
    df = spark.createDataFrame([(100,), (300,)], "length int")
    assert M.enforce_length(df, 300)["recommended_limit"] == 384
    with pytest.raises(M.SampleTooLong, match="384"):
        M.enforce_length(df, 200)
