import pytest
from conftest import NO_RUBRIC, alert, candidate, lines, scenario
from pyspark.sql import functions as F

from proofmill.operators import dedup as D, metrics as M, pairs as P, rules as V


def with_line(text):
    return [lines()[0][:25] + text, lines()[1]]


HEAD = " [ERROR] [,] --- [http-nio-8080-exec-1] "
FAULTS = {
    "schema": dict(log_environment="dev"), "alert": dict(alert=alert(severity="info", description="최근 5분 5xx 비율이 22%. 서버 측 광범위 실패 가능성.")),
    "alert-text": dict(alert=alert(summary="other")),
    "log-line": dict(log_samples=with_line(HEAD + "c.web.exception.RestExceptionHandler : invented")),
    "slot-value": dict(log_samples=with_line(HEAD + "c.web.exception.RestExceptionHandler : method=GET uri=/x exception=E message=m")),
    "error-level": dict(log_samples=[x.replace("[ERROR]", "[WARN]") for x in lines()]),
    "timestamp": dict(log_samples=lines()[::-1]), "rubric": dict(rubric=NO_RUBRIC.replace("예", "네")),
    "duplicate": dict(name="taken"), "duplicate-content": dict(),
}


@pytest.fixture(scope="module")
def validated(make):
    old = make.scenarios([scenario(1, name="taken", alert=alert(alertname="CpuUsageHigh"))])
    rows = [candidate(0, name="monitor-clean")]
    for i, (name, change) in enumerate(FAULTS.items(), 1):
        base = {"name": f"monitor-c{i}", "alert": alert(description=f"최근 5분 5xx 비율이 {i}%. 서버 측 광범위 실패 가능성.")}
        if name == "duplicate-content":
            base.pop("alert")
        rows.append(candidate(i, **{**base, **change}))
    rows.append(candidate(99, name="monitor-lacking", present=["name"]))
    return V.validate(make.candidates(rows), old)


def failing(row):
    return {k for k, v in row["failures"].items() if v}


def test_each_fault_meets_its_validator(validated):
    got = {r["seq"]: failing(r) for r in validated.collect()}
    assert got[0] == set()
    for i, name in enumerate(FAULTS, 1):
        assert name in got[i], (name, got[i])
    assert got[10] == {"duplicate-content"}
    assert got[99] == {"schema"}


def test_filter_stats_count_a_candidate_once_per_validator(validated):
    stats = {(r["kind"], r["name"]): r["n"] for r in M.filter_stats(validated).collect()}
    assert stats["total", ""] == 12 and stats["passed", ""] == 1 and stats["drop", "duplicate-content"] == 1


def test_screener_only_sees_clean_candidates(spark, validated):
    screens = spark.createDataFrame([("monitor-clean", True, ""), ("monitor-c1", True, "x")],
                                    "name string, contradiction boolean, reason string")
    got = {r["name"]: failing(r) for r in V.screen(validated, screens).collect()}
    assert got["monitor-clean"] == {"screen"} and "screen" not in got["monitor-c1"]


def test_two_verdicts_of_one_name_are_one(spark, validated):
    screens = spark.createDataFrame([("monitor-clean", True, "b"), ("monitor-clean", True, "a"), ("monitor-clean", False, "")],
                                    "name string, contradiction boolean, reason string")
    rows = V.screen(validated, screens).collect()
    assert len(rows) == validated.count()
    assert next(r["failures"]["screen"] for r in rows if r["name"] == "monitor-clean") == ["a"]


def test_an_incomplete_alert_registers_no_content(make):
    alone = alert()
    rows = [candidate(1, name="monitor-x1", alert={**alone, "severity": None}), candidate(2, name="monitor-x2", alert=alone),
            candidate(3, name="monitor-x3", alert=alone)]
    got = {r["seq"]: list(r["v_duplicate-content"]) for r in V.duplicate_contents(make.candidates(rows)).collect()}
    assert got[1] == got[2] == [] and got[3]


def test_name_twins_within_a_batch(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq long, name string")
    flags = lambda **kw: {r["seq"]: bool(r["v_duplicate"]) for r in V.duplicate_names(rows, **kw).collect()}
    assert flags() == {1: False, 2: True, 3: False}
    assert flags(within_batch=False) == {1: False, 2: False, 3: False}


def test_duplicates_point_to_the_earliest(make):
    rows = make.scenarios([scenario(1), scenario(2), scenario(3, alert=alert(summary="else")), scenario(4)])
    got = {(r["later"], r["earlier"], r["partner_side"]) for r in D.find_duplicates(D.with_signature(rows)).collect()}
    assert got == {("monitor-s2", "monitor-s1", "batch"), ("monitor-s4", "monitor-s1", "batch")}
    held = make.scenarios([scenario(9, name="gold")])
    got = {(r["later"], r["earlier"], r["partner_side"])
           for r in D.find_duplicates(D.with_signature(rows), D.with_signature(held)).collect()}
    assert got == {(f"monitor-s{i}", "gold", "against") for i in (1, 2, 4)}


def test_ids_do_not_matter_but_alert_and_span_do(make):
    moved = [x.replace("10:01", "23:59") for x in lines()]
    rows = make.scenarios([
        scenario(1), scenario(2, log_samples=[x.replace("message=m", "message=m ") for x in lines()]),
        scenario(3, log_samples=moved), scenario(4, log_samples=[x.replace("08-01", "09-02") for x in lines()])])
    sig = {r["seq"]: r["signature"] for r in D.with_signature(rows).collect()}
    assert sig[4] == sig[1] and len({sig[1], sig[2], sig[3]}) == 3


def side(base, s, seq, **kw):
    return candidate(seq, **{"name": f"{base}-{s}", "alert": alert(summary=s), "expected": "예" if s == "a" else "아니오", **kw})


def test_contrast_pairs(make):
    rows = make.candidates([
        side("ok", "a", 1), side("ok", "b", 2), side("logs", "a", 3), side("logs", "b", 4, log_samples=lines(3)),
        side("same", "a", 5), side("same", "b", 6, expected="예"), side("text", "a", 7), side("text", "b", 8, alert=alert(summary="a")),
        side("alone", "a", 9), side("env", "a", 10), side("env", "b", 11, log_environment="dev"), candidate(12, name="single")])
    got = {(r["base"], r["reason"]) for r in P.contrast_pairs(rows).collect()}
    assert got == {("logs", "logs_differ"), ("same", "same_verdict"), ("text", "same_alert_text"),
                   ("alone", "missing_side"), ("env", "other_environment")}
    assert {r["name"] for r in P.paired_names(rows).collect()} == {"ok-a", "ok-b"}


def test_temporal_pairs(make):
    far = [lines()[0], lines()[1].replace("10:01", "14:01")]
    rows = make.candidates([
        side("ok", "a", 1), side("ok", "b", 2, log_samples=far), side("tight", "a", 3), side("tight", "b", 4),
        side("both", "a", 5, log_samples=far), side("both", "b", 6), side("count", "a", 7), side("count", "b", 8, log_samples=lines(3)),
        side("content", "a", 9), side("content", "b", 10, log_samples=[x + "!" for x in lines()])])
    got = {(r["base"], r["reason"]) for r in P.temporal_pairs(rows).collect()}
    assert got == {("tight", "no_side_tight"), ("both", "yes_side_spread"), ("both", "no_side_tight"),
                   ("count", "line_count_differs"), ("content", "content_differs")}


def test_leaks_need_the_same_alert(spark):
    prompt = lambda name, n: f"심각도: x\n지문: {n}\n알림명: {name}\n요약: s\n- [2026] a {n}"
    chat = spark.createDataFrame([("train", 1, prompt("A", 1)), ("valid", 2, prompt("A", 2)), ("valid", 3, prompt("B", 3))],
                                 "split string, line_no long, user string")
    assert [r["line_no"] for r in D.train_valid_leaks(chat).collect()] == [2]
    gold = spark.createDataFrame([(["[2026] a 77"],)], "log_samples array<string>")
    assert {r["line_no"] for r in D.contaminated_prompts(chat, gold).collect()} == {1, 2, 3}


def test_split_integrity(spark):
    m = spark.createDataFrame([("dev", "a"), ("test", "a"), ("dev", "gone")], "split string, name string")
    s = spark.createDataFrame([("a",), ("new",)], "name string")
    got = {tuple(r) for r in D.split_integrity(m, s).collect()}
    assert got == {("in_two_splits", "a"), ("unassigned", "new"), ("unknown_member", "gone")}


def test_exemplars_fall_back_to_the_first_ones(make):
    rows = make.scenarios([scenario(i) for i in range(1, 5)])  # no negative rubric head
    rows = rows.withColumn("rubric", F.lit("'근거 발견: 예'로 판정하면 정답"))
    got = {(r["axis"], r["name"]) for r in V.pick_exemplars(rows).collect()}
    assert ("unrelated-trap", "monitor-s1") in got and len(got) == 14


def test_prefilter_drops_no_match_and_few_others_pass(spark):
    from proofmill.functions.prefilter import flag_possible, possible
    rows = spark.range(4000).select(F.when(F.col("id") % 400 == 7, F.lit(None)).otherwise(F.concat(F.lit("k"), "id")).alias("k"),
                                    (F.col("id") % 3).alias("m"), "id")
    side = rows.where("id % 10 = 0").select("k", "m").unionByName(spark.createDataFrame([(None, 1), ("other", 2)], "k string, m long"))
    for bits in (1 << 20, 1 << 12):
        got = {r["id"]: r["hit"] for r in flag_possible(rows, side, ["k", "m"], "hit", bits).collect()}
        assert len(got) == 4000 and all(got[i] for i in range(0, 4000, 10) if i % 400 != 7)
        assert not any(got[i] for i in range(7, 4000, 400))
    few = possible(rows, side, ["k", "m"]).count()
    assert 400 <= few <= 405
    assert possible(rows, side.limit(0), ["k"]).count() == 0 and flag_possible(rows.limit(0), side, ["k"], "hit").count() == 0
    plan = possible(rows, side, ["k", "m"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_signatures_are_computed_once_for_both_tables(spark):
    """Firsts, frequent keys and the join read kept rows, not the signatures' making."""
    made = spark.sparkContext.accumulator(0)

    def sign(seq):
        made.add(1)
        return str(seq % 4)

    signed = lambda lo, hi: spark.range(lo, hi).selectExpr("id AS seq", "concat('n', id) AS name").withColumn(
        "signature", F.udf(sign, "string")("seq"))
    got = D.find_duplicates(signed(0, 10), signed(100, 102)).collect()
    assert {(r["seq"], r["earlier"], r["partner_side"]) for r in got} == {
        (0, "n100", "against"), (4, "n100", "against"), (8, "n100", "against"), (1, "n101", "against"), (5, "n101", "against"),
        (9, "n101", "against"), (6, "n2", "batch"), (7, "n3", "batch")}
    assert made.value == 12
