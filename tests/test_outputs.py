import json

import pytest
from conftest import NO_RUBRIC, YES_RUBRIC, alert, lines, scenario
from pyspark.sql import functions as F

from proofmill.operators import outputs as O, prompts as P

L0 = lines()[0]


def answer(**kw):
    base = dict(summary="s", rootCauseHypothesis="c", suggestedActions=[], evidenceFound=True, evidenceLine=L0)
    return json.dumps({**base, **kw}, ensure_ascii=False)


@pytest.fixture(scope="module")
def scored(spark, make):
    cases = {
        "exact": answer(), "blanks": answer(evidenceLine=L0.replace(" ", "  ")), "partial": answer(evidenceLine=L0[30:]),
        "made_up": answer(evidenceLine="made up"), "empty": answer(evidenceLine=""),
        "denied": answer(evidenceFound=False, rootCauseHypothesis=""), "guess": answer(evidenceFound=False),
        "broken": "{", "no_summary": answer(summary=" "),
    }
    s = make.scenarios([scenario(1, name="pos"), scenario(2, name="neg", rubric=NO_RUBRIC, expected="아니오")])
    rows = [(case, name, i, raw) for name in ("pos", "neg") for i, (case, raw) in enumerate(cases.items())]
    outs = spark.createDataFrame(rows, "arm string, scenario string, sample_idx int, raw string")
    return {(r["scenario"], r["arm"]): r for r in O.score_outputs(outs, s).collect()}


def test_grounding_is_lenient_about_blanks_and_parts(scored):
    got = {c: scored["pos", c]["grounded"] for _, c in scored}
    assert got == {"exact": True, "blanks": True, "partial": True, "made_up": False, "empty": False,
                   "denied": False, "guess": False, "broken": False, "no_summary": True}


@pytest.mark.parametrize("case,pos,neg", [
    ("exact", 1.0, 0.5), ("blanks", 0.6, 0.5), ("partial", 0.6, 0.5), ("empty", 0.6, 0.5), ("denied", 0.5 + 0.0, 1.0),
    ("guess", 0.2, 0.7), ("broken", 0.0, 0.0), ("no_summary", 0.9, 0.4)])
def test_reward(scored, case, pos, neg):
    # a denial keeps its format and, on the strict citation rule, its citation points
    pos = {"denied": 0.5, "guess": 0.2}.get(case, pos)
    assert scored["pos", case]["reward"] == pytest.approx(pos)
    assert scored["neg", case]["reward"] == pytest.approx(neg)


def test_expectation_prefers_the_stated_verdict(spark):
    rows = [("예", NO_RUBRIC), ("아니오", YES_RUBRIC), ("", YES_RUBRIC), ("", NO_RUBRIC), (None, "'근거 발견: 아니오'면 정답. '근거 발견: 예'면 오답")]
    df = spark.createDataFrame(rows, "expected string, rubric string")
    assert [r["expects_yes"] for r in O.with_expectation(df).collect()] == [True, False, True, False, False]


def target(spark, **kw):
    row = O.parse_outputs(spark.createDataFrame([("x", answer(**kw))], "scenario string, raw string"))
    return row.withColumns({
        "log_samples": F.array(*[F.lit(x) for x in lines()]), "expects_yes": F.lit(True),
        "alert": F.from_json(F.lit(json.dumps(alert(), ensure_ascii=False)),
                             "alertname string, summary string, description string, labels map<string,string>")})


def test_identifier_rules_differ_in_scope(spark):
    t = target(spark, summary="PhantomConsumer 실패, RestExceptionHandler", suggestedActions=["GhostFactory 재시작", "stream=ghost"])
    a, logs, al = F.col("analysis"), F.col("log_samples"), F.col("alert")
    row = t.select(O.identifiers_grounded(a, logs, al).alias("x"), O.no_fabricated_identifiers(a, logs, al).alias("y")).first()
    assert row["x"] == ["consumer:PhantomConsumer"]
    assert sorted(row["y"]) == ["consumer:GhostFactory", "consumer:PhantomConsumer", "stream:ghost"]


def test_verify_target_names_the_first_rule(spark):
    row = O.verify_target(target(spark, evidenceFound=False)).first()
    assert row["first_rule"] == "verdict"
    assert row["failures"]["no-cause"] == ["cause_without_evidence"]
    assert O.verify_target(target(spark)).first()["first_rule"] is None


def test_citation_repair_needs_exactly_one_line(spark):
    fix = lambda **kw: target(spark, **kw).select(
        O.repair_citation(F.col("analysis"), F.col("log_samples"))["evidence_line"]).first()[0]
    assert fix(evidenceLine="message=m1") == lines()[1]
    assert fix(evidenceLine="uri=/rooms") == "uri=/rooms"
    assert fix(evidenceLine="nowhere") == "nowhere"


def test_evidence_identifiers(spark):
    line = ("[t] [ERROR] [,] --- [redis-stream-thread-pool-room:join3] c.g.o.OutboxEventProcessor : "
            "SelectCardConsumer streamKey=cardgame:select")
    got = spark.range(1).select(O.evidence_identifiers(F.lit(line))).first()[0]
    assert sorted(got) == sorted(["c.g.o.OutboxEventProcessor", "OutboxEventProcessor", "SelectCardConsumer",
                                  "cardgame:select", "room:join"])


def test_trials_survive_broken_answers(spark, make):
    good = '{"accuracy":5,"groundedness":5,"hallucinationDetected":false,"verdict":"PASS","rationale":"ok"}'
    t = spark.createDataFrame([("r", "monitor-s1", 1, answer(), good, 9), ("r", "monitor-s1", 2, "oops", good, 9)],
                              "run string, scenario string, trial int, raw string, judge_raw string, latency_ms long")
    rows = {r["trial"]: r for r in O.trial_results(t, make.scenarios([scenario(1)])).collect()}
    assert rows[1]["verdict"] == "PASS" and rows[1]["answer"].startswith("요약: s\n근거 발견: 예\n원인 가설: c\n제안 조치: (없음)")
    assert rows[2]["verdict"] == "FAIL" and rows[2]["answer"] == "평가 실패" and rows[2]["error"]


def test_prompt_layout(make):
    text = P.with_prompt(make.scenarios([scenario(1, log_samples=["l1"])])).first()["prompt"]
    assert text.splitlines() == [
        "심각도: critical", "지문: f", "알림명: Http5xxRatioHigh", "요약: HTTP 5xx 비율 5% 초과 (prod-app)",
        "설명(사람이 적어둔 추측 — 확인된 사실 아님): 최근 5분 5xx 비율이 7%. 서버 측 광범위 실패 가능성.", "라벨:", "- job=prod-app",
        "", "최근 ERROR 로그 샘플 (출처 환경: prod):", "- l1"]
    bare = P.with_prompt(make.scenarios([scenario(1, log_samples=[])])).first()["prompt"]
    assert bare.endswith("- job=prod-app\n")


def test_variant_rules_go_before_the_marker(spark, make):
    v = P.PromptVariants("a\nMARK b", {"x": (" rule", "\nMARK"), "y": (" end", None)})
    got = {r["variant"]: r["system"] for r in P.prompt_variants(make.scenarios([scenario(1)]), v).collect()}
    assert got == {"production": "a\nMARK b", "x": "a rule\nMARK b", "y": "a\nMARK b end"}
    with pytest.raises(ValueError):
        P.PromptVariants("a", {"x": ("r", "gone")}).column()


def test_citations_with_other_blanks_than_their_line(spark):
    rows = spark.createDataFrame([
        (None, ["a b"]), ("", ["a b"]), (" \t", ["a b"]), ("a  b", ["x a b y"]), ("a b", ["x a  b y"]), ("a b", ["a", "b a"]), ("a b", None), ("b", ["a", None, "b"])],
        "evidence string, lines array<string>")
    got = rows.select(O.cites_log(F.col("evidence"), F.col("lines")).alias("c")).collect()
    assert [r["c"] for r in got] == [False, False, False, True, True, False, False, True]


def test_without_a_citation_no_line_is_squashed(monkeypatch, spark):
    """Nor is one for a citation that some line holds when the citation alone is squashed."""
    whole = O.X.squash_ws
    monkeypatch.setattr(O.X, "squash_ws", lambda v: whole(v) if "evidence" in str(v) else
                        F.raise_error(F.lit("squashed")).cast("string"))
    rows = spark.createDataFrame([(None, ["a b"]), ("a  b", ["a z b", "x a b y"])], "evidence string, lines array<string>")
    got = rows.select(O.cites_log(F.col("evidence"), F.col("lines")).alias("c")).collect()
    assert [r["c"] for r in got] == [False, True]
