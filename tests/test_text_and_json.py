import json

import pytest
from pyspark.sql import functions as F

from proofmill.functions import jsontext as J, text as X
from proofmill.functions.stage import let, once
from proofmill.operators import outputs as O


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_strip_and_squash_cover_unicode_blanks(spark):
    assert one(spark, X.strip_ws, "　 a ", "\x1fb\x85") == ["a", "b"]
    assert one(spark, X.squash_ws, " a  \t b\n") == ["a b"]


def test_message_normaliser_drops_ids_and_numbers(spark):
    got = one(spark, X.normalize_message,
              "id 123e4567-e89b-12d3-a456-426614174000 and 0123456789abcdef0123 x",
              "recordId=1234567890123-7 at 2026-08-01T10:00:00.5Z", "joinCode=AB12, playerName=kim 7 8 9", "50건 é42")
    assert got == ["id <uuid> and <hex> x", "recordId=<record> at <ts>",
                   "joinCode=<code>, player=<name> <n> <n> <n>", "50건 é42"]
    assert one(spark, X.normalize_alert_text, "5분에 50 건") == ["5분에 50 건"]


def test_error_level_is_the_second_bracket(spark):
    assert one(spark, X.is_error_level, "[t] [ERROR] x", "[t] [ERROR ] x", "[t] [INFO] ERROR", "ERROR") == [
        True, True, False, False]


def test_long_stacks_fold_and_long_lines_are_cut(spark):
    frames = "".join(f" at a.B{i}(F.java:{i})" for i in range(6))
    got = one(spark, X.normalize_line, "x" + frames + " tail", "a\tb", "y" * 900)
    assert got[0] == "x at a.B0(F.java:0) at a.B1(F.java:1) at a.B2(F.java:2) ... (스택 3줄 생략) tail"
    assert got[1] == "a b"
    assert got[2] == "y" * 800 + " …(잘림)"


def test_line_family(spark):
    got = one(spark, X.line_family, "--- [t] c.A : consumer=Foo x", "--- [t] c.A : exception=Bar x", "--- [t] c.A : z", "z")
    assert got == ["c.A:Foo", "c.A:Bar", "c.A", "기타"]


@pytest.mark.parametrize("thread,family", [
    ("", "virtual"), ("http-nio-8080-exec-3", "exec"), ("redis-stream-thread-pool-room:join2", "stream"),
    ("redis-stream-thread-pool-ghost1", None), ("pool-1-thread-2", "pool"), ("delay-removal-task-1", "pool"),
    ("nunchi-task-1", "game-task"), ("clientInboundChannel-9", "ws-inbound"), ("main", None)])
def test_thread_family(spark, thread, family):
    assert one(spark, X.thread_family, thread) == [family]


def test_span(spark):
    df = spark.createDataFrame([(["[2026-01-01 00:00:00.0] a", "[2026-01-01 00:30:00.0] b"],), (["x"],)], "l array<string>")
    got = [tuple(r) for r in df.select(X.span_minutes(F.col("l")), X.span_bucket(X.span_minutes(F.col("l")))).collect()]
    assert got == [(30.0, "mid"), (None, "?")]


DEEP = '{"a":' * 9 + "1" + "}" * 9


@pytest.mark.parametrize("text,found", [
    ('{"a":1}', '{"a":1}'), ('pre {"a":{"b":"}"}} post }', '{"a":{"b":"}"}}'), ('```json\n{"a":1}\n```x', '{"a":1}'),
    ('```\n{"a":"`"}```', '{"a":"`"}'), ("  no json ", "no json"), ('x {"a":1 ', '{"a":1'), ('{"a":"\\"}"}', '{"a":"\\"}"}'),
    ("go " + DEEP + " on", DEEP), ('x \\" {"q":"}"} y', '{"q":"}"} y'.split(" y")[0]), ("```json\n```", "")])
def test_object_extraction(spark, text, found):
    rows = O.extract_objects(spark.createDataFrame([(text,)], "raw string"))
    assert rows.first()["json"] == found


def test_parse_analysis_follows_truthiness(spark):
    texts = ['{"summary":"s","evidenceFound":"false","evidenceLine":null,"suggestedActions":["a",1,true,null]}',
             '{"evidenceFound":0,"rootCauseHypothesis":5}', '{"evidenceFound":[]}', '{"suggestedActions":7}', "[1]", '{"a":1} x',
             '{"suggestedActions":"ab","summary":true}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = {r["i"]: r for r in O.parse_outputs(df).collect()}
    a = got[0]["analysis"]
    assert (a.evidence_found, a.evidence_line, a.suggested_actions) == (True, "", ["a", "1", "True", "None"])
    assert (got[1]["analysis"].evidence_found, got[1]["analysis"].root_cause_hypothesis) == (False, "5")
    assert got[2]["analysis"].evidence_found is False
    assert got[3]["parse_failed"] and got[4]["parse_failed"] and not got[5]["parse_failed"]
    assert got[6]["analysis"].suggested_actions == ["a", "b"] and got[6]["analysis"].summary == "True"
    strict = {r["i"]: r["parse_failed"] for r in O.parse_outputs(df, lenient=False).collect()}
    assert strict[5] and not strict[0]


def test_judge_scores_are_clamped(spark):
    texts = ['{"accuracy":9,"groundedness":-3,"verdict":"pass"}', '{"accuracy":"4","groundedness":3.7,"verdict":"PASS"}',
             '{"accuracy":"3.7","groundedness":true}', "nope"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, judge_raw string")
    got = {r["i"]: (r["score"].accuracy, r["score"].groundedness, r["score"].verdict) for r in O.parse_scores(df).collect()}
    assert got == {0: (5, 0, "FAIL"), 1: (4, 3, "PASS"), 2: (0, 1, "FAIL"), 3: (0, 0, "FAIL")}


def test_target_json_is_spaced_and_round_trips(spark):
    raw = json.dumps({"summary": 'a "q" \\ 한글\n', "rootCauseHypothesis": "", "suggestedActions": ["x", "y"],
                      "evidenceFound": True, "evidenceLine": "l"}, ensure_ascii=False)
    df = O.parse_outputs(spark.createDataFrame([(raw,)], "raw string"))
    assert df.select(J.target_json(F.col("analysis"))).first()[0] == raw


def test_once_keeps_rows_and_nulls(spark):
    df = once(spark.createDataFrame([(1,), (None,)], "v int"), w=F.col("v") * 2)
    assert [tuple(r) for r in df.collect()] == [(1, 2), (None, None)]
    assert df.select(let(F.col("w"), lambda w: w + 1).alias("x")).first()["x"] == 3


def test_large_objects_need_no_regex_stack(spark):
    flat = '{"a":[' + ",".join(['"x\\n{"'] * 50_000) + "]}"
    rows = spark.createDataFrame([("pre " + flat + " }",)], "raw string")
    assert O.extract_objects(rows).first()["json"] == flat


def test_normalising_equals_its_rules_one_after_the_other(spark):
    """The scan ahead of the rules and the literal names change no result."""
    import random

    rules = [
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"), (r"\b[0-9a-f]{16,32}\b", "<hex>"),
        (r"\b\d{13}-\d+\b", "<record>"), (r"\b\d{4}-\d{2}-\d{2}T[\d:.]+Z\b", "<ts>"), (r"joinCode=[A-Z0-9]{4}", "joinCode=<code>"),
        (r"\b(?:playerName|guestName)=\S+", "player=<name>")]
    number = (r"\b\d+\b", "<n>")
    pieces = ["0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", "deadbeefdeadbeef", "0" * 13 + "-", "2026-01-02T03:04:05.6Z", "joinCode=AB12", "playerName=",
              "guestName=", "x", "é", "예", " ", " ", "́", "7", "42", "٣", "\U0001d7ce" * 13, "-", "_", "=", "f" * 33, "join", "\n", "<", "Z"]
    rng = random.Random(7)
    values = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))),) for _ in range(3000)] + [(None,)]

    def plain(value, rules):
        for pattern, placeholder in rules:
            value = F.regexp_replace(value, X.rx(pattern), placeholder)
        return X.strip_ws(value)

    rows = spark.createDataFrame(values, "v string")
    got = rows.select("v", X.normalize_message(F.col("v")).alias("m"), plain(F.col("v"), [*rules, number]).alias("m_want"),
                      X.normalize_alert_text(F.col("v")).alias("a"), plain(F.col("v"), rules).alias("a_want"))
    assert got.where("NOT (m <=> m_want) OR NOT (a <=> a_want)").collect() == []
    assert got.where("m LIKE '%<uuid>%'").count() and got.where("m LIKE '%<record>%'").count() and got.where("m LIKE '%player=<name>%'").count()
