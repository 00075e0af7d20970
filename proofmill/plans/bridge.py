"""The data model's tables, derived from the driver's tables.

The driver has no scenarios, model outputs or logs. These views make them out of the whole
of ``documents`` (with ``labels``), ``events`` and ``supplier``, with faults spread over the
rows, so that every operator meets the cases it is there for. ``plans/oracle.py`` says the
same in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as K
from ..session import tune

ARMS = ("base", "trained")
SAMPLES = (-1, 0, 1, 2, 3)
QUESTION = "알림의 원인은?"
SYSTEM = "로그를 보고 JSON 하나로 답하라."
YES_RUBRIC = "'근거 발견: 예'로 판정하면 정답. '근거 발견: 아니오'로 판정하면 오답."
NO_RUBRIC = "'근거 발견: 아니오'로 판정하면 정답. '근거 발견: 예'로 판정하면 오답."
MENTION = " 알림 수치를 언급해야 한다."
ALERTS = list(K.ALERT_RULES)
RULE_NAMES = ("CircuitBreakerOpen", "AppInstanceDown", "RedisStreamE2eLatencyHigh",
              "WsConnectionFailuresHigh", "SomethingElse")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def log_format(lines: Column, n: Column, id_: Column) -> Column:
    """Text lines as log lines; only the timestamps depend on the row's id."""
    step = F.when(n % 3 == 0, 20).when(n % 3 == 1, 600).otherwise(4000)
    base = F.lit(1767225600) + (id_ % 365) * 86400

    def one(line: Column, i: Column) -> Column:
        stamp = F.concat(
            F.date_format(F.timestamp_seconds(base + i.cast("long") * step), "yyyy-MM-dd HH:mm:ss"), F.lit("."),
            F.lpad((i % 1000).cast("string"), 3, "0"))
        d = (i % 10).cast("string")
        tail = (
            F.when(i % 4 == 0, F.concat(
                F.lit("http-nio-8080-exec-"), d, F.lit("] c.web.exception.RestExceptionHandler : "
                "method=GET uri=/rooms exception=TimeoutException message="), line))
            .when(i % 4 == 1, F.concat(
                F.lit("redis-stream-thread-pool-room:join"), d, F.lit("] c.global.redis.EventDispatcher : "
                "이벤트 처리 실패: consumer=RoomJoinConsumer, message=RoomJoinEvent["), line, F.lit("]")))
            .when(i % 4 == 2, F.concat(
                F.lit("] c.r.infra.OracleObjectStorageService : Oracle Object Storage QR 코드 업로드 실패: contents="),
                d, F.lit(", error="), line))
            .otherwise(F.concat(
                F.lit("pool-1-thread-"), d, F.lit("] c.r.application.service.RoomService : "
                "방 참가 비동기 처리 실패: eventId="), d, F.lit(", joinCode=AB12, playerName="), line)))
        return F.concat(F.lit("["), stamp, F.lit("] [ERROR] [,] --- ["), tail)

    return F.transform(lines, one)


def _alert(n: Column, id_: Column) -> Column:
    slot = F.concat(n.cast("string"), F.when(n % 2 == 0, "/RoomJoinConsumer").otherwise(""))
    known = F.array(*[F.struct(
        F.lit(name).alias("alertname"), F.lit(K.ALERT_RULES[name][0]).alias("severity"),
        F.lit(K.ALERT_TEXTS[name][0][0]).alias("summary"),
        F.lit(K.ALERT_TEXTS[name][1][0]).alias("description"),
        F.lit(K.ALERT_RULES[name][1].get("job", "prod-app")).alias("job")) for name in ALERTS])
    a = F.get(known, (n % 20).cast("int"))
    fill = lambda c: F.replace(a[c], F.lit("{}"), slot)
    job = F.create_map(F.lit("job"), a["job"])
    group = F.create_map(F.lit("incident_group"), F.lit("ip-blocking"))
    return F.struct(
        a["alertname"].alias("alertname"), a["severity"].alias("severity"),
        F.concat(F.lit("fp-"), id_.cast("string")).alias("fingerprint"),
        fill("summary").alias("summary"), fill("description").alias("description"),
        F.when(a["alertname"] == "IpBanRateSpike", F.map_concat(job, group)).otherwise(job).alias("labels"))


def scenarios(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One scenario per document: its lines as logs, the label's quality as the verdict."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    n, id_, q = F.col("n_chars"), F.col("doc_id"), F.col("quality")
    expected = F.when(q == 1, K.YES).when(q == 0, K.NO).otherwise("")
    says_yes = (expected == K.YES) | ((expected == "") & (id_ % 2 == 0))
    return d.select(
        id_.alias("seq"), F.concat(F.lit("monitor-doc-"), id_.cast("string")).alias("name"),
        F.lit(QUESTION).alias("question"),
        F.concat(F.when(says_yes, YES_RUBRIC).otherwise(NO_RUBRIC),
                 F.when(id_ % 5 == 0, MENTION).otherwise("")).alias("rubric"),
        F.col("source"), _alert(n, id_).alias("alert"),
        log_format(text_lines(F.col("text")), n, id_).alias("log_samples"),
        F.lit("prod").alias("log_environment"), expected.alias("expected"),
        q.isNotNull().alias("labelled"), *keep)


def golden_and_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents are the evaluation set, all others are candidates."""
    s = scenarios(spark, sf_dir)
    return s.filter("labelled"), s.filter("NOT labelled")


def benchmark_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    n = F.length("text").cast("long")
    return b.select(
        F.col("item_id").alias("seq"), F.concat(F.lit("golden-"), F.col("item_id").cast("string")).alias("name"),
        _alert(n, F.col("item_id")).alias("alert"),
        log_format(text_lines(F.col("text")), n, F.col("item_id")).alias("log_samples"))


# --------------------------------------------------------------------------------------
# Model outputs, trials, probabilities
# --------------------------------------------------------------------------------------


def _cited(lines: Column, id_: Column) -> Column:
    """The line that a document's outputs cite, null where it has no lines."""
    return F.get(lines, (id_ % F.nullif(F.size(lines), F.lit(0))).cast("int"))


def _mod(id_: Column, n: int) -> Column:
    """What is left of an id, so that a multiple of it stays in range whatever the id is."""
    return F.pmod(id_, F.lit(n))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, scenario, sample_idx, raw, doc_id, arm_no): two arms, greedy and four samples."""
    s = scenarios(spark, sf_dir)
    yes = (F.col("expected") == K.YES) | ((F.col("expected") == "") & (F.col("seq") % 2 == 0))
    picks = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(i).alias("arm_no"), F.lit(k).alias("sample_idx"))
                      for i, a in enumerate(ARMS) for k in SAMPLES])
    rows = s.select(
        F.col("seq").alias("doc_id"), F.col("name").alias("scenario"), yes.alias("yes"),
        _cited(F.col("log_samples"), F.col("seq")).alias("cited"),
    ).withColumn("p", F.explode(picks)).select("doc_id", "scenario", "yes", "cited", "p.*")
    id_, k, arm = F.col("doc_id"), F.col("sample_idx"), F.col("arm_no")
    mixed = F.pmod(_mod(id_, 12) * 7 + (k + 1) * 3 + arm * 5, F.lit(12))
    good = F.when(F.col("yes"), 0).otherwise(11)
    case = F.when((arm == 1) & (F.pmod(_mod(id_, 4) + k, F.lit(4)) != 0), good).otherwise(mixed)
    rows = rows.withColumn("case", case.cast("int"))
    c, cited = F.col("case"), F.col("cited")

    summary = (F.when(c == 8, 'uses {braces} and "quotes" in it')
               .when(id_ % 3 == 0, "현황 streamKey=room:join 지연")
               .when(id_ % 3 == 1, "현황 streamKey=ghost:key 지연").otherwise("요약만 있음"))
    cause = (F.when(c == 11, "").when(id_ % 4 == 0, "RoomJoinConsumer 처리 실패")
             .when(id_ % 4 == 1, "GhostService 장애").when(id_ % 4 == 2, "원인 미상")
             .otherwise("RestExceptionHandler 오류 recordId=1234567890123-7"))
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    actions = (F.when(id_ % 6 == 0, F.array().cast("array<string>"))
               .when(id_ % 5 == 1, strings("재시도", "PhantomFactory 재시작"))
               .otherwise(strings("uri /rooms/ABCD 확인")))
    evidence = (F.when(c == 1, F.substr(cited, F.lit(1), F.floor(F.length(cited) / 2).cast("int")))
                .when(c == 2, F.concat(cited, F.lit(" zz-altered")))
                .when(c == 9, F.replace(cited, F.lit(" "), F.lit("  ")))
                .when(c >= 10, "").otherwise(cited))
    claim = F.when(c.isin(3), F.lit(None)).when(c == 7, F.lit(None)).otherwise(c < 10)
    # case 7 says it with a string, case 3 does not say it at all
    body = F.to_json(F.struct(
        summary.alias("summary"), cause.alias("rootCauseHypothesis"),
        actions.alias("suggestedActions"), claim.alias("evidenceFound"),
        F.when(c == 7, F.lit("false")).alias("evidence_text"), evidence.alias("evidenceLine")))
    body = F.replace(body, F.lit('"evidence_text":'), F.lit('"evidenceFound":'))
    raw = (F.when(c == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(c == 5, F.substr(body, F.lit(1), F.length(body) - 1))
           .when(c == 6, "[1, 2]")
           .when(c == 8, F.concat(F.lit("Answer: "), body, F.lit(" done }")))
           .otherwise(body))
    return rows.select("arm", "scenario", "sample_idx", raw.alias("raw"), "doc_id", "arm_no")


JUDGE_ANSWERS = (
    ['{"accuracy":5,"groundedness":4,"hallucinationDetected":false,"verdict":"PASS","rationale":"ok"}'] * 4
    + ['{"accuracy":9,"groundedness":-3,"hallucinationDetected":true,"verdict":"FAIL","rationale":"bad"}',
       '{"accuracy":"4","groundedness":3.7,"verdict":"pass"}',
       "PASS",
       '{"accuracy":"x","groundedness":null,"hallucinationDetected":"false","verdict":"PASS","rationale":null}',
       '{"accuracy":true,"groundedness":"3.7","hallucinationDetected":0,"verdict":"FAIL","rationale":"r"}'])


def judge_raw(id_: Column, trial: Column, arm: Column) -> Column:
    n = len(JUDGE_ANSWERS)
    at = F.pmod(_mod(id_, n) * 5 + trial * 3 + arm, F.lit(n)).cast("int")
    return F.get(F.array(*[F.lit(a) for a in JUDGE_ANSWERS]), at)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five trials per arm (run) and scenario, each with an answer and a judge's answer."""
    o = outputs(spark, sf_dir)
    trial = F.col("sample_idx") + 2
    return o.select(
        F.col("arm").alias("run"), "scenario", trial.alias("trial"), "raw",
        judge_raw(F.col("doc_id"), trial, F.col("arm_no")).alias("judge_raw"),
        F.pmod(_mod(F.col("doc_id"), 500) * 13 + trial, F.lit(500)).alias("latency_ms"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, scenario, label, true_p, false_p) from the labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels")
    t = F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / F.lit(1000.0)
    f = F.when(F.col("doc_id") % 50 == 7, 0.0).otherwise(1.0 - t)
    t = F.when(F.col("doc_id") % 50 == 7, 0.0).otherwise(t)
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("idx"), F.concat(F.lit("monitor-doc-"), F.col("doc_id").cast("string")).alias("scenario"),
        (F.col("quality") == 1).alias("label"), t.alias("true_p"), f.alias("false_p"))


# --------------------------------------------------------------------------------------
# Logs and rules
# --------------------------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines_of(table(spark, sf_dir, "events"))


def log_lines_of(e: DataFrame) -> DataFrame:
    """(seq, ts_ns, ts, line) from events; times are cut to the minute, so ties occur."""
    u, k = F.col("user_id"), F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    minute = (F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long") * 60
    stamp = F.date_format(F.timestamp_seconds(minute), "yyyy-MM-dd HH:mm:ss")
    level = (F.when(kind.isin("error", "click"), "ERROR").when(kind == "view", "ERROR ")
             .when(kind == "signup", "INFO").otherwise("WARN"))
    v = F.floor("value").cast("string")
    body = (
        F.when(u % 4 == 0, F.concat(
            F.lit("c.global.redis.EventDispatcher : 이벤트 처리 실패: consumer=C"), k, F.lit(" value="), v))
        .when(u % 4 == 1, F.concat(
            F.lit("c.web.exception.RestExceptionHandler : method=GET exception=E"),
            (k.cast("int") % 3).cast("string"), F.lit(" ERROR value="), v))
        .when(u % 4 == 2, F.concat(F.lit("c.r.i.w.PlayerDisconnectionService : disconnect "), v))
        .otherwise(F.concat(F.lit("boom ERROR "), v)))
    frames = F.when(u % 5 == 0, F.repeat(F.lit("\tat a.B$C.run(D.java:1)"), (k.cast("int") % 6)
                                         .cast("int"))).otherwise("")
    filler = F.when(u % 17 == 0, F.repeat(F.lit(" pad"), 220)).otherwise("")
    line = F.concat(
        F.lit("["), stamp, F.lit(".000] ["), level, F.lit("] [,] --- [pool-"), (u % 4).cast("string"),
        F.lit("-thread-1] "), body, frames, F.lit(" end"), filler)
    return e.select(
        F.col("event_id").alias("seq"), (minute * F.lit(1_000_000_000)).alias("ts_ns"),
        F.timestamp_seconds(minute).alias("ts"), line.alias("line"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rules from suppliers: few names, many rows, so the last row of a name counts."""
    s = table(spark, sf_dir, "supplier")
    names = F.array(*[F.lit(n) for n in RULE_NAMES])
    key = F.col("s_suppkey")
    return s.select(
        key.alias("seq"), F.get(names, (key % 5).cast("int")).alias("name"),
        F.when(key % 3 != 0, "critical").alias("severity"),
        F.concat(F.lit(" {{ $labels.job }} of "), F.col("s_name"), F.lit(" at {{ $value | humanize }} ")).alias("summary"),
        F.concat(F.lit("{{ $labels.stream }}/{{ $labels.name }} {{ $labels.zone }}nation "),
                 F.col("s_nationkey").cast("string")).alias("description"))


# --------------------------------------------------------------------------------------
# Candidates and chat
# --------------------------------------------------------------------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a candidate; ``doc_id % 19`` picks the fault, 0 to 3 are clean."""
    s = scenarios(spark, sf_dir, ("doc_id", "n_chars"))
    id_, lines, a = F.col("doc_id"), F.col("log_samples"), F.col("alert")
    f = id_ % 19
    place = F.floor(id_ / 19) % F.greatest(F.size(lines), F.lit(1))  # of the line at fault
    at = lambda make: F.transform(lines, lambda x, i: F.when(i == place, make(x)).otherwise(x))
    # the stamp in its brackets stays
    swap = lambda text: at(lambda x: F.concat(F.substr(x, F.lit(1), F.lit(25)), F.lit(text)))
    logs = (
        F.when(f == 9, swap(" [ERROR] [,] --- [http-nio-8080-exec-1] c.web.exception.RestExceptionHandler : 없는 메시지"))
        .when(f == 10, at(lambda x: F.replace(x, F.lit("[ERROR] "), F.lit("ERROR "))))
        .when(f == 11, swap(" [ERROR] [,] --- [weird-1] c.web.exception.RestExceptionHandler : "
                            "method=GET uri=/nowhere exception=E message=m"))
        .when(f == 12, swap(" [ERROR] [,] --- [http-nio-8080-exec-1] c.global.redis.EventDispatcher : "
                            "이벤트 처리 실패: consumer=GhostConsumer, message=GhostEvent[x]"))
        .when(f == 13, at(lambda x: F.replace(x, F.lit("[ERROR]"), F.lit("[WARN]"))))
        .when(f == 14, F.reverse(lines))
        .otherwise(lines))
    job = a["labels"]["job"]
    alert = F.struct(
        F.when(f == 4, "NoSuchAlert").otherwise(a["alertname"]).alias("alertname"),
        F.when(f == 5, "info").otherwise(a["severity"]).alias("severity"),
        a["fingerprint"].alias("fingerprint"),
        F.when(f == 7, "아무 요약").otherwise(a["summary"]).alias("summary"),
        F.when(f == 8, "").otherwise(a["description"]).alias("description"),
        F.when(f == 6, F.map_concat(a["labels"], F.create_map(F.lit("zone"), F.lit("z1"))))
        .otherwise(a["labels"]).alias("labels"))
    twin = id_ - F.when(id_ % 23 == 5, 1).otherwise(0)
    every = list(K.REQUIRED_FIELDS)
    axes = F.array(*[F.lit(x[0]) for x in K.AXES])
    return s.select(
        "seq",
        F.concat(F.when(f == 16, "Monitor_Doc").otherwise("monitor-doc-"), twin.cast("string")).alias("name"),
        F.when(f == 18, F.lit(None)).otherwise(F.col("question")).alias("question"),
        F.when(f == 15, "판정 기준 없음").otherwise(F.col("rubric")).alias("rubric"),
        "source", alert.alias("alert"), logs.alias("log_samples"),
        F.when(f == 17, "dev").otherwise("prod").alias("log_environment"), "expected",
        F.get(axes, (id_ % 7).cast("int")).alias("axis"),
        F.when(f == 18, F.array(*[F.lit(k) for k in every if k != "question"]))
        .otherwise(F.array(*[F.lit(k) for k in every])).alias("present"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast pairs: two rows per document, named -a and -b, with the pair faults in turn."""
    s = scenarios(spark, sf_dir, ("doc_id",))
    rows = s.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b"))))
    id_, b = F.col("doc_id"), F.col("side") == "b"
    f = id_ % 9
    lines, a = F.col("log_samples"), F.col("alert")
    logs = (
        F.when(b & (f == 1), F.transform(lines, lambda x: F.concat(x, F.lit("!"))))
        .when(b & (f == 2), F.transform(lines, lambda x, i: F.concat(
            F.date_format(F.timestamp_seconds(F.lit(1767225600) + i * 7200), "'['yyyy-MM-dd HH:mm:ss"),
            F.substr(x, F.lit(21), F.length(x)))))
        .when(b & (f == 3), F.concat(lines, F.array(F.lit("extra"))))
        .otherwise(lines))
    expected = F.when(b & (f == 4), K.YES).when(b, K.NO).otherwise(K.YES)
    alert = a.withField("summary", F.when(b & (f != 5), F.concat(a["summary"], F.lit(" 변경")))
                        .otherwise(a["summary"]))
    name = F.concat(F.lit("monitor-pair-"), id_.cast("string"),
                    F.when((f == 7) & b, "-c").otherwise(F.concat(F.lit("-"), F.col("side"))))
    return rows.select(
        (id_ * 2 + F.when(b, 1).otherwise(0)).alias("seq"), name.alias("name"),
        alert.alias("alert"), logs.alias("log_samples"), expected.alias("expected"),
        F.when(b & (f == 6), "dev").otherwise("prod").alias("log_environment"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two teacher attempts per scenario: the first two outputs of the trained arm."""
    o = outputs(spark, sf_dir).filter("arm = 'trained' AND sample_idx < 1")
    return o.select("scenario", (F.col("sample_idx") + 1).alias("attempt"), "raw")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built training rows: one per scenario, split by a hash of its name."""
    from ..operators.prompts import with_prompt

    s = with_prompt(scenarios(spark, sf_dir))
    valid = F.substring(F.md5("name"), 1, 1).isin("0", "1")
    return s.select(
        F.when(valid, "valid").otherwise("train").alias("split"),
        F.when(valid, 1).otherwise(0).alias("split_order"),
        F.col("seq").alias("line_no"), F.col("name").alias("scenario"), F.col("prompt").alias("user"))


def teacher_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher rows for labelled documents; toxic ones appear again in the later split."""
    from ..operators.prompts import with_prompt

    toxic = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "toxic")
    s = with_prompt(scenarios(spark, sf_dir)).join(toxic, "seq")
    copies = F.when(F.col("toxic") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return s.withColumn("split_order", F.explode(copies)).select(
        "split_order", F.col("seq").alias("line_no"), F.col("prompt").alias("user"),
        F.concat(F.lit("teacher-"), F.col("split_order").cast("string"), F.lit("-"),
                 F.col("seq").cast("string")).alias("assistant"))
