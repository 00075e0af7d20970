"""The bridge of ``plans/bridge.py`` in DuckDB SQL, as named CTEs for the oracles."""

from __future__ import annotations

from .. import fixed_values as K
from . import bridge as B


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def log_format(lines: str, n: str, id_: str) -> str:
    return f"""list_transform({lines}, lambda l, i: '[' ||
      strftime(make_timestamp(CAST((1767225600 + ({id_} % 365) * 86400 + (i - 1) *
        (CASE {n} % 3 WHEN 0 THEN 20 WHEN 1 THEN 600 ELSE 4000 END)) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S')
      || '.' || lpad(CAST((i - 1) % 1000 AS VARCHAR), 3, '0') || '] [ERROR] [,] --- [' ||
      CASE (i - 1) % 4
        WHEN 0 THEN 'http-nio-8080-exec-' || ((i - 1) % 10) || '] c.web.exception.RestExceptionHandler : method=GET uri=/rooms exception=TimeoutException message=' || l
        WHEN 1 THEN 'redis-stream-thread-pool-room:join' || ((i - 1) % 10) || '] c.global.redis.EventDispatcher : 이벤트 처리 실패: consumer=RoomJoinConsumer, message=RoomJoinEvent[' || l || ']'
        WHEN 2 THEN '] c.r.infra.OracleObjectStorageService : Oracle Object Storage QR 코드 업로드 실패: contents=' || ((i - 1) % 10) || ', error=' || l
        ELSE 'pool-1-thread-' || ((i - 1) % 10) || '] c.r.application.service.RoomService : 방 참가 비동기 처리 실패: eventId=' || ((i - 1) % 10) || ', joinCode=AB12, playerName=' || l END)"""


def text_lines(text: str) -> str:
    return f"list_filter(string_split({text}, chr(10)), lambda x: x <> '')"


def alert_columns(n: str, id_: str) -> str:
    pick = lambda values: f"({qlist(values)})[CAST({n} % 20 AS INTEGER) + 1]"
    slot = f"(CAST({n} AS VARCHAR) || CASE WHEN {n} % 2 = 0 THEN '/RoomJoinConsumer' ELSE '' END)"
    return f"""{pick(B.ALERTS)} AS alertname,
      {pick([K.ALERT_RULES[a][0] for a in B.ALERTS])} AS severity, 'fp-' || {id_} AS fingerprint,
      replace({pick([K.ALERT_TEXTS[a][0][0] for a in B.ALERTS])}, '{{}}', {slot}) AS summary,
      replace({pick([K.ALERT_TEXTS[a][1][0] for a in B.ALERTS])}, '{{}}', {slot}) AS description,
      {pick([K.ALERT_RULES[a][1].get("job", "prod-app") for a in B.ALERTS])} AS job"""


def norm_ids(x: str) -> str:
    """Ids out; \\b is spelled out because RE2's only knows ASCII words."""
    word = r"\p{L}\p{N}_"
    left, right = rf"(^|[^{word}])", rf"($|[^{word}])"

    def both(pattern: str, to: str, x: str) -> str:
        for _ in range(2):
            x = f"regexp_replace({x}, '{left}{pattern}{right}', '\\1{to}\\2', 'g')"
        return x

    x = both("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>", x)
    x = both("[0-9a-f]{16,32}", "<hex>", x)
    x = both(r"\d{13}-\d+", "<record>", x)
    x = both(r"\d{4}-\d{2}-\d{2}T[\d:.]+Z", "<ts>", x)
    x = f"regexp_replace({x}, 'joinCode=[A-Z0-9]{{4}}', 'joinCode=<code>', 'g')"
    return rf"regexp_replace({x}, '(^|[^{word}])(?:playerName|guestName)=\S+', '\1player=<name>', 'g')"


def norm_message(x: str) -> str:
    x = norm_ids(x)
    word = r"\p{L}\p{N}_"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^{word}])\d+($|[^{word}])', '\1<n>\2', 'g')"
    return f"trim({x})"


SIG_LINE = r"^\[[^\]]*\] \[[A-Z]+\] \[[^\]]*\] --- \[[^\]]*\] (\S+) : (.+)$"


def span_minutes(lines: str) -> str:
    stamps = (f"list_transform(list_filter({lines}, lambda x: regexp_matches(x, '^\\[\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d')), "
              "lambda x: epoch(CAST(substr(x, 2, 19) AS TIMESTAMP)))")
    return (f"CASE WHEN len({stamps}) >= 2 THEN (list_max({stamps}) - list_min({stamps})) / 60.0 END")


def span_bucket(minutes: str) -> str:
    return (f"CASE WHEN {minutes} IS NULL THEN '?' WHEN {minutes} <= 5 THEN 'tight' "
            f"WHEN {minutes} <= 60 THEN 'mid' ELSE 'spread' END")


def signature(lines: str = "log_samples") -> str:
    """One text per row that is equal exactly when the signature is."""
    part = f"regexp_extract(x, '{SIG_LINE}', 1)"
    line = (f"CASE WHEN {part} = '' THEN '?' || chr(1) || {norm_message('x')} ELSE {part} || chr(1) || "
            + norm_message(f"regexp_extract(x, '{SIG_LINE}', 2)") + " END")
    return (f"alertname || chr(2) || trim({norm_ids('summary')}) || chr(2) || trim({norm_ids('description')}) "
            f"|| chr(2) || {span_bucket(span_minutes(lines))} || chr(2) || "
            f"array_to_string(list_transform({lines}, lambda x: {line}), chr(3))")


def prompt(lines: str = "log_samples") -> str:
    labels = ("'job=' || job || CASE WHEN alertname = 'IpBanRateSpike' "
              "THEN chr(10) || '- incident_group=ip-blocking' ELSE '' END")
    return f"""{q(K.PROMPT_SEVERITY)} || severity || chr(10) || {q(K.PROMPT_FINGERPRINT)} || fingerprint || chr(10) ||
      {q(K.PROMPT_ALERTNAME)} || alertname || chr(10) || {q(K.PROMPT_SUMMARY)} || summary || chr(10) ||
      {q(K.PROMPT_DESCRIPTION)} || description || chr(10) || {q(K.PROMPT_LABELS)} || chr(10) || '- ' || {labels} ||
      CASE WHEN len({lines}) > 0 THEN chr(10) || chr(10) || {q(K.PROMPT_LOGS_HEAD)} || 'prod' || {q(K.PROMPT_LOGS_TAIL)}
        || array_to_string(list_transform({lines}, lambda x: chr(10) || '- ' || x), '') ELSE '' END || chr(10)"""


def evaluated(x: str) -> str:
    """Blank-squashed text."""
    return rf"regexp_replace(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g')"


def judged_number(key: str) -> str:
    """A score of the judge's JSON (``judged``): numbers cut to whole ones, whole numbers in
    quotes and truth values count, all else is 0; within 0 to 5."""
    at = f"json_extract_string(judged, '$.{key}')"
    return f"""CAST(greatest(0, least(5, CASE json_type(judged, '$.{key}')
      WHEN 'BOOLEAN' THEN CASE {at} WHEN 'true' THEN 1 ELSE 0 END
      WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim({at}), '[+-]?[0-9]+') THEN CAST(trim({at}) AS BIGINT) ELSE 0 END
      WHEN 'NULL' THEN 0 ELSE coalesce(CAST(trunc(TRY_CAST({at} AS DOUBLE)) AS BIGINT), 0) END)) AS INTEGER)"""


JUDGED_FLAG = """coalesce(CASE json_type(judged, '$.hallucinationDetected') WHEN 'NULL' THEN false
      WHEN 'VARCHAR' THEN json_extract_string(judged, '$.hallucinationDetected') <> ''
      ELSE json_extract_string(judged, '$.hallucinationDetected') NOT IN ('false', '0', '0.0') END, false)"""
JUDGED_PASS = "coalesce(json_extract_string(judged, '$.verdict') = 'PASS', false)"

_LINES = text_lines("d.text")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "b_scenario": ((), f"""SELECT *, (expected = '예' OR (expected = '' AND contains(split_part(rubric, '정답', 1), '근거 발견: 예'))) AS expects_yes
     FROM (SELECT d.doc_id, d.doc_id AS seq, d.n_chars, l.quality, l.toxic, d.source, 'monitor-doc-' || d.doc_id AS name,
      CASE l.quality WHEN 1 THEN '예' WHEN 0 THEN '아니오' ELSE '' END AS expected,
      CASE WHEN l.quality = 1 OR (l.quality IS NULL AND d.doc_id % 2 = 0) THEN {q(B.YES_RUBRIC)} ELSE {q(B.NO_RUBRIC)} END
        || CASE WHEN d.doc_id % 5 = 0 THEN {q(B.MENTION)} ELSE '' END AS rubric,
      {alert_columns('d.n_chars', 'd.doc_id')},
      {log_format(_LINES, 'd.n_chars', 'd.doc_id')} AS log_samples
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""),
    "b_benchmark": ((), f"""SELECT item_id AS seq, 'golden-' || item_id AS name,
      {alert_columns('len(text)', 'item_id')},
      {log_format(text_lines('text'), 'len(text)', 'item_id')} AS log_samples FROM benchmark"""),
    "b_case": (("b_scenario",), """SELECT s.doc_id, s.name AS scenario, s.expects_yes, a.arm, a.arm_no, k.sample_idx,
      s.log_samples[CAST(s.doc_id % len(s.log_samples) AS INTEGER) + 1] AS cited,
      CASE WHEN a.arm_no = 1 AND ((s.doc_id + k.sample_idx) % 4 + 4) % 4 <> 0
           THEN CASE WHEN s.expects_yes THEN 0 ELSE 11 END
           ELSE (s.doc_id * 7 + (k.sample_idx + 1) * 3 + a.arm_no * 5) % 12 END AS c
      FROM b_scenario s, (VALUES ('base', 0), ('trained', 1)) a(arm, arm_no),
        (VALUES (-1), (0), (1), (2), (3)) k(sample_idx)"""),
    # what a right reading of the raw text must find, straight from how it was made
    "b_analysis": (("b_case",), """SELECT *, c IN (5, 6) AS parse_failed, c IN (0, 1, 2, 4, 7, 8, 9) AS claimed,
      CASE WHEN c = 8 THEN 'uses {braces} and "quotes" in it' WHEN doc_id % 3 = 0 THEN '현황 streamKey=room:join 지연'
           WHEN doc_id % 3 = 1 THEN '현황 streamKey=ghost:key 지연' ELSE '요약만 있음' END AS summary,
      CASE WHEN c = 11 THEN '' WHEN doc_id % 4 = 0 THEN 'RoomJoinConsumer 처리 실패' WHEN doc_id % 4 = 1 THEN 'GhostService 장애'
           WHEN doc_id % 4 = 2 THEN '원인 미상' ELSE 'RestExceptionHandler 오류 recordId=1234567890123-7' END AS cause,
      CASE WHEN doc_id % 6 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 5 = 1 THEN ['재시도', 'PhantomFactory 재시작']
           ELSE ['uri /rooms/ABCD 확인'] END AS actions,
      CASE WHEN c = 1 THEN left(cited, len(cited) // 2) WHEN c = 2 THEN cited || ' zz-altered'
           WHEN c = 9 THEN replace(cited, ' ', '  ') WHEN c >= 10 THEN '' ELSE cited END AS evidence_line
      FROM b_case"""),
    "b_fact": (("b_analysis", "b_scenario"), f"""SELECT arm, arm_no, scenario, doc_id, sample_idx, c, alertname, expects_yes, parse_failed, claimed,
        grounded, strict_ok, summary, cause, actions, evidence_line, log_samples,
        CASE WHEN parse_failed THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
          (CASE WHEN NOT (claimed AND cause = '') THEN 0.1::DOUBLE ELSE 0.0 END)
          + (CASE WHEN claimed = expects_yes THEN 0.5::DOUBLE ELSE 0.0 END)
          + (CASE WHEN NOT expects_yes OR strict_ok THEN 0.4::DOUBLE ELSE 0.0 END) + 0.0::DOUBLE
          - (CASE WHEN NOT claimed AND cause <> '' THEN 0.3::DOUBLE ELSE 0.0 END))) END AS reward
      FROM (SELECT a.*, s.alertname, s.log_samples,
          NOT a.parse_failed AND a.claimed AND {evaluated('a.evidence_line')} <> '' AND
            len(list_filter(s.log_samples, lambda x: contains({evaluated('x')}, {evaluated('a.evidence_line')}))) > 0 AS grounded,
          NOT a.parse_failed AND (NOT a.claimed OR (trim(a.evidence_line) <> '' AND list_contains(s.log_samples, trim(a.evidence_line)))) AS strict_ok
        FROM (SELECT * REPLACE (claimed AND NOT parse_failed AS claimed) FROM b_analysis) a JOIN b_scenario s ON s.name = a.scenario)"""),
    "b_trial": (("b_fact",), f"""SELECT *, CASE WHEN is_judged THEN judge_raw ELSE '{{}}' END AS judged
      FROM (SELECT *, CASE WHEN json_valid(judge_raw) THEN json_type(judge_raw) = 'OBJECT' ELSE false END AS is_judged
      FROM (SELECT *, ({qlist(B.JUDGE_ANSWERS)})[CAST(j + 1 AS INTEGER)] AS judge_raw FROM (SELECT *, arm AS run, sample_idx + 2 AS trial,
        (doc_id * 13 + sample_idx + 2) % 500 AS latency, (doc_id * 5 + (sample_idx + 2) * 3 + arm_no) % 9 AS j,
        {q(K.SUMMARY_PREFIX)} || CASE WHEN grounded THEN summary ELSE {q(K.NO_EVIDENCE_SUMMARY)} END || chr(10) ||
        {q(K.VERDICT_PREFIX)} || CASE WHEN grounded THEN '예' ELSE '아니오' END || chr(10) ||
        {q(K.CAUSE_PREFIX)} || CASE WHEN grounded AND cause <> '' THEN cause ELSE {q(K.NOTHING)} END || chr(10) ||
        {q(K.ACTIONS_PREFIX)} || CASE WHEN len(actions) = 0 THEN ' ' || {q(K.NOTHING)}
          ELSE chr(10) || '- ' || array_to_string(actions, chr(10) || '- ') END AS flat
      FROM b_fact)))"""),
    "b_result": (("b_trial",), f"""SELECT run, scenario, trial, doc_id, expects_yes,
        CASE WHEN parse_failed THEN {q(K.FAILED_ANSWER)} ELSE flat END AS answer,
        CASE WHEN parse_failed THEN 0 ELSE {judged_number("accuracy")} END AS accuracy,
        CASE WHEN parse_failed THEN 0 ELSE {judged_number("groundedness")} END AS groundedness,
        NOT parse_failed AND {JUDGED_FLAG} AS hallucination_detected,
        CASE WHEN NOT parse_failed AND {JUDGED_PASS} THEN 'PASS' ELSE 'FAIL' END AS verdict,
        CASE WHEN parse_failed THEN 0 ELSE latency END AS latency_ms, parse_failed AS failed, j
      FROM b_trial"""),
    "b_prob": ((), """SELECT idx, scenario, label, CASE WHEN zero THEN 0.0 ELSE t END AS true_p, CASE WHEN zero THEN 0.0 ELSE 1.0 - t END AS false_p,
        CASE WHEN zero THEN 0.5::DOUBLE ELSE t / (t + (1.0 - t)) END AS score
      FROM (SELECT l.doc_id AS idx, 'monitor-doc-' || l.doc_id AS scenario, l.quality = 1 AS label, l.doc_id % 50 = 7 AS zero,
        ((l.doc_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE AS t FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""),
    "b_log_line": ((), r"""SELECT event_id AS seq, m * 1000000000 AS ts_ns, user_id AS u,
        '[' || strftime(make_timestamp(m * 1000000), '%Y-%m-%d %H:%M:%S') || '.000] [' ||
        CASE WHEN event_type IN ('error', 'click') THEN 'ERROR' WHEN event_type = 'view' THEN 'ERROR ' WHEN event_type = 'signup' THEN 'INFO' ELSE 'WARN' END
        || '] [,] --- [pool-' || (user_id % 4) || '-thread-1] ' ||
        CASE user_id % 4 WHEN 0 THEN 'c.global.redis.EventDispatcher : 이벤트 처리 실패: consumer=C' || k || ' value=' || v
          WHEN 1 THEN 'c.web.exception.RestExceptionHandler : method=GET exception=E' || (k % 3) || ' ERROR value=' || v
          WHEN 2 THEN 'c.r.i.w.PlayerDisconnectionService : disconnect ' || v
          ELSE 'boom ERROR ' || v END
        || CASE WHEN user_id % 5 = 0 THEN repeat(chr(9) || 'at a.B$C.run(D.java:1)', CAST(k % 6 AS INTEGER)) ELSE '' END || ' end'
        || CASE WHEN user_id % 17 = 0 THEN repeat(' pad', 220) ELSE '' END AS line
      FROM (SELECT *, CAST(epoch_us(ts) // 60000000 AS BIGINT) * 60 AS m, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events)"""),
    "b_error": (("b_log_line",), r"""SELECT *, CASE WHEN len(clean) > 800 THEN left(clean, 800) || ' …(잘림)' ELSE clean END AS shown
      FROM (SELECT *,
        CASE WHEN frames > 3 THEN regexp_replace(flat, '( at a\.B\$C\.run\(D\.java:1\)){4,}', ' at a.B$C.run(D.java:1) at a.B$C.run(D.java:1) at a.B$C.run(D.java:1) ... (스택 ' || (frames - 3) || '줄 생략)') ELSE flat END AS clean,
        CASE WHEN logger = '' THEN '기타' WHEN consumer <> '' THEN logger || ':' || consumer WHEN exception <> '' THEN logger || ':' || exception ELSE logger END AS family
      FROM (SELECT *, replace(line, chr(9), ' ') AS flat, (len(line) - len(replace(line, 'D.java:1', ''))) // 8 AS frames,
          regexp_extract(line, '--- \[[^\]]*\] (\S+) : ', 1) AS logger, regexp_extract(line, 'consumer=(\w+)', 1) AS consumer,
          regexp_extract(line, 'exception=(\w+)', 1) AS exception
        FROM b_log_line WHERE regexp_matches(line, '^\[[^\]]+\] \[ERROR *\]')))"""),
    "b_rule": ((), f"""SELECT s_suppkey AS seq, ({qlist(B.RULE_NAMES)})[CAST(s_suppkey % 5 AS INTEGER) + 1] AS name,
        CASE WHEN s_suppkey % 3 <> 0 THEN 'critical' ELSE 'warning' END AS severity,
        'prod-app of ' || s_name || ' at 12' AS summary, 'room-events/OracleObjectStorage nation ' || s_nationkey AS description
      FROM supplier"""),
    "b_last_rule": (("b_rule",), "SELECT * FROM b_rule QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1"),
    "b_candidate": (("b_scenario",), """SELECT doc_id, doc_id AS seq, f, place, n_chars,
        CASE WHEN f = 16 THEN 'Monitor_Doc' ELSE 'monitor-doc-' END || (doc_id - CASE WHEN doc_id % 23 = 5 THEN 1 ELSE 0 END) AS name,
        CASE WHEN f = 15 THEN '판정 기준 없음' ELSE rubric END AS rubric, expected,
        CASE WHEN f = 4 THEN 'NoSuchAlert' ELSE alertname END AS alertname, CASE WHEN f = 5 THEN 'info' ELSE severity END AS severity,
        CASE WHEN f = 7 THEN '아무 요약' ELSE summary END AS summary, CASE WHEN f = 8 THEN '' ELSE description END AS description,
        CASE WHEN f = 17 THEN 'dev' ELSE 'prod' END AS env, job,
        CASE WHEN f = 9 THEN list_concat(log_samples[:place] || [left(log_samples[place + 1], 25) || ' [ERROR] [,] --- [http-nio-8080-exec-1] c.web.exception.RestExceptionHandler : 없는 메시지'], log_samples[place + 2:])
          WHEN f = 10 THEN list_concat(log_samples[:place] || [replace(log_samples[place + 1], '[ERROR] ', 'ERROR ')], log_samples[place + 2:])
          WHEN f = 11 THEN list_concat(log_samples[:place] || [left(log_samples[place + 1], 25) || ' [ERROR] [,] --- [weird-1] c.web.exception.RestExceptionHandler : method=GET uri=/nowhere exception=E message=m'], log_samples[place + 2:])
          WHEN f = 12 THEN list_concat(log_samples[:place] || [left(log_samples[place + 1], 25) || ' [ERROR] [,] --- [http-nio-8080-exec-1] c.global.redis.EventDispatcher : 이벤트 처리 실패: consumer=GhostConsumer, message=GhostEvent[x]'], log_samples[place + 2:])
          WHEN f = 13 THEN list_concat(log_samples[:place] || [replace(log_samples[place + 1], '[ERROR]', '[WARN]')], log_samples[place + 2:])
          WHEN f = 14 THEN list_reverse(log_samples) ELSE log_samples END AS log_samples,
        (['positive-dense', 'unrelated-trap', 'stale-reingested', 'sparse-evidence', 'partial-relevance', 'compound-cause', 'near-miss-component'])[CAST(doc_id % 7 AS INTEGER) + 1] AS axis
      FROM (SELECT *, doc_id % 19 AS f, (doc_id // 19) % greatest(len(log_samples), 1) AS place FROM b_scenario)"""),
    "b_pair": (("b_scenario",), """SELECT doc_id * 2 + CASE WHEN side = 'b' THEN 1 ELSE 0 END AS seq, doc_id, side, doc_id % 9 AS f,
        'monitor-pair-' || doc_id || CASE WHEN doc_id % 9 = 7 AND side = 'b' THEN '-c' ELSE '-' || side END AS name,
        CASE WHEN side = 'b' AND doc_id % 9 <> 5 THEN summary || ' 변경' ELSE summary END AS summary, description,
        CASE WHEN side = 'b' AND doc_id % 9 = 4 THEN '예' WHEN side = 'b' THEN '아니오' ELSE '예' END AS expected,
        CASE WHEN side = 'b' AND doc_id % 9 = 6 THEN 'dev' ELSE 'prod' END AS env,
        CASE WHEN side = 'b' AND doc_id % 9 = 1 THEN list_transform(log_samples, lambda x: x || '!')
          WHEN side = 'b' AND doc_id % 9 = 2 THEN list_transform(log_samples, lambda x, i:
            strftime(make_timestamp(CAST((1767225600 + (i - 1) * 7200) * 1000000 AS BIGINT)), '[%Y-%m-%d %H:%M:%S') || substr(x, 21))
          WHEN side = 'b' AND doc_id % 9 = 3 THEN list_append(log_samples, 'extra') ELSE log_samples END AS log_samples
      FROM b_scenario, (VALUES ('a'), ('b')) x(side)"""),
    "b_chat": (("b_scenario",), f"""SELECT CASE WHEN left(md5(name), 1) IN ('0', '1') THEN 'valid' ELSE 'train' END AS split,
        doc_id AS line_no, name AS scenario, {prompt()} AS "user", * EXCLUDE (seq) FROM b_scenario"""),
}


def sql(body: str, *needs: str) -> str:
    """A query over the base tables with the CTEs it needs, in order of dependence."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order)
    body = body.strip()
    glue = ",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return "WITH " + ctes + glue
