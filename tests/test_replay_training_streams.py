import json

import pytest
from pyspark.errors import PySparkException
from conftest import scenario
from pyspark.sql import functions as F

from proofmill import schemas
from proofmill.operators import probes as PR, prompts as P, replay as R, training as T
from proofmill.sources import readers, sinks
from proofmill.streaming import jobs

H = 1800 * 10**9


def log(spark, rows):
    return spark.createDataFrame([(i, ts, f"[t] [{lv}] [,] --- [p] c.A : consumer={c} n{i}") for i, (ts, lv, c) in enumerate(rows)],
                                 schemas.LOG_LINE)


def test_windows_keep_the_latest_and_break_ties(spark):
    rows = [(1, "ERROR", "X"), (5, "ERROR", "Y"), (5, "ERROR", "Z"), (9, "INFO", "W"), (H + 1, "ERROR", "Q"), (3 * H, "WARN", "Q")]
    got = R.build_windows(log(spark, rows), limit=2).orderBy("index").collect()
    assert [(r["index"], r["end_ns"], r["family"], len(r["samples"])) for r in got] == [
        (0, H, "c.A:Y", 2), (1, 2 * H, "c.A:Q", 1)]
    assert got[0]["samples"][0].endswith("n1")  # equal times keep the input order


def test_scenarios_rotate_through_loaded_rules_only(spark):
    rules = spark.createDataFrame([
        (1, "CircuitBreakerOpen", None, "old", "d"), (2, "CircuitBreakerOpen", None, "on {{ $labels.job }} {{ $value }}", "{{ x }}d"),
        (3, "AppInstanceDown", "critical", "s", "d"), (4, "RedisStreamE2eLatencyHigh", "warning", "s", "d")], schemas.ALERT_RULE)
    lines = spark.createDataFrame([(i, i * H + 1, f"[t] [ERROR] [,] --- [p] {lg} : m") for i, lg in enumerate(
        ["c.global.redis.EventDispatcher", "c.unknown", "c.global.redis.EventDispatcher"])], schemas.LOG_LINE)
    got = {r["name"]: r for r in R.to_scenarios(R.build_windows(lines), rules).collect()}
    assert {n: r["alert"]["alertname"] for n, r in got.items()} == {
        "replay-pos-000": "RedisStreamE2eLatencyHigh", "replay-pos-002": "RedisStreamE2eLatencyHigh",
        "replay-neg-000": "CircuitBreakerOpen", "replay-neg-001": "AppInstanceDown", "replay-neg-002": "CircuitBreakerOpen"}
    neg = got["replay-neg-000"]
    assert neg["alert"]["summary"] == "on prod-app 12" and neg["alert"]["severity"] == "warning" and neg["expected"] == "아니오"
    assert got["replay-pos-000"]["expected"] == ""


def scored(spark, rows):
    return spark.createDataFrame(rows, "scenario string, sample_idx int, reward double, raw string")


def test_best_and_worst_prefer_earlier_samples(spark):
    row = T.best_and_worst(scored(spark, [("s", -1, 1.0, "g"), ("s", 0, 0.2, "a"), ("s", 1, 1.0, "b"), ("s", 2, 0.2, "c")])).first()
    assert (row["best"]["raw"], row["worst"]["raw"], row["greedy"]) == ("b", "a", 1.0)


def test_best_of_n_reasons(spark, make):
    ok = '{"summary":"s"}'
    rows = scored(spark, [("monitor-s1", -1, 0.5, "g"), ("monitor-s1", 0, 1.0, ok), ("monitor-s2", -1, 0.5, ok), ("monitor-s2", 0, 0.6, ok),
                          ("gone", -1, 1.0, ok), ("monitor-s3", -1, 1.0, "{")])
    picked = T.best_of_n(rows, make.scenarios([scenario(i) for i in (1, 2, 3)]))
    got = {r["scenario"]: (r["reason"], r["beats_greedy"]) for r in picked.collect()}
    assert got == {"monitor-s1": ("accepted", True), "monitor-s2": ("below_min_reward", True),
                   "gone": ("no_scenario", False), "monitor-s3": ("parse_failed", False)}


def test_teacher_lookup_takes_the_last_line(spark, make):
    s = make.scenarios([scenario(1), scenario(2, log_samples=["x"])])
    prompt = P.with_prompt(s).filter("seq = 1").first()["prompt"]
    chat = spark.createDataFrame([(0, 1, prompt, "old"), (1, 1, prompt, "new"), (0, 9, prompt, "mid"), (1, 5, "other", "z")],
                                 "split_order int, line_no long, user string, assistant string")
    assert [tuple(r) for r in T.teacher_by_prompt(chat, s).collect()] == [("monitor-s1", "new")]


def test_attempts_stop_at_the_first_failure_of_the_teacher(spark):
    rows = [("late", 0, False, 2, "citation"), ("late", 1, False, 0, None), ("bad", 0, True, 0, None), ("bad", 1, False, 0, None),
            ("never", 0, False, 1, "verdict"), ("never", 1, False, 1, "schema")]
    df = spark.createDataFrame(rows, "scenario string, attempt int, parse_failed boolean, n_reasons int, first_rule string")
    got = {r["scenario"]: (r["accepted"], r["attempt"], r["drop_rule"]) for r in T.select_attempt(df).collect()}
    assert got == {"late": (True, 1, None), "bad": (False, None, "teacher"), "never": (False, None, "schema")}


@pytest.mark.parametrize("n,size", [(1, 1), (6, 1), (7, 1), (20, 3)])
def test_split_sizes_are_exact(spark, n, size):
    df = spark.range(n).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    parts = [sorted(r["name"] for r in T.train_valid_split(df.repartition(p)).filter("split = 'valid'").collect()) for p in (1, 5)]
    assert parts[0] == parts[1] and len(parts[0]) == size


def test_mix_ratio(spark):
    df = spark.range(100).select(F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") < 50).alias("expects_yes"))
    rows = T.mix_ratio(df, 0.3).collect()  # 71 is the largest total 50 no can carry
    assert (len(rows), sum(r["expects_yes"] for r in rows)) == (70, 21)


def test_preference_blocks_do_not_change_the_result(spark):
    log_ = spark.range(1, 250).select(F.lit("r").alias("run"), F.col("id").alias("step"), F.sin("id").alias("policy_chosen"),
                                      F.lit(0.0).alias("ref_chosen"), F.cos("id").alias("policy_rejected"), F.lit(0.0).alias("ref_rejected"))
    rows = [sorted(map(tuple, T.preference_metrics(log_, block=b).collect())) for b in (20, 100_000)]
    assert all(a == pytest.approx(b) for a, b in zip(*[[r[4] for r in x] for x in rows])) and len(rows[0]) == 249


ANSWER = "요약: s\n근거 발견: {v}\n원인 가설: c\n제안 조치:\n- a"


def test_mutations_apply_where_they_make_sense(spark):
    df = spark.createDataFrame([("yes", ANSWER.format(v="예"), "r"), ("no", ANSWER.format(v="아니오"), "언급"), ("odd", "free text", "r")],
                               "scenario string, answer string, rubric string")
    got = {}
    for r in PR.build_probes(df).collect():
        got.setdefault(r["scenario"], {})[r["mutation"]] = r["answer"]
    assert set(got["yes"]) == {"unmutated", "verdict-flip", "component-swap", "benign-paraphrase", "vague-cause", "hedged-summary", "no-actions"}
    assert set(got["no"]) == {"unmutated", "verdict-flip", "fabricated-cause", "benign-paraphrase", "hedged-summary"}
    assert got["yes"]["verdict-flip"] == ANSWER.format(v="아니오") and got["yes"]["unmutated"] == ANSWER.format(v="예")
    assert got["yes"]["no-actions"].endswith("제안 조치: (없음)") and "odd" not in got
    assert len(PR.build_probes(df, "subtle").collect()) == 4


def test_balanced_pick_fills_up_with_no(spark):
    df = spark.createDataFrame([(f"y{i}", ANSWER.format(v="예")) for i in range(2)] + [(f"n{i}", ANSWER.format(v="아니오")) for i in range(9)],
                               "scenario string, answer string")
    got = sorted(r["scenario"] for r in PR.pick_balanced(df, 6).collect())
    assert got == ["n0", "n1", "n2", "n3", "y0", "y1"]


def as_file(s):
    return json.dumps({"name": s["name"], "question": "q", "rubric": s["rubric"], "source": "s", "alert": {**s["alert"], "labels": None},
                       "logSamples": s["log_samples"], "logEnvironment": "prod"}, ensure_ascii=False)


def test_file_readers(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    with pytest.raises(FileNotFoundError):
        readers.load_scenarios(spark, str(d))
    for i in (2, 1):
        (d / f"f{i}.json").write_text(as_file(scenario(i)), encoding="utf-8")
    rows = readers.with_seq(readers.load_scenarios(spark, str(d)), "file").orderBy("seq").collect()
    assert [(r["seq"], r["name"], r["alert"]["labels"]) for r in rows] == [(1, "monitor-s1", {}), (2, "monitor-s2", {})]
    (d / "f3.json").write_text('{"name": "x"}', encoding="utf-8")
    with pytest.raises(Exception, match="missing"):
        readers.load_scenarios(spark, str(d)).collect()
    (d / "f4.json").write_text("{broken", encoding="utf-8")
    got = {r["name"]: r["unreadable"] for r in readers.ingest_candidates(spark, str(d)).collect()}
    assert got == {"monitor-s1": False, "monitor-s2": False, "x": False, "f4": True}


def test_log_rule_split_and_chat_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "20", "line": "b"}\n\n{"ts": 10, "line": "a"}\n  \n{"ts": 10, "line": "c"}\n')
    rows = readers.load_log_lines(spark, str(tmp_path / "log.jsonl")).orderBy("ts_ns", "seq").collect()
    assert [(r["ts_ns"], r["line"]) for r in rows] == [(10, "a"), (10, "c"), (20, "b")]
    (tmp_path / "bad.jsonl").write_text('{"ts": 1, "line": "a"}\n{"ts": 2, "line": "b"\n{"ts": "x", "line": "c"}\n')
    with pytest.raises(PySparkException, match="broken log line"):
        readers.load_log_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    raw = spark.read.text(str(tmp_path / "bad.jsonl")).selectExpr("value", "monotonically_increasing_id() AS pos")
    kept = readers.parse_log_lines(raw, keep_broken=True).orderBy("pos").collect()
    assert [(r["line"], r["broken"]) for r in kept] == [("a", False), (None, True), (None, True)]
    (tmp_path / "rules.json").write_text('[{"name":"A","summary":"1"},{"name":"A","summary":"2"}]')
    last = R.last_rule_per_name(readers.load_rules(spark, str(tmp_path / "rules.json"))).collect()
    assert [(r["name"], r["summary"]) for r in last] == [("A", "2")]
    (tmp_path / "splits.json").write_text('{"dev":["monitor-s1"],"test":["b","c"]}')
    members = readers.load_splits(spark, str(tmp_path / "splits.json"))
    names = spark.createDataFrame([("monitor-s1",), ("b",)], "name string")
    assert [r["name"] for r in readers.split_filter(names, members, "dev").collect()] == ["monitor-s1"]
    assert readers.split_filter(names, members, "all").count() == 2
    with pytest.raises(KeyError, match="unknown split"):
        readers.split_filter(names, members, "prod")
    df = spark.createDataFrame([("train", [("system", "s"), ("user", "u"), ("assistant", "a")])],
                               "split string, messages array<struct<role string, content string>>")
    sinks.write_chat(df, str(tmp_path / "chat"))
    row = readers.load_chat(spark, str(tmp_path / "chat")).first()
    assert (row["split"], row["user"], row["assistant"]) == ("train", "u", "a")
    (tmp_path / "flat").mkdir()
    text = spark.read.text(str(tmp_path / "chat")).first()["value"]
    (tmp_path / "flat" / "train.jsonl").write_text(text + "\n")
    row = readers.load_chat(spark, str(tmp_path / "flat")).first()
    assert (row["split"], row["user"], row["assistant"]) == ("train", "u", "a")
    assert "| 1 |" in sinks.markdown(spark.range(1, 2), "t")


def test_tabular_splits_and_scores(spark, tmp_path):
    spark.createDataFrame([("dev", "a"), ("test", "b")], "split string, name string").write.parquet(str(tmp_path / "s"))
    members = readers.load_split_table(spark, str(tmp_path / "s"))
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r["name"] for r in readers.split_filter(names, members, "dev").collect()] == ["a"]
    spark.createDataFrame([("base", "greedy", "a", .5)], "arm string, kind string, scenario string, score double").write.parquet(str(tmp_path / "m"))
    assert readers.load_score_table(spark, str(tmp_path / "m")).first()["score"] == .5


def test_own_mutations(spark):
    answer = "요약: s\n근거 발견: 예\n원인 가설: c\n제안 조치:\n- a"
    df = spark.createDataFrame([("x", answer, "r"), ("y", "no layout", "r")], "scenario string, answer string, rubric string")
    own = {"louder": ("FAIL", lambda f: F.concat(f["summary"], F.lit("!"))), "never": ("PASS", lambda f: F.lit(None).cast("string"))}
    rows = PR.build_probes(df, "gross", own).collect()
    assert [(r["scenario"], r["answer"]) for r in rows if r["mutation"] == "louder"] == [("x", "s!")]
    assert "never" not in {r["mutation"] for r in rows} and "verdict-flip" in {r["mutation"] for r in rows}
    with pytest.raises(ValueError, match="unknown set"):
        PR.mutations("other")


def test_score_trial_and_sampling_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"base":{"greedy":{"a":0.5},"best":{"a":1.0}}}')
    got = {(r["arm"], r["kind"], r["scenario"]): r["score"] for r in readers.load_score_matrix(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("base", "greedy", "a"): 0.5, ("base", "best", "a"): 1.0}
    d = tmp_path / "t"
    d.mkdir()
    (d / "b.jsonl").write_text('{"scenario_name":"s","trial":1,"answer":"second","score":{"verdict":"PASS"}}\n')
    (d / "a.jsonl").write_text('{"probe":1}\n{"scenario_name":"s","trial":1,"answer":"no","score":{"verdict":"FAIL"}}\n'
                               '{"scenario_name":"s","trial":1,"answer":"first","score":{"verdict":"PASS"}}\n')
    assert [tuple(r) for r in PR.passing_answers(readers.load_trials(spark, str(d))).collect()] == [("s", "first")]
    p = tmp_path / "p"
    p.mkdir()
    (p / "s.json").write_text('{"scenario":"s","greedy":{"text":"g","total":0.5},"samples":[{"text":"x","total":1.0}]}')
    assert sorted((r["sample_idx"], r["raw"]) for r in readers.load_sampling_files(spark, str(p)).collect()) == [(-1, "g"), (0, "x")]


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_live_windows_equal_the_batch_and_drop_late_lines(spark, tmp_path):
    feed, out, progress = (str(tmp_path / x) for x in ("feed", "out", "progress"))
    schema = "seq long, ts timestamp, ts_ns long, line string"
    rows = [(i, i * 16 + i * 37 % 300) for i in range(300)] + [(900, 90_000)]
    mk = lambda batch: spark.createDataFrame(
        [(i, t * 10**9, f"[t] [ERROR] [,] --- [p] c.A : consumer=C{i % 3} n{i}") for i, t in batch], "seq long, ts_ns long, line string"
    ).select("seq", F.timestamp_seconds(F.col("ts_ns") / 10**9).alias("ts"), "ts_ns", "line")

    def feed_and_run(batch):
        mk(batch).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        run(jobs.live_windows(stream, limit=5).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", progress))

    feed_and_run(rows[:150])
    feed_and_run(rows[150:])
    feed_and_run([(999, 10)])  # far behind the watermark
    latest = spark.read.schema("bucket long, rn int, line string, n long").parquet(out)
    got = {r["end_ns"]: (r["samples"], r["family"]) for r in jobs.windows_from_lines(latest).collect()}
    assert [tuple(r) for r in jobs.late_lines(latest).collect()] == [(0, 1)]
    whole = jobs.windows_from_lines(latest.unionByName(jobs.open_windows(spark, progress))).collect()
    every = R.build_windows(mk(rows).select("seq", "ts_ns", "line"), limit=5).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, every))  # the last window is still open
    feed_and_run([(1000 + i, 20 + i) for i in range(40)] + [(2000, 99_000)])  # a late burst, and the next window
    latest = spark.read.schema("bucket long, rn int, line string, n long").parquet(out)
    assert [tuple(r) for r in jobs.late_lines(latest).collect()] == [(0, 41)]
    assert 90_000 // 1800 in {r["bucket"] for r in latest.where("rn IS NOT NULL").collect()}
    batch = R.build_windows(mk(rows[:-1]).select("seq", "ts_ns", "line"), limit=5)
    assert got == {r["end_ns"]: (r["samples"], r["family"]) for r in batch.collect()}


def test_intake_skips_content_seen_in_earlier_batches(spark, make, tmp_path):
    feed, path, progress = (str(tmp_path / x) for x in ("feed", "accepted", "progress"))
    for batch in ([scenario(2), scenario(1)], [scenario(0), scenario(4, log_samples=["x"])], [scenario(5, log_samples=["x"])]):
        make.scenarios(batch).select("seq", "name", "alert", "log_samples").write.mode("append").parquet(feed)
        stream = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
        run(jobs.candidate_intake(stream, path, progress))
    assert sorted(r["name"] for r in jobs.accepted(spark, path).collect()) == ["monitor-s1", "monitor-s4"]
    state = spark.read.format("statestore").load(progress).select("value.groupState.name").collect()
    assert sorted(r["name"] for r in state) == ["monitor-s1", "monitor-s4"]


def test_resume_leaves_done_scenarios_out(spark, make):
    done = spark.createDataFrame([("monitor-s1",)], "scenario string")
    rows = make.scenarios([scenario(i) for i in (3, 1, 2)])
    assert [r["name"] for r in sinks.todo(rows, done, 1).collect()] == ["monitor-s2"]


def test_a_batch_is_in_the_folder_once_however_often_it_is_written(spark, tmp_path):
    sink = sinks.trial_sink(spark, str(tmp_path / "trials"))
    rows = lambda lo, hi: spark.range(lo, hi).select("id", (F.col("id") % 2).alias("run"))
    with pytest.raises(FileNotFoundError):
        sink.read()
    sink.write(rows(0, 4), "a")
    sink.stage(rows(4, 6), "b")  # a job that died before its commit
    assert sorted(r["id"] for r in sink.read().collect()) == [0, 1, 2, 3]
    sink.write(rows(4, 6), "b")
    sink.write(rows(4, 6), "b")
    sink.write(rows(0, 4), "a")
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(6))
    late = sink.stage(rows(4, 6), "b")  # a second writer of the same batch comes too late
    sink.commit("b", late)
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(6)) and set(sink.commits()) == {"a", "b"}
    assert sink.discard_stages() == 2 and sorted(r["run"] for r in sink.read().collect()) == [0, 0, 0, 1, 1, 1]


def test_a_job_that_fails_while_writing_leaves_nothing_to_read(spark, tmp_path):
    sink = sinks.CommittedFolder(spark, str(tmp_path / "x"))
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sink.write(bad, "one")
    assert sink.commits() == {}
    sink.write(spark.range(100), "one")
    assert sink.read().count() == 100


def test_streams_go_to_an_own_sink(spark, tmp_path):
    feed = str(tmp_path / "feed")
    taken = {}

    class Own:
        def write(self, rows, batch):
            taken[batch] = sorted(r["id"] for r in rows.collect())

    folder = sinks.CommittedFolder(spark, str(tmp_path / "out"))
    for lo in (0, 3):
        spark.range(lo, lo + 3).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema("id long").parquet(feed)
        run(sinks.stream_to(stream, Own(), str(tmp_path / "own")))
        run(sinks.stream_to(stream, folder, str(tmp_path / "folder")))
    assert taken == {"batch-0": [0, 1, 2], "batch-1": [3, 4, 5]}
    assert sorted(r["id"] for r in folder.read().collect()) == list(range(6))


def test_folders_in_their_order(spark, tmp_path):
    from proofmill.operators import dedup
    for folder, names in (("z last", ["a", "b"]), ("b", ["b", "c"]), ("c+1%", ["c"])):
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / f"{name}.json").write_text(json.dumps({"name": name}) if name != "c" else "broken")
    paths = [str(tmp_path / f) for f in ("c+1%", "z last", "b")]
    got = dedup.unique_names(readers.load_candidate_folders(spark, paths)).collect()
    assert sorted((r["name"], r["dir_order"], r["unreadable"], r["is_first"]) for r in got) == [
        ("a", 1, False, True), ("b", 1, False, True), ("b", 2, False, False), ("c", 0, True, True), ("c", 2, True, False)]


def test_folders_of_lines(spark, tmp_path):
    """Many candidates a file, in the order of their lines; no file per candidate."""
    from proofmill.operators import dedup
    for folder, text in (("z", '{"name": "a"}\n\n{"name": "b"}\n{"name": "a"}\n'), ("b", '{"name": "b"}\nbroken\n')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0.json").write_text(text)
    rows = readers.load_candidate_folders(spark, [str(tmp_path / f) for f in ("z", "b")], lines=True)
    got = dedup.unique_names(rows).orderBy("dir_order", "file").collect()
    assert [(r["name"] if not r["unreadable"] else None, r["dir_order"], r["unreadable"], r["is_first"]) for r in got] == [
        ("a", 0, False, True), ("b", 0, False, True), ("a", 0, False, False), ("b", 1, False, False), (None, 1, True, True)]
    assert len({r["file"] for r in got}) == 5


def _candidate_files(monkeypatch, spark, tmp_path):
    """The JSON files that ``audit_folders`` writes, and its rows, over documents of its own."""
    from proofmill.plans import bridge, q_curation
    names = spark.range(30).selectExpr("id AS seq", "concat('n', id % 20) AS name")
    monkeypatch.setattr(bridge, "candidates", lambda s, sf: names)
    monkeypatch.setattr(q_curation, "scratch", lambda s, what: str(tmp_path / what))
    got = q_curation.audit_folders(spark, "").collect()
    return len(list((tmp_path / "folders").rglob("*.json"))), got


def test_folder_audit_writes_no_file_per_candidate(monkeypatch, spark, tmp_path):
    files, got = _candidate_files(monkeypatch, spark, tmp_path)
    assert len(got) == 30 and sum(r["is_first"] for r in got) == 20
    assert files < 20


def test_trials_are_scored_once_for_all_their_stages(monkeypatch, spark, tmp_path):
    from proofmill.plans import bridge, q_outputs
    runs = spark.sparkContext.accumulator(0)

    def scored(trials, scenarios):
        def seen(trial):
            runs.add(1)
            return trial
        return trials.withColumn("trial", F.udf(seen, "int")("trial"))

    rows = spark.range(10).selectExpr("'r' AS run", "cast(id % 5 AS int) AS trial", "'PASS' AS verdict")
    monkeypatch.setattr(bridge, "trials", lambda s, sf: rows)
    monkeypatch.setattr(bridge, "scenarios", lambda s, sf: None)
    monkeypatch.setattr(q_outputs.O, "trial_results", scored)
    monkeypatch.setattr(q_outputs, "scratch", lambda s, what: str(tmp_path / what))
    assert [tuple(r) for r in q_outputs.trial_sink(spark, "").collect()] == [("r", 10, 10)]
    assert runs.value == 10
