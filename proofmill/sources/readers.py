"""Readers for the file layouts: scenarios, candidates, logs, rules, splits, scores, trials.

Order carries meaning in most of them, so every reader adds an explicit order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as K
from ..functions.ordering import running_totals
from ..schemas import SCENARIO_FILE


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One row per file: its name and text."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))


def _fields(raw: Column) -> Column:
    return F.from_json(raw, SCENARIO_FILE)


def parse_scenario_files(files: DataFrame) -> DataFrame:
    """(file, raw) -> scenario columns plus the top-level keys that are ``present`` and those
    of the alert, ``alert_present``.

    ``unreadable`` marks text that is not one JSON object; its fields are null.
    """
    node = F.try_parse_json("raw")
    step = files.withColumn("__ok", F.coalesce(
        F.schema_of_variant(node).startswith("OBJECT"), F.lit(False)))
    step = step.withColumn("s", F.when(F.col("__ok"), _fields(F.col("raw"))))
    s = F.col("s")
    empty = F.array().cast("array<string>")
    return step.select(
        "file", s["name"].alias("name"), s["question"].alias("question"),
        s["rubric"].alias("rubric"), s["source"].alias("source"),
        F.when(s["alert"].isNotNull(), s["alert"].withField("labels", F.coalesce(
            s["alert"]["labels"], F.create_map().cast("map<string,string>")))).alias("alert"),
        s["logSamples"].alias("log_samples"), s["logEnvironment"].alias("log_environment"),
        F.coalesce(s["expected"], F.lit("")).alias("expected"), s["axis"].alias("axis"),
        F.when(F.col("__ok"), F.json_object_keys("raw")).otherwise(empty).alias("present"),
        F.coalesce(F.json_object_keys(F.get_json_object("raw", "$.alert")), empty).alias("alert_present"),
        (~F.col("__ok")).alias("unreadable"))


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.json`` of a directory as scenarios; ``file`` gives their order.

    An empty directory is an error right away, a file with a missing field is one while
    the job runs.
    """
    files = _files(spark, path, "*.json")
    if files.isEmpty():
        raise FileNotFoundError(f"no scenario files in {path}")
    rows = parse_scenario_files(files)
    missing = missing_fields()
    checked = F.when(
        F.col("unreadable") | (F.size(missing) > 0),
        F.raise_error(F.concat(F.col("file"), F.lit(": missing "), F.array_join(missing, ", ")))
        .cast("string")).otherwise(F.col("name"))
    return rows.withColumn("name", checked).drop("present", "alert_present", "unreadable", "axis")


def missing_fields() -> Column:
    """Required fields that a parsed file lacks, those of its alert as ``alert.<field>``."""
    top = F.array_except(F.array(*[F.lit(k) for k in K.REQUIRED_FIELDS]), F.col("present"))
    alert = F.array_except(F.array(*[F.lit(k) for k in K.ALERT_FIELDS]), F.col("alert_present"))
    return F.concat(top, F.transform(alert, lambda k: F.concat(F.lit("alert."), k)))


def ingest_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate files, unreadable ones included; the file stem names those without a name."""
    rows = parse_scenario_files(_files(spark, path, "*.json"))
    return rows.withColumn("name", F.coalesce(
        "name", F.regexp_replace("file", r"\.json$", "")))


def load_candidate_folders(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Candidates of several folders, ``dir_order`` being the folder's place in the list, which
    goes before ``file`` where names repeat (see ``dedup.unique_names``). One scan reads them all.
    A folder named twice counts at its first place; a folder that is missing is an error.

    ``lines`` reads files of one candidate a line, as ``sinks.write_candidates`` makes them: the
    layout for more candidates than a file system bears files. ``file`` then is the file's name and
    the line's place in it, in the order of the lines; blank lines are skipped.
    """
    make, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    whole = [make(p).getFileSystem(conf).makeQualified(make(p)).toUri().toString() for p in paths]
    plain = lambda uri: F.regexp_replace(uri, "^([A-Za-z0-9]+):/+", "$1:/")
    folder = plain(F.regexp_extract("folder", "^(.*)/[^/]*$", 1))
    name = F.col("_metadata.file_name")
    if lines:
        digits = lambda n: F.lpad(n.cast("string"), 19, "0")
        name = F.concat_ws("#", name, digits(F.col("_metadata.file_block_start")), digits(F.monotonically_increasing_id()))
    files = spark.read.option("wholetext", not lines).option("pathGlobFilter", "*.json").text(paths).select(
        F.col("_metadata.file_path").alias("folder"), name.alias("file"), F.col("value").alias("raw"))
    if lines:
        files = files.filter(F.col("raw").rlike(r"(?U)\S"))
    places = F.array(*[plain(F.lit(uri)) for uri in whole])
    placed = files.select(F.struct((F.array_position(places, folder) - 1).cast("int").alias("dir_order"), "file").alias("file"), "raw")
    rows = parse_scenario_files(placed)
    at = rows["file"]
    return rows.select(at["dir_order"].alias("dir_order"), at["file"].alias("file"), *[c for c in rows.columns if c not in ("file", "name")],
                       F.coalesce("name", F.regexp_replace(at["file"], r"\.json$", "")).alias("name"))


def with_seq(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``seq``, the position in the order of the given columns (file, for files)."""
    return running_totals(df, [F.col(c).asc() for c in order], {"seq": F.lit(1)})


def load_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log JSONL with ``ts`` (epoch ns, number or text) and ``line``; blank lines skipped, a
    broken one is an error while the job runs.

    ``seq`` is the position (file, block of the file, place in the block), which decides
    between equal times without numbering the lines.
    """
    text = spark.read.text(path).select("value", _position().alias("pos"))
    return parse_log_lines(text).select(F.col("pos").alias("seq"), "ts_ns", "line")


def _position() -> Column:
    """Orderable position of a text line: ids grow within a block, blocks within a file."""
    return F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))


def parse_log_lines(rows: DataFrame, keep_broken: bool = False) -> DataFrame:
    """(value, pos) -> (pos, ts_ns, line).

    A line that is no JSON object with both fields is an error while the job runs. With
    ``keep_broken`` it stays as a row of nulls, and a column ``broken`` tells.
    """
    fields = F.from_json("value", "ts string, line string")
    step = rows.filter(F.col("value").rlike(r"(?U)\S")).withColumn("j", fields).select(
        "pos", "value", F.col("j.ts").try_cast("long").alias("ts_ns"), F.col("j.line").alias("line"))
    broken = F.try_parse_json("value").isNull() | F.col("ts_ns").isNull() | F.col("line").isNull()
    step = step.withColumn("broken", broken)
    if keep_broken:
        known = lambda c: F.when(~F.col("broken"), F.col(c)).alias(c)
        return step.select("pos", known("ts_ns"), known("line"), "broken")
    return step.select("pos", "ts_ns", _or_raise(F.col("line"), F.col("broken"), "log line").alias("line"))


def _or_raise(value: Column, broken: Column, what: str) -> Column:
    return F.when(broken, F.raise_error(F.concat(F.lit(f"broken {what}: "), F.substr("value", F.lit(1), F.lit(200))))
                  .cast("string")).otherwise(value)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Alert rules from a JSON array file, in file order."""
    raw = spark.read.option("wholetext", True).text(path)
    rules = F.from_json("value", "array<struct<name string, severity string, summary string, description string>>")
    return raw.select(F.posexplode(rules).alias("pos", "r")).select(
        F.col("pos").cast("long").alias("seq"), "r.*")


def explode_splits(manifest: DataFrame) -> DataFrame:
    """(members map) -> (split, name)."""
    return manifest.select(F.explode("members").alias("split", "names")).select(
        "split", F.explode("names").alias("name"))


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("wholetext", True).text(path)
    return explode_splits(raw.select(
        F.from_json("value", "map<string,array<string>>").alias("members")))


def load_split_table(spark: SparkSession, path: str) -> DataFrame:
    """(split, name) from Parquet: the layout for manifests that outgrow one JSON object."""
    return spark.read.schema("split string, name string").parquet(path)


ALL = "all"


def split_filter(scenarios: DataFrame, members: DataFrame, split: str) -> DataFrame:
    """Scenarios of one split; ``all`` keeps everything, an unknown split is an error."""
    if split == ALL:
        return scenarios
    own = members.filter(F.col("split") == split)
    if own.isEmpty():
        known = members.select("split").distinct().orderBy("split").limit(20).collect()
        raise KeyError(f"unknown split {split}, known: {[r[0] for r in known]}, {ALL}")
    return scenarios.join(own.select("name").distinct(), "name", "left_semi")


def load_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Score file ``{arm: {kind: {scenario: score}}}`` as a long table of greedy and best."""
    raw = spark.read.option("wholetext", True).text(path)
    arms = F.from_json("value", "map<string,struct<greedy map<string,double>,best map<string,double>>>")
    per = raw.select(F.explode(arms).alias("arm", "k")).select("arm", F.explode(F.create_map(
        F.lit("greedy"), F.col("k.greedy"), F.lit("best"), F.col("k.best"))).alias("kind", "scores"))
    return per.filter(F.col("scores").isNotNull()).select(
        "arm", "kind", F.explode("scores").alias("scenario", "score"))


def load_score_table(spark: SparkSession, path: str) -> DataFrame:
    """(arm, kind, scenario, score) from Parquet: the layout for matrices of any size."""
    return spark.read.schema("arm string, kind string, scenario string, score double").parquet(path)


def load_sampling_files(spark: SparkSession, path: str) -> DataFrame:
    """Sampling files ``{scenario, greedy, samples}`` as (scenario, sample_idx, raw, reward)."""
    one = "struct<text string, total double, parse_failed boolean>"
    row = F.from_json("raw", f"struct<scenario string, greedy {one}, samples array<{one}>>")
    rows = _files(spark, path, "*.json").select(row.alias("r"))
    samples = F.transform(F.col("r.samples"), lambda x, i: F.struct(i.alias("i"), x.alias("s")))
    greedy = F.array(F.struct(F.lit(-1).alias("i"), F.col("r.greedy").alias("s")))
    return rows.select(F.col("r.scenario").alias("scenario"), F.explode(
        F.concat(greedy, samples)).alias("x")).select(
        "scenario", F.col("x.i").alias("sample_idx"), F.col("x.s.text").alias("raw"),
        F.col("x.s.total").alias("reward"), F.col("x.s.parse_failed").alias("parse_failed"))


def load_chat(spark: SparkSession, path: str) -> DataFrame:
    """``train.jsonl`` and ``valid.jsonl``, or the folders that ``write_chat`` makes, as
    (split, split_order, line_no, user, assistant). A line without messages is an error."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    msgs = F.from_json("value", "struct<messages array<struct<role string, content string>>>")
    m = F.col("m.messages")
    rows = text.select(
        "value", msgs.alias("m"), F.regexp_extract(
            "_metadata.file_path", r"(?:split=(?=(?:train|valid)/)|/(?=(?:train|valid)\.jsonl$))(train|valid)", 1).alias("split"),
        _position().alias("line_no"))
    assistant = _or_raise(F.element_at(m, -1)["content"], F.coalesce(F.size(m), F.lit(0)) < 1, "chat line")
    return rows.filter(F.col("split").isin("train", "valid") & F.col("value").rlike(r"(?U)\S")).select(
        "split", F.when(F.col("split") == "train", 0).otherwise(1).alias("split_order"), "line_no",
        F.get(m, F.lit(1))["content"].alias("user"), assistant.alias("assistant"))


def load_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial JSONL files; rows of another layout come with a null verdict, a line that is no
    JSON is an error."""
    score = "struct<accuracy int, groundedness int, hallucination_detected boolean, verdict string, rationale string>"
    row = F.from_json("value", f"struct<scenario_name string, trial int, answer string, score {score}, "
                               "analyzer_latency_ms long, error string>")
    text = spark.read.option("pathGlobFilter", "*.jsonl").text(path)
    return text.select(
        F.col("_metadata.file_name").alias("file"), _position().alias("line_no"), "value",
        row.alias("r")).filter(F.col("value").rlike(r"(?U)\S")).select(
        "file", "line_no", _or_raise(F.col("r.scenario_name"), F.try_parse_json("value").isNull(), "trial line")
        .alias("scenario"), "r.trial", "r.answer",
        "r.score.accuracy", "r.score.groundedness", "r.score.hallucination_detected",
        "r.score.verdict", "r.score.rationale", F.col("r.analyzer_latency_ms").alias("latency_ms"),
        "r.error")
