"""Candidate validation: one array of reasons per validator, all of them in one pass.

Catalog lookups are expressions over a ``Catalog``, a configuration object with a few dozen
entries, so validation needs no join and no shuffle except for the two duplicate checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as K
from ..functions import text as X
from ..functions.ordering import share_by_key
from ..functions.stage import let, once
from ..session import reused
from . import dedup


@dataclass(frozen=True)
class Catalog:
    """What is known to exist: alerts, texts, log messages, threads, slot values."""

    alert_rules: dict = field(default_factory=lambda: K.ALERT_RULES)
    alert_texts: dict = field(default_factory=lambda: K.ALERT_TEXTS)
    log_messages: tuple = K.LOG_MESSAGES
    logger_families: dict = field(default_factory=lambda: K.LOGGER_FAMILIES)
    stream_pools: tuple = K.STREAM_POOLS
    consumers: tuple = K.CONSUMERS
    consumer_events: dict = field(default_factory=lambda: K.CONSUMER_EVENTS)
    games: tuple = K.GAMES


def _flat(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def _say(code: str, value: Column) -> Column:
    return F.concat(F.lit(code + ":"), F.coalesce(value.cast("string"), F.lit("none")))


def parse_lines(lines: Column) -> Column:
    """Fields of each catalog-format line; ``ok`` is false when the format does not fit.

    The pattern is run once a line: it puts a mark between the fields, and a split takes them.
    """
    mark = "\u0001"
    whole = X.rx(K.CATALOG_LINE.removesuffix("$") + r"\R?\z")
    marked = "".join(f"{mark}${group}" for group in (1, 2, 5, 6, 7))

    def fields(line: Column, i: Column) -> Column:
        def named(p: Column) -> Column:
            ok = (F.size(p) == 6) & (F.get(p, F.lit(0)) == "") & ~line.startswith(mark)
            part = lambda k: F.when(ok, F.get(p, F.lit(k))).otherwise(F.when(line.isNotNull(), ""))
            return F.struct(i.alias("i"), ok.alias("ok"), *[
                part(k).alias(name) for k, name in enumerate(("ts", "level", "thread", "logger", "message"), 1)])
        return let(F.split(F.regexp_replace(line, whole, marked), mark, 6), named)

    return F.transform(lines, fields)


def _per_line(parsed: Column, reasons) -> Column:
    """Reasons of all lines, each with the index of its line."""
    return F.flatten(F.transform(parsed, lambda p: F.transform(
        reasons(p), lambda r: F.concat(F.lit("line "), p["i"].cast("string"), F.lit(" "), r))))


def schema_reasons(c, catalog) -> Column:
    missing = F.transform(
        F.array_except(F.array(*[F.lit(k) for k in K.REQUIRED_FIELDS]), c["present"]),
        lambda k: F.concat(F.lit("missing:"), k))
    env, name = c["log_environment"], c["name"]
    rest = _flat(
        F.when(F.coalesce(F.size(c["log_samples"]), F.lit(0)) < 1, "no_log_lines"),
        F.when(~env.eqNullSafe(F.lit("prod")), _say("environment", env)),
        F.when(~F.coalesce(name.rlike(X.whole(K.SCENARIO_NAME)), F.lit(False)), _say("name", name)))
    return F.when(F.size(missing) > 0, missing).otherwise(rest)


def alert_reasons(c, catalog) -> Column:
    a = c["alert"]
    labels = F.coalesce(a["labels"], F.create_map().cast("map<string,string>"))
    out = F
    for name, (severity, required, optional) in catalog.alert_rules.items():
        allowed = ["alertname", "severity", *required, *optional]
        checks = [F.when(~a["severity"].eqNullSafe(F.lit(severity)), _say("severity", a["severity"]))]
        for key, value in required.items():
            got = F.element_at(labels, key)
            checks.append(F.when(~got.eqNullSafe(F.lit(value)), _say(f"label {key}", got)))
        extra = F.transform(
            F.array_except(F.map_keys(labels), F.array(*[F.lit(k) for k in allowed])),
            lambda k: F.concat(F.lit("unknown label:"), k))
        text = F.when(
            (F.coalesce(a["summary"], F.lit("")) == "") | (F.coalesce(a["description"], F.lit("")) == ""),
            "no_alert_text")
        out = out.when(a["alertname"] == name, F.concat(_flat(*checks), extra, _flat(text)))
    return out.otherwise(F.array(_say("unknown alert", a["alertname"])))


def alert_text_reasons(c, catalog) -> Column:
    a = c["alert"]
    summary = F.coalesce(a["summary"], F.lit(""))
    description = F.coalesce(a["description"], F.lit(""))
    out = F
    for name, (summaries, descriptions) in catalog.alert_texts.items():
        out = out.when(a["alertname"] == name, _flat(
            F.when(~X.any_of([X.matches_template(summary, t) for t in summaries]), "summary"),
            F.when(~X.any_of([X.matches_template(description, t) for t in descriptions]), "description")))
    return out.otherwise(F.array().cast("array<string>"))  # the alert rule reports unknown alerts


def log_line_reasons(c, catalog) -> Column:
    by_logger: dict[str, list] = {}
    for logger, template, level in catalog.log_messages:
        by_logger.setdefault(logger, []).append((template, level))

    def one(p: Column) -> Column:
        known = F
        for logger, messages in by_logger.items():
            known = known.when(p["logger"] == logger, X.any_of(
                [X.matches_template(p["message"], t) for t, _ in messages]))
        seen = F.struct(X.thread_family(p["thread"]).alias("family"), known.otherwise(False).alias("known"))
        return F.when(~p["ok"], F.array(F.lit("format"))).otherwise(let(seen, lambda s: found(p, s["family"], s["known"])))

    def found(p: Column, family: Column, known: Column) -> Column:
        level_ok, family_ok = F, F
        for logger, messages in by_logger.items():
            at = p["logger"] == logger
            level_ok = level_ok.when(at, X.any_of(
                [(p["level"] == lv) & X.matches_template(p["message"], t) for t, lv in messages]))
            allowed = catalog.logger_families.get(logger)
            if allowed:
                family_ok = family_ok.when(at, family.isNull() | family.isin(*allowed))
        return _flat(
            F.when(family.isNull(), _say("thread", p["thread"])),
            F.when(~known, _say("unknown message of", p["logger"])),
            F.when(known & ~level_ok.otherwise(True), _say("level", p["level"])),
            F.when(known & ~family_ok.otherwise(True), _say("family", family)))

    return _per_line(c["parsed"], one)


def slot_value_reasons(c, catalog) -> Column:
    pools = [p for p in catalog.stream_pools if p != K.SHARED_POOL]

    def one(p: Column) -> Column:
        m = p["message"]
        get = lambda pattern, i=1: F.nullif(F.regexp_extract(m, X.rx(pattern), i), F.lit(""))
        consumer, event = get(K.SLOT_CONSUMER), get(K.SLOT_CONSUMER, 2)
        uri, stream = get(K.SLOT_URI), get(K.SLOT_STREAM)
        box, key = get(K.SLOT_OUTBOX), get(K.SLOT_OUTBOX, 2)
        record, game, join = get(K.SLOT_RECORD), get(K.SLOT_GAME), get(K.SLOT_JOIN)
        wrong_event = F.lit(False)
        for name, paired in catalog.consumer_events.items():
            wrong_event = wrong_event | ((consumer == name) & (event != paired))
        return F.when(p["ok"], _flat(
            F.when(m.startswith(K.EVENT_FAILURE_START) & consumer.isNull(), "event failure format"),
            F.when(consumer.isNotNull() & ~consumer.isin(*catalog.consumers), _say("consumer", consumer)),
            F.when(consumer.isNotNull() & wrong_event, _say("event", event)),
            F.when(m.startswith("method=") & uri.isNotNull() & ~uri.rlike(X.whole(K.URI_PATTERN)),
                   _say("uri", uri)),
            F.when(box.isNotNull() & ~box.rlike(X.whole(r"\d+")), _say("outbox id", box)),
            F.when(box.isNotNull() & ~key.isin(*pools), _say("streamKey", key)),
            F.when(m.contains("container") & stream.isNotNull() & ~stream.isin(*pools),
                   _say("stream", stream)),
            F.when(record.isNotNull() & m.contains(K.SETTLEMENT_WORD)
                   & ~record.rlike(X.whole(K.RECORD_ID_PATTERN)), _say("recordId", record)),
            F.when(game.isNotNull() & ~game.isin(*catalog.games), _say("game", game)),
            F.when(join.isNotNull() & ~join.rlike(X.whole(K.JOIN_CODE_PATTERN)), _say("joinCode", join)),
        )).otherwise(F.array().cast("array<string>"))

    return _per_line(c["parsed"], one)


def error_level_reasons(c, catalog) -> Column:
    return _per_line(c["parsed"], lambda p: _flat(
        F.when(p["ok"] & (p["level"] != "ERROR"), _say("level", p["level"]))))


def timestamp_reasons(c, catalog) -> Column:
    stamped = F.transform(F.filter(c["parsed"], lambda p: p["ok"]), lambda p: F.struct(
        p["i"].alias("i"),
        F.try_to_timestamp(p["ts"], F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts")))
    broken = F.filter(stamped, lambda s: s["ts"].isNull())
    times = F.transform(stamped, lambda s: s["ts"])
    return F.when(
        F.size(broken) > 0,
        F.array(F.concat(F.lit("line "), F.get(broken, F.lit(0))["i"].cast("string"),
                         F.lit(" unreadable time"))),
    ).when(times != F.array_sort(times), F.array(F.lit("not_ascending"))).otherwise(
        F.array().cast("array<string>"))


def rubric_reasons(c, catalog) -> Column:
    rubric = F.coalesce(c["rubric"], F.lit(""))
    yes, no = rubric.contains(K.RUBRIC_YES), rubric.contains(K.RUBRIC_NO)
    want = F.coalesce(c["expected"], F.lit(""))
    return _flat(
        F.when(~yes & ~no, "no_verdict_quoted"),
        F.when(~rubric.contains(K.RIGHT_WORD) | ~rubric.contains(K.WRONG_WORD), "no_conditions"),
        F.when((want == K.YES) & ~yes, "expected_yes_not_quoted"),
        F.when((want == K.NO) & ~no, "expected_no_not_quoted"))


#: Validators that look at one candidate alone, in report order.
ROW_VALIDATORS = {
    "schema": schema_reasons,
    "alert": alert_reasons,
    "alert-text": alert_text_reasons,
    "log-line": log_line_reasons,
    "slot-value": slot_value_reasons,
    "error-level": error_level_reasons,
    "timestamp": timestamp_reasons,
    "rubric": rubric_reasons,
}


def validate_rows(
    candidates: DataFrame, catalog: Catalog = Catalog(), validators=None
) -> DataFrame:
    """Adds one ``v_<validator>`` array of reasons per row validator."""
    validators = ROW_VALIDATORS if validators is None else validators
    c = candidates.withColumn("parsed", F.coalesce(
        parse_lines(F.col("log_samples")), parse_lines(F.array().cast("array<string>"))))
    row = {name: F.col(name) for name in c.columns}
    reasons = F.struct(*[rule(row, catalog).alias(f"v_{n}") for n, rule in validators.items()])
    return once(c, __reasons=reasons).drop("parsed").select(
        *[x for x in candidates.columns], "__reasons.*")


def duplicate_names(
    candidates: DataFrame, existing: DataFrame | None = None, within_batch: bool = True
) -> DataFrame:
    """Adds ``v_duplicate``: the name exists already, or came earlier in the batch.

    ``within_batch=False`` only looks at ``existing``.
    """
    names = candidates.select("name", F.lit(1).alias("side"), "seq")
    if existing is not None:
        old = existing.select("name", F.lit(0).alias("side"), F.lit(0).cast("long").alias("seq"))
        names = names.unionByName(old)
    firsts = names.groupBy("name").agg(
        F.min(F.struct("side", "seq")).alias("__first"), F.count(F.lit(1)).alias("__n"),
    ).filter(F.col("__n") > 1)
    linked = share_by_key(candidates, firsts, ["name"], "__n", sparse=True)
    first = F.col("__first")
    known = F.coalesce(first["side"] == 0, F.lit(False))
    if within_batch:
        known = known | F.coalesce(first["seq"] < F.col("seq"), F.lit(False))
    return linked.withColumn("v_duplicate", _flat(
        F.when(known & F.col("name").isNotNull(), _say("name", F.col("name"))))).drop("__first", "__n")


def duplicate_contents(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``v_duplicate-content``. Candidates that lack a field neither count nor match;
    every other one registers its content, whatever the other validators say."""
    signed = dedup.with_signature(candidates.filter(_is_whole()))
    old = None if existing is None else dedup.with_signature(existing)
    return _with_content(candidates, signed, old)


def _is_whole() -> Column:
    """All required fields are there, those of the alert included."""
    fields = F.size(F.array_except(F.array(*[F.lit(k) for k in K.REQUIRED_FIELDS]), F.col("present"))) == 0
    for key in K.ALERT_FIELDS:
        fields = fields & F.col("alert")[key].isNotNull()
    return fields


def _with_content(rows: DataFrame, signed: DataFrame, existing: DataFrame | None) -> DataFrame:
    found = dedup.find_duplicates(signed, existing).select("seq", F.col("earlier").alias("__earlier"))
    return rows.join(found, "seq", "left").withColumn("v_duplicate-content", _flat(
        F.when(F.col("__earlier").isNotNull(), _say("content", F.col("__earlier"))))).drop("__earlier")


def validate(
    candidates: DataFrame, existing: DataFrame | None = None, catalog: Catalog = Catalog(),
    within_batch: bool = True, screens: DataFrame | None = None,
) -> DataFrame:
    """(seq, name, failures): all validators in report order, then the screener's verdict.

    ``candidates`` carries seq and the fields of schemas.CANDIDATE. Unreadable rows
    (``unreadable`` true) only fail with ``generation``. ``screens`` (name, contradiction,
    reason) is consulted for candidates that no rule rejects; a null contradiction passes.
    """
    base = candidates
    if "unreadable" not in base.columns:
        base = base.withColumn("unreadable", F.lit(False))
    readable = base.filter(~F.col("unreadable")).drop("unreadable")
    # one pass over the wide rows; both duplicate checks then read narrow ones
    row = dedup.with_signature(validate_rows(readable, catalog))
    row = reused(row.select(
        "seq", "name", "signature", _is_whole().alias("whole"), *[f"v_{n}" for n in ROW_VALIDATORS]))
    if existing is not None:
        existing = reused(dedup.with_signature(existing).select("seq", "name", "signature"))
    names = [*ROW_VALIDATORS, "duplicate", "duplicate-content"]
    checked = duplicate_names(row, existing, within_batch)
    checked = _with_content(checked, row.filter("whole"), existing)
    checked = checked.select("seq", "name", F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(*[F.col(f"v_{n}") for n in names])).alias("failures"))
    if screens is not None:
        checked = screen(checked, screens)
    broken = base.filter("unreadable").select("seq", "name", F.create_map(
        F.lit("generation"), F.array(F.lit("unreadable"))).alias("failures"))
    return checked.unionByName(broken)


def is_clean(failures: Column) -> Column:
    return F.size(F.map_filter(failures, lambda k, v: F.size(v) > 0)) == 0


def screen(validated: DataFrame, screens: DataFrame) -> DataFrame:
    """Adds a ``screen`` failure to clean candidates that the screener found contradictory.

    Several verdicts of one name count as one: any contradiction holds, the first reason in
    alphabetical order is shown.
    """
    verdicts = screens.filter("contradiction").groupBy("name").agg(
        F.coalesce(F.min("reason"), F.lit("")).alias("__reason"))
    # rejected rows skip the join: its key is null for them
    keyed = validated.withColumn(
        "__k", F.when(is_clean(F.col("failures")), F.col("name")))
    clean = keyed.filter(F.col("__k").isNotNull()).drop("__k")
    rest = keyed.filter(F.col("__k").isNull()).drop("__k")
    hit = clean.join(verdicts, "name", "left")
    bad = F.create_map(F.lit("screen"), F.array(
        F.when(F.col("__reason") == "", "contradiction").otherwise(F.col("__reason"))))
    hit = hit.select("seq", "name", F.when(
        F.col("__reason").isNotNull(), F.map_concat("failures", bad)
    ).otherwise(F.col("failures")).alias("failures"))
    return hit.unionByName(rest.select("seq", "name", "failures"))


def axis_profile(candidates: DataFrame) -> DataFrame:
    """Candidates per axis and how many leave its line range or verdict."""
    axes = candidates.sparkSession.createDataFrame(
        list(K.AXES), "axis string, axis_expected string, min_logs int, max_logs int")
    n = F.size("log_samples")
    return candidates.join(F.broadcast(axes), "axis").groupBy("axis").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(n < F.col("min_logs")).alias("too_few_lines"),
        F.count_if(n > F.col("max_logs")).alias("too_many_lines"),
        F.count_if(~F.col("expected").eqNullSafe(F.col("axis_expected"))).alias("other_verdict"))


def alert_coverage(scenarios: DataFrame, catalog: Catalog = Catalog()) -> DataFrame:
    """Scenario count per catalog alert; 0 marks an alert nobody covers."""
    known = scenarios.sparkSession.createDataFrame(
        [(n,) for n in catalog.alert_rules], "alertname string")
    counts = scenarios.groupBy(F.col("alert.alertname").alias("alertname")).agg(
        F.count(F.lit(1)).alias("n"))
    return known.join(counts, "alertname", "left").select(
        "alertname", F.coalesce("n", F.lit(0)).alias("scenarios"),
        F.col("n").isNotNull().alias("covered"))


def pick_exemplars(scenarios: DataFrame, per_axis: int = 2) -> DataFrame:
    """(axis, name): the first scenarios whose rubric has the axis's polarity, or the first
    of all when no scenario has it."""
    w = Window.partitionBy("yes").orderBy("seq")
    ranked = scenarios.select(
        "seq", "name", F.col("rubric").contains(K.RUBRIC_YES).alias("yes")
    ).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_axis)
    # a handful of rows from here on: the first ones of each polarity
    groups = ranked.groupBy(F.lit(1).alias("one")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "name", "yes"))).alias("all"))
    pick = lambda want: F.filter("all", lambda x: x["yes"] == F.lit(want))
    choice = lambda want: F.when(F.size(pick(want)) > 0, pick(want)).otherwise(
        F.slice("all", 1, per_axis))
    axes = F.array(*[F.struct(F.lit(key).alias("axis"), choice(expected == K.YES).alias("picked"))
                     for key, expected, _, _ in K.AXES])
    return groups.select(F.explode(axes).alias("a")).select(
        "a.axis", F.explode("a.picked").alias("p")).select("axis", F.col("p.name").alias("name"))
