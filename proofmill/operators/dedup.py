"""Content signatures, duplicates and leak audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as K
from ..functions import text as X
from ..functions.ordering import share_by_key
from ..functions.prefilter import possible
from ..functions.stage import let, once
from ..session import reused

_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def with_signature(scenarios: DataFrame) -> DataFrame:
    """Adds ``signature``: alert name, id-free alert texts, time span, and the (logger,
    message) skeleton of the lines in order, as one digest.

    The span and the alert text belong to it: pairs that differ only there are contrast
    pairs, not copies.
    """
    a = F.col("alert")
    spanned = scenarios.withColumn("span", X.span_minutes(F.col("log_samples")))
    return once(spanned, signature=F.sha2(F.to_json(F.struct(
            a["alertname"].alias("name"),
            X.normalize_alert_text(a["summary"]).alias("summary"),
            X.normalize_alert_text(a["description"]).alias("description"),
            X.span_bucket(F.col("span")).alias("span"),
            X.signature_lines(F.col("log_samples")).alias("lines"),
        )), 256)).drop("span")


def find_duplicates(rows: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """(seq, later, earlier, partner_side) for each row whose signature came before.

    Both tables have seq, name and signature. Rows of ``against`` all come first. A match
    among the rows themselves is reported as well, with partner_side ``batch``.
    """
    # all uses below read narrow rows that are kept, so signatures are computed once: a shuffle
    # would be made anew wherever a use needs other columns or filters than the next
    own = reused(rows.select("seq", "name", "signature")).withColumn("side", F.lit(1))
    every = own
    if against is not None:
        old = reused(against.select("seq", "name", "signature"))
        every = own.unionByName(old.withColumn("side", F.lit(0)))
    # a signature may cover a third of the table: only its first row and its size travel
    firsts = every.groupBy("signature").agg(
        F.min(F.struct("side", "seq", "name")).alias("first"), F.count(F.lit(1)).alias("n"),
    ).filter(F.col("n") > 1)
    linked = share_by_key(own, firsts, ["signature"], "n", sparse=True)
    first = F.col("first")
    return linked.filter(
        first.isNotNull() & ~((first["side"] == 1) & (first["seq"] == F.col("seq")))
    ).select(
        "seq", F.col("name").alias("later"), first["name"].alias("earlier"),
        F.when(first["side"] == 0, "against").otherwise("batch").alias("partner_side"))


def unique_names(rows: DataFrame) -> DataFrame:
    """Adds ``is_first``: the first row of each name by (dir_order, file) is kept."""
    firsts = rows.groupBy("name").agg(
        F.min(F.struct("dir_order", "file")).alias("first"), F.count(F.lit(1)).alias("n"))
    linked = share_by_key(rows, firsts, ["name"], "n")
    return linked.withColumn(
        "is_first", F.struct("dir_order", "file") == F.col("first")).drop("first", "n")


def prompt_signature(content) -> Column:
    """Signature of a built prompt: its alert lines and its normalised log lines."""
    return _parts_digest(prompt_parts(content))


def prompt_parts(content) -> Column:
    """The lines of a built prompt that count: ``alert`` as they are, ``logs`` normalised."""
    starts = lambda line: X.any_of([line.startswith(p) for p in K.PROMPT_ALERT_LINE_STARTS])
    return let(F.split(content, _LINE_ENDS), lambda lines: F.struct(
        F.filter(lines, starts).alias("alert"), _log_lines(lines).alias("logs")))


def prompt_log_lines(content) -> Column:
    """Normalised log lines of a built prompt."""
    return _log_lines(F.split(content, _LINE_ENDS))


def _log_lines(lines) -> Column:
    logs = F.transform(F.filter(lines, lambda line: line.startswith("- [")), lambda line: F.substr(line, F.lit(3)))
    return F.transform(logs, X.normalize_message)


def _parts_digest(parts) -> Column:
    return F.sha2(F.to_json(parts), 256)


def train_valid_leaks(chat: DataFrame) -> DataFrame:
    """Validation rows whose prompt signature also occurs in training."""
    signed = chat
    if "signature" not in chat.columns:
        signed = reused(once(chat, signature=prompt_signature(F.col("user"))).drop("user"))
    train = signed.filter(F.col("split") == "train").select("signature")
    valid = signed.filter(F.col("split") == "valid").select("signature")
    # the smaller side is filtered by nothing, it filters the larger one
    leaked = possible(train, valid, ["signature"]).distinct()
    return signed.filter(F.col("split") == "valid").join(leaked, "signature", "left_semi").drop("signature")


def contaminated_prompts(chat: DataFrame, golden: DataFrame) -> DataFrame:
    """Built prompts whose normalised log lines are those of an evaluation scenario."""
    if "logs" not in chat.columns:
        chat = once(chat, logs=_line_digest(prompt_log_lines(F.col("user"))))
    if "logs" not in golden.columns:
        golden = golden.select(_golden_digest().alias("logs"))
    held = golden.select("logs").distinct()
    return possible(chat, held, ["logs"]).join(held, "logs", "left_semi").drop("logs")


def _line_digest(lines) -> Column:
    return F.sha2(F.to_json(F.struct(lines.alias("l"))), 256)


def _golden_digest() -> Column:
    return _line_digest(F.transform(F.col("log_samples"), X.normalize_message))


def shared_lines(rows: DataFrame, golden: DataFrame, lines: str = "log_samples") -> DataFrame:
    """Rows that share a whole normalised message with an evaluation scenario."""
    # digests of the messages are compared, so the text itself does not move
    message = lambda df: df.select(
        "name", F.explode(F.transform(X.signature_lines(F.col(lines)),
                                      lambda x: F.sha2(x["message"], 256))).alias("message"))
    held = message(golden).select("message").distinct()
    return possible(message(rows), held, ["message"]).join(held, "message", "left_semi").groupBy("name").agg(
        F.count(F.lit(1)).alias("shared_lines"))


def audit_summary(candidates: DataFrame, golden: DataFrame, chat: DataFrame) -> DataFrame:
    """Problems found by each of the four audits, plus their total and the exit status.

    Every row turns into the keys it is compared by, with its role. One grouping by key, which
    counts map-side, answers all four: copies among candidates, candidates equal to a golden
    scenario, validation prompts that are in training, and golden log lines in prompts.
    """
    entry = lambda kind, key, role: F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), role.alias("role"))
    signature = F.col("signature")
    sides = [
        with_signature(candidates).select(F.array(entry("content", signature, F.lit("candidate"))).alias("keys")),
        with_signature(golden).select(F.array(
            entry("content", signature, F.lit("golden")),
            entry("lines", _golden_digest(), F.lit("golden"))).alias("keys")),
        once(chat, parts=prompt_parts(F.col("user"))).select(F.array(
            entry("prompt", _parts_digest(F.col("parts")), F.col("split")),
            entry("lines", _line_digest(F.col("parts.logs")), F.lit("chat"))).alias("keys")),
    ]
    keys = sides[0].unionByName(sides[1]).unionByName(sides[2]).select(F.explode("keys").alias("k"))
    n = lambda role: F.count_if(F.col("k.role") == role).alias(f"n_{role}")
    per = keys.groupBy("k.kind", "k.key").agg(*[n(r) for r in ("candidate", "golden", "train", "valid", "chat")])
    when = lambda kind, met, value: F.coalesce(
        F.sum(F.when((F.col("kind") == kind) & met, value)), F.lit(0).cast("long"))
    found = per.agg(
        when("content", F.col("n_candidate") > 1, F.col("n_candidate") - 1).alias("internal_duplicate"),
        when("content", F.col("n_golden") > 0, F.col("n_candidate")).alias("golden_overlap"),
        when("prompt", F.col("n_train") > 0, F.col("n_valid")).alias("train_valid_leak"),
        when("lines", F.col("n_golden") > 0, F.col("n_chat")).alias("golden_in_training"))
    total = sum((F.col(c) for c in found.columns), F.lit(0).cast("long"))
    report = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("problems")) for c in found.columns],
                     F.struct(F.lit("total").alias("check"), total.alias("problems")))
    return found.select(F.explode(report).alias("r")).select(
        "r.check", "r.problems", F.when(F.col("r.problems") > 0, 1).otherwise(0).alias("status"))


def existing_names(*tables: DataFrame) -> DataFrame:
    """Names over several batches, once each."""
    names = tables[0].select("name")
    for table in tables[1:]:
        names = names.unionByName(table.select("name"))
    return names.distinct()


def split_integrity(members: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Names in two splits, names without a split, split members without a scenario."""
    twice = members.groupBy("name").agg(F.countDistinct("split").alias("n")).filter("n > 1")
    m, s = members.select("name").distinct(), scenarios.select("name").distinct()
    found = [("in_two_splits", twice.select("name")),
             ("unassigned", s.join(m, "name", "left_anti")),
             ("unknown_member", m.join(s, "name", "left_anti"))]
    out = None
    for problem, names in found:
        part = names.select(F.lit(problem).alias("problem"), "name")
        out = part if out is None else out.unionByName(part)
    return out
