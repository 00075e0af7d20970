"""Replay of production logs: error windows and the scenarios made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as K
from ..functions import text as X
from ..functions.ordering import running_totals

_NS = 1_000_000_000


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(X.is_error_level(F.col("line")))


def bucket_of(ts_ns: Column, width_seconds: int) -> Column:
    """Window number since the epoch, also for times before it."""
    width = F.lit(width_seconds * _NS)
    # whole-number arithmetic: nanoseconds since 1970 do not fit a double exactly
    return F.call_function("div", ts_ns - F.pmod(ts_ns, width), width)


def latest_lines(
    lines: DataFrame, width_seconds: int = K.WINDOW_SECONDS, limit: int = K.WINDOW_LINE_LIMIT
) -> DataFrame:
    """The latest error lines of each window: (bucket, rn, ts_ns, line), rn 1 is the latest.

    Equal times keep their input order. The limit is on a rank, which Spark also applies
    before the shuffle, so a window with a third of all lines sends only ``limit`` rows
    per input partition.
    """
    w = Window.partitionBy("bucket").orderBy(F.desc("ts_ns"), F.asc("seq"))
    return error_lines(lines).select(
        bucket_of(F.col("ts_ns"), width_seconds).alias("bucket"), "ts_ns", "seq", "line",
    ).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def build_windows(
    lines: DataFrame, width_seconds: int = K.WINDOW_SECONDS, limit: int = K.WINDOW_LINE_LIMIT
) -> DataFrame:
    """(index, end_ns, samples, family) per window that has an error line.

    ``family`` is the most frequent one among the kept lines; a tie goes to the family met
    first, that is, with the latest line.
    """
    return numbered_windows(collect_windows(latest_lines(lines, width_seconds, limit), width_seconds))


def numbered_windows(windows: DataFrame) -> DataFrame:
    """(index, end_ns, samples, family): windows numbered in order of time."""
    counted = running_totals(windows, [F.col("bucket").asc()], {"upto": F.lit(1)}, [F.col("bucket")])
    return counted.select((F.col("upto") - 1).alias("index"), "end_ns", "samples", "family")


def collect_windows(latest: DataFrame, width_seconds: int) -> DataFrame:
    """(bucket, end_ns, samples, family) from the kept lines (bucket, rn, line)."""
    kept = latest.select(
        "bucket", "rn", X.normalize_line(F.col("line")).alias("shown"),
        X.line_family(F.col("line")).alias("family"))
    # every group has at most as many rows as lines were kept per window
    families = kept.groupBy("bucket", "family").agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"),
        F.collect_list(F.struct("rn", "shown")).alias("part"))
    windows = families.groupBy("bucket").agg(
        F.max(F.struct(F.col("n"), (-F.col("first_rn")).alias("m"), F.col("family"))).alias("top"),
        F.flatten(F.collect_list("part")).alias("shown"))
    return windows.select(
        "bucket", ((F.col("bucket") + 1) * F.lit(width_seconds * _NS)).alias("end_ns"),
        F.transform(F.array_sort("shown"), lambda x: x["shown"]).alias("samples"),
        F.col("top.family").alias("family"))


def last_rule_per_name(rules: DataFrame) -> DataFrame:
    """A repeated rule name keeps its last row."""
    return rules.groupBy("name").agg(
        F.max_by(F.struct("severity", "summary", "description"), "seq").alias("r")
    ).select("name", "r.*")


def render_rules(rules: DataFrame) -> DataFrame:
    """Rules with severity defaulted and template expressions filled in."""
    text = lambda c: X.render_rule(F.coalesce(F.col(c), F.lit("")))
    return last_rule_per_name(rules).select(
        "name", F.coalesce("severity", F.lit("warning")).alias("severity"),
        text("summary").alias("summary"), text("description").alias("description"))


def rule_pools(rules: DataFrame, related=None, unrelated=None) -> DataFrame:
    """(coarse, matched, pos, size, rule columns): which rules a log family may be paired
    with. Rules that are not loaded drop out before the positions are counted; ``coarse``
    is null for the pool any family draws negatives from."""
    related = K.RELATED_RULES if related is None else related
    unrelated = K.UNRELATED_RULES if unrelated is None else unrelated
    wanted = [(fam, True, i, n) for fam, names in related.items() for i, n in enumerate(names)]
    wanted += [("", False, i, n) for i, n in enumerate(unrelated)]
    spec = rules.sparkSession.createDataFrame(
        wanted, "coarse string, matched boolean, ord int, name string")
    w = Window.partitionBy("coarse", "matched")
    return spec.join(render_rules(rules), "name").select(
        "coarse", "matched", "name", "severity", "summary", "description",
        (F.row_number().over(w.orderBy("ord")) - 1).alias("pos"),
        F.count(F.lit(1)).over(w).alias("size"))


def to_scenarios(
    windows: DataFrame, rules: DataFrame, related=None, unrelated=None
) -> DataFrame:
    """Positive and negative scenarios per window.

    A negative gets a rule that touches no family, in rotation, and the verdict no. A
    positive gets a rule of its own family and stays without a verdict.
    """
    pools = F.broadcast(rule_pools(rules, related, unrelated))  # as many rows as pool entries
    w = windows.withColumn("coarse", X.coarse_family(F.col("family")))
    w = w.withColumn("want", F.explode(F.array(
        F.struct(F.col("coarse").alias("coarse"), F.lit(True).alias("matched")),
        F.struct(F.lit("").alias("coarse"), F.lit(False).alias("matched"))))).select(
        "index", "samples", "want.*")
    j = w.join(pools, ["coarse", "matched"]).filter(
        F.pmod(F.col("index"), F.col("size")) == F.col("pos"))
    sign = F.when(F.col("matched"), "pos").otherwise("neg")
    return j.select(
        F.format_string("replay-%s-%03d", sign, F.col("index")).alias("name"),
        F.lit("").alias("question"), F.lit("").alias("rubric"), F.lit("prod-replay").alias("source"),
        F.struct(
            F.col("name").alias("alertname"), F.col("severity"),
            F.format_string("replay-%s-%d", sign, F.col("index")).alias("fingerprint"),
            F.col("summary"), F.col("description"),
            F.create_map(F.lit("alertname"), F.col("name"), F.lit("severity"), F.col("severity"),
                         F.lit("job"), F.lit("prod-app")).alias("labels")).alias("alert"),
        F.col("samples").alias("log_samples"), F.lit("prod").alias("log_environment"),
        F.when(F.col("matched"), "").otherwise(K.NO).alias("expected"),
        "index", (~F.col("matched")).alias("negative"))
