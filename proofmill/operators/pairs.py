"""Contrast pairs: two candidates named ``<base>-a`` and ``<base>-b``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as K
from ..functions import text as X
from ..functions.stage import once


def pair_base(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, X.rx(K.PAIR_NAME), 1), F.lit(""))


def pair_side(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, X.rx(K.PAIR_NAME), 2), F.lit(""))


def _sides(candidates: DataFrame) -> DataFrame:
    """One row per base with what both sides need to be compared by.

    Log and text columns travel as digests, so that the grouping moves a fixed number of
    bytes per candidate. A repeated side keeps its last row.
    """
    lines = F.col("log_samples")
    digest = lambda value: F.sha2(F.to_json(F.struct(value.alias("v"))), 256)
    named = candidates.select("*", pair_base(F.col("name")).alias("base"),
                              pair_side(F.col("name")).alias("side"))
    facts = once(named.filter(F.col("base").isNotNull()), v=F.struct(
            F.size(lines).alias("n_lines"),
            digest(lines).alias("logs"),
            digest(F.transform(lines, X.without_stamp)).alias("skeleton"),
            X.span_minutes(lines).alias("span"),
            F.col("expected"),
            digest(F.struct(F.col("alert.summary"), F.col("alert.description"))).alias("text"),
            F.col("log_environment").alias("env"),
        )).select("base", "side", "seq", "v")
    side = lambda s: F.max_by(F.when(F.col("side") == s, F.col("v")),
                              F.when(F.col("side") == s, F.col("seq")))
    return facts.groupBy("base").agg(side("a").alias("a"), side("b").alias("b"))


def _missing(row_a: Column, row_b: Column) -> Column:
    return row_a.isNull() | row_b.isNull()


def contrast_pairs(candidates: DataFrame) -> DataFrame:
    """(base, reason) per problem of a pair that keeps its logs and changes its alert."""
    a, b = F.col("a"), F.col("b")
    loose = F.array_compact(F.array(
        F.when(a["expected"].eqNullSafe(b["expected"]), "same_verdict"),
        F.when(a["text"] == b["text"], "same_alert_text"),
        F.when(~a["env"].eqNullSafe(b["env"]), "other_environment")))
    reasons = (
        F.when(_missing(a, b), F.array(F.lit("missing_side")))
        .when(a["logs"] != b["logs"], F.array(F.lit("logs_differ")))
        .otherwise(loose))
    return _sides(candidates).select("base", F.explode(reasons).alias("reason"))


def temporal_pairs(
    candidates: DataFrame, tight: float = K.TIGHT_MINUTES, spread: float = K.SPREAD_MINUTES
) -> DataFrame:
    """(base, reason) per problem of a pair that only changes its timestamps."""
    a, b = F.col("a"), F.col("b")
    a_yes = F.coalesce(a["expected"] == K.YES, F.lit(False))
    yes_span = F.when(a_yes, a["span"]).otherwise(b["span"])
    no_span = F.when(a_yes, b["span"]).otherwise(a["span"])
    reasons = (
        F.when(_missing(a, b), F.array(F.lit("missing_side")))
        .when(a["n_lines"] != b["n_lines"], F.array(F.lit("line_count_differs")))
        .when(a["skeleton"] != b["skeleton"], F.array(F.lit("content_differs")))
        .when(a["expected"].eqNullSafe(b["expected"]), F.array(F.lit("same_verdict")))
        .when(yes_span.isNull() | no_span.isNull(), F.array(F.lit("no_timestamps")))
        .otherwise(F.array_compact(F.array(
            F.when(yes_span > tight, "yes_side_spread"),
            F.when(no_span < spread, "no_side_tight")))))
    return _sides(candidates).select("base", F.explode(reasons).alias("reason"))


def paired_names(candidates: DataFrame) -> DataFrame:
    """Names of candidates in a sound contrast pair."""
    bad = contrast_pairs(candidates).select("base").distinct()
    named = candidates.select("name", pair_base(F.col("name")).alias("base"))
    return named.filter(F.col("base").isNotNull()).join(bad, "base", "left_anti").select(
        "name").distinct()
