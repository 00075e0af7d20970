"""Ranks and running totals over a whole table without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import reused
from .prefilter import flag_possible

_HEX = 4  # 16^4 = 65,536 hash buckets


def hash_rank(df: DataFrame, key: Column, out: str, by: list[str] | None = None) -> DataFrame:
    """1-based rank in the order of ``md5(key)``, per group of ``by`` or over the whole table.

    Equal hashes (repeated keys) are told apart by nothing, so ``key`` should be unique.
    The first hex digits cut the table into 65,536 even buckets: counts per bucket are a
    small table, and each bucket is ranked on its own.
    """
    by = by or []
    hashed = df.withColumn("__h", F.md5(key)).withColumn("__b", F.substring("__h", 1, _HEX))
    counts = hashed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*by, "__b").orderBy("__h")
    ranked = hashed.withColumn("__rn", F.row_number().over(inside))
    joined = ranked.join(offsets, [*by, "__b"])
    return joined.withColumn(out, (F.col("__off") + F.col("__rn")).cast("long")).drop(
        "__h", "__b", "__off", "__rn")


def running_totals(
    df: DataFrame, order: list[Column], totals: dict[str, Column], places: list[Column] | None = None,
    buckets: int | None = None, overall: bool = False,
) -> DataFrame:
    """Running sums over the whole table in ``order`` (which must be a total order).

    ``places`` are numbers that rise along the order: the leading one and, where that repeats, the
    next one. A quantile sketch of each, merged from partial sketches, gives ``buckets`` bounds;
    rows are dealt once, by their bucket, and summed there; the sums of the buckets, a fixed number
    of rows, are broadcast and shift each bucket by those before it. A leading value that holds
    several buckets' share of the rows is dealt over them by the second place, so a tie of any
    size is no single task, and sums are exact wherever the bounds fall. Null places come first.

    Without numbers, ``places=None``, rows are sorted by range instead and kept in between.
    ``overall`` adds ``<name>_all``, the sum over all rows.
    """
    values = [c.alias(f"__v_{name}") for name, c in totals.items()]
    if places is None:
        placed = reused(df.select("*", *values).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    else:
        buckets = buckets or min(1024, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        named = [c.cast("double").alias(f"__p_{i}") for i, c in enumerate(places)]
        bounds = df.select(*named).agg(*[_bounds(f"__p_{i}", buckets).alias(f"__b_{i}") for i in range(len(places))])
        bound = [bounds.select(f"__b_{i}").scalar().alias(f"__b_{i}") for i in range(len(places))]
        placed = df.select("*", *values, *named, *bound)
        placed = placed.withColumn("__part", _bucket(len(places), buckets)).drop(
            *[f"__{k}_{i}" for k in "pb" for i in range(len(places))])
    per_part = placed.groupBy("__part").agg(
        *[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in totals])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_part.select(
        "__part",
        *[F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__o_{name}")
          for name in totals],
        *[F.sum(f"__s_{name}").over(Window.partitionBy()).alias(f"{name}_all") for name in totals if overall])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = placed.select(
        "*", *[F.sum(f"__v_{name}").over(inside).alias(f"__r_{name}") for name in totals])
    # one row per bucket or partition: bounded by their number, not by the data
    out = out.join(F.broadcast(shift), "__part")
    for name in totals:
        out = out.withColumn(name, F.col(f"__r_{name}") + F.col(f"__o_{name}"))
    return out.drop("__part", *[f"__{k}_{name}" for k in "vro" for name in totals])


def _bounds(place: str, buckets: int) -> Column:
    """``buckets - 1`` rising quantiles of a number; none without rows."""
    number = F.when(~F.isnan(place), F.col(place))
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    quantiles = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(number, F.lit(2000)), ranks)
    return F.when(F.count(number) > 0, F.array_sort(quantiles)).otherwise(F.array().cast("array<double>"))


def _bucket(places: int, buckets: int) -> Column:
    """Number of bounds below the leading place; for a place that is several bounds at once, as
    many more as the share of those bounds that its second place calls for."""
    low = _count_below("0", buckets, strict=True)
    if places == 1:
        return low
    same = _count_below("0", buckets, strict=False) - low
    share = _count_below("1", buckets, strict=True)
    return low + F.when(same > 1, F.floor(share * same / F.lit(buckets)).cast("int")).otherwise(F.lit(0))


def _count_below(place: str, buckets: int, strict: bool) -> Column:
    """How many of the place's sorted bounds are below it (or equal to it); 0 for null."""
    bounds, value = F.col(f"__b_{place}"), F.col(f"__p_{place}")
    steps, step = [], 1 << (max(buckets - 1, 1).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1

    def walk(found: Column, step: Column) -> Column:
        bound = F.get(bounds, found + step - 1)
        below = (bound < value) if strict else (bound <= value)
        return found + F.when(below, step).otherwise(F.lit(0))

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), walk)


def share_by_key(
    rows: DataFrame, summary: DataFrame, keys: list[str], count: str, hot: int = 1000, sparse: bool = False,
) -> DataFrame:
    """Left-join one summary row per key back onto the rows when few keys may be huge.

    The ``hot`` most frequent keys (a fixed number of rows) are broadcast. Their rows, and rows with
    a null key, which match nothing, are done there and reach no exchange; any other key holds less
    than 1/``hot`` of the table and goes through an ordinary join. Both parts read ``rows``: what is
    costly to make should lie behind a shuffle or a table, which they share. ``sparse`` says that
    most keys have no summary: a Bloom prefilter then keeps their rows out of the join, too.
    """
    values = [c for c in summary.columns if c not in keys]
    top = summary.orderBy(F.desc(count), *keys).limit(hot)
    top = top.select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__served"))
    step = rows.join(F.broadcast(top), keys, "left")
    served = F.coalesce(F.col("__served"), F.lit(False))
    for k in keys:
        served = served | F.col(k).isNull()
    if sparse:
        step = flag_possible(step, summary, keys, "__possible")
        served = served | ~F.col("__possible")
    done = step.where(served).select(*rows.columns, *[F.col(f"__hot_{c}").alias(c) for c in values])
    rest = step.where(~served).select(*rows.columns).join(summary, keys, "left").select(*rows.columns, *values)
    return done.unionByName(rest)
