"""Connected components of an edge table by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    Every round points each node's larger neighbours, then each node's smaller ones, at its
    smallest neighbour. Minima are combined map-side, and a hub's neighbours only meet its
    minimum in a join that adaptive execution can split. Each round is written to the shared
    folder and the one before is deleted; a round that changes nothing ends the loop.
    """
    pairs = written(_undirected(edges), "edges")
    before = None
    for _ in range(most_rounds):
        last, pairs = pairs, written(_star(_star(pairs, larger=True), larger=False), "edges")
        discard(last)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    tops = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(tops)


def _undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a > b."""
    return (edges.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """``larger``: every node u points its larger neighbours at its smallest neighbour or itself.
    Otherwise it points its smaller neighbours and itself at its smallest neighbour."""
    down = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    around = down.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))) if larger else down
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger:
        up = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        out = up.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = (down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return out.where("a <> b").distinct()
