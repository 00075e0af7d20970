"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A vector's code is the signs of its principal components after a rotation learned to lose
little by rounding (iterative quantisation), on a bounded sample. The code is cut into eight
substrings of eight bits and every row is indexed under each. By the pigeonhole principle a
code within Hamming radius ``8 q + a`` differs by at most ``q`` bits in one of the first
``a + 1`` substrings, or by at most ``q - 1`` in another, so probing the keys within those
distances retrieves every code in the radius. What is retrieved is checked for the exact
radius and reranked by cosine in double precision.

Each query has its own radius. A pilot of a bounded sample of rows gives five rows that are
near; the radius takes in their codes, and ``SPREAD`` standard deviations beyond the distance
to be expected at the fifth's cosine, so the true neighbours, which are nearer still, are very
likely inside and five rows always are.

Rows of one vector are one point that carries its smallest ids, as many as can ever be
returned. Buckets above the mean size, or ``MOST_BUCKET`` rows, are dealt into parts that meet
the bucket's probes separately, so a hot bucket is never one task. Counts of the 2,048 buckets
are the only thing that comes to the driver, beside the sample.

Defined cases: null vectors, and those that are zero or hold a null or non-finite component,
take no part, nor do vectors whose length is not the table's most frequent one (the larger of
equally frequent ones); rows with a null id cannot be returned or asked for; of rows that repeat
an id only one vector counts, the largest in array order; a query never finds its own id; ties
in score go to the smaller id; a table with fewer than six rows gives what there is; an empty
table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import python_ready, runs, written

NEAREST = 5
BITS = 64
PARTS = 8
KEY_BITS = BITS // PARTS
#: Rows that the rotation is learned on, and that serve as pilot.
SAMPLE = 4096
SPREAD = 1.5
#: Rows of a bucket that one part may hold, at least and at most.
LEAST_BUCKET, MOST_BUCKET = 256, 65_536
#: Probes compared with a bucket part at once.
_BLOCK = 512
_MASKS = [[sum(1 << i for i in c) for size in range(d + 1) for c in combinations(range(KEY_BITS), size)]
          for d in range(KEY_BITS + 1)]


@dataclass(frozen=True)
class Codes:
    """The learned projection, and the pilot rows with their codes."""

    project: np.ndarray
    pilot: np.ndarray         # of length one
    pilot_ids: np.ndarray
    pilot_codes: np.ndarray

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, as uint64."""
        bits = np.packbits(vectors @ self.project > 0, axis=1, bitorder="little")
        return bits.view("<u8").reshape(-1).astype(np.uint64)

    def radii(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, nearest: int, spread: float) -> np.ndarray:
        """The radius of each query; all bits where the pilot holds too few other rows."""
        out = np.full(len(ids), BITS)
        k = min(nearest, len(self.pilot_ids))
        for at in range(0, len(ids) if k else 0, _BLOCK):
            cosines = vectors[at:at + _BLOCK] @ self.pilot.T
            cosines[ids[at:at + _BLOCK, None] == self.pilot_ids[None]] = -2
            top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(cosines, top, axis=1)
            reach = np.bitwise_count(codes[at:at + _BLOCK, None] ^ self.pilot_codes[top]).max(axis=1)
            share = np.arccos(np.clip(best.min(axis=1), -1, 1)) / math.pi
            expected = BITS * share + spread * np.sqrt(BITS * share * (1 - share))
            radius = np.minimum(np.maximum(reach, np.ceil(expected)), BITS).astype(int)
            out[at:at + _BLOCK] = np.where((best > -1.5).sum(axis=1) < nearest, BITS, radius)
        return out


def learn(ids: np.ndarray, vectors: np.ndarray, rounds: int = 30) -> Codes:
    """Principal directions, then a rotation that brings the components near their signs."""
    n, d = vectors.shape
    k = min(d, BITS)
    values, directions = np.linalg.eigh(vectors.T @ vectors)
    directions = directions[:, np.argsort(-values)[:k]]
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(BITS, BITS)))[0][:k]
    low = vectors @ directions
    if n >= BITS:
        for _ in range(rounds):
            left, _, right = np.linalg.svd(low.T @ np.sign(low @ rotation), full_matrices=False)
            rotation = left @ right
    model = Codes(directions @ rotation, vectors, ids, np.empty(0, np.uint64))
    return Codes(model.project, vectors, ids, model.of(vectors))


def reaches(radius: int) -> list[int]:
    """Distance to probe in each substring: -1 for none, so that every code within is met."""
    if radius >= BITS:
        return [KEY_BITS] + [-1] * (PARTS - 1)          # one substring's keys are all the rows
    q, a = divmod(radius, PARTS)
    return [q] * (a + 1) + [q - 1] * (PARTS - a - 1)


def _usable(rows: DataFrame) -> DataFrame:
    """(id, v) with one valid vector of the usual length for each id."""
    v = F.col("embedding").cast("array<double>")
    plain = rows.select(F.col("vec_id").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0))
    return plain.groupBy("id").agg(F.max("v").alias("v"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)     # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def search(rows: DataFrame, every: int = 50, nearest: int = NEAREST, sample: int = SAMPLE,
           spread: float = SPREAD) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    python_ready(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = written(_usable(rows).withColumn("d", F.size("v")), "vectors")
    sizes = valid.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return empty
    valid = valid.where(F.col("d") == sizes[0]["d"]).select("id", "v")
    chance = min(1.0, sample / sizes[0]["count"])
    place = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 32)) / float(1 << 32)
    picked = sorted(valid.where(place < chance).collect(), key=lambda r: r["id"])
    if not picked:
        picked = valid.orderBy("id").limit(1).collect()
    codes = learn(np.array([r["id"] for r in picked]), _unit(np.array([r["v"] for r in picked])))
    shared = spark.sparkContext.broadcast(codes)

    # one point per vector with the smallest ids that can be returned, one of which may be the query's
    order = Window.partitionBy("v").orderBy("id")
    points = (valid.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest + 1)
              .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))

    @F.pandas_udf("struct<code:long,vector:binary>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            if not len(vs):
                yield pd.DataFrame({"code": pd.Series([], dtype="int64"), "vector": pd.Series([], dtype=object)})
                continue
            own = np.array(vs.tolist(), dtype=np.float64)
            yield pd.DataFrame({"code": shared.value.of(_unit(own)).view(np.int64),
                                "vector": [v.tobytes() for v in own]})

    @F.pandas_udf("struct<code:long,vector:binary,radius:int>")
    def ask(ids: pd.Series, vs: pd.Series) -> pd.DataFrame:
        own = np.array(vs.tolist(), dtype=np.float64).reshape(len(ids), -1)
        if not len(ids):
            return pd.DataFrame({"code": pd.Series([], dtype="int64"), "vector": pd.Series([], dtype=object),
                                 "radius": pd.Series([], dtype="int32")})
        unit = _unit(own)
        code = shared.value.of(unit)
        return pd.DataFrame({"code": code.view(np.int64), "vector": [v.tobytes() for v in own],
                             "radius": shared.value.radii(ids.to_numpy(), unit, code, nearest, spread).astype("int32")})

    index = written(points.select("ids", encode("v").alias("e")).select("ids", "e.code", "e.vector"), "index")
    queries = written(valid.where(F.col("id") % every == 0).select("id", ask("id", "v").alias("e"))
                      .select("id", "e.code", "e.vector", "e.radius"), "queries")

    # bucket number = substring * 256 + key
    key = lambda j: F.lit(j << KEY_BITS) + F.shiftrightunsigned("code", j * KEY_BITS).bitwiseAND((1 << KEY_BITS) - 1)
    placed = index.select("ids", "code", "vector", F.explode(F.array(*[key(j) for j in range(PARTS)])).alias("bucket"))
    counts = dict(placed.groupBy("bucket").count().collect())
    mean = sum(counts.values()) / max(1, len(counts))
    unit = int(np.clip(mean, LEAST_BUCKET, MOST_BUCKET))
    parts = {int(b): -(-n // unit) for b, n in counts.items()}
    part_count = F.element_at(F.lit([parts.get(b, 0) for b in range(PARTS << KEY_BITS)]), (F.col("bucket") + 1).cast("int"))
    entries = placed.select(
        "bucket", F.pmod(F.xxhash64("vector"), part_count).alias("part"), F.lit(0).alias("side"),
        F.lit(None).cast("long").alias("id"), "ids", "code", "vector", F.lit(0).alias("radius"))

    @F.pandas_udf("array<long>")
    def probes(code: pd.Series, radius: pd.Series) -> pd.Series:
        out = []
        for c, r in zip(code.to_numpy().view(np.uint64).tolist(), radius):
            out.append([(j << KEY_BITS) + ((c >> (j * KEY_BITS) & ((1 << KEY_BITS) - 1)) ^ mask)
                        for j, reach in enumerate(reaches(int(r))) if reach >= 0 for mask in _MASKS[reach]])
        return pd.Series(out)

    asked = (queries.withColumn("bucket", F.explode(probes("code", "radius"))).where(part_count > 0)
             .select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), part_count - 1)).alias("part"), F.lit(1).alias("side"),
                     "id", F.lit(None).cast("array<long>").alias("ids"), "code", "vector", "radius"))
    dealt = (entries.unionByName(asked).withColumn("group", F.xxhash64("bucket", "part"))
             .repartition("group").sortWithinPartitions("group", "bucket", "part", "side"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def keyed() -> Iterator[pd.DataFrame]:
            for rows in batches:
                rows["place"] = list(zip(rows["bucket"], rows["part"]))
                yield rows
        for own in runs(keyed(), "place"):
            is_query = own["side"].to_numpy() == 1
            if is_query.all() or not is_query.any():
                continue
            yield _best(own[~is_query], own[is_query], int(own["bucket"].iat[0]) >> KEY_BITS, nearest)

    found = dealt.mapInPandas(compare, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score")


def _best(entries: pd.DataFrame, asked: pd.DataFrame, part: int, nearest: int) -> pd.DataFrame:
    """The nearest rows of one bucket part for each of its probes, among codes within the radius
    that no earlier substring's probes meet."""
    vectors = np.frombuffer(b"".join(entries["vector"]), np.float64).reshape(len(entries), -1)
    units, codes = _unit(vectors), entries["code"].to_numpy().view(np.uint64)
    id_lists = entries["ids"].tolist()
    owner = np.repeat(np.arange(len(entries)), [len(i) for i in id_lists])
    ids = np.concatenate([np.asarray(i, dtype=np.int64) for i in id_lists])
    out = []
    byte = np.uint64((1 << KEY_BITS) - 1)
    for at in range(0, len(asked), _BLOCK):
        own = asked.iloc[at:at + _BLOCK]
        code, radius = own["code"].to_numpy().view(np.uint64), own["radius"].to_numpy()
        reach = np.array([reaches(int(r)) for r in radius])
        differ = code[:, None] ^ codes[None]
        inside = np.bitwise_count(differ) <= radius[:, None]
        for j in range(part):
            inside &= np.bitwise_count(differ >> np.uint64(j * KEY_BITS) & byte).astype(int) > reach[:, j, None]
        some = np.flatnonzero(inside.any(axis=1))
        if not len(some):
            continue
        mine = _unit(np.frombuffer(b"".join(own["vector"].iloc[some]), np.float64).reshape(len(some), -1))
        rough = np.where(inside[some], mine @ units.T, -np.inf)
        for q, row in zip(some, rough):
            query = int(own["id"].iat[q])
            score, allowed = row[owner], ids != query
            score = np.where(allowed, score, -np.inf)
            k = min(nearest, len(score))
            # all that may tie with the k-th, to the last digits, then the exact order
            near = np.flatnonzero((score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-12) & np.isfinite(score))
            if len(near):
                exact = _cosines(own["vector"].iat[q], entries["vector"].to_numpy()[owner[near]])
                first = np.lexsort((ids[near], -exact))[:nearest]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][first], "score": exact[first]}))
    columns = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)}
    return pd.concat(out) if out else pd.DataFrame(columns)


def _cosines(query: bytes, rows: np.ndarray) -> np.ndarray:
    """Cosines of single pairs, each by the same operations wherever and among whatever it is met."""
    q = np.frombuffer(query, np.float64)
    own = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    q, own = q / np.abs(q).max(), own / np.abs(own).max(axis=1, keepdims=True)
    total = np.add.reduce(own * q, axis=1)
    return np.clip(total / (np.sqrt(np.add.reduce(own * own, axis=1)) * math.sqrt(np.add.reduce(q * q))), -1, 1)
