"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint is cut into 32 segments of two bits; its embedding is the vector of set bits per
segment. Flipping one bit moves one coordinate by one, so the Manhattan distance of two
embeddings is never above the Hamming distance of the fingerprints. Kept in unary code (a
segment's bits sorted), the Manhattan distance is itself a bit count of an exclusive or.

Range join: the segments form eight groups. Two points at Manhattan distance at most ``bits``
differ in at most ``bits`` groups, so they agree on all coordinates of at least
``8 - bits`` groups. Every point enters one grid cell for each choice of that many groups (70
for four bits); points that share a cell are compared, first by Manhattan distance, then
exactly. Cells that hold more than ``dense`` points are not compared pairwise: each of their
points meets the others through the fingerprints within half the radius around it, which finds
the same links at a cost in proportion to the points. Inside a cell links are reduced to
a spanning forest before they leave the task, so a large group never emits all its pairs.

Defined cases: null text counts as empty; texts without a word have fingerprint zero and link
like any other; equal fingerprints are one point, so exact copies and repeated rows cost one;
component_id is the smallest non-null id reachable, null only if all ids of the component are
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .common import python_ready, text_of, written
from .components import components

WORDS = 4
BITS = 4
GROUPS = 8
#: Points of one cell that are compared pairwise; denser cells go by their neighbourhoods.
DENSE = 8192
_SEED = 42
_BLOCK = 1024
_LOW = 0x5555555555555555


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats counted; as a signed integer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    step = min(words, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts, ends[step:])),
                         dtype=np.uint64, count=len(parts) - step)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.unpackbits(hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8),
                              axis=1, bitorder="little")
        counts += block.sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[Column | str], name: str = "fingerprint",
                 words: int = WORDS) -> DataFrame:
    """``keep`` and the fingerprint of each document as a long."""
    python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.select(*keep, hashed(text_of()).alias(name))


def _embedding(point: Column) -> Column:
    """Set bits per two-bit segment, in unary code: the segment's bits in order."""
    low = F.lit(_LOW)
    high = F.shiftrightunsigned(point, 1)
    either = point.bitwiseOR(high).bitwiseAND(low)
    both = point.bitwiseAND(high).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def embedded(points: np.ndarray) -> np.ndarray:
    """The same embedding of a uint64 array."""
    low = np.uint64(_LOW)
    high = points >> np.uint64(1)
    return ((points | high) & low) | ((points & high & low) << np.uint64(1))


def _masks(bits: int) -> list[int]:
    """One mask for each choice of groups that points within ``bits`` may agree on."""
    if not 0 <= bits < GROUPS:
        raise ValueError(f"bits must be below {GROUPS}")
    masks = []
    for groups in combinations(range(GROUPS), GROUPS - bits):
        mask = sum(0xFF << (8 * g) for g in groups)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links within ``bits`` among distinct uint64 points.

    Grows each tree from its first point: the frontier, in blocks, is compared with all points
    not yet reached, and each reached point brings one link.
    """
    codes = embedded(points)
    left = np.arange(len(points))
    tails, heads = [], []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:_BLOCK], frontier[_BLOCK:]
            near = np.bitwise_count(codes[now, None] ^ codes[None, left]) <= bits
            if near.any():
                near &= np.bitwise_count(points[now, None] ^ points[None, left]) <= bits
                hit = near.any(axis=0)
                tails.append(now[near.argmax(axis=0)[hit]])
                heads.append(left[hit])
                frontier = np.concatenate((frontier, left[hit]))
                left = left[~hit]
    if not tails:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(tails), np.concatenate(heads)


def links(points: DataFrame, bits: int = BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) among distinct ``fingerprint`` values; equal closure to all links within ``bits``."""
    code = _embedding(F.col("fingerprint"))
    masks = F.array(*[F.lit(m) for m in _masks(bits)])
    cells = points.select("fingerprint", F.posexplode(F.transform(masks, code.bitwiseAND)).alias("choice", "corner"))
    cells = cells.select(F.xxhash64("choice", "corner").alias("cell"), "fingerprint")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "fingerprint")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        kept = 0
        for values in _cells(batches, dense):
            if isinstance(values, tuple):                    # part of a dense cell
                a.append(values[0])
                b.append(values[0])
            else:
                left, right = _forest(values.view(np.uint64), bits)
                if not len(left):
                    continue
                a.append(values[left])
                b.append(values[right])
            kept += len(a[-1])
            if kept > 50_000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
                a, b, kept = [], [], 0
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    found = written(dealt.mapInPandas(compare, "a long, b long"), "links")
    # points of dense cells, once each, marked by a link to themselves
    crowd = found.where("a = b").select("a").distinct()
    return found.where("a <> b").distinct().unionByName(_by_neighbourhood(crowd, bits)) if bits else found.where("a <> b")


def _cells(batches: Iterator[pd.DataFrame], dense: int) -> Iterator:
    """Sorted distinct points of each cell with at least two; a dense cell comes in parts, each
    as a one-tuple, so no task holds more than ``dense`` points and a batch."""
    cell, held, over = None, [], False

    def out():
        if held and not over:
            values = np.concatenate(held)
            if len(values) > 1:
                yield values

    size = 0
    for rows in batches:
        keys, points = rows["cell"].to_numpy(), rows["fingerprint"].to_numpy()
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = np.concatenate(([0], cuts, [len(keys)]))
        # single points between two cuts have no partner
        for k, (start, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            inside = 0 < k < len(edges) - 2
            if inside and end - start == 1:
                continue
            if cell is None or keys[start] != cell:
                yield from out()
                cell, held, over, size = keys[start], [], False, 0
            held.append(points[start:end])
            size += end - start
            if over or size > dense:
                over = True
                for part in held:
                    yield (part,)
                held = []
    yield from out()


def _by_neighbourhood(points: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) among points ``a``: two points within ``bits`` share a fingerprint that is
    within half of it, rounded up and down, of each; all that share one point at the smallest."""
    near, far = bits // 2, bits - bits // 2
    flips = [sum(1 << i for i in chosen) for size in range(far + 1) for chosen in combinations(range(64), size)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    # a fixed number of flips, 2,081 for four bits
    met = points.select(F.explode(F.lit(signed)).alias("flip"), "a").select(
        F.col("a").bitwiseXOR(F.col("flip")).alias("at"), "a")
    if near == far:
        least = met.groupBy("at").agg(F.min("a").alias("b"))
        return met.join(least, "at").where("a <> b").select("a", "b").distinct()
    # an odd distance splits into a near and a far side: those on the near side of a shared
    # fingerprint link to its smallest point on the far side, and the other way round
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("at"))) <= near
    least = met.groupBy("at").agg(F.min("a").alias("any"), F.min(F.when(close, F.col("a"))).alias("nearest"))
    both = met.join(least, "at")
    return both.where("nearest IS NOT NULL AND a <> nearest").select("a", F.col("nearest").alias("b")).unionByName(
        both.where(close & (F.col("a") != F.col("any"))).select("a", F.col("any").alias("b"))).distinct()


def _linked(found: DataFrame, bits: int, dense: int) -> DataFrame:
    """(fingerprint, root, component_id) of fingerprints: the least one of their component and the
    least id of it.

    ``found``: doc_id, fingerprint. Fingerprints without a link keep their own smallest id.
    """
    points = found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    points = written(points, "points")
    roots = written(components(links(points.select("fingerprint"), bits, dense)), "roots")
    named = points.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = WORDS, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint as 16 hex digits, component_id."""
    found = written(fingerprints(docs, ["doc_id"], words=words), "fingerprints")
    named = _linked(found, bits, dense)
    return found.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = BITS, words: int = WORDS, dense: int = DENSE) -> DataFrame:
    """The documents with one of each near-duplicate group: the row of the smallest id, and among
    rows of that id the one of the smallest text digest; of rows equal in both one. Own columns only.

    Only rows in a Bloom bitmap of the others, or of rows that stand there twice, are shuffled.
    """
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()), 256)
    found = written(fingerprints(docs, ["doc_id", row.alias("row")], words=words), "fingerprints")
    named = _linked(found, bits, dense)
    # a group is told by its root, as one id may stand in several groups
    placed = written(found.join(named, "fingerprint").select("doc_id", "row", "root"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stays = placed.groupBy("root").agg(first).select("root", F.col("first.row").alias("stay"))
    leaves = placed.join(stays, "root").where("row <> stay").select(F.col("row").alias("__leaves"))
    leaves = written(leaves, "leaves")
    gone = bloom.members(leaves, F.col("__leaves"), 5)
    twice = bloom.repeated(placed.select("row"), F.col("row"), 7)
    marked = bloom.probe(docs.withColumn("__row", row), gone, F.col("__row"), 5, "__near_hit")
    marked = bloom.probe(marked, twice, F.col("__row"), 7, "__twice_hit")
    own, hit = [F.col(f"`{c}`") for c in docs.columns], F.col("__near_hit") | F.col("__twice_hit")
    maybe = marked.where(hit).join(leaves, F.col("__row") == F.col("__leaves"), "left_anti")
    # equal rows are reduced map-side to one of them
    once = maybe.groupBy("__row").agg(F.any_value(F.struct(*own)).alias("__one")).select("__one.*")
    return marked.where(~hit).select(*own).unionByName(once)
