"""Conversation prefix trie, by count-min screening of prefix digests.

A conversation's prefix of d turns has a digest: the sum of four 64-bit hashes of (place, turn)
over its turns. The digests are running sums, so a conversation of any length is spread over
partitions. A count-min sketch counts the digests of all prefixes. Counts are never too small, so
an estimate of one proves that a prefix belongs to one conversation alone: its node, and all
nodes below, are written out right there. Only prefixes with a larger estimate are shuffled and
grouped exactly.

Sums over subtrees need no walk. Each node is counted with its smallest member c, and a node
above it has c as a member too; so the sum over a node's subtree is the sum, over its members c,
of what c's own nodes at that depth or below hold: one running sum per conversation and one
grouping. Groupings are combined before the shuffle, the few most frequent prefixes are joined
by broadcast, and ids of ends are packed by sorted range before they meet.

Rebuilding: turns are ordered by ``turn``, null first, ties by a digest of role and text; null
role or text is empty. Conversation c becomes the first h turns of conversation c - c % 100 (all
if it has fewer, none if it is absent) and its own turns behind its first h, with h the unsigned
CRC-32 of its decimal id, modulo 6.

Defined cases: rows with a null conv_id belong to no conversation and are left out; repeated rows
are turns of their own; empty and very long texts are turns like any other; an empty table has
no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import share_by_key
from .common import discard, python_ready, written
from .running import running_sums

FAMILY = 100
MOST_SHARED = 5
#: Odd factors of the sketch's two rows, and the most cells a row may have (its bits: 8 MB).
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MOST_BITS = 26
#: Cells of a block of the sketch; ids packed into one row.
BLOCK_BITS = 14
PACKED = 4096
SUMMED_KEYS = 1 << 21

_KEY = ["k0", "k1", "k2", "k3"]
_PARENT = ["p0", "p1", "p2", "p3"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % (MOST_SHARED + 1)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) and (conv_id, depth, turn digest, points) of the rebuilt conversations;
    depth counts from 1, points are the code points of the turn's text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("points"), F.lit(1).cast("long").alias("place"))
    placed = written(running_sums(turns, "conv_id", [F.asc_nulls_first("turn"), F.col("digest")], ["place"])
                     .select("conv_id", "digest", "points", F.col("place_sum").alias("place")), "turns")
    first = placed.where(f"conv_id % {FAMILY} = 0 AND place <= {MOST_SHARED}").withColumnRenamed("conv_id", "top")
    held = first.groupBy("top").agg(F.max("place").alias("held"))
    convs = (placed.groupBy("conv_id").agg(F.max("place").alias("own"))
             .withColumns({"top": F.expr(f"conv_id - conv_id % {FAMILY}"), "h": _shared_turns(F.col("conv_id"))})
             .join(held, "top", "left")
             .withColumn("taken", F.least("h", F.coalesce("held", F.lit(0).cast("long"))))
             .withColumn("length", F.expr("taken + greatest(own - h, 0L)")))
    convs = written(convs.select("conv_id", "top", "h", "taken", "length"), "conversations")
    taken = convs.join(first, "top").where("place <= taken").select(
        "conv_id", F.col("place").alias("depth"), "digest", "points")
    own = placed.join(convs, "conv_id").where("place > h").select(
        "conv_id", F.expr("place - h + taken").alias("depth"), "digest", "points")
    return convs.select("conv_id", "length"), taken.unionByName(own)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation and depth from 0 on, in the shared folder: conv_id, depth, length,
    points, the prefix's digest k0..k3 and its parent's p0..p3."""
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "length", zero.alias("points"), *[zero.alias(f"h{i}") for i in range(4)])
    rows = turns.join(convs, "conv_id").select(
        "conv_id", "depth", "length", "points",
        *[F.xxhash64(F.lit(i), "depth", "digest").alias(f"h{i}") for i in range(4)])
    summed = running_sums(roots.unionByName(rows), "conv_id", [F.col("depth")], [f"h{i}" for i in range(4)])
    return written(summed.select(
        "conv_id", "depth", "length", "points", *[F.col(f"h{i}_sum").alias(k) for i, k in enumerate(_KEY)],
        *[F.col(f"h{i}_before").alias(p) for i, p in enumerate(_PARENT)]), "prefixes")


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(FACTORS[row])
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(FACTORS[1 - row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(keys: DataFrame, bits: int) -> DataFrame:
    """(sketch_row, block, counters): the count-min sketch of a one-column frame of longs, two rows
    of 2^bits counters that stop at 255. Workers sum their rows' cells first; a block is merged
    as a stream, so no task holds more than one of them."""
    block_bits = min(BLOCK_BITS, bits)
    size = 1 << block_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def packed():
            keys = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
            for row in range(len(FACTORS)):
                cells, counts = np.unique(_cells(keys, row, bits), return_counts=True)
                blocks, starts = np.unique(cells >> block_bits, return_index=True)
                for block, lo, hi in zip(blocks, starts, [*starts[1:], len(cells)]):
                    yield (row, int(block), (cells[lo:hi] & (size - 1)).astype("<u2").tobytes(),
                           np.minimum(counts[lo:hi], 255).astype(np.uint8).tobytes())

        def emitted():
            found = list(packed())
            for s in range(0, len(found), 1024):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*found[s:s + 1024]), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["sketch_row", "block", "cells", "counts"])

        for batch in batches:
            waiting.append(batch.column(0).to_numpy())
            n += batch.num_rows
            if n >= SUMMED_KEYS:
                yield from emitted()
                waiting, n = [], 0
        yield from emitted()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, np.zeros(size, np.int64)

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()),
                 pa.array([np.minimum(counters, 255).astype(np.uint8).tobytes()], pa.binary())],
                names=["sketch_row", "block", "counters"])

        for batch in batches:
            for row, block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (row, block) != now:
                    if now is not None:
                        yield done()
                    now, counters = (row, block), np.zeros(size, np.int64)
                counters[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, np.uint8)
        if now is not None:
            yield done()

    counted = keys.mapInArrow(count, "sketch_row int, block long, cells binary, counts binary")
    return (counted.repartition("sketch_row", "block").sortWithinPartitions("sketch_row", "block")
            .mapInArrow(merge, "sketch_row int, block long, counters binary"))


def _screened(rows: DataFrame, bits: int) -> DataFrame:
    """The rows with ``alone`` and ``parent_alone``: the estimate of the prefix, of its parent, is one.

    The driver gathers one bit per cell, "more than one": at most 2 * 2^MOST_BITS / 8 bytes.
    """
    spark = rows.sparkSession
    key, parent = F.xxhash64(*_KEY), F.xxhash64(*_PARENT)
    counts = sketch(rows.select(key.alias("key")), bits)
    size = 1 << min(BLOCK_BITS, bits)
    more = np.zeros((len(FACTORS), (1 << bits) // 8), np.uint8)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [np.packbits(np.frombuffer(c, np.uint8) > 1).tobytes() for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.binary())],
                                             names=["sketch_row", "block", "more"])

    for row in counts.mapInArrow(bits_of, "sketch_row int, block long, more binary").toLocalIterator():
        more[row["sketch_row"], row["block"] * size // 8:(row["block"] + 1) * size // 8] = np.frombuffer(row["more"], np.uint8)
    sent = spark.sparkContext.broadcast(more)
    columns, n_columns = rows.columns, len(rows.columns)

    def alone(keys: np.ndarray) -> np.ndarray:
        shared = np.ones(len(keys), bool)
        for row in range(len(FACTORS)):
            cell = _cells(keys, row, bits)
            shared &= (sent.value[row, cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
        return ~shared

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_columns], *[pa.array(alone(batch.column(n_columns + i).to_numpy())) for i in (0, 1)]],
                names=[*columns, "alone", "parent_alone"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select("*", key.alias("__key"), parent.alias("__parent")).mapInArrow(
        screen, f"{fields}, alone boolean, parent_alone boolean")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k0..k3, ends_sha256) of the ids (conv_id) that end at each prefix, in ascending order."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4).to_numpy()
            keys = np.stack([c.to_numpy() for c in batch.columns[:4]])
            fresh = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(ids) else np.zeros(0, bool)
            starts = np.flatnonzero(fresh)
            text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in keys], pa.array(ids[starts]), pa.array(text, pa.string())],
                                             names=[*_KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None

        def done():
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in now], pa.array([hashed.hexdigest()])],
                                              names=[*_KEY, "ends_sha256"])

        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if now is not None:
                        yield done()
                    now, hashed = key, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
        if now is not None:
            yield done()

    keys = "k0 long, k1 long, k2 long, k3 long"
    packed = (ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
              .mapInArrow(pack, f"{keys}, first long, ids string"))
    return packed.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, f"{keys}, ends_sha256 string")


def nodes(conversations: DataFrame, bits: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``bits``: log2 of the sketch's width, by default four cells per
    prefix and at most 2^MOST_BITS."""
    python_ready(conversations.sparkSession)
    paths = prefixes(*rebuilt(conversations))
    if bits is None:
        bits = min(MOST_BITS, max(10, (4 * paths.count()).bit_length()))
    rows = _screened(paths, bits)
    shared = written(rows.where("NOT alone").drop("alone", "parent_alone", *_PARENT), "shared")

    groups = written(shared.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"), F.max("length").alias("longest"),
        F.min_by("length", "conv_id").alias("rep_length"), F.min("points").alias("node_points"),
        F.min("depth").alias("node_depth")), "groups")
    placed = written(share_by_key(shared, groups.select(*_KEY, "n_convs", "rep", "longest"), _KEY, "n_convs"), "members")
    own = F.col("rep") == F.col("conv_id")
    # of each conversation the deepest node that has a smaller member: its own nodes begin below
    joins = written(placed.where(~own).groupBy("conv_id").agg(
        F.max_by(F.struct("depth", "length", "rep", *_KEY), "depth").alias("at")).select("conv_id", "at.*"), "joins")
    weighed = placed.select(
        "conv_id", "depth", *_KEY,
        F.when(own, (F.col("n_convs") - 1) * F.col("points")).otherwise(F.lit(0)).cast("long").alias("saved"),
        # a conversation that ends at a node which goes on, or which is not its own, adds no leaf
        F.when((F.col("depth") == F.col("length")) & ~(own & (F.col("longest") == F.col("depth"))), 1)
        .otherwise(0).cast("long").alias("dull"))
    sums = (running_sums(weighed, "conv_id", [F.desc("depth")], ["saved", "dull"]).groupBy(*_KEY)
            .agg(F.sum("saved_sum").alias("saved_tokens"), F.sum("dull_sum").alias("n_dull")))
    children = joins.where("length > depth").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("joined"))
    above = joins.select(F.col("conv_id").alias("rep"), F.expr("depth + 1").alias("node_depth"), F.col("rep").alias("above"))
    grouped = (groups.join(sums, _KEY).join(children, _KEY, "left")
               .join(_end_digests(shared.where("depth = length")), _KEY, "left")
               .join(above, ["rep", "node_depth"], "left")
               .select(F.col("rep").alias("conv_id"), F.col("node_depth").alias("depth"),
                       F.expr("if(node_depth = 0, null, coalesce(above, rep))").alias("parent_conv_id"), "n_convs",
                       F.expr("coalesce(joined, 0L) + if(rep_length > node_depth, 1L, 0L)").alias("n_children"),
                       F.expr("n_convs - n_dull").alias("n_leaves"), "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))

    single = rows.where("alone").select("conv_id", "depth", "length", "parent_alone")
    tops = single.where("NOT parent_alone").join(
        above.withColumnsRenamed({"rep": "conv_id", "node_depth": "depth"}), ["conv_id", "depth"], "left")
    inner = single.where("parent_alone").withColumn("above", F.lit(None).cast("long"))
    tails = tops.unionByName(inner).select(
        "conv_id", "depth", F.expr("if(depth = 0, null, coalesce(above, conv_id))").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.expr("if(depth < length, 1L, 0L)").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256))
        .otherwise(F.lit(_EMPTY)).alias("ends_sha256"))
    discard(placed)
    return grouped.unionByName(tails)


def oracle() -> str:
    """The nodes in DuckDB SQL; CRC-32 is spelt out bit by bit."""
    return """
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS top, list({'role': role, 'text': text} ORDER BY place) AS own,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
               lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295) % 6 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns
  FROM c LEFT JOIN c b ON b.conv_id = c.top),
p AS (
  SELECT conv_id, u.d, turns[1:u.d] AS path, len(turns) AS length
  FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) AS longest,
         CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS points,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = length), '')) AS ends_sha256
  FROM p GROUP BY path, d),
s AS (
  SELECT n.path[1:u.k] AS path, u.k AS d, count(*) FILTER (WHERE n.d = u.k + 1) AS n_children,
         count(*) FILTER (WHERE n.longest = n.d) AS n_leaves, sum((n_convs - 1) * points)::BIGINT AS saved_tokens
  FROM n, unnest(range(0, n.d + 1)) AS u(k) GROUP BY n.path[1:u.k], u.k)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.path = n.path AND s.d = n.d LEFT JOIN n up ON up.d = n.d - 1 AND up.path = n.path[1:n.d - 1]"""
