"""Repeated byte strings, removed by a hash-compared suffix sort.

A byte goes if a string of ``WINDOW`` bytes around it also starts earlier in the corpus. Three
steps find those strings.

Cutting: each window has a key, the least mixed hash among its ``GRAM``-byte strings. Equal
windows have equal keys, and neighbouring windows mostly share theirs, so a text falls into
segments of windows with one key. Keys are counted over the corpus; a fixed Bloom bitmap of the
repeated ones leaves the segments whose windows may repeat. Only those are shuffled, by key.

Sorting: within a key the suffixes at all window starts are sorted. They are dealt by their first
eight bytes, then merge-sorted; two suffixes are compared through prefix polynomial hashes, a
binary search for their common extension and the byte behind it. Neighbours that agree on
``WINDOW`` bytes are repeats of the earliest of them. The order is then verified byte by byte; had
a collision of hashes disturbed it, the sort is done again under another base.

Skew: equal segments are reduced to the earliest before they move, and the others' bytes are
marked right there. A key with more than ``HOT`` segments left is reduced again by grouping, and if
it is still large, cut anew with a longer gram, up to whole windows, where only equal ones meet.

Defined cases: null text is empty; documents are ordered by doc_id, null first, then by a hash of
their text; rows equal in both are one document and have one result; texts shorter than a window
lose nothing; matches never cross documents; very long texts are cut into overlapping pieces; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import share_by_key
from . import bloom
from .common import python_ready, text_of, written

WINDOW = 100
#: Bytes of the strings whose least hash is a window's key, from the first cut to the last.
GRAMS = (32, 66, 84, 100)
#: Most segments of a key that one task sorts, and most hot keys that are broadcast.
HOT = 4096
MOST_BROADCAST = 1 << 16
#: Bytes worked on at a time, in whole texts or pieces of them.
PORTION = 1 << 20
SORTED_BYTES = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)

_ROW = "m long, id long, tie long, start long, n int, bytes binary"
_NAMES = ["m", "id", "tie", "start", "n", "bytes"]


class Hashes:
    """Prefix polynomial hashes modulo 2^64 of a byte string, with room behind its end."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: bytes, base: int = BASES[0]):
        self.size = len(data)
        self.data = np.frombuffer(data + bytes(2 * WINDOW), np.uint8)
        self.power, self.inverse = self._table(base, len(self.data) + 1)
        letters = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        letters = (letters ^ (letters >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(letters[self.data] * self.power[:len(self.data)], out=self.prefix[1:])

    @classmethod
    def _table(cls, base: int, size: int):
        if base not in cls._powers or len(cls._powers[base][0]) < size:
            size = max(size, PORTION + 3 * WINDOW)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            cls._powers[base] = tuple(both)
        return cls._powers[base]

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def grams(self, k: int, count: int) -> np.ndarray:
        """Mixed hashes of the k-byte strings at the first ``count`` places."""
        h = (self.prefix[k:k + count] - self.prefix[:count]) * self.inverse[:count]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at x and y share, at most WINDOW: a binary search by hashes."""
        px, py, wx, wy = self.prefix[x], self.prefix[y], self.power[y], self.power[x]
        length = np.zeros(len(x), np.int64)
        step = 64
        while step:
            longer = length + step
            equal = (self.prefix[x + longer] - px) * wx == (self.prefix[y + longer] - py) * wy
            length = np.where(equal & (longer <= WINDOW), longer, length)
            step >>= 1
        return length

    def equal_bytes(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the byte strings at x and y are equal; compared byte by byte."""
        out = np.ones(len(x), bool)
        for lo in range(0, len(x), 4096):
            n = length[lo:lo + 4096]
            ends = np.cumsum(n)
            inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
            differs = (self.data[np.repeat(x[lo:lo + 4096], n) + inside] != self.data[np.repeat(y[lo:lo + 4096], n) + inside])
            out[lo:lo + 4096] = np.add.reduceat(differs, ends - n) == 0
        return out


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``counts`` numbers of each."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def cut(hashes: Hashes, starts: np.ndarray, ends: np.ndarray, k: int):
    """(start, windows, key, inner) of the segments of the pieces [starts, ends) of a byte string;
    ``inner``: two windows of the segment may be equal. A segment has at most WINDOW - k + 1
    windows, as many as hold one k-byte string."""
    count, most = hashes.size - WINDOW + 1, WINDOW - k + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = hashes.grams(k, hashes.size - k + 1)
    least, span = grams, 1
    while 2 * span <= most:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < most:
        least = np.minimum(least[:len(least) - (most - span)], least[most - span:])
    edge = np.zeros(hashes.size + 1, np.int32)
    whole = ends - starts >= WINDOW
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - WINDOW + 1, -1)
    valid = np.cumsum(edge[:count]) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | fresh[1:]
    start, windows = np.flatnonzero(fresh), np.flatnonzero(stop) - np.flatnonzero(fresh) + 1
    parts = -(-windows // most)
    nth = _ragged(np.zeros(len(parts), np.int64), parts)
    windows = np.minimum(most, np.repeat(windows, parts) - nth * most)
    start = np.repeat(start, parts) + nth * most
    return start, windows, least[start], repeating(grams, start, windows, most)


def repeating(grams: np.ndarray, start: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Segments in which two windows may be equal. Those are less than ``most`` apart, and so are
    their equal grams at ``most`` places in a row, one of which is a multiple of ``most``."""
    at = np.arange(0, len(grams), most)
    seen = np.zeros(len(at), bool)
    for apart in range(1, most):
        inside = np.searchsorted(at, len(grams) - apart)
        seen[:inside] |= grams[at[:inside]] == grams[at[:inside] + apart]
    before = np.concatenate(([0], np.cumsum(seen)))
    return before[np.minimum((start + windows + most - 2) // most + 1, len(at))] > before[-(-start // most)]


def ranks(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Places of documents in their order; equal ones share a place."""
    order = np.lexsort((ties, ids))
    fresh = np.concatenate(([0], (ids[order][1:] != ids[order][:-1]) | (ties[order][1:] != ties[order][:-1])))
    out = np.zeros(len(ids), np.int64)
    out[order] = np.cumsum(fresh[:len(ids)])
    return out


def reduce_equal(hashes: Hashes, start, windows, key, rank, place) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments the earliest (by rank, then place) is kept; the others are ``again``,
    unless they are the same place of the same document, which is dropped."""
    length = windows + WINDOW - 1
    digest = hashes.of(start, length)
    order = np.lexsort((place, rank, length, digest))
    x, y = order[:-1], order[1:]
    same = (digest[x] == digest[y]) & (length[x] == length[y]) & (key[x] == key[y])
    at = np.flatnonzero(same)
    same[at] = hashes.equal_bytes(start[x[at]], start[y[at]], length[x[at]]) if len(at) else same[at]
    head = np.concatenate(([True], ~same)) if len(order) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    kept, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    kept[order[head]] = True
    again[order] = ~head & ((rank[order] != rank[first]) | (place[order] != place[first]))
    return kept, again


def suffix_sort(hashes: Hashes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first WINDOW bytes, equal ones in the given
    order; and how many bytes each shares with the one before it."""
    eight = np.ndarray((len(hashes.data) - 7,), ">u8", hashes.data, strides=(1,))[starts].astype(np.uint64)
    order = np.argsort(eight, kind="stable")
    fresh = np.concatenate(([True], eight[order][1:] != eight[order][:-1])) if len(order) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.concatenate((heads, [len(order)])))
    run = 1
    while len(sizes) and run < sizes.max():
        large = sizes > run
        spot = _ragged(heads[large], sizes[large])
        base, size = np.repeat(heads[large], sizes[large]), np.repeat(sizes[large], sizes[large])
        own = (spot - base) // run
        right = own & 1 == 1
        other = (own ^ 1) * run
        low, high = np.minimum(other, size), np.minimum(other + run, size)
        rank, most = np.zeros(len(spot), np.int64), high - low
        live = np.flatnonzero(most > 0)
        while len(live):
            mid = (rank[live] + most[live]) // 2
            a, b = order[spot[live]], order[base[live] + low[live] + mid]
            # elements of the other run that come first: smaller ones, and equal ones of a left run
            shared = hashes.common(starts[a], starts[b])
            x, y = hashes.data[starts[a] + shared], hashes.data[starts[b] + shared]
            before = np.where(shared == WINDOW, right[live], y < x)
            rank[live] = np.where(before, mid + 1, rank[live])
            most[live] = np.where(before, most[live], mid)
            live = live[rank[live] < most[live]]
        place = base + (own & ~1) * run + (spot - base - own * run) + rank
        order[place] = order[spot]
        run *= 2
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        shared[1:] = hashes.common(starts[order[:-1]], starts[order[1:]])
    return order, shared


def in_order(hashes: Hashes, starts: np.ndarray, order: np.ndarray, shared: np.ndarray) -> bool:
    """Whether the bytes themselves bear out the order and the common extensions."""
    x, y, n = starts[order[:-1]], starts[order[1:]], shared[1:]
    some = n > 0
    if not hashes.equal_bytes(x[some], y[some], n[some]).all():
        return False
    part = n < WINDOW
    return bool((hashes.data[x[part] + n[part]] < hashes.data[y[part] + n[part]]).all())


def repeats(data: bytes, start, windows, rank, place) -> np.ndarray:
    """Whether each window of the segments (laid behind each other) also stands earlier."""
    at = _ragged(start, windows)
    rank, place = np.repeat(rank, windows), _ragged(place, windows)
    by_place = np.lexsort((place, rank))
    at, rank, place = at[by_place], rank[by_place], place[by_place]
    for base in BASES:
        hashes = Hashes(data, base)
        order, shared = suffix_sort(hashes, at)
        if in_order(hashes, at, order, shared):
            break
    else:
        raise RuntimeError("hashes under every base collide")
    first = order[np.maximum.accumulate(np.where(shared < WINDOW, np.arange(len(order)), 0))] if len(order) else order
    again = np.zeros(len(at), bool)
    again[by_place[order]] = (rank[order] != rank[first]) | (place[order] != place[first])
    return again


def _pieces(ids, ties, bases, texts) -> Iterator[tuple]:
    """Portions (data, starts, ends, ids, ties, bases) of whole texts, or of overlapping pieces of
    long ones, such that each window lies in exactly one piece."""
    held, size = [], 0
    for i, tie, base, text in zip(ids, ties, bases, texts):
        for lo in range(0, max(len(text) - WINDOW + 1, 0), PORTION):
            piece = text[lo:lo + PORTION + WINDOW - 1]
            if size and size + len(piece) > PORTION:
                yield _portion(held)
                held, size = [], 0
            held.append((i, tie, base + lo, piece))
            size += len(piece)
    if held:
        yield _portion(held)


def _portion(held):
    ids, ties, bases, pieces = zip(*held)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    starts = np.concatenate(([0], ends[:-1]))
    return b"".join(pieces), starts, ends, np.array(ids, np.int64), np.array(ties, np.int64), np.array(bases, np.int64)


def _batch(key, ids, ties, start, windows, data: bytes | None, at=None) -> pa.RecordBatch:
    """Segments with their bytes, or spans without."""
    payload = ([data[s:s + n + WINDOW - 1] for s, n in zip(at.tolist(), windows.tolist())] if data is not None
               else [None] * len(start))
    return pa.RecordBatch.from_arrays(
        [pa.array(key.astype(np.int64) if data is not None else [None] * len(start), pa.int64()),
         pa.array(ids), pa.array(ties), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(payload, pa.binary())],
        names=_NAMES)


def _segments(portion, k: int, wanted=None) -> Iterator[pa.RecordBatch]:
    """The earliest of each set of equal segments of a portion, and the spans of the others."""
    data, starts, ends, ids, ties, bases = portion
    hashes = Hashes(data)
    start, windows, key, _ = cut(hashes, starts, ends, k)
    if wanted is not None:
        hit = wanted(key.view(np.int64))
        start, windows, key = start[hit], windows[hit], key[hit]
    if not len(start):
        return
    piece = np.searchsorted(starts, start, "right") - 1
    place = bases[piece] + start - starts[piece]
    kept, again = reduce_equal(hashes, start, windows, key, ranks(ids, ties)[piece], place)
    for chosen, payload in ((kept, data), (again, None)):
        if chosen.any():
            c = np.flatnonzero(chosen)
            yield _batch(key[c], ids[piece[c]], ties[piece[c]], place[c], windows[c], payload, start[c])


def _document(docs: DataFrame) -> DataFrame:
    """(id, tie, bytes) of every row: id orders null first, tie tells texts of one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(text_of()).alias("tie"), F.encode(text_of(), "utf-8").alias("bytes"))


def _portions_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0] * batch.num_rows, batch.column(2).to_pylist())


def _repeated_keys(rows: DataFrame, k: int) -> DataFrame:
    """Keys that more than one segment of the corpus has, or one that may repeat inside."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, *_ in _portions_of(batch):
                _, _, key, inner = cut(Hashes(data), starts, ends, k)
                found, number = np.unique(key.view(np.int64), return_inverse=True)
                n = np.minimum(np.bincount(number, 1 + inner, len(found)), 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["m", "n"])

    return rows.mapInArrow(keys, "m long, n int").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m")


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """Segments that may repeat, reduced within each portion, and the spans found by that."""
    spark, bits = rows.sparkSession, bloom.BITS
    # a key is a mixed hash, so its low bits are its cell
    cells = _repeated_keys(rows, k).select(F.col("m").bitwiseAND(F.lit(bits - 1)).alias("cell"))
    blocks = bloom.bitmap(cells).collect()  # at most 8 MiB
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in blocks:
        bitmap[row["block"] * bloom.BLOCK // 8:(row["block"] + 1) * bloom.BLOCK // 8] = np.frombuffer(row["bitmap"], np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)

    def wanted(keys: np.ndarray) -> np.ndarray:
        cell = keys & (bits - 1)
        return (sent.value[cell >> 3] >> (cell & 7) & 1).astype(bool)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in _portions_of(batch):
                yield from _segments(portion, k, wanted)

    return written(rows.mapInArrow(segments, _ROW), "segments")


def _recut(rows: DataFrame, k: int) -> DataFrame:
    """The windows of segments, cut anew under a longer gram."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in _pieces(*(batch.column(c).to_pylist() for c in (1, 2, 3, 5))):
                yield from _segments(portion, k)

    return written(rows.mapInArrow(segments, _ROW), "segments")


def _sorted_spans(rows: DataFrame) -> DataFrame:
    """Spans of repeated windows, found by sorting the suffixes of each key's segments."""
    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        key, ids, ties, place, windows = (table.column(c).to_numpy().astype(np.int64) for c in range(5))
        texts = table.column(5).to_pylist()
        rank = ranks(ids, ties)

        def packed(chosen):
            data = b"".join(texts[c] for c in chosen)
            ends = np.cumsum(windows[chosen] + WINDOW - 1)
            return data, ends - windows[chosen] - WINDOW + 1

        every = np.arange(len(key))
        data, start = packed(every)
        hashes, k = Hashes(data), GRAMS[0]
        kept, again = reduce_equal(hashes, start, windows, key, rank, place)
        inner = repeating(hashes.grams(k, hashes.size - k + 1), start, windows, WINDOW - k + 1)
        if again.any():
            yield _batch(key[again], ids[again], ties[again], place[again], windows[again], None)
        left = np.flatnonzero(kept)
        _, number, n = np.unique(key[left], return_inverse=True, return_counts=True)
        left = left[(n[number] > 1) | inner[left]]
        if not len(left):
            return
        data, start = packed(left)
        at, nth = np.repeat(left, windows[left]), _ragged(np.zeros(len(left), np.int64), windows[left])
        hit = repeats(data, start, windows[left], rank[left], place[left])
        # neighbouring windows of one segment make one span
        head = hit & np.concatenate(([True], ~hit[:-1] | (at[1:] != at[:-1])))
        tail = hit & np.concatenate((~hit[1:] | (at[1:] != at[:-1]), [True]))
        h, t = np.flatnonzero(head), np.flatnonzero(tail)
        if len(h):
            yield _batch(key[at[h]], ids[at[h]], ties[at[h]], place[at[h]] + nth[h], t - h + 1, None)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole keys, but for the last one, which may go on in the next batch
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if size >= SORTED_BYTES and held[-1].column(0)[0].as_py() != keys[lo]:
                    yield from found(held)
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += sum(map(len, held[-1].column(5).to_pylist()))
        if held:
            yield from found(held)

    return rows.repartition("m").sortWithinPartitions("m").mapInArrow(spans, _ROW)


def _split(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys that one task may sort, and those of larger keys, if there are any."""
    counts = rows.groupBy("m").agg(F.count(F.lit(1)).alias("__n"))
    large = written(counts.where(F.col("__n") > hot).select("m"), "hot-keys")
    n = large.count()
    if not n:
        return rows, None
    side = F.broadcast(large) if n <= MOST_BROADCAST else large
    return rows.join(side, "m", "left_anti"), rows.join(side, "m", "left_semi")


def _reduced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal segments of the whole corpus reduced to the earliest, and the spans of the others."""
    firsts = written(rows.groupBy("m", "bytes").agg(
        F.min(F.struct("id", "tie", "start", "n")).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    joined = share_by_key(rows, firsts, ["m", "bytes"], "copies")
    spans = joined.where("NOT (id = first.id AND tie = first.tie AND start = first.start)").select(
        F.lit(None).cast("long").alias("m"), "id", "tie", "start", "n", F.lit(None).cast("binary").alias("bytes"))
    return firsts.select("m", "first.id", "first.tie", "first.start", "first.n", "bytes"), spans


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, tie, start, n): windows start .. start + n - 1 of that document also start earlier."""
    python_ready(docs.sparkSession)
    rows, found = _candidates(_document(docs), GRAMS[0]), []
    for nth, _ in enumerate(GRAMS):
        found.append(rows.where("bytes IS NULL"))
        few, many = _split(rows.where("bytes IS NOT NULL"), hot)
        found.append(_sorted_spans(few))
        if many is None:
            break
        firsts, others = _reduced(many)
        found.append(others)
        few, many = _split(firsts, hot)
        found.append(_sorted_spans(few))
        if many is None or nth + 1 == len(GRAMS):
            break  # different whole windows under one hash do not repeat
        rows = _recut(many, GRAMS[nth + 1])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("id", "tie", "start", "n")


def removed(starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs [begin, end) of bytes that the spans cover."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate(starts[order] + windows[order] + WINDOW - 1)
    head = np.concatenate(([True], begin[1:] > end[:-1])) if len(begin) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    return begin[at], end[np.concatenate((at[1:] - 1, [len(end) - 1]))] if len(at) else end[:0]


def kept_texts(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of every document.

    Only documents whose mark is in a fixed Bloom bitmap of those with spans are shuffled.
    """
    found = written(spans(docs, hot), "spans")
    per_doc = found.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = docs.select("doc_id", text_of().alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text_of()).alias("tie"))
    mark = F.xxhash64("id", "tie")
    hits = bloom.members(found.select("id", "tie").distinct(), mark, 5)
    probed = bloom.probe(rows, hits, mark, 5, "__may_lose")
    plain = probed.where("NOT __may_lose").select("doc_id", "text", F.lit(None).cast("array<struct<start:long,n:int>>").alias("spans"))
    joined = probed.where("__may_lose").join(per_doc, ["id", "tie"], "left").select("doc_id", "text", "spans")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                if not own:
                    out.append((len(data), 0, 0, data))
                    continue
                begin, end = removed(np.array([s["start"] for s in own], np.int64), np.array([s["n"] for s in own], np.int64))
                kept = b"".join(data[lo:hi] for lo, hi in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                out.append((len(data), int((end - begin).sum()), len(begin), kept))
            n_bytes, n_removed, n_spans, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    lost = joined.mapInArrow(cut_out, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    whole = plain.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"),
                         zero.alias("n_spans"), F.encode("text", "utf-8").alias("kept"))
    return whole.unionByName(lost)


def digest_rows(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return kept_texts(docs, hot).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, u.p, array_slice(b, u.p + 1, u.p + {WINDOW}) AS s FROM d, unnest(range(0, octet_length(b) - {WINDOW - 1})) AS u(p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM w),
a AS (SELECT doc_id, p, p > {WINDOW} + coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{2 * WINDOW}) AS fresh FROM r WHERE nth > 1),
g AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM a),
x AS (SELECT doc_id, run, min(p) AS lo, max(p) + {WINDOW} AS hi FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM x),
k AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
             string_agg(hex(array_slice(b, before + 1, lo)), '' ORDER BY lo) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN k.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(array_slice(b, last + 1, octet_length(b))))) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
