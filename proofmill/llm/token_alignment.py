"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers cut the same bytes at different places. Their tokens are merged by byte ends: at
a state (i, j) tokens i of A and j of B overlap, which is a link; the one that ends first moves
on, and where both end at once there is a cut between groups. One NumPy vector holds the states
of all documents of a batch. Every step emits a link of each live document, moves all pointers
and drops the finished ones. A long document enters as several lanes of ``LANE`` bytes: the
state at a byte follows from the token ends alone, so lanes of one text walk side by side.

An id pair's count is the number of documents that hold it linked. Each worker sums the pairs
of its documents before the shuffle. The ``hot`` most frequent pairs, a fixed number, go to all
workers as sorted arrays; only occurrences of rarer pairs are shuffled, and none of their keys can
hold more than 1/``hot`` of all occurrences.

Texts are split before blanks and line ends behind a non-blank, then tokenised: no token of either
vocabulary spans such a place, so the ids of a text are those of its parts in order. Parts repeat, and each
worker keeps the ids of those seen last in a bounded table.

Defined cases: texts that are null or empty, and texts whose joined token bytes differ from a
space and the text, have no tokens: all numbers 0 and an empty digest; very long texts are taken
whole; repeated rows are documents of their own, in counts too; null ids are kept; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import pathlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, python_ready, written

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Bytes of a lane, and of the documents merged at a time (a longer document is merged alone).
LANE = 2048
BATCH_BYTES = 1 << 20
#: Parts whose ids a worker keeps, and pairs it sums before handing them on.
KEPT_PARTS = 200_000
SUMMED_PAIRS = 1 << 20
#: Pairs that are sent to all workers: 17 bytes each, 2.2 MB.
HOT_PAIRS = 1 << 17

#: Marks the places to split at; texts that hold it themselves are split the slow way.
_MARK = "\x1f"
_RUN = re.compile(rf"\s[ \n]|\A[ \n]|{_MARK}")
_SAFE_PLACE = re.compile(r"(?<=\S)(?=[ \n])")


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {chr(b if b in shown else next(other)): b for b in range(256)}


def _ranked(path: str, bytes_of: list[bytes]):
    """A quick encoder for a byte-level vocabulary whose ids follow its merges, else None."""
    import public_tokenizers
    import tiktoken
    model = json.loads(pathlib.Path(path).read_text(encoding="utf-8"))
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
    made = [model["model"]["vocab"].get(m.replace(" ", ""), -1) for m in merges]
    level = model.get("pre_tokenizer") or {}
    if (level.get("type") != "ByteLevel" or not level.get("use_regex") or level.get("add_prefix_space")
            or model.get("normalizer") or made != list(range(256, 256 + len(made)))
            or any(len(x) != 1 for x in bytes_of[:256])):
        return None
    ranks = {x: i for i, x in enumerate(bytes_of[:256 + len(made)])}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Tokens:
    """Token ids of a batch of documents, laid behind each other, and how many each has."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


class _Ragged:
    """Id sequences by number, in one growing array."""

    def __init__(self):
        self.flat, self.size = np.zeros(1 << 16, np.int64), 0
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int64)])
        self.flat[self.size:self.size + len(ids)] = ids
        self.start = np.concatenate([self.start, self.size + np.cumsum(counts) - counts])
        self.n = np.concatenate([self.n, counts])
        self.size += len(ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[numbers]
        ends = np.cumsum(n)
        at = np.repeat(self.start[numbers] - ends + n, n)
        at += np.arange(len(at))
        return self.flat[at], ends


class Vocabularies:
    """Both tokenizers, the bytes of every token, and the ids of the parts seen last."""

    def __init__(self, path_a: str, path_b: str, kept: int = KEPT_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_of_letter()
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, name)) if all(c in letters for c in name) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.quick_a = _ranked(path_a, self.bytes_a)
        # parts may be tokenised alone only if no piece goes on into a blank or holds a line end
        self.by_parts = self.quick_a is not None and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.blank = self.b.piece_to_id("▁")
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.kept = kept
        self.written = _renderings(len(self.bytes_a), len(self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.part_a, self.part_b, self.uneven = _Ragged(), _Ragged(), np.zeros(0, bool)

    def parts(self, text: str) -> list[str]:
        """The text behind a blank, cut before blanks and line ends that follow a non-blank."""
        whole = " " + text
        if not self.by_parts:
            return [whole]
        if _RUN.search(text):
            return _SAFE_PLACE.split(whole)
        return whole.replace(" ", _MARK + " ").replace("\n", _MARK + "\n").split(_MARK)[1:]

    def ids_b(self, parts: list[str]) -> list[list[int]]:
        """The second tokenizer puts a blank in front of its input by itself; it stands alone where
        a line end follows, and a blank alone is its own piece."""
        coded = self.b.encode([p[p.startswith(" "):] for p in parts], num_threads=1)
        for n, part in enumerate(parts):
            if part == " ":
                coded[n] = [self.blank]
            elif part[0] != " ":
                coded[n] = coded[n][1:]
        return coded

    def ids_a(self, parts: list[str]) -> list[list[int]]:
        if self.quick_a is not None:
            return [self.quick_a.encode_ordinary(p) for p in parts]
        return [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, parts: set[str]) -> None:
        """Ids of parts not met yet."""
        new = [p for p in parts if p not in self.number]
        if len(self.number) + len(new) > self.kept:
            self.forget()
            new = list(parts)
        if not new:
            return
        new.sort()
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        size = np.array([len(p.encode()) for p in new], np.int64)
        uneven = np.zeros(len(new), bool)
        for kept, coded, lengths, table in ((self.part_a, self.ids_a(new), self.length_a, self.bytes_a),
                                            (self.part_b, self.ids_b(new), self.length_b, self.bytes_b)):
            counts = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.fromiter(chain.from_iterable(coded), np.int64, int(counts.sum()))
            kept.extend(ids, counts)
            ends = np.concatenate(([0], np.cumsum(lengths[ids])))[np.concatenate(([0], np.cumsum(counts)))]
            uneven |= np.diff(ends) != size
            if not uneven.any() and b"".join(map(table.__getitem__, ids.tolist())) == "".join(new).encode():
                continue
            for n, (part, own) in enumerate(zip(new, coded)):
                uneven[n] |= b"".join(map(table.__getitem__, own)) != part.encode()
        self.uneven = np.concatenate([self.uneven, uneven])

    def encode(self, texts: list[str]) -> Tokens:
        """Both id sequences of each text; empty where the text is, or where joined bytes differ
        from a space and the text."""
        split = [self.parts(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        n = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if self.uneven[numbers].any():
            doc = np.repeat(np.arange(len(split)), n)
            for d in np.unique(doc[self.uneven[numbers]]):
                own = numbers[doc == d]
                whole = (" " + texts[d]).encode()
                if any(b"".join(map(table.__getitem__, kept.take(own)[0].tolist())) != whole
                       for table, kept in ((self.bytes_a, self.part_a), (self.bytes_b, self.part_b))):
                    n[d], numbers, doc = 0, numbers[doc != d], doc[doc != d]
        last = np.concatenate(([0], np.cumsum(n)))
        (a, ends_a), (b, ends_b) = self.part_a.take(numbers), self.part_b.take(numbers)
        return Tokens(a, b, np.diff(np.concatenate(([0], ends_a))[last]), np.diff(np.concatenate(([0], ends_b))[last]))


def _renderings(size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with the sign that follows (inside A's side a comma, behind it a bar; inside
    B's side a comma, behind it a semicolon) as rows of bytes, and their lengths."""
    texts = [f"{i}{sign}".encode() for size, signs in ((size_a, ",|"), (size_b, ",;"))
             for sign in signs for i in range(size)]
    wide = max(map(len, texts))
    table = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8).reshape(len(texts), wide)
    return table, np.array([len(t) for t in texts], np.int64)


def merge(ends_a: np.ndarray, ends_b: np.ndarray, stops: np.ndarray, lane: int = LANE):
    """Links (i, j) in order, and the last token of either side in each group.

    ``ends_a`` and ``ends_b`` are ascending byte ends of the tokens of all documents of the batch,
    laid behind each other; ``stops`` are the documents' ends, where both sides end.
    """
    # i + j never repeats on the walk; a slot holds twice i, and one more at a cut
    slot = np.full(len(ends_a) + len(ends_b) + 1, -1, np.int64)
    starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
    lanes = -(-(stops - starts) // lane)
    low = np.repeat(starts, lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(low + lane, np.repeat(stops, lanes))
    i = np.searchsorted(ends_a, low, "right")
    j = np.searchsorted(ends_b, low, "right")
    while len(i):
        a, b = ends_a[i], ends_b[j]
        moves_a, moves_b = a <= b, b <= a
        slot[i + j] = 2 * i + (moves_a & moves_b)  # a link across a lane's end is set by both, alike
        i, j = i + moves_a, j + moves_b
        live = np.minimum(a, b) < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    at = np.flatnonzero(slot >= 0)
    set_ = slot[at]
    links_i = set_ >> 1
    links_j = at - links_i
    cut = np.flatnonzero(set_ & 1)
    return links_i, links_j, links_i[cut], links_j[cut]


def aligned(tokens: Tokens, words: Vocabularies) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each document of a batch; pairs are
    distinct id pairs ``a * size of B + b`` as int64 bytes, times their links as int32 bytes."""
    a, b, n_a, n_b = tokens.a, tokens.b, tokens.n_a, tokens.n_b
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    ends_a, ends_b = np.cumsum(words.length_a[a]), np.cumsum(words.length_b[b])
    i, j, cut_a, cut_b = merge(ends_a, ends_b, ends_a[last_a[n_a > 0] - 1])
    n_links = np.diff(np.searchsorted(i, np.concatenate(([0], last_a))))
    n_groups = np.diff(np.searchsorted(cut_a, np.concatenate(([0], last_a))))

    size_a, size_b = len(words.bytes_a), len(words.bytes_b)
    every = size_a * size_b  # document and pair in one number; a batch has far fewer than 2^20 documents
    key = np.sort(np.repeat(np.arange(len(n_a)) * every, n_links) + a[i] * size_b + b[j])
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])) if len(key) else [])
    times = np.diff(np.concatenate((first, [len(key)]))).astype("<i4")
    key = key[first]
    pairs, pair_at = (key % every).astype("<i8"), np.searchsorted(key, np.arange(len(n_a) + 1) * every)

    # both sides of each group behind one another, each token with its sign
    in_a, in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    code = np.empty(len(a) + len(b), np.int64)
    end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    end_a[cut_a], end_b[cut_b] = 1, 1
    code[np.arange(len(a)) + np.repeat(cut_b + 1 - in_b, in_a)] = a + size_a * end_a
    code[np.arange(len(b)) + np.repeat(cut_a + 1, in_b)] = 2 * size_a + b + size_b * end_b
    table, lengths = words.written
    signs = table[code]
    signs = signs[signs != 0].tobytes()
    text_at = np.concatenate(([0], np.cumsum(lengths[code])))[np.concatenate(([0], last_a + last_b))]

    return [(int(n_a[d]), int(n_b[d]), int(n_groups[d]), int(n_links[d]),
             hashlib.sha256(signs[text_at[d]:text_at[d + 1] - 1]).hexdigest() if n_a[d] else "",
             pairs[pair_at[d]:pair_at[d + 1]].tobytes(), times[pair_at[d]:pair_at[d + 1]].tobytes())
            for d in range(len(n_a))]


_words: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """The worker's tokenizers for these files; made once per worker."""
    if (path_a, path_b) not in _words:
        _words[path_a, path_b] = Vocabularies(path_a, path_b)
    return _words[path_a, path_b]


def _portions(texts: list[str], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(start, at)
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document, in the shared folder: row (a number of its own), doc_id, n_a, n_b,
    n_groups, n_links, groups_sha256, and its distinct linked id pairs with their links."""
    python_ready(docs.sparkSession)
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = vocabularies(path_a, path_b), TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for portion in _portions(texts):
                found = aligned(words.encode(texts[portion]), words)
                ids = batch.column(0).slice(portion.start, len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(at, at + len(found)), pa.int64()), ids,
                     *[pa.array(c, kind) for c, kind in zip(zip(*found), kinds)]],
                    names=[f.name for f in schema.fields])
                at += len(found)

    return written(docs.select("doc_id", "text").mapInArrow(align, schema), "aligned")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best) in the shared folder: documents that hold the pair linked, and whether
    no other pair of the same A id is held by more."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, waiting, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def summed():
            keys = np.concatenate([held, *waiting])
            weights = np.concatenate([counts, np.ones(len(keys) - len(held), np.int64)])
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, weights, len(keys)).astype(np.int64)

        def rows(keys, sums):
            for s in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[s:s + (1 << 16)]), pa.array(sums[s:s + (1 << 16)])], names=["pair", "docs"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                waiting.append(np.frombuffer(raw, "<i8"))
                n += len(waiting[-1])
                if n >= SUMMED_PAIRS:
                    held, counts = summed()
                    waiting, n = [], 0
                    if len(held) >= SUMMED_PAIRS:
                        yield from rows(held, counts)
                        held, counts = held[:0], counts[:0]
        yield from rows(*summed())

    sums = (found.select("pairs").mapInArrow(tally, "pair long, docs long")
            .groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {size_b}")))
    sums = written(sums, "pairs")
    most = sums.groupBy("a").agg(F.max("docs").alias("most"))  # at most as many rows as A has ids
    best = written(sums.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")
    discard(sums)
    return best


def _hot(pairs: DataFrame, most: int):
    """At most ``most`` pairs, the most frequent ones, as sorted arrays (pair, docs, best)."""
    level = F.floor(F.log2("docs") * 8).cast("int")  # some hundred levels
    level_rows = pairs.groupBy(level.alias("level")).count().collect()
    least, n = None, 0
    for row in sorted(level_rows, reverse=True):
        n += row["count"]
        if n > most:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    hot = pairs.where(level >= least).toPandas().sort_values("pair")
    return hot["pair"].to_numpy(), hot["docs"].to_numpy(), hot["best"].to_numpy()


def digest_rows(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
                hot: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    found = alignments(docs, path_a, path_b)
    pairs = pair_counts(found, len(vocabularies(path_a, path_b).bytes_b))
    served = spark.sparkContext.broadcast(_hot(pairs, hot))
    columns = [c for c in found.columns if c not in ("pairs", "times")]
    schema = T.StructType([*[found.schema[c] for c in columns], *[
        T.StructField(n, T.LongType()) for n in ("n_best", "count_sum", "pair", "links")]])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs_of, best_of = served.value
        for batch in batches:
            names = batch.schema.names
            raw = [batch.column(names.index(n)).to_pylist() for n in ("pairs", "times")]
            pair = np.frombuffer(b"".join(raw[0]), "<i8")
            times = np.frombuffer(b"".join(raw[1]), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(len(raw[0])), [len(x) // 8 for x in raw[0]])
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            docs_at = np.where(hit, docs_of[at], 0) if len(known) else np.zeros(len(pair), np.int64)
            best_at = hit & best_of[at] if len(known) else hit
            # whole numbers up to 2^53 are exact in these sums
            n_best = np.bincount(doc, times * best_at, len(raw[0])).astype(np.int64)
            total = np.bincount(doc, times * docs_at, len(raw[0])).astype(np.int64)
            none = pa.nulls(len(raw[0]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(names.index(c)) for c in columns], pa.array(n_best), pa.array(total), none, none],
                names=[f.name for f in schema.fields])
            rare = np.flatnonzero(~hit)
            if len(rare):
                row = batch.column(names.index("row")).to_numpy()[doc[rare]]
                empty = [pa.nulls(len(rare), batch.column(names.index(c)).type) for c in columns[1:]]
                none = pa.nulls(len(rare), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), *empty, none, none, pa.array(pair[rare]), pa.array(times[rare])],
                    names=[f.name for f in schema.fields])

    looked = written(found.mapInArrow(look_up, schema), "looked-up")
    rare = (looked.where("pair IS NOT NULL").select("row", "pair", "links").join(pairs, "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rare_best"),
                                F.sum(F.col("links") * F.col("docs")).alias("rare_sum")))
    out = looked.where("pair IS NULL").join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.expr("n_best + coalesce(rare_best, 0)").alias("n_best"),
        F.expr("count_sum + coalesce(rare_sum, 0)").alias("count_sum"), "groups_sha256")
    discard(found)
    return out
