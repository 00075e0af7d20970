"""Packing by concatenate and cut.

All documents stand in one line of token ids, each ended by an end id; the line is cut into
windows of a fixed length, so only the last window has any padding. Pass one tokenises every
document once, keeps its ids and its place within its own partition, and sums the tokens of
each partition. The prefix sums of those totals (one number per partition) turn local places
into global ones. Pass two cuts each document at the window bounds it crosses, which gives one
record per piece; no row moves in either pass.

Texts are split at blanks and line ends before tokenising. The vocabulary's pre-tokeniser drops
white space and no token spans it, so the ids of a text are those of its parts in order; parts
repeat, and each worker keeps the ids of the ones it has seen in a bounded table.

Defined cases: null and empty texts are one end id; very long texts span as many windows as they
need; the order of documents is that of the input's partitions, so repeated rows and ties each
get a place of their own; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import python_ready, written

LENGTH = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Parts whose ids a worker keeps.
KEPT_PARTS = 400_000

#: A Latin word and the signs behind it: each is one run for the pre-tokeniser. The capital I
#: with a dot is left out, its lower case is no longer a run of letters.
_WORD = re.compile(r"""([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)\Z""")
_BLANKS = str.maketrans("\n\t\r", "   ")
_tokenizers: dict[str, "PartIds"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class PartIds(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes, by way of a table of their parts.

    The table keeps the parts seen last: once it holds ``kept`` it becomes the older half, from
    which parts move up as they are met again, and the half before it is let go.
    """

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        from tokenizers import Tokenizer
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.kept = kept // 2
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if (found := self.older.get(part)) is None:
            if m := _WORD.match(part):
                # letters are one run and the vocabulary is lower case
                found = self._run(m[1].lower()) + (self[m[2]] if m[2] else b"")
            else:
                found = _pack(self.tokenizer.encode(part, add_special_tokens=False).ids)
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[part] = found
        return found

    def _run(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return _pack([t.id for t in self.word(word)])

    def encode(self, text: str) -> bytes:
        text = text.translate(_BLANKS) if "\t" in text or "\r" in text else text.replace("\n", " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def part_ids(path: str) -> PartIds:
    """The worker's table for this vocabulary; made once per worker."""
    if path not in _tokenizers:
        _tokenizers[path] = PartIds(path)
    return _tokenizers[path]


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, at, doc_id, doc_tokens, ids) in the shared folder: ``at`` counts the ids of the
    documents before it in the same partition, ``ids`` holds them with the end id."""
    python_ready(docs.sparkSession)
    path = path or vocabulary_path()
    end = int(end_id).to_bytes(4, "little")
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            encode_text = part_ids(path).encode
            ids = [encode_text(t or "") + end for t in batch.column(1).to_pylist()]
            sizes = np.array([len(i) // 4 for i in ids], dtype=np.int64)
            places = at + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(ids) else sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), batch.column(0),
                 pa.array(sizes), pa.array(ids, pa.binary())], names=[f.name for f in schema.fields])

    return written(docs.select("doc_id", "text").mapInArrow(encode, schema), "tokens")


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document: doc_id, start, length, doc_tokens, sequence_id, offset, and
    its ids as little-endian unsigned 32-bit bytes."""
    tokens = tokenised(docs, path, end_id)
    # one total per partition; their prefix sums are the partitions' first places
    totals = sorted(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    firsts, first = [], 0
    for row in totals:
        firsts.append((row["part"], first))
        first += row["n"]
    bases = docs.sparkSession.createDataFrame(firsts, "part int, base long")
    lined = tokens.join(F.broadcast(bases), "part").withColumn("first", F.expr("base + at"))
    windows = lined.select("*", F.explode(F.expr(
        f"sequence(first div {length}, (first + doc_tokens - 1) div {length})")).alias("sequence_id"))
    cut = windows.withColumns({
        "begin": F.expr(f"greatest(first, sequence_id * {length})"),
        "stop": F.expr(f"least(first + doc_tokens, (sequence_id + 1) * {length})")})
    return cut.select(
        "doc_id", F.expr("begin - first").alias("start"), F.expr("stop - begin").alias("length"),
        "doc_tokens", "sequence_id", F.expr(f"begin - sequence_id * {length}").alias("offset"),
        F.expr("substring(ids, cast((begin - first) * 4 + 1 as int), cast((stop - begin) * 4 as int))").alias("ids"))


def sequences(cut: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole windows from their pieces, the last one padded.

    A window has at most ``length`` pieces, so its group is bounded.
    """
    joined = F.expr("aggregate(transform(array_sort(collect_list(struct(`offset`, ids))), p -> p.ids), "
                    "cast('' as binary), (a, b) -> concat(a, b))")
    rows = cut.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    pad = F.unhex(F.expr(f"repeat('{int(pad_id).to_bytes(4, 'little').hex()}', cast({length} - n_tokens as int))"))
    return rows.withColumn("ids", F.concat("ids", pad))


def piece_rows(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces(docs, length, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
