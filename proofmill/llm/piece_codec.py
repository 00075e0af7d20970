"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Distinct words of equal length advance together, one character at a time. All substrings that
end at the current position are hashed from prefix sums, the hashes probe the sorted keys of
the pieces, and vectorised maxima over the candidates store a backpointer for each word and
position; reading the pointers from the end gives the pieces.

What is maximised depends on the model. Of a unigram model it is the sum of scores. A
byte-pair model has no sum to maximise, but its result obeys a Viterbi recurrence all the
same: the result for a prefix is that for a shorter one and a last piece, and a piece may
follow another exactly if encoding the two strings together gives these two pieces back. That
test only depends on the pieces' merge trees along their seam; it is taken for whole arrays
of pairs, and exactly one candidate passes. Ids equal the library's; of a unigram
model's segmentations with equal sums either may come out.

Texts are cut where no piece can span: before a run of blanks and around line ends. Each
worker keeps the ids of the parts it has seen in a bounded table.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become byte
pieces, or one unknown id for each run if the model has none; very long texts and words are
encoded whole; decoding the ids of a text gives the text back, if the model has byte pieces, but
for the blank sign itself, which the format cannot tell from a blank;
repeated rows give equal ids; an empty table gives no row; other columns are not read.
Models with another normaliser than the identity, or with user-defined pieces, are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import python_ready, text_of

VOCABULARY = "piece_bpe_32k.model"
#: Parts whose ids a worker keeps.
KEPT_PARTS = 500_000
BLANK = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NEVER = np.int64(1) << np.int64(40)
_UNKNOWN_PENALTY = 10.0
_LEAD = np.uint64(42)
#: Words that advance together.
_TOGETHER = 8192
_SIGNS = ".,!?;:|%#$&*"
_UNITS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _points(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64)))) if n else np.ones(1, np.uint64)


class Model:
    """The tables of a SentencePiece model, made from its file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb
        spec = pb.ModelProto()
        spec.ParseFromString(proto if proto is not None else open(path, "rb").read())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only the identity normaliser without blank removal is supported")
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE) or any(p.type == _USER for p in spec.pieces):
            raise ValueError("only unigram and byte-pair models without user-defined pieces are supported")
        self.prefix = BLANK if spec.normalizer_spec.add_dummy_prefix else ""
        self.text = [p.piece for p in spec.pieces]
        normal = [i for i, p in enumerate(spec.pieces) if p.type == _NORMAL]
        if any(BLANK in self.text[i].lstrip(BLANK) or "\n" in self.text[i] for i in normal):
            raise ValueError("a piece spans a cut")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == _UNKNOWN)
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE
                    else b"" if p.type == _CONTROL else b" \xe2\x81\x87 " if p.type == _UNKNOWN
                    else p.piece.replace(BLANK, " ").encode() for p in spec.pieces]
        score = {i: spec.pieces[i].score for i in normal}
        self.strange = len(self.text)                      # stands for a character no piece has
        if self.kind == _BPE:
            normal = self._merge_trees(normal, score)
        self.longest = max((len(self.symbols[i]) if self.kind == _BPE else len(self.text[i]) for i in normal), default=1)
        strings = [self.symbols[i] if self.kind == _BPE else self.text[i] for i in normal]
        keys = np.array([self._hash(s) for s in strings], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, dtype=np.int64)[order]
        # where in the sorted keys those of each leading part begin, and how many there are
        lead = (self.keys >> _LEAD).astype(np.int64)
        self.begin = np.searchsorted(lead, np.arange(1 << (64 - int(_LEAD)))).astype(np.int32)
        self.many = np.bincount(lead, minlength=len(self.begin)).astype(np.int8)
        # neighbouring characters inside pieces; nothing merges across any others
        self.inside = {s[k:k + 2] for s in strings for k in range(len(s) - 1)}
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        worth = np.full(len(self.text) + 1, -np.inf, dtype=np.float32)
        worth[list(score)] = list(score.values())
        worth[self.strange] = min(score.values(), default=0.0) - _UNKNOWN_PENALTY
        self.score = worth

    @staticmethod
    def _hash(text: str) -> int:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        return int((points * _powers(_BASE, len(points))[1:]).sum())

    # merge trees of a byte-pair model

    def _merge_trees(self, normal: list[int], score: dict[int, float]) -> list[int]:
        """Ids of the symbols that encoding can give, and the tables for testing seams."""
        self.symbols = {i: self.text[i] for i in normal}
        number = {s: i for i, s in self.symbols.items()}
        # characters that only occur inside pieces are symbols as well, unknown if left alone
        for char in sorted({c for s in self.symbols.values() for c in s} - set(number)):
            number[char] = i = self.strange + 1 + len(self.symbols)
            self.symbols[i] = char
        turn = {i: k for k, i in enumerate(sorted(normal, key=lambda i: (-score[i], i)))}
        split: dict[int, tuple[int, int]] = {}
        for i, s in self.symbols.items():
            if len(s) > 1 and (parts := self._halves(s, number, turn)):
                split[i] = number[parts[0]], number[parts[1]]
        good = {i for i, s in self.symbols.items() if len(s) == 1 or i in split}
        since: dict[int, int] = {}

        def time(i: int) -> int:
            """When the symbol comes to be: in its turn, or once both its parts are there."""
            if i not in since:
                since[i] = -1 if i not in split else max(turn[i], time(split[i][0]), time(split[i][1]))
            return since[i]

        def spine(i: int, side: int) -> list[int]:
            out = [i]
            while out[-1] in split:
                out.append(split[out[-1]][side])
            return out[::-1]

        place = {i: k for k, i in enumerate(sorted(good))}
        self.place = np.full(max(self.symbols, default=0) + 2, len(place), dtype=np.int64)
        self.place[list(place)] = list(place.values())
        spines = [[spine(i, side) for i in sorted(good)] for side in (1, 0)]
        depth = max((len(s) for both in spines for s in both), default=1)
        tables = []
        for both in spines:
            symbol = np.full((len(place) + 1, depth), self.strange, dtype=np.int64)
            until = np.full((len(place) + 1, depth), _NEVER)
            for k, s in enumerate(both):
                symbol[k, :len(s)] = s
                until[k, :len(s) - 1] = [time(i) for i in s[1:]]
            tables.append((symbol, until))
        (self.right, self.right_until), (self.left, self.left_until) = tables
        self.width = np.int64(max(self.symbols, default=0) + 2)
        pairs = sorted((number[s[:k]] * int(self.width) + number[s[k:]], turn[i]) for i, s in self.symbols.items() if i in split
                       for k in range(1, len(s)) if number.get(s[:k]) in good and number.get(s[k:]) in good)
        self.pair = np.array([p for p, _ in pairs], dtype=np.int64)
        self.pair_turn = np.array([t for _, t in pairs], dtype=np.int64)
        return sorted(good)

    @staticmethod
    def _halves(piece: str, number: dict[str, int], turn: dict[int, int]) -> tuple[str, str] | None:
        """The two symbols whose merge completes the piece, or None if merging never gives it."""
        parts = list(piece)
        while len(parts) > 1:
            turns = [turn.get(number.get(a + b, -1), _NEVER) for a, b in zip(parts, parts[1:])]
            best = min(range(len(turns)), key=turns.__getitem__)
            if turns[best] >= _NEVER:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return None

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether encoding the two symbols' strings together gives the two symbols, pair by pair.

        Merging builds the right edge of the first and the left edge of the second step by step.
        The seam breaks if at some moment the two symbols that face each other would merge before
        either is taken into its own side; of equal turns the left one comes first.
        """
        out = np.ones(len(first), dtype=bool)
        at = np.arange(len(first))
        a, b = self.place[first], self.place[second]
        i, j = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        while len(at):
            own, other = self.right_until[a, i], self.left_until[b, j]
            key = self.right[a, i] * self.width + self.left[b, j]
            found = np.minimum(np.searchsorted(self.pair, key), max(0, len(self.pair) - 1))
            turn = np.where(self.pair[found] == key, self.pair_turn[found], _NEVER) if len(self.pair) else np.full(len(at), _NEVER)
            broken = (turn < own) & (turn <= other)
            out[at[broken]] = False
            left_first = own <= other
            i, j = i + left_first, j + ~left_first
            go = ~broken & ((own < _NEVER) | (other < _NEVER))
            at, a, b, i, j = at[go], a[go], b[go], i[go], j[go]
        return out

    # the lattice

    def _candidates(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the hashes, and the powers that bring a substring's to the front."""
        n = points.shape[1]
        terms = (points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n]
        sums = np.concatenate((np.zeros((len(points), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
        return sums, _powers(_INVERSE, n) * _BASE

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1: looks through the few sorted keys of its leading bits."""
        flat = hashes.ravel()
        out = np.full(len(flat), -1, dtype=np.int64)
        at = np.flatnonzero(self.many[flat >> _LEAD])
        lead = flat[at] >> _LEAD
        place, left = self.begin[lead], self.many[lead]
        while len(at):
            same = self.keys[place] == flat[at]
            out[at[same]] = self.ids[place[same]]
            go = ~same & (left > 1)
            at, place, left = at[go], place[go] + 1, left[go] - 1
        return out.reshape(hashes.shape)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of one length, one word after the other, and where each word's begin;
        ``strange`` for characters that no piece has."""
        n, rows = len(words[0]), len(words)
        sums, inverse = self._candidates(_points(words, n))
        last = np.full((rows, n + 1), self.strange, dtype=np.int64)      # the symbol that ends here
        size = np.ones((rows, n + 1), dtype=np.int64)                    # its length: the backpointer
        total = np.zeros((rows, n + 1), dtype=np.float32)       # the library's precision
        for end in range(1, n + 1):
            sizes = np.arange(1, min(end, self.longest) + 1)
            starts = end - sizes
            symbol = self._probe((sums[:, end, None] - sums[:, starts]) * inverse[starts])
            symbol[:, 0] = np.where(symbol[:, 0] < 0, self.strange, symbol[:, 0])
            if self.kind == _UNIGRAM:
                worth = np.where(symbol >= 0, self.score[symbol] + total[:, starts], np.float32(-np.inf))
                best = worth.shape[1] - 1 - worth[:, ::-1].argmax(axis=1)     # of equals the longest
                total[:, end] = worth[np.arange(rows), best]
            else:
                row, col = np.nonzero(symbol >= 0)
                begin = starts[col]
                fits = begin == 0
                inner = np.flatnonzero(~fits)
                pair = last[row[inner], begin[inner]] * self.width + symbol[row[inner], col[inner]]
                kinds, back = np.unique(pair, return_inverse=True)       # few pairs, met many times
                fits[inner] = self.may_follow(kinds // self.width, kinds % self.width)[back]
                possible = np.zeros(symbol.shape, dtype=bool)
                possible[row[fits], col[fits]] = True
                best = possible.shape[1] - 1 - possible[:, ::-1].argmax(axis=1)
            last[:, end] = symbol[np.arange(rows), best]
            size[:, end] = sizes[best]
        return self._read(last, size)

    @staticmethod
    def _read(last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follows the backpointers of all words from their ends: symbols, and where each word's begin."""
        rows, n = last.shape[0], last.shape[1] - 1
        at, live, steps = np.full(rows, n), np.arange(rows), []
        while len(live):
            steps.append((live, last[live, at[live]]))
            at[live] -= size[live, at[live]]
            live = live[at[live] > 0]
        who = np.concatenate([s[0] for s in steps[::-1]])
        symbols = np.concatenate([s[1] for s in steps[::-1]])
        return symbols[np.argsort(who, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(who, minlength=rows))))

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word as little-endian unsigned 32-bit bytes."""
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word), []).append(word)
        out = {}
        for n, own in by_size.items():
            together = max(1, min(_TOGETHER, 2_000_000 // n))
            for at in range(0, len(own), together):
                block = own[at:at + together]
                symbols, first = self.segment(block)
                edges = (4 * first).tolist()
                packed = symbols.astype("<u4").tobytes()
                for word, start, end in zip(block, edges, edges[1:]):
                    out[word] = packed[start:end]
                strange = np.flatnonzero(symbols >= self.strange)
                for row in np.unique(np.searchsorted(first, strange, side="right") - 1).tolist():
                    out[block[row]] = self._spelled(block[row], symbols[first[row]:first[row + 1]])
        return out

    def _spelled(self, word: str, symbols: np.ndarray) -> bytes:
        """Ids where some character is not in the vocabulary: its bytes, or one unknown for a run."""
        ids, at = [], 0
        for symbol in symbols.tolist():
            n = len(self.text[symbol]) if symbol < self.strange else 1
            if symbol < self.strange:
                ids.append(symbol)
            elif self.bytes:
                ids += [self.bytes[b] for b in word[at].encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at += n
        return np.array(ids, dtype="<u4").tobytes()


class Codec:
    """Encodes and decodes whole texts, keeping the ids of parts seen last in a bounded table."""

    def __init__(self, model: Model, kept: int = KEPT_PARTS):
        self.model, self.kept = model, kept // 2
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        prefix = self.model.prefix
        if not text:
            return []
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text:
            return _UNITS.findall(prefix + text.replace(" ", BLANK))
        return (prefix + text.replace(" ", " " + BLANK)).replace("\n", " \n ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        split = [self._parts(t) for t in texts]
        known, older = self.known, self.older
        fresh = {p for parts in split for p in parts if p not in known}
        if len(known) + len(fresh) > self.kept:
            self.older = older = known
            self.known = known = {"": b""}
            fresh = {p for parts in split for p in parts if p}
        ask, cut, inside = set(), [], self.model.inside
        for part in fresh:
            if part in older:
                known[part] = older[part]
            elif len(part) > 1 and part[-1] in _SIGNS and part[-2:] not in inside:
                cut.append(part)                       # no piece spans the last two characters
                ask.update(p for p in (part[:-1], part[-1]) if p not in known)
            else:
                ask.add(part)
        known.update(self.model.word_ids(list(ask)))
        for part in cut:
            known[part] = known[part[:-1]] + known[part[-1]]
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.model.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text[:1] == " " else text


_worker: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for this model; made once per worker."""
    if path not in _worker:
        _worker[path] = Codec(Model(path))
    return _worker[path]


def encoded(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Documents with the ids of their whole text, as little-endian unsigned 32-bit bytes."""
    python_ready(docs.sparkSession)
    path = path or vocabulary_path()

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(codec(path).encode(list(texts)), dtype=object)

    return docs.withColumn(ids, encode(text_of()))


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows with the text of their ids; null ids have a null text."""
    python_ready(rows.sparkSession)
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series([None if i is None else codec(path).decode(i) for i in own], dtype=object)

    return rows.withColumn(text, decode(ids))


def digest_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, CRC-32 of the ids, SHA-256 of the text decoded from them, and whether it is the text."""
    rows = encoded(docs.select("doc_id", "text"), path, "ids")
    back = decoded(rows, path, "ids", "back")
    return back.select(
        "doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("back", 256).alias("text_sha256"), (F.col("back") == text_of()).alias("round_trip"))
