"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings counts their common letter subsequences of length three, gapped ones
too, each letter that the occurrences span costing a factor ``DECAY``; it is normalised and
raised to ``POWER``. Inserted letters and gaps lower it gently instead of breaking the match;
signs inside a word, letters written apart and digits for letters are undone before. A word is
compared with a landmark through its best window of about the landmark's length, so an insult's
stem counts inside any longer word.

Landmarks are letter strings that greedily cover the toxic documents of a bounded labelled
sample and are rare in the clean ones. A sentence's features are the kernel values of its best
words with each landmark, whitened by the landmarks' own kernel matrix (Nyström). Only
documents are labelled, so the machine is trained on sentences in rounds: all sentences of
clean documents are negative; of each toxic document the sentence that scores highest is
positive, and any that matches a landmark better than all clean sentences do. A document's score comes from its worst
sentence and from its worst different words, which tell several insults spread over a text from
one chance match, against its number of different words, as long texts match more by chance: it
is the larger one of two logistic curves fitted on the same documents, of the sentence alone and of
all of these. Each worker computes a word's values once
and keeps them in a bounded table.

Kernel values below ``CUT`` count as zero; an upper bound on the kernel, cheap to take for
whole blocks of words, finds the words for which that holds.

Defined cases: null and empty texts have no word and score as a sentence without one; texts
are read whole, words longer than ``PIECE`` letters in overlapping pieces; repeated rows get
equal scores; documents with disagreeing, null or other labels teach nothing; without a toxic
and a clean row every score is the share of toxic ones, 0.5 if there is none; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import clear_labels, fold, sample_by, python_ready, text_of, written

#: Labelled documents of each label, about, that the model is fitted on.
PER_CLASS = 1000
LANDMARKS = 48
DECAY = 0.7
POWER = 4
CUT = 0.65
THRESHOLD = 0.7
#: Share of the sample's clean documents that may pass the threshold where labels overlap.
CLEAN_PASSES = 0.002
#: Letters of a landmark, at least and at most, and how many more its windows may have.
SHORTEST, LONGEST, SLACK = 4, 9, 2
#: Marks around every word, so a landmark may tell a word's start and end from its inside.
START, END = "^", "$"
#: Landmarks for the clean side: strings around a landmark that clean documents hold more often.
CLEAN_LANDMARKS = 16
PIECE = 48
#: Words whose decision a worker keeps.
KEPT_WORDS = 600_000
_ORDER = 3
_POOL = np.array([1.0, 0.5, 0.25])
_PAIRS = 3
_CODES = 32
_ROUNDS = 4
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SIGNS = ".,!?;:|%#&*()\"'-"
_ENDS = (".", "!", "?", "…", "\n")
_BLANKS = str.maketrans("\t\r", "  ")


def letters(word: str) -> str:
    """The word's letters in lower case, signs dropped and digits that stand for letters undone."""
    low = word.lower()
    if low.isalpha() or (low := low.strip(_SIGNS)).isalpha():
        return low
    if not any(c.isalpha() for c in low):
        return ""
    return "".join(_DIGITS.get(c, c if c.isalpha() else "") for c in low)


def _codes(text: str) -> np.ndarray:
    """Letters as numbers below 32: the marks are 0 and 27, a-z are 1 to 26, others share the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    other = np.where(points == ord(START), 0, np.where(points == ord(END), 27, 28 + points % 4))
    return np.where((points >= 97) & (points <= 122), points - 96, other)


@lru_cache(maxsize=PIECE + 1)
def _triples(n: int, most_span: int) -> tuple[np.ndarray, np.ndarray]:
    """Position triples of an n-letter string within a span, and their weights."""
    at = [t for t in combinations(range(n), _ORDER) if t[-1] - t[0] < most_span]
    at = np.array(at, dtype=np.int64).reshape(-1, _ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1)


def features(text: str) -> dict[int, float]:
    """Weight of each three-letter subsequence of a short string."""
    at, weight = _triples(len(text), len(text))
    found: dict[int, float] = {}
    codes = _codes(text)
    for code, w in zip((codes[at] @ (_CODES ** 2, _CODES, 1)).tolist(), weight.tolist()):
        found[code] = found.get(code, 0.0) + w
    return found


@lru_cache(maxsize=50_000)
def _window(text: str) -> tuple[dict[int, float], float]:
    """Features of a window and their norm; windows recur in many words."""
    found = features(text)
    return found, math.sqrt(sum(w * w for w in found.values()))


@lru_cache(maxsize=200_000)
def kernel(a: str, b: str) -> float:
    """The normalised kernel of two short strings; the table of values seen is bounded."""
    (small, one), (large, two) = sorted((_window(a), _window(b)), key=lambda w: len(w[0]))
    dot = sum(w * large[code] for code, w in small.items() if code in large)
    return dot / (one * two) if dot else 0.0


def word_kernel(word: str, landmark: str) -> float:
    """The best window's kernel with the landmark, zero below the cut, else raised to the power."""
    best = 0.0
    for size in range(len(landmark), len(landmark) + SLACK + 1):
        for start in range(max(1, len(word) - size + 1)):
            best = max(best, kernel(word[start:start + size], landmark))
        if len(word) <= size:
            break
    return best ** POWER if best >= CUT else 0.0


class Landmarks:
    """Kernel values of many words with fixed landmarks."""

    def __init__(self, strings: tuple[str, ...]):
        self.strings = strings
        windows = [_window(s) for s in strings]
        self.limit = np.array([len(s) + SLACK for s in strings], dtype=np.int64)
        self.most_span = int(self.limit.max(initial=SHORTEST + SLACK))
        self.bounds: dict[int, np.ndarray] = {}
        # for each subsequence code the landmarks that have it, as a compressed list
        pairs = sorted((code, i, w / norm) for i, (m, norm) in enumerate(windows) for code, w in m.items())
        self.first = np.searchsorted([p[0] for p in pairs], np.arange(_CODES ** _ORDER + 1))
        self.some = np.diff(self.first) > 0
        self.who = np.array([p[1] for p in pairs], dtype=np.int64)
        self.share = np.array([p[2] for p in pairs])

    def _bound(self, n: int) -> np.ndarray:
        """The cut times the least norm of a window compared with each landmark, in words of n letters."""
        if n not in self.bounds:
            sizes = [min(n, len(s)) for s in self.strings]
            self.bounds[n] = CUT * np.array([math.sqrt(float((_triples(k, k)[1] ** 2).sum())) for k in sizes])
        return self.bounds[n]

    def values(self, words: list[str]) -> dict[str, np.ndarray]:
        """The kernel values of the words that have any; a word is at most ``PIECE`` letters."""
        out: dict[str, np.ndarray] = {}
        by_size: dict[int, list[str]] = {}
        for word in words:
            if len(word) >= _ORDER:
                by_size.setdefault(len(word), []).append(word)
        m = len(self.strings)
        for n, own in by_size.items():
            at, weight = _triples(n, self.most_span)
            bound, span = self._bound(n), at[:, -1] - at[:, 0] + 1
            rows = max(1, 400_000 // len(at))
            for start in range(0, len(own), rows):
                block = own[start:start + rows]
                codes = np.ascontiguousarray(_codes("".join(block)).reshape(len(block), n).T.astype(np.int32))
                pairs = codes * _CODES
                subs = (pairs * _CODES)[at[:, 0]] + pairs[at[:, 1]] + codes[at[:, 2]]
                col, row = np.nonzero(self.some[subs])
                if not len(row):
                    continue
                hit = subs[col, row]
                low, size = self.first[hit], self.first[hit + 1] - self.first[hit]
                entry = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                who, row, col = self.who[entry], np.repeat(row, size), np.repeat(col, size)
                fits = span[col] <= self.limit[who]      # else no window holds the subsequence
                sums = np.bincount(row[fits] * m + who[fits], (weight[col] * self.share[entry])[fits],
                                   minlength=len(block) * m).reshape(len(block), m)
                maybe = sums >= bound
                for r in np.flatnonzero(maybe.any(axis=1)):
                    values = np.zeros(m)
                    for i in np.flatnonzero(maybe[r]):
                        values[i] = word_kernel(block[r], self.strings[i])
                    if values.any():
                        out[block[r]] = values
        return out

    def gram(self) -> np.ndarray:
        """The landmarks' own kernel matrix."""
        return np.array([[kernel(a, b) ** POWER for b in self.strings] for a in self.strings])


def pieces(word: str) -> list[str]:
    """A word's letters between its marks, in pieces that overlap by more than a window."""
    plain = START + letters(word) + END
    if len(plain) <= PIECE:
        return [plain]
    step = PIECE - LONGEST - SLACK
    return [plain[i:i + PIECE] for i in range(0, len(plain) - LONGEST - SLACK, step)]


def _pooled(values: np.ndarray) -> np.ndarray:
    """One value for each landmark from those of a sentence's words: the best different words
    count in full, by half and by a quarter, so many distant ones never add up to a match."""
    if len(values) == 1:
        return values[0]
    best = -np.sort(-np.unique(values, axis=0), axis=0)[:len(_POOL)]
    return _POOL[:len(best)] @ best


class Words:
    """Landmark values of words, kept in a bounded table, and of the sentences made of them."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self._clear()

    def _clear(self) -> None:
        self.number = {"": 0, "\n": 1}
        self.row = np.zeros(1024, dtype=np.int64)        # of the word's values, 0 for none
        self.end = np.zeros(1024, dtype=bool)            # whether the word ends a sentence
        self.single = np.zeros(1024, dtype=bool)         # whether it is one letter
        self.end[1] = True
        self.values = [np.zeros(len(self.landmarks.strings))]
        self.rows: dict[bytes, int] = {}                 # of the values seen: words alike share one

    def _learn(self, fresh: list[str]) -> None:
        parts = [pieces(w) for w in fresh]
        found = self.landmarks.values(list({p for own in parts for p in own}))
        size = len(self.number)
        if (need := size + len(fresh)) > len(self.row):
            grow = max(need, 2 * len(self.row)) - len(self.row)
            self.row, self.end, self.single = (
                np.concatenate((a, np.zeros(grow, dtype=a.dtype))) for a in (self.row, self.end, self.single))
        for n, (word, own) in enumerate(zip(fresh, parts), size):
            self.number[word] = n
            self.end[n] = word.endswith(_ENDS)
            self.single[n] = len(own[0]) == 3
            if values := [found[p] for p in own if p in found]:
                most = np.max(values, axis=0)
                self.row[n] = self.rows.setdefault(most.tobytes(), len(self.values))
                if self.row[n] == len(self.values):
                    self.values.append(most)

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the features of its sentences that have one other than zero."""
        return [sentences for sentences, _, _ in self.described(texts)]

    def described(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each text the features of its sentences and of its different words, those that have
        one other than zero, and how many different words it has."""
        split = [(t.translate(_BLANKS) if "\t" in t or "\r" in t else t).replace("\n", " \n ").split(" ") for t in texts]
        known = self.number
        fresh = {w for tokens in split for w in tokens if w not in known}
        if fresh and len(known) + len(fresh) > KEPT_WORDS:
            self._clear()
            known = self.number
            fresh = {w for tokens in split for w in tokens if w not in known}
        self._learn(sorted(fresh))
        return [self._features(tokens) for tokens in split]

    def _features(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        at = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        rows = self.row[at]
        some = np.flatnonzero(rows)
        values = [self.values[r] for r in rows[some].tolist()]
        words = [self.values[r] for r in set(rows[some].tolist())]
        for place, value in self._spelled(tokens, at):
            if not any(np.array_equal(value, w) for w in words):
                words.append(value)
            some = np.append(some, place)
            values.append(value)
        different = len(set(tokens))
        if not values:
            none = np.empty((0, len(self.landmarks.strings)))
            return none, none, different
        values = np.array(values)
        number = np.concatenate(([0], np.cumsum(self.end[at])[:-1]))[some]
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order])) + 1
        return (np.array([_pooled(block) for block in np.split(values[order], cuts)]),
                np.array(words), different)

    def _spelled(self, tokens: list[str], at: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Values of runs of four or more letters written apart, at the run's first token."""
        single = self.single[at]
        if single.sum() < SHORTEST:
            return []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
        runs = [(s, e) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if e - s >= SHORTEST]
        if not runs:
            return []
        joined = {s: pieces("".join(letters(t) for t in tokens[s:e])) for s, e in runs}
        found = self.landmarks.values(list({p for own in joined.values() for p in own}))
        return [(s, np.max([found[p] for p in own if p in found], axis=0))
                for s, own in joined.items() if any(p in found for p in own)]


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: np.ndarray       # one per landmark, the whitening included
    bias: float
    slope: float
    shift: float
    constant: float | None = None
    #: The second curve: weights of the worst sentence and of what ``spread_of`` tells, and shift.
    spread: np.ndarray | None = None

    def scores(self, words: Words, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found = words.described(texts)
        # a sentence without any value counts as zero, every text has room for one
        worst = np.array([(f @ self.weights).max(initial=0.0) for f, _, _ in found])
        curve = self.slope * (worst + self.bias) + self.shift
        if self.spread is not None and len(found):
            x = np.array([spread_of(w @ self.weights, n) for _, w, n in found])
            curve = np.maximum(curve, np.column_stack((worst + self.bias, x)) @ self.spread[:-1] + self.spread[-1])
        return 1 / (1 + np.exp(-np.clip(curve, -50, 50)))

    def words(self) -> Words:
        return Words(Landmarks(self.landmarks))


def spread_of(words: np.ndarray, different: int) -> np.ndarray:
    """The decisions of a document's worst different words, in pairs of falling rank, as they are
    and over the logarithm of its number of different words."""
    best = np.sort(words[words > 0])[::-1][:2 * _PAIRS]
    pairs = np.pad(best, (0, 2 * _PAIRS - len(best))).reshape(_PAIRS, 2).sum(axis=1)
    return np.concatenate((pairs, pairs / max(1.0, math.log1p(different))))


def _strings(text: str) -> set[str]:
    """All letter strings of landmark length in the text's words."""
    found = set()
    for word in {p for t in set(text.split()) for p in pieces(t)}:
        for size in range(SHORTEST, LONGEST + 1):
            found.update(word[i:i + size] for i in range(len(word) - size + 1))
    return found


def choose_landmarks(sample: DataFrame, label: str, toxic: int, clean: int, most: int = LANDMARKS) -> tuple[str, ...]:
    """Strings that cover the toxic documents, greedily; a document counts half for each string
    that covers it already, and twice the share of clean documents is held against a string.
    Then come strings around these that clean documents hold more often."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for value, texts in rows.groupby(label)["text"]:
                seen = Counter(s for t in texts for s in _strings(t))
                yield pd.DataFrame({"string": list(seen), "label": value, "docs": list(seen.values())})

    counted = written(sample.mapInPandas(count, "string string, label int, docs long").groupBy("string").agg(
        F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("miss")), "strings")
    # less what chance alone may bring, so rare strings of a few long documents stay out
    gain = (F.col("hit") - 2 * F.sqrt("hit")) / float(toxic) - 2 * (F.col("miss") + 1) / float(clean)
    best = counted.withColumn("gain", gain).where("gain > 0").orderBy(
        F.desc("gain"), "string").limit(60 * most).collect()
    names = [r["string"] for r in best]
    against = np.array([2 * (r["miss"] + 1) / clean for r in best])
    place = {s: i for i, s in enumerate(names)}

    @F.pandas_udf("array<int>")
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(place[s] for s in _strings(t) if s in place) for t in texts])

    docs = sample.where(F.col(label) == 1).orderBy("doc_id").select(hits("text").alias("h")).collect()
    covers = np.zeros((len(docs), len(names)), dtype=np.float32)
    for i, r in enumerate(docs):
        covers[i, r["h"]] = 1
    worth, chosen, free = np.ones(len(docs)), [], np.ones(len(names), dtype=bool)
    while len(chosen) < most and len(names):
        gains = (worth @ covers - np.sqrt(worth ** 2 @ covers)) / max(1, len(docs)) - against * worth.mean()
        gains[~free] = -1
        # among nearly equal gains the longest string, it is the most particular
        if gains.max() <= 0:
            break
        near = np.flatnonzero(gains >= 0.95 * gains.max())
        top = max(near, key=lambda i: (len(names[i]), names[i]))
        chosen.append(top)
        # a string inside or around a chosen one says little more
        free &= np.array([names[top] not in n and n not in names[top] for n in names])
        worth = worth * (1 - 0.5 * covers[:, top])
    strings = [names[i] for i in chosen]
    if not strings:
        return ()
    around = F.lit(False)
    for string in strings:
        around = around | F.col("string").contains(string)
    excess = (F.col("miss") - 2 * F.sqrt("miss")) / float(clean) - F.col("hit") / float(toxic)
    beside = counted.where(around & ~F.col("string").isin(strings)).withColumn("excess", excess).where(
        "excess > 0").orderBy(F.desc("excess"), "string").limit(CLEAN_LANDMARKS).collect()
    return tuple(strings + [r["string"] for r in beside])


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 5.0) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    active = None
    for _ in range(40):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        own = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + c * own.T @ x[active], c * own.T @ y[active])
    return w


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: np.ndarray) -> np.ndarray:
    """Weights and shift of the logistic curve of labels 0 and 1 over columns, weighted to the share
    of label 1, by Newton steps."""
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sentence_curve(value: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Slope and shift over the worst sentence's decision, whose own bound is zero."""
    return _logistic(value[:, None], y, prior, np.full(2, 1e-2))


def _joint_curve(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Weights and shift over columns of any scale."""
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = _logistic((x - middle) / scale, y, prior, np.array([1e-1] * x.shape[1] + [1e-3]))
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * middle / scale).sum())


def fit(docs: DataFrame, labelled: DataFrame, label: str = "toxic", per_class: int = PER_CLASS,
        most: int = LANDMARKS) -> Model:
    """The model of documents and their (doc_id, label) rows, from a bounded sample of them."""
    python_ready(docs.sparkSession)
    picked, counts = sample_by(labelled, label, per_class)
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    constant = Model((), np.zeros(0), 0.0, 0.0, 0.0, prior)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    sizes = {r[label]: r["count"] for r in sample.groupBy(label).count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return constant
    strings = choose_landmarks(sample, label, sizes[1], sizes[0], most)
    if not strings:
        return constant
    landmarks = Landmarks(strings)
    values, vectors = np.linalg.eigh(landmarks.gram())
    white = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T

    @F.pandas_udf("struct<sentences binary, words binary, different int>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words(Landmarks(strings))
        for texts in batches:
            found = words.described(list(texts))
            yield pd.DataFrame({
                "sentences": [f.astype("<f4").tobytes() for f, _, _ in found],
                "words": [f.astype("<f4").tobytes() for _, f, _ in found], "different": [n for _, _, n in found]})

    rows = sample.select("doc_id", label, describe("text").alias("f")).select("doc_id", label, "f.*").collect()
    rows.sort(key=lambda r: (r[label], r["doc_id"]))
    matrix = lambda b: np.frombuffer(b, "<f4").reshape(-1, len(strings)).astype(float)
    # one zero row stands for a document's sentences without any landmark
    raw = [np.vstack((matrix(r["sentences"]), np.zeros(len(strings)))) for r in rows]
    spread = [(matrix(r["words"]), r["different"]) for r in rows]
    y = np.array([r[label] for r in rows])
    return _train(landmarks, raw, spread, y, white, prior)


def _train(landmarks: Landmarks, raw: list[np.ndarray], spread: list[tuple[np.ndarray, int]], y: np.ndarray,
           white: np.ndarray, prior: float) -> Model:
    """The model of the documents' sentence features, word features and labels, in rounds.

    Positive are the worst sentence of each toxic document, by the machine so far, its sentences
    that match a landmark clearly better than any sentence of a clean document does, and the
    landmarks that no clean sentence comes near, each as a sentence of its own.
    """
    known = np.max([h.max(axis=0) for h, v in zip(raw, y) if v == 0], axis=0)
    sure = [np.flatnonzero((h > known + 0.4).any(axis=1)) for h, v in zip(raw, y) if v == 1]
    held = [h @ white for h in raw]
    clean = np.vstack([h for h, v in zip(held, y) if v == 0])
    toxic = [h for h, v in zip(held, y) if v == 1]
    worst = [int(np.argmax(h.sum(axis=1))) for h, v in zip(raw, y) if v == 1]
    alone = landmarks.gram()[known < 0.9] @ white
    w = None
    for _ in range(_ROUNDS):
        hits = np.vstack([h[np.union1d(s, [i]).astype(int)] for h, s, i in zip(toxic, sure, worst)])
        x = np.vstack((hits, alone, clean))
        sign = np.concatenate((np.ones(len(hits) + len(alone)), -np.ones(len(clean))))
        weight = np.concatenate((np.full(len(hits), 1 / len(hits)), np.full(len(alone), 1 / max(1, len(alone))),
                                 np.full(len(clean), 1 / len(clean)))) * len(toxic)
        w = _machine(x, sign, weight)
        again = [int(np.argmax(h @ w[:-1])) for h in toxic]
        if again == worst:
            break
        worst = again
    top = np.array([(h @ w[:-1]).max() for h in held])
    weights = white @ w[:-1]
    x = np.column_stack((top + w[-1], [spread_of(f @ weights, n) for f, n in spread]))
    pass_, clean = math.log(THRESHOLD / (1 - THRESHOLD)), y == 0
    # a worst sentence decides by itself only above all clean documents of the sample
    alone = _sentence_curve(x[:, 0], y, prior)
    alone[-1] += min(0.0, pass_ - float((x[clean, 0] * alone[0] + alone[-1]).max()) - 1e-9)
    # beside it labels are weighted up to evenly, as far as few of those documents pass
    curve = _joint_curve(x, y, prior)
    room = pass_ - float(np.quantile(x[clean] @ curve[:-1] + curve[-1], 1 - CLEAN_PASSES, method="higher")) - 1e-9
    curve[-1] += min(max(room, 0.0), max(math.log((1 - prior) / prior), 0.0))
    return Model(landmarks.strings, weights, float(w[-1]), float(alone[0]), float(alone[-1]), None, curve)


def with_score(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """Documents with the score of their whole text in a new column."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _kept_words(shared.value)
        for texts in batches:
            yield pd.Series(shared.value.scores(words, list(texts)))

    return docs.withColumn(score, judge(text_of()))


_worker: dict[tuple, Words] = {}


def _kept_words(model: Model) -> Words:
    """The worker's table for this model; a table of another model is let go."""
    key = (model.landmarks, model.weights.tobytes())
    if key not in _worker:
        _worker.clear()
        _worker[key] = model.words()
    return _worker[key]


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, clear_labels(labels, "toxic").where(fold("doc_id", 3) != 1))
    rows = with_score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
