"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of cells holds a bit per language. An n-gram of a language sets that language's bit
in its cells; the AND of an n-gram's cells is therefore the set of all languages that contain
it, found by one probe however many languages there are. A text's n-grams are probed, the bits
counted per language, and each count corrected by the share of foreign n-grams that would hit
the language's bits by chance; the largest corrected count decides.

The filter is fitted on about ``PER_LANGUAGE`` documents of each language, chosen by the hash
of their id, whole texts. An n-gram belongs to a language if at least ``LEAST_DOCS`` of
those contain it and its rate there is at least ``SHARE`` of its highest rate in any language,
so stray foreign lines do not spread into every filter.

Defined cases: null text and text without a letter are ``und`` with score 0; a text whose
n-grams hit no language takes the most frequent training language, scored by its share; ties
go to the language first in alphabetical order; documents with a null lang teach nothing;
without any training row every text is ``und``; an empty table gives no row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fold, sample_by, python_ready, text_of

GRAM = 4
PER_LANGUAGE = 500
LEAST_DOCS = 3
SHARE = 0.15
HASHES = 3
#: Cells per n-gram, and the most cells a table may have.
CELLS_PER_GRAM = 16
MOST_CELLS = 1 << 22
UNKNOWN = "und"
_PIECE = 1 << 16

_ODD = np.random.default_rng(20).integers(1 << 62, size=GRAM + HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams with at least two letters or one beside a blank, in bounded pieces.

    Letters are lower-cased, all else counts as a blank, two blanks stand at either end.
    """
    points = np.frombuffer(("  " + text.lower() + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return
    values = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    for at in range(0, len(values) - GRAM + 1, _PIECE):
        part, own = values[at:at + _PIECE + GRAM - 1], letter[at:at + _PIECE + GRAM - 1]
        n = len(part) - GRAM + 1
        hashes, some = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        for k in range(GRAM):
            hashes += part[k:k + n] * _ODD[k]
            some |= own[k:k + n]
        if some.any():
            yield hashes[some]


def _cells(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mixed = hashes ^ (hashes >> np.uint64(29))
    for odd in _ODD[GRAM:]:
        yield (mixed * odd) >> np.uint64(64 - bits)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    shares: np.ndarray        # of the training rows
    bits: int                 # the table has 2 ** bits cells
    table: np.ndarray         # cells x words of 64 languages
    chance: np.ndarray        # chance that a foreign n-gram hits each language

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        total, found = 0, np.zeros(len(self.languages), dtype=np.int64)
        for hashes in grams(text):
            total += len(hashes)
            masks = None
            for cells in _cells(hashes, self.bits):
                masks = self.table[cells] if masks is None else masks & self.table[cells]
            for l in range(len(self.languages)):
                found[l] += np.count_nonzero(masks[:, l // 64] & np.uint64(1 << (l % 64)))
        return total, found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, found = self.counts(text)
        if not total:
            return UNKNOWN, 0.0
        true = np.clip((found - total * self.chance) / np.maximum(1 - self.chance, 1e-9), 0, None)
        if not true.any():
            best = int(np.argmax(self.shares))
            return self.languages[best], float(self.shares[best])
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum())


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], docs: dict[str, int]) -> Model:
    """The model of each language's n-gram hashes and the number of documents that hold them."""
    languages = tuple(sorted(docs))
    shares = np.array([docs[l] for l in languages], dtype=np.float64)
    shares /= max(shares.sum(), 1)
    every = np.unique(np.concatenate([counts[l][0] for l in languages if l in counts] or [np.empty(0, np.uint64)]))
    rate = np.zeros((len(languages), len(every)))
    seen = np.zeros_like(rate)
    for i, l in enumerate(languages):
        if l in counts:
            at = np.searchsorted(every, counts[l][0])
            seen[i, at] = counts[l][1]
            rate[i] = seen[i] / docs[l]
    need = np.array([min(LEAST_DOCS, max(1, docs[l] // 4)) for l in languages])[:, None] if languages else 0
    member = (seen >= need) & (rate >= SHARE * rate.max(axis=0, initial=0)) if languages else seen > 0
    size = max(1, int(member.any(axis=0).sum()) if languages else 1)
    bits = int(np.clip(np.ceil(np.log2(CELLS_PER_GRAM * size)), 8, np.log2(MOST_CELLS)))
    table = np.zeros((1 << bits, (len(languages) + 63) // 64 or 1), dtype=np.uint64)
    for i in range(len(languages)):
        for cells in _cells(every[member[i]], bits):
            table[cells, i // 64] |= np.uint64(1 << (i % 64))
    fill = np.array([np.count_nonzero(table[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(languages))])
    return Model(languages, shares, bits, table, (fill / (1 << bits)) ** HASHES)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of documents with text and lang; counts n-grams of the sample in Spark."""
    python_ready(docs.sparkSession)
    taught = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sample, _ = sample_by(taught, "lang", per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lang, texts in rows.groupby("lang")["text"]:
                held = [np.unique(np.concatenate(g)) for t in texts if (g := list(grams(t)))]
                if held:
                    values, docs_with = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": values.view(np.int64), "docs": docs_with})

    found = (sample.mapInPandas(count, "lang string, gram long, docs long").groupBy("lang", "gram")
             .agg(F.sum("docs").alias("docs")).toPandas())
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {l: (g["gram"].to_numpy().view(np.uint64), g["docs"].to_numpy()) for l, g in found.groupby("lang")}
    return build(counts, sizes)


def with_language(docs: DataFrame, model: Model, name: str = "found") -> DataFrame:
    """Documents with a struct (lang, score) of their whole text."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(name, predict(text_of()))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; fitted on the rows whose fold is not held out."""
    own = docs.select("doc_id", "text", "lang")
    model = fit(own.where(fold("doc_id", 3) != 1))
    return with_language(own.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
