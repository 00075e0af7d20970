"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

The terms of a text are trigrams over character classes of its UTF-8 bytes, and the ways
neighbouring words and lines repeat. Term weights are square roots of relative frequencies
times an inverse document frequency. A singular value decomposition of a bounded sample of
labelled documents (``PER_CLASS`` of each label) gives the latent space; the labelled vectors
are broadcast, and every document takes the exact cosine with every one of them, in blocks.
The ``NEIGHBOURS`` most similar vote with their similarity as weight.

Defined cases: null and empty texts and texts without a term have no direction; they score
the share of label 1 among all training labels; ties in similarity go to the earlier labelled
row, by label and id; repeated rows get equal scores; without a labelled row
every score is 0.5; a sample of one label scores that label; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import clear_labels, fold, sample_by, python_ready, text_of

#: Labelled documents of each label, about, that the model is fitted on.
PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Documents whose cosines are taken in one matrix product.
BLOCK = 512

_CLASSES = 32
_REPEATS = 8
TERMS = _CLASSES ** 3 + _REPEATS


def _byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, non-ASCII, punctuation by sign."""
    table = np.full(256, 5, dtype=np.uint8)
    table[list(range(97, 123))] = 0
    table[list(range(65, 91))] = 1
    table[list(range(48, 58))] = 2
    table[[9, 11, 12, 32]] = 3
    table[[10, 13]] = 4
    table[list(range(0, 9)) + list(range(14, 32)) + [127]] = 6
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[signs] = 7 + np.arange(len(signs)) % (_CLASSES - 7)
    return table


_CLASS_OF = _byte_classes()


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and square roots of their relative frequencies."""
    data = _CLASS_OF[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)].astype(np.int32)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    grams = (data[:-2] * _CLASSES + data[1:-1]) * _CLASSES + data[2:]
    counts = np.bincount(grams, minlength=TERMS).astype(np.float32)
    words = text.split()
    same = sum(map(str.__eq__, words, words[1:]))
    near = sum(map(str.__eq__, words, words[2:]))
    lines = text.split("\n")
    repeats = len(lines) - len(set(lines))
    distinct = len(set(words)) / max(1, len(words))
    n = max(1, len(words) - 1)
    counts /= len(grams)
    # shares of repeating neighbours stand beside the trigrams as terms of their own
    counts[_CLASSES ** 3:_CLASSES ** 3 + 5] = (
        same / n, near / n, repeats / len(lines), max(0.0, 0.5 - distinct) if len(words) > 20 else 0.0, 0.0)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at])


@dataclass(frozen=True)
class Model:
    """Latent space, labelled vectors and their labels; bounded by its parameters."""

    project: np.ndarray      # TERMS x dimensions, inverse document frequencies included
    vectors: np.ndarray      # labelled x dimensions, of length one
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]), dtype=np.float32)
        for i, text in enumerate(texts):
            at, weight = terms(text)
            if len(at):
                out[i] = weight @ self.project[at]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        found = np.full(len(texts), self.prior)
        if not len(self.labels):
            return found
        vectors = self.embed(texts)
        lengths = np.linalg.norm(vectors, axis=1)
        for start in range(0, len(texts), BLOCK):
            rows = start + np.flatnonzero(lengths[start:start + BLOCK] > 1e-12)
            if not len(rows):
                continue
            cosines = (vectors[rows] / lengths[rows, None]) @ self.vectors.T
            k = min(self.neighbours, cosines.shape[1])
            nearest = np.argsort(-cosines, axis=1, kind="stable")[:, :k] if cosines.shape[1] <= 64 else _top(cosines, k)
            weight = np.clip(np.take_along_axis(cosines, nearest, axis=1), 1e-6, None).astype(np.float64)
            found[rows] = (weight * self.labels[nearest]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(found, 0.0, 1.0)


def _top(cosines: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest per row; among equals at the edge the smaller column."""
    edge = -np.partition(-cosines, k - 1, axis=1)[:, k - 1:k]
    above = cosines > edge
    equal = cosines == edge
    room = k - above.sum(axis=1, keepdims=True)
    take = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(take)[1].reshape(len(cosines), k)


def fit(docs: DataFrame, labelled: DataFrame, label: str = "quality", per_class: int = PER_CLASS,
        dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """The model of documents and their (doc_id, label) rows: all count for the prior, a bounded
    sample of them brings its texts."""
    python_ready(docs.sparkSession)
    picked, counts = sample_by(labelled, label, per_class)
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5

    @F.pandas_udf("struct<at:binary,weight:binary>")
    def featurize(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [terms(t) for t in texts]
            yield pd.DataFrame({"at": [a.astype("<i4").tobytes() for a, _ in found],
                                "weight": [w.astype("<f4").tobytes() for _, w in found]})

    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    rows = sample.select("doc_id", label, featurize("text").alias("f")).collect()
    rows.sort(key=lambda r: (r[label], r["doc_id"]))
    at = [np.frombuffer(r["f"]["at"], "<i4") for r in rows]
    used = np.unique(np.concatenate(at)) if at else np.empty(0, np.int64)
    # only terms that some sampled document has get a column
    matrix = np.zeros((len(rows), len(used)), dtype=np.float32)
    for i, r in enumerate(rows):
        matrix[i, np.searchsorted(used, at[i])] = np.frombuffer(r["f"]["weight"], "<f4")
    keep = (matrix > 0).any(axis=1)
    matrix, labels = matrix[keep], np.array([r[label] for r in rows], dtype=np.float64)[keep]
    del rows, at
    if not len(labels):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior, neighbours)
    idf = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 1
    matrix *= idf
    # the small side's Gram matrix gives the singular vectors
    values, left = np.linalg.eigh((matrix @ matrix.T).astype(np.float64))
    top = np.argsort(-values)[:dimensions]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-30)]
    right = matrix.T @ (left[:, top] / np.sqrt(values[top])).astype(np.float32)
    project = np.zeros((TERMS, len(top)), dtype=np.float32)
    project[used] = right * idf[:, None]
    vectors = matrix @ right
    lengths = np.linalg.norm(vectors, axis=1)
    keep = lengths > 1e-12
    return Model(project, (vectors[keep] / lengths[keep, None]).astype(np.float32), labels[keep], prior, neighbours)


def with_score(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """Documents with the score of their whole text in a new column."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(list(texts)))

    return docs.withColumn(score, judge(text_of()))


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) outside the held-out fold."""
    return clear_labels(labels, "quality").where(fold("doc_id", 4) != 2)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, training_rows(labels))
    rows = with_score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns only."""
    model = fit(docs, training_rows(labels))
    kept = with_score(docs, model, "__quality_score").where(F.col("__quality_score") >= threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
