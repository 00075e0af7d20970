import os

import numpy as np
import pytest

from proofmill.llm import quality
from proofmill.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels").where("quality is not null")
    got = quality.judged(table(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out")
    hits = got.selectExpr("predicted = quality hit", "quality").collect()
    for label in (0, 1):
        own = [r["hit"] for r in hits if r["quality"] == label]
        assert len(own) > 50 and np.mean(own) >= 0.97


def test_exact_cosines_in_blocks_match_a_plain_vote():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab .A!%\n"), 60)) for _ in range(700)]
    model = quality.Model(rng.normal(size=(quality.TERMS, 6)).astype(np.float32),
                          (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(90, 6))).astype(np.float32),
                          rng.integers(0, 2, 90).astype(float), 0.4)
    got = model.scores(texts)
    for i in (0, 511, 512, 699):
        v = model.embed([texts[i]])[0].astype(np.float64)
        cos = model.vectors.astype(np.float64) @ (v / np.linalg.norm(v))
        near = np.argsort(-cos, kind="stable")[:model.neighbours]
        w = np.clip(cos[near], 1e-6, None)
        assert got[i] == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-4)


def test_ties_take_the_earlier_row():
    cosines = np.array([[.5, .9, .5, .5, .1]], dtype=np.float32)
    assert quality._top(cosines, 3).tolist() == [[0, 1, 2]]


def test_odd_rows(spark, documents):
    good = [(i, f"Plain words and more words number {i}. They go on.") for i in range(30)]
    bad = [(100 + i, "%%% ### $$$ %%% " * 5 + str(i)) for i in range(30)]
    docs = documents(good + bad + [(500, None), (501, ""), (502, "ab"), (None, "x y"), (1, good[1][1])],
                     extra=("score", "quality"))
    labels = spark.createDataFrame(
        [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(1, 1, 0), (2, 0, 1), (None, 0, 0), (3, None, 1)],
        "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == 64 and got[120]["predicted"] == 0 and got[20]["predicted"] == 1
    assert got[500]["score"] == got[501]["score"] == got[502]["score"]
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _ in good}
    none = quality.judged(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert quality.judged(documents([]), labels).count() == 0
