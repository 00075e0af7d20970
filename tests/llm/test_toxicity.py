import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from proofmill.llm import toxicity as T
from proofmill.llm.common import table

SF = "/root/testdata/sf0.1"
WORDS = st.text(alphabet="abcdé^$z", min_size=3, max_size=10)


def brute_kernel(a, b):
    """Weighted common subsequences of length three by listing every position triple."""
    def dot(x, y):
        return sum(T.DECAY ** (i[2] - i[0] + j[2] - j[0] + 2)
                   for i in itertools.combinations(range(len(x)), 3) for j in itertools.combinations(range(len(y)), 3)
                   if all(code(x[p]) == code(y[q]) for p, q in zip(i, j)))
    code = lambda c: int(T._codes(c)[0])
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if dot(a, b) else 0.0


@settings(max_examples=25, deadline=None)
@given(WORDS, WORDS)
def test_kernel_by_its_definition(a, b):
    assert T.kernel(a, b) == pytest.approx(brute_kernel(a, b))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abct^$", min_size=1, max_size=14), max_size=8),
       st.lists(st.text(alphabet="abct^$", min_size=4, max_size=7), min_size=1, max_size=4, unique=True))
def test_the_bound_drops_no_word_above_the_cut(words, landmarks):
    found = T.Landmarks(tuple(landmarks)).values(words)
    for word in words:
        want = [T.word_kernel(word, l) if len(word) >= 3 else 0.0 for l in landmarks]
        assert np.allclose(found.get(word, np.zeros(len(landmarks))), want)


def test_gaps_and_inserted_letters_lower_the_kernel_gently():
    at = lambda w: T.word_kernel(T.pieces(w)[0], "^idiot$")
    assert at("idiot") == at("IDIOT!!") == at("i.d-i*o_t") == at("1d10t") == pytest.approx(1)
    assert 1 > at("idixot") > at("table") and 1 > at("idioot") > .3 and at("table") == 0


def model(landmarks=("^idiot$", "^scum$")):
    return T.Model(landmarks, np.full(len(landmarks), 2.0), -1.0, 3.0, 0.0)


def test_worst_sentence_decides_and_words_count_once():
    m = model()
    one, two, many, spelled, none = m.scores(m.words(), [
        "a good day. you idiot there", "idiot\nscum idiot scum.", "idiot " * 500, "so i d i o t it was", ""])
    assert none < .1 and one == many == spelled and one == pytest.approx(1 / (1 + math.exp(-3)))
    assert two == pytest.approx(1 / (1 + math.exp(-9)))          # two landmarks in one sentence


def test_results_do_not_depend_on_what_a_worker_has_kept(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("idots um.\n"), 300)) + " idiot" for _ in range(30)] + ["x" * 5000 + "idiot" * 3]
    fresh = [float(model().scores(model().words(), [t])[0]) for t in texts]
    monkeypatch.setattr(T, "KEPT_WORDS", 60)
    m = model()
    assert np.allclose(m.scores(m.words(), texts), fresh)
    words = m.words()
    assert np.allclose([float(m.scores(words, [t])[0]) for t in texts], fresh)


def test_held_out_accuracy(spark):
    """A few of these toxic documents hold nothing but junk; of the others nearly all are found."""
    docs, labels = table(spark, SF, "documents").repartition(8), table(spark, SF, "labels").where("toxic is not null")
    got = T.judged(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in got if r["toxic"] == 1]
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert len(toxic) > 100 and np.mean(toxic) > .9 and np.mean(clean) <= .01


def test_several_different_words_tell_more_than_one():
    m = T.Model(("^idiot$", "^scum$"), np.full(2, 2.0), -1.0, 1.0, -9.0, None, np.array([1.0] * 7 + [-2.0]))
    one, again, apart, long = m.scores(m.words(), [
        "an idiot.", "an idiot. an idiot. an idiot.", "an idiot. a scum.", "an idiot. " + " ".join(f"w{i}" for i in range(500))])
    assert one == again < apart and long < one
    assert T.spread_of(np.array([.5, -1, 2, 1, 1]), 9).tolist() == pytest.approx([3, 1.5, 0, 3 / math.log(10), 1.5 / math.log(10), 0])
    assert T.spread_of(np.zeros(0), 0).tolist() == [0] * 6


def test_the_threshold_keeps_clean_documents_out_where_labels_overlap():
    """Shifted towards even labels, but no further than few clean documents of the sample pass."""
    rng, marks = np.random.default_rng(3), T.Landmarks(("^idiot$", "^scum$"))
    y = np.array([1] * 60 + [0] * 600)
    level = np.where(y == 1, 1.0, 0.0) + rng.normal(scale=.3, size=len(y))
    raw = [np.array([[max(v, 0), 0], [0, 0]]) for v in level]
    m = T._train(marks, raw, [(r[:1], 5) for r in raw], y, np.eye(2), 60 / 660)
    worst = np.array([(r @ m.weights).max() for r in raw])
    x = np.column_stack((worst + m.bias, [T.spread_of(r[:1] @ m.weights, 5) for r in raw]))
    curve = np.maximum(m.slope * x[:, 0] + m.shift, x @ m.spread[:-1] + m.spread[-1])
    passes = curve >= math.log(.7 / .3)
    assert passes[y == 0].mean() <= T.CLEAN_PASSES + 1e-9 and passes[y == 1].mean() > .3


def test_odd_rows(spark, documents):
    clean = [(i, f"plain words about number {i} and the weather. It goes on\nand on") for i in range(60)]
    toxic = [(100 + i, f"plain words about {i}. you are a gribbel there, scum") for i in range(60)]
    docs = documents(clean + toxic + [(500, None), (501, ""), (502, "a gribbel"), (None, "gribbel scum"), (503, "one fine day")],
                     extra=("score", "label"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic] +
                                   [(1, 1, 0), (3, 0, None), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = T.judged(docs, labels).collect()
    got = {r["doc_id"]: r["predicted"] for r in rows}
    assert len(rows) == 125 and got[500] == got[501] == got[503] == got[20] == 0
    assert got[120] == got[None] == 1
    assert {r["score"] for r in T.judged(docs, labels.limit(0)).collect()} == {.5}
    assert T.judged(documents([]), labels).count() == 0


def test_the_fit_reads_every_sentence_with_a_feature(spark, documents, monkeypatch):
    docs = [(i, f"the quiet river number{i} runs.") for i in range(20)]
    docs += [(i, "you glorbnak here. " * (60 if i == 25 else 1)) for i in range(20, 30)]
    labels = spark.createDataFrame([(i, int(i >= 20)) for i, _ in docs], "doc_id long, toxic int")
    seen, train = [], T._train
    monkeypatch.setattr(T, "_train", lambda marks, raw, *rest: (seen.extend(raw), train(marks, raw, *rest))[1])
    T.fit(documents(docs), labels)
    # sixty sentences and the zero row
    assert max(map(len, seen)) == 61
