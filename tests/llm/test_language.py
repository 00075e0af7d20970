import os

import numpy as np
import pytest

from proofmill.llm import language
from proofmill.llm.common import table

SF = "/root/testdata/sf0.1"
EN = "the house and the garden were quiet that morning before the others woke up"
DE = "das haus und der garten waren still an jenem morgen bevor die anderen aufwachten"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = language.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr(
        "avg(cast(lang_pred = lang as double)) hit", "count(*) n", "min(score) lo", "max(score) hi").first()
    assert got["n"] > 3000 and got["hit"] >= 0.98 and 0 <= got["lo"] and got["hi"] <= 1


def plain_grams(text):
    text = "  " + "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
    return [text[i:i + 4] for i in range(len(text) - 3) if text[i:i + 4].strip()]


@pytest.mark.parametrize("text", ["Ab c", "é!", "x" * 200, EN * 3000, "a1b", "Straße, 12"])
def test_grams_by_their_definition(text):
    got = np.concatenate(list(language.grams(text)))
    plain = plain_grams(text)
    assert len(got) == len(plain) and len(set(got.tolist())) == len(set(plain))


def model_of(texts):
    counts, sizes = {}, {}
    for lang, own in texts.items():
        values, n = np.unique(np.concatenate([np.unique(np.concatenate(list(language.grams(t)))) for t in own]), return_counts=True)
        counts[lang], sizes[lang] = (values, n), len(own)
    return language.build(counts, sizes)


def test_filters_hold_every_gram_of_every_language_and_counts_are_corrected():
    names = [f"l{i:02d}" for i in range(70)]
    rng = np.random.default_rng(5)
    texts = {n: ["".join(rng.choice(list("abcdefghij ") + [chr(0x400 + i)], 400)) for _ in range(4)] for i, n in enumerate(names)}
    model = model_of(texts)
    assert model.table.shape[1] == 2
    for i in (0, 63, 64, 69):
        total, found = model.counts(texts[names[i]][0])
        assert model.predict(texts[names[i]][0])[0] == names[i]
        assert 0 < found[i] <= total


def test_odd_rows(spark, documents):
    rows = [(i, EN + f" number {i}", "en") for i in range(30)] + [(100 + i, DE, "de") for i in range(30)]
    odd = [(500, None, "en"), (501, "", "de"), (502, "123 !!", "en"), (503, EN, None), (503, EN, None), (None, DE, "de"),
           (504, DE * 2000, "en"), (505, "ж", None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows + odd],
                                 "doc_id long, text string, lang string, lang_pred string, found string")
    got = [r.asDict() for r in language.predicted(docs).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert [by[i]["lang_pred"] for i in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "en", "de", "de"]
    assert by[505]["lang_pred"] in ("en", "de") and by[500]["score"] == 0
    assert language.predicted(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.predicted(docs.where("lang is null")).collect()} == {"und"}
