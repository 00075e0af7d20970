import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from proofmill.llm import piece_codec as P


def proto(kind, prefix=True):
    spec = pb.ModelProto()
    spec.ParseFromString(open(P.vocabulary_path(), "rb").read())
    spec.trainer_spec.model_type = kind
    spec.normalizer_spec.add_dummy_prefix = prefix
    if kind == 1:
        # scores like a unigram model's, from the order of the pieces
        for i, piece in enumerate(spec.pieces):
            piece.score = 0.0 if piece.type != 1 else -2.0 - np.log1p(i) - 1e-4 * (i * 7919 % 997)
    return spec.SerializeToString()


CASES = {name: (P.Codec(P.Model(proto=p), kept=2000), sentencepiece.SentencePieceProcessor(model_proto=p))
         for name, p in (("bpe", proto(2)), ("unigram", proto(1)))}
ODD = ["", " ", "  a  b\n c", "a\n\nb", " \n ", "▁x", "x▁▁y", "tab\there", "Ⅷ ﬁ é", "日本語テキスト", "🙂🙂 ok", "a" * 70,
       "The quick brown fox, naïve façade.", "    four", "end ", "internationalization's", "\x00\x01", "１２３ 4567 89", "İß ŉ", "=====----",
       "aaaa aaaaa aaaaaa", "ß" * 30, "́x", "ab​cd"]


def ids(codec, text):
    return np.frombuffer(codec.encode([text])[0], "<u4").tolist()


def same(codec, got, want):
    """Equal ids, or for a unigram model, whose sums may tie, equal sums of the same text."""
    if codec.model.kind == 2 or got == want:
        return got == want
    score = np.where(np.isfinite(codec.model.score), codec.model.score, 0.0)
    return codec.decode(np.array(got, "<u4").tobytes()) == codec.decode(np.array(want, "<u4").tobytes()) and \
        abs(score[got].sum() - score[want].sum()) < 1e-3


@pytest.mark.parametrize("name", CASES)
def test_ids_equal_the_library_on_odd_texts(name):
    codec, library = CASES[name]
    for text in ODD:
        assert same(codec, ids(codec, text), library.encode(text)), text
        assert codec.decode(codec.encode([text])[0]) == text.replace(P.BLANK, " ")


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text(alphabet="thereinos ", max_size=25), st.sampled_from(ODD)), max_size=5).map("".join))
def test_ids_equal_the_library(text):
    for codec, library in CASES.values():
        assert same(codec, ids(codec, text), library.encode(text))
        assert codec.decode(codec.encode([text])[0]) == text.replace(P.BLANK, " ")


def test_ids_equal_the_library_on_many_made_up_words():
    rng = random.Random(6)
    bits = "th re in er an on ing tion ed the ción mente que ich ung sch eau ment è é ß ñ ou . , ! % A Th Re".split()
    texts = [" ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(60)) for _ in range(120)]
    for codec, library in CASES.values():
        for text, got in zip(texts, codec.encode(texts)):
            assert same(codec, np.frombuffer(got, "<u4").tolist(), library.encode(text))


def test_what_may_follow():
    """The seam test agrees with encoding the two strings together, on random pairs of pieces."""
    model, rng = CASES["bpe"][0].model, random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto(2, prefix=False))
    pool = [i for i in model.ids.tolist() if i < model.strange and not model.text[i].startswith(P.BLANK) and len(model.text[i]) < 7]
    pairs = [(rng.choice(pool), rng.choice(pool)) for _ in range(3000)]
    got = model.may_follow(*map(np.array, zip(*pairs)))
    for (a, b), fits in zip(pairs, got):
        both = library.encode(model.text[a] + model.text[b])
        assert (both == [a, b]) == bool(fits)


def test_rows(documents):
    texts = [(1, "one two"), (2, None), (3, ""), (4, "x " * 30_000), (4, "one two"), (None, "é🙂\n")]
    docs = documents(texts, extra=("ids", "back"))
    library = CASES["bpe"][1]
    got = sorted(((r["doc_id"], r["n_ids"], r["ids_crc32"], r["text_sha256"], r["round_trip"]) for r in P.digest_rows(docs).collect()), key=repr)
    want = [(i, len(e := library.encode(t or "")), zlib.crc32(np.array(e, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True)
            for i, t in texts]
    assert got == sorted(want, key=repr)
    assert P.digest_rows(documents([])).count() == 0


def test_other_models_are_refused():
    spec = pb.ModelProto()
    spec.ParseFromString(proto(2))
    spec.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError):
        P.Model(proto=spec.SerializeToString())
