import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from proofmill.llm import packing

PARTS = packing.PartIds(packing.vocabulary_path(), kept=20)
WHOLE = Tokenizer.from_file(packing.vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(
    ["The end.", "don't", "İstanbul.", "áb", " ̈x", "x y", "\x1c", "ΑΣ.", "<|endoftext|>", "ﬁ.,", "A.B",
     "ñó,", "１２", "x,!!", "Ñ|", "a<|endoftext|>b", "it's!", "Ĳ.", "ŉ", "tab\there", "cr\r\n"])), max_size=6))
def test_ids_by_parts_equal_ids_of_the_whole_text(parts):
    for text in (" ".join(parts), "\n".join(parts), "".join(parts)):
        found = PARTS.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", (7, 2048))
def test_pieces_tile_every_document_and_window(documents, length):
    texts = [(i, t) for i, t in enumerate(
        ["", None, "one two three", "the end. " * 900, "x", "x", "Über, naïve", "a" * 9000])] + [(3, "again"), (None, "no id")]
    docs = documents(texts, extra=("ids", "part", "at", "start")).repartition(3)
    cut = packing.pieces(docs, length).collect()
    by_doc = {}
    for p in cut:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"], p["sequence_id"] * length + p["offset"] - p["start"]), []).append(p)
    assert len(by_doc) == len(texts)
    want = sorted(WHOLE.encode(t or "", add_special_tokens=False).ids + [1] for _, t in texts)
    got = []
    for key, ps in by_doc.items():
        ps.sort(key=lambda p: p["start"])
        assert [p["start"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps])[:-1].tolist()
        assert sum(p["length"] for p in ps) == key[1] and all(len(p["ids"]) == 4 * p["length"] for p in ps)
        got.append(np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").tolist())
    assert sorted(got) == want
    lines = sorted((p["sequence_id"], p["offset"], p["length"]) for p in cut)
    at = 0
    for seq, offset, size in lines:
        assert seq * length + offset == at and offset + size <= length
        at += size
    assert at == sum(map(len, want))


def test_sequences_are_padded_at_the_end_only(documents):
    docs = documents([(1, "one two three four"), (2, "five")])
    rows = packing.sequences(packing.pieces(docs, 4), 4, pad_id=7).orderBy("sequence_id").collect()
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in rows]
    assert [len(i) for i in ids] == [4] * len(ids) and sum(r["n_tokens"] for r in rows) == 7
    assert ids[-1][-1] == 7


def test_digest_and_empty_table(documents):
    row = packing.piece_rows(documents([(5, "hello")])).first()
    ids = np.array(WHOLE.encode("hello", add_special_tokens=False).ids + [1], "<u4")
    assert row["ids_crc32"] == zlib.crc32(ids.tobytes()) and row["doc_id"] == 5
    assert packing.piece_rows(documents([])).count() == 0
