import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from proofmill.llm import suffix_dedup as sd

W = sd.WINDOW
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows):
    """Every window looked up among all that start earlier."""
    seen, out = {}, []
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    result = {}
    for doc in docs:
        data = doc[1].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - W + 1):
            if seen.setdefault(data[p:p + W], (doc, p)) != (doc, p):
                gone[p:p + W] = b"\1" * W
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        result[doc] = (doc[0], len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    for i, t in rows:
        out.append(result[i, t or ""])
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "ß", "ax"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passage, line, long = prose(rng, 60), prose(rng, 14), prose(rng, 3000)
    texts = [prose(rng, rng.randrange(120)) for _ in range(25)]
    texts += [f"{prose(rng, rng.randrange(20))} {passage[rng.randrange(90):]} {prose(rng, 9)}" for _ in range(8)]
    texts += [f"{prose(rng, 25)}\n{line}\n{prose(rng, 25)}" for _ in range(30)]  # a line shorter than a window
    texts += [texts[3]] * 4 + ["a" * 450, "a" * 1300, "ab" * 300, "", None, "x" * 99, "x" * 100, "x" * 100, long, long[2000:9000] + "é"]
    texts += [("".join(rng.choices("abcdefgh", k=n)) * 6)[:170] for n in (3, 17, 50, 61, 68, 69, 70)]  # periods of one text
    near = list(prose(rng, 90))
    for _ in range(6):
        copy = near.copy()
        copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    rng.shuffle(texts)
    return [*enumerate(texts), (None, passage), (3, texts[3])]


@pytest.mark.parametrize("seed,hot", [(1, sd.HOT), (2, 6), (3, 1)])
def test_rows_equal_brute_force(documents, seed, hot):
    rows = corpus(seed)
    docs = documents(rows, extra=("id", "tie", "m", "bytes", "spans")).repartition(6)
    got = sd.digest_rows(docs, hot).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_pieces_of_long_texts(documents, monkeypatch):
    monkeypatch.setattr(sd, "PORTION", 700)
    rng = random.Random(8)
    long = prose(rng, 2000)
    for text in (long, long[:800], long[:799], "y" * 700):
        cover = []
        for data, starts, ends, ids, ties, bases in sd._pieces([1], [2], [5], [text.encode()]):
            start, windows, *_ = sd.cut(sd.Hashes(data), starts, ends, 32)
            piece = np.searchsorted(starts, start, "right") - 1
            cover += [p for b, n in zip(bases[piece] + start - starts[piece], windows) for p in range(b, b + n)]
        assert cover == list(range(5, 5 + len(text.encode()) - W + 1))


def test_equal_windows_have_equal_keys_under_every_gram():
    rng = random.Random(4)
    passage = prose(rng, 50)
    data = f"{prose(rng, 40)}{passage}{prose(rng, 40)}|{passage}zz{passage[7:]}{'q' * 300}".encode()
    for k in sd.GRAMS:
        start, windows, key, _ = sd.cut(sd.Hashes(data), np.array([0]), np.array([len(data)]), k)
        keys = dict(zip(sd._ragged(start, windows).tolist(), np.repeat(key, windows).tolist()))
        assert sorted(keys) == list(range(len(data) - W + 1))
        by_window = {}
        for p, value in keys.items():
            assert by_window.setdefault(data[p:p + W], value) == value


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=60), st.sampled_from([b"a" * 130, b"ab" * 70, b"abc" * 60])), min_size=1, max_size=8),
       st.integers(0, 2))
def test_suffix_sort_orders_by_the_first_bytes(parts, base):
    data = b"".join(parts) * 3
    starts = np.arange(max(len(data) - W + 1, 0))
    hashes = sd.Hashes(data, sd.BASES[base])
    order, shared = sd.suffix_sort(hashes, starts)
    want = sorted(range(len(starts)), key=lambda p: (data[p:p + W], p))
    assert order.tolist() == want and sd.in_order(hashes, starts, order, shared)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 75), st.integers(0, 120), st.integers(0, 40), st.sampled_from(sd.GRAMS), st.integers(0, 99))
def test_equal_windows_inside_a_segment_are_seen(period, extra, ahead, k, seed):
    rng = random.Random(seed)
    data = rng.randbytes(ahead) + (rng.randbytes(period) * 300)[:W + extra] + rng.randbytes(20)
    start, windows, key, inner = sd.cut(sd.Hashes(data), np.array([0]), np.array([len(data)]), k)
    for s, n, flag in zip(start, windows, inner):
        assert flag or len({data[p:p + W] for p in range(s, s + n)}) == n


def test_a_wrong_order_is_found_out():
    data = (prose(random.Random(2), 80)).encode()
    hashes, starts = sd.Hashes(data), np.arange(len(data) - W + 1)
    order, shared = sd.suffix_sort(hashes, starts)
    assert not sd.in_order(hashes, starts, order[::-1], shared)
    assert not sd.in_order(hashes, starts, order, np.where(shared > 3, shared - 1, shared))


def test_empty_table(documents):
    assert sd.digest_rows(documents([])).collect() == []
