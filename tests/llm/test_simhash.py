import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from proofmill.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles)
        value |= (2 * ones > len(shingles)) << bit
    return value


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(
    ["A", "b\t", "É", "\x0b", "\x1c", " ", "ß", "w"]), max_size=40).map(" ".join)))
def test_fingerprint_by_its_definition(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_manhattan_distance_never_exceeds_hamming():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    low = np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(b))
    assert (low <= np.bitwise_count(a ^ b)).all()
    counts = [[(int(x) >> (2 * s) & 3).bit_count() for s in range(32)] for x in (a[0], b[0])]
    assert low[0] == sum(abs(p - q) for p, q in zip(*counts))


def near_points(seed, n=120):
    rng = random.Random(seed)
    points = {0, (1 << 64) - 1}
    while len(points) < n:
        base = rng.choice(sorted(points)) if rng.random() < .8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            base ^= 1 << rng.randrange(64)
        points.add(base)
    return sorted(points)


def brute_components(points, bits):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, p in enumerate(points):
        for q in points[:i]:
            if (p ^ q).bit_count() <= bits:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


@pytest.mark.parametrize("seed, bits, dense", [(1, 4, 8192), (2, 4, 3), (3, 2, 8192), (4, 0, 8192), (5, 3, 8192), (6, 3, 3), (7, 1, 3), (8, 5, 8192)])
def test_links_close_to_the_brute_force_components(spark, seed, bits, dense):
    points = near_points(seed)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    table = spark.createDataFrame([(signed(p), i) for i, p in enumerate(points)], "fingerprint long, doc_id long")
    got = {r["fingerprint"]: r["component_id"] for r in simhash._linked(table, bits, dense).collect()}
    roots = brute_components(points, bits)
    least = {}
    for i, p in enumerate(points):
        least.setdefault(roots[p], i)
    assert got == {signed(p): least[roots[p]] for p in points}


def test_near_duplicates_of_odd_rows(documents, collected):
    body = " ".join(f"word{i}" for i in range(400))
    docs = documents([(8, body), (3, body + " tail"), (3, body), (5, None), (6, "  \n"), (None, body), (9, "alone here"),
                      (2, "x" * 100_000)], extra=("fingerprint", "component_id", "root"))
    got = collected(simhash.near_duplicates(docs), "doc_id", "component_id")
    assert got == sorted([(8, 3), (3, 3), (3, 3), (None, 3), (5, 5), (6, 5), (9, 9), (2, 2)], key=repr)
    left = simhash.representatives(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 9]
    again = documents([(8, body), (8, body), (3, body), (3, body), (3, body), (4, "alone here"), (4, "alone here"), (4, None)])
    assert sorted((r["doc_id"], r["text"] or "") for r in simhash.representatives(again).collect()) == [
        (3, body), (4, ""), (4, "alone here")]
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.representatives(documents([])).count() == 0
