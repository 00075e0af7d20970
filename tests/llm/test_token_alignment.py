import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from proofmill.llm import token_alignment

WORDS = token_alignment.Vocabularies(
    token_alignment.vocabulary_path(token_alignment.VOCABULARY_A),
    token_alignment.vocabulary_path(token_alignment.VOCABULARY_B), kept=30)
ODD = ["", "a", "The end of  the naïve story.", "  two   blanks  ", "tab\tand\r\nline \n end", " x 　y",
       "日本語のテキスト", "emoji 🎉🎉!", "<|endoftext|> and <s> </s> <unk>", "▁low ▁", "x\x00y\x1c z",
       "it's 12345 DON'T", " ", "\n", "a ́b", "x" * 400]


def whole(text):
    """Ids of both tokenizers for the text as a whole."""
    return (WORDS.a.encode(" " + text, add_special_tokens=False).ids, WORDS.b.encode(text)) if text else ([], [])


def spans(ids, table):
    ends = np.cumsum([len(table[i]) for i in ids]).tolist()
    return list(zip([0, *ends], ends))


def brute(texts):
    """Rows by comparing every token of A with every token of B."""
    docs, held = [], Counter()
    for text in texts:
        a, b = whole(text or "")
        joined = [b"".join(t[i] for i in ids) for ids, t in ((a, WORDS.bytes_a), (b, WORDS.bytes_b))]
        if not text or joined != [b" " + text.encode()] * 2:
            docs.append(([], [], [], []))
            continue
        sa, sb = spans(a, WORDS.bytes_a), spans(b, WORDS.bytes_b)
        links = [(x, y) for x, p in zip(a, sa) for y, q in zip(b, sb) if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [(",".join(str(x) for x, p in zip(a, sa) if lo < p[1] <= hi) + "|"
                   + ",".join(str(y) for y, q in zip(b, sb) if lo < q[1] <= hi)) for lo, hi in zip([0, *cuts], cuts)]
        held.update(set(links))
        docs.append((a, b, links, groups))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [(len(a), len(b), len(g), len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, k, g in docs]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(ODD)), max_size=6))
def test_ids_by_parts_equal_ids_of_the_whole_text(parts):
    for text in (" ".join(parts), "".join(parts), "\n".join(parts)):
        a, b = whole(text)
        joined = [b"".join(t[i] for i in ids) for ids, t in ((a, WORDS.bytes_a), (b, WORDS.bytes_b))]
        even = joined == [b" " + text.encode()] * 2
        found = WORDS.encode([text])
        got = [found.a.tolist(), found.b.tolist()]
        assert got == ([a, b] if even else [[], []])


@given(st.lists(st.tuples(st.lists(st.integers(1, 9), min_size=1), st.lists(st.integers(1, 9), min_size=1)), max_size=5),
       st.integers(1, 12))
def test_merge_of_any_cuts_in_lanes_of_any_width(docs, lane):
    ends_a, ends_b, stops, links, cuts, base = [], [], [], set(), [], 0
    for left, right in docs:
        gap = sum(left) - sum(right)
        left, right = (left, [*right, gap]) if gap > 0 else ([*left, -gap] if gap else left, right)
        a, b = (base + np.cumsum(left)).tolist(), (base + np.cumsum(right)).tolist()
        for i, (p, q) in enumerate(zip([base, *a], a), len(ends_a)):
            links |= {(i, j) for j, (r, s) in enumerate(zip([base, *b], b), len(ends_b)) if p < s and r < q}
        cuts += [(len(ends_a) + i, len(ends_b) + b.index(e)) for i, e in enumerate(a) if e in b]
        ends_a, ends_b, base = ends_a + a, ends_b + b, a[-1]
        stops.append(base)
    i, j, cut_a, cut_b = token_alignment.merge(
        np.array(ends_a, np.int64), np.array(ends_b, np.int64), np.array(stops, np.int64), lane)
    assert list(zip(i.tolist(), j.tolist())) == sorted(links)
    assert list(zip(cut_a.tolist(), cut_b.tolist())) == cuts


@pytest.mark.parametrize("hot", (0, 40, 1 << 17))
def test_rows_equal_brute_force(documents, hot):
    texts = [None, *ODD, "the cat sat on the mat " * 30, "The end of  the naïve story.", "the cat", "mat, cat\nthe"]
    docs = documents([*enumerate(texts), (3, "the cat"), (None, "no id, the cat")], extra=("row", "pairs", "n_a", "pair"))
    got = token_alignment.digest_rows(docs.repartition(3), hot=hot).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    ids = [*range(len(texts)), 3, None]
    want = [(i, *row) for i, row in zip(ids, brute([*texts, "the cat", "no id, the cat"]))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_long_text_beside_short_ones(documents):
    text = " ".join(f"word{i % 97} naïve{i % 13}" for i in range(9000))
    got = token_alignment.digest_rows(documents([(1, text), (2, "word1")])).where("doc_id = 1").first()
    a, b = whole(text)
    assert (got["n_a"], got["n_b"]) == (len(a), len(b))
    ends = [set(np.cumsum([len(t[i]) for i in ids]).tolist()) for ids, t in ((a, WORDS.bytes_a), (b, WORDS.bytes_b))]
    assert got["n_groups"] == len(ends[0] & ends[1]) and got["n_links"] == len(ends[0] | ends[1])


def test_empty_table(documents):
    assert token_alignment.digest_rows(documents([])).collect() == []
