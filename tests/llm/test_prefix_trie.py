import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm import prefix_trie
from proofmill.llm.running import running_sums

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn), tie, (role, text)))
    own = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        top = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(top, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    below = defaultdict(list)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    children = Counter(path[:-1] for path in members if path)
    return sorted([(
        min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path],
        sum(not children[p] for p in below[path]), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below[path] if p),
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(path)).encode()).hexdigest())
        for path, m in members.items()], key=repr)


def invented(seed, n=60, texts=("a", "bb", "naïve 🎉", "", None)):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([*range(0, 8), *range(100, 112), *range(200, 204), 305, 399, -3, -100, 12345678901])
        for turn in range(rng.randrange(5)):
            rows.append((conv, rng.choice([turn, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed,bits", [(1, 3), (2, 4), (3, 6), (4, None)])
def test_nodes_equal_brute_force_at_any_width_of_the_sketch(spark, seed, bits):
    rows = [*invented(seed), (None, 1, "user", "no conversation"),
            *[(c, t, "user", x) for c in range(500, 520) for t, x in enumerate(["same"] * (c % 7))]]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, depth int, k0 int").repartition(5)
    got = prefix_trie.nodes(table, bits).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_copies_one_long_conversation_and_the_sql(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 3, 7) for t in range(700)]  # shared down to the end
    rows += [(c, t, "user", x) for c in range(1000, 1300) for t, x in enumerate(["hello", "hi", "bye"])]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sorted(map(tuple, prefix_trie.nodes(table).select(COLUMNS).collect()), key=repr)
    assert got == brute(rows)
    con = duckdb.connect()
    small = [r for r in rows if r[1] < 8] + invented(9)
    conversations = spark.createDataFrame(small, SCHEMA).toArrow()  # noqa: F841
    con.register("conversations", conversations)
    sql = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.oracle()})").fetchall(), key=repr)
    assert sql == brute(small)


def test_empty_table_and_rows_without_a_conversation(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_sketch_counts_are_never_too_small(spark):
    keys = np.random.default_rng(5).integers(-10**18, 10**18, 500)
    keys = np.concatenate([keys, keys[:100], np.repeat(keys[:3], 300)])
    found = prefix_trie.sketch(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(4), 12).collect()
    counters = np.zeros((2, 1 << 12), np.uint8)
    for row in found:
        counters[row["sketch_row"]] = np.frombuffer(row["counters"], np.uint8)
    for key, n in Counter(keys.tolist()).items():
        estimate = min(counters[r, prefix_trie._cells(np.array([key]), r, 12)[0]] for r in (0, 1))
        assert estimate >= min(n, 255)
    alone = [k for k, n in Counter(keys.tolist()).items() if n == 1]
    assert np.mean([min(counters[r, prefix_trie._cells(np.array([k]), r, 12)[0]] for r in (0, 1)) == 1 for k in alone]) > 0.9


def test_running_sums_over_keys_of_any_size(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 9, -4]), i, rng.randrange(-2**62, 2**62), 1) for i in range(3000)]
    table = spark.createDataFrame(rows, "key long, at long, big long, one long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = running_sums(table, "key", [F.desc("at")], ["big", "one"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sums = defaultdict(lambda: [0, 0])
    want = {}
    for key, at, big, one in sorted(rows, key=lambda r: -r[1]):
        s = sums[key]
        want[at] = (*s, s[0] + big, s[1] + one)
        s[0], s[1] = s[0] + big, s[1] + one
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert {r["at"]: (r["big_before"], r["one_before"], r["big_sum"], r["one_sum"]) for r in got} == {
        at: tuple(map(wrap, w)) for at, w in want.items()}
