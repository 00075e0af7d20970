import os

import numpy as np
import pytest

from proofmill.llm import neighbours as N
from proofmill.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, code long, rank int"


def brute(rows, every, nearest=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own = np.array(v, np.float32).astype(np.float64)
            ok[i] = max(ok[i], tuple(own)) if i in ok else tuple(own)
    if not ok:
        return {}
    lengths = [len(v) for v in ok.values()]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n))
    ids = np.array(sorted(i for i in ok if len(ok[i]) == usual))
    m = np.array([ok[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in ids[ids % every == 0]:
        c = m @ m[list(ids).index(q)]
        order = [k for k in np.lexsort((ids, -np.round(c, 13))) if ids[k] != q][:nearest]
        out[int(q)] = [(int(ids[k]), c[k]) for k in order]
    return out


def found(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    out = {}
    for r in N.search(df, every, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 20, 40, 63, 64])
def test_probing_meets_every_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    reach = N.reaches(radius)
    for _ in range(300):
        flips = rng.permutation(64)[:min(radius, 64)]
        per_part = np.bincount(flips // N.KEY_BITS, minlength=N.PARTS)
        assert any(n <= r for n, r in zip(per_part, reach))


@pytest.mark.parametrize("bucket", [256, 7])
def test_whole_radius_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(N, "LEAST_BUCKET", bucket)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    rows = [(i, [float(x) for x in base[i % 60] * (1 if i % 3 else 2)]) for i in range(140)]
    want, got = brute(rows, 10), found(spark, rows, 10, spread=100.0)
    assert set(want) == set(got)
    for q, near in want.items():
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in got[q]], [s for _, s in near], atol=1e-12)
        assert [i for _, i, _ in got[q]] == [i for i, _ in near]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 1.0]), (11, [-1.0, 0.0]),
            (100, [0.0, 0.0]), (150, None), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]),
            (350, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (400, [1e30, 1e30]), (12, [])]
    want, got = brute(rows, 50), found(spark, rows, 50)
    assert set(got) == set(want) == {0, 50, 400}
    assert [i for _, i, _ in got[0]] == [3, 7, 50, 400, 9] and got[400][0][2] == pytest.approx(2 ** -.5)
    assert [(r, i) for r, i, _ in found(spark, [(0, [1.0]), (50, [2.0])], 50)[0]] == [(1, 50)]
    assert found(spark, [(0, [1.0, 2.0])], 50) == {} and found(spark, [], 50) == {} and found(spark, [(0, None)], 50) == {}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1", "/root/testdata/check_s"])
def test_recall_against_brute_force(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    df = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    want, got = brute(rows, 50), {}
    for r in N.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len(got[q] & {i for i, _ in near}) / len(near) for q, near in want.items()])
    print(sf, recall)
    assert recall >= 0.93
