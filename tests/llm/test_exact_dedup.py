import hashlib

from hypothesis import HealthCheck, given, settings, strategies as st

from proofmill.llm import bloom, exact_dedup


def brute(rows):
    best, size = {}, {}
    for i, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = max([x for x in (best.get(t), i) if x is not None], default=None)
    return sorted(((i, best[t or ""], size[t or ""], i == best[t or ""],
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 30)),
                          st.sampled_from([None, "", "a", "A", "b ", "b", "é", "x" * 5000])), max_size=25))
def test_groups_equal_brute_force(documents, collected, rows):
    for bits in (64, bloom.BITS):
        assert collected(exact_dedup.groups(documents(rows), bits), *COLUMNS) == brute(rows)


def test_filters_never_miss_a_copy_and_let_most_others_through(spark):
    from pyspark.sql import functions as F
    keys = spark.range(3000).select((F.col("id") % 2900).alias("k"))
    found = bloom.probe(keys, bloom.repeated(keys, F.col("k"), 9, 1 << 20), F.col("k"), 9, "hit", 1 << 20)
    hits = [r["k"] for r in found.where("hit").collect()]
    assert set(range(100)) <= set(hits) and len(hits) < 240


def test_deduplicate_keeps_whole_rows(documents, collected):
    docs = documents([(1, "a"), (9, "a"), (9, "a"), (4, None), (None, ""), (7, "c")],
                     extra=("kept", "__copy", "digest"))
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert collected(left, "doc_id", "text", "kept") == [(4, None, "x"), (7, "c", "x"), (9, "a", "x")]
    assert exact_dedup.deduplicate(documents([])).count() == 0


def test_main_path_runs_no_python(documents):
    docs = documents([(1, "a"), (2, "a")])
    for df in (exact_dedup.groups(docs), exact_dedup.deduplicate(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
