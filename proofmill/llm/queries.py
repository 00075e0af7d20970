"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_dedup, language, neighbours, packing, piece_codec, prefix_trie, quality, secrets, simhash,
    suffix_dedup, token_alignment, toxicity, url_trust)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


@query("op1_url_trust", url_trust.oracle())
def urls(spark, sf_dir):
    return url_trust.verdicts(table(spark, sf_dir, "pages"))


@query("op3_language")
def languages(spark, sf_dir):
    return language.predicted(table(spark, sf_dir, "documents"))


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def exact_copies(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@query("op4_packing")
def packed(spark, sf_dir):
    return packing.piece_rows(table(spark, sf_dir, "documents"))


@query("op5_neighbours")
def nearest_vectors(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query("op6_simhash")
def near_copies(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def toxic_scores(spark, sf_dir):
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_piece_codec")
def piece_ids(spark, sf_dir):
    return piece_codec.digest_rows(table(spark, sf_dir, "documents"))


@query("op9_quality")
def quality_scores(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_secrets")
def secret_spans(spark, sf_dir):
    return secrets.digest_rows(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def token_links(spark, sf_dir):
    return token_alignment.digest_rows(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefix_trie.oracle())
def conversation_nodes(spark, sf_dir):
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


@query("op13_suffix_dedup", suffix_dedup.ORACLE)
def repeated_strings(spark, sf_dir):
    return suffix_dedup.digest_rows(table(spark, sf_dir, "documents"))
