"""The subpackage's queries by name, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, codes, collocations, exact, license, mixing, neighbours, pii, quality, simhash, substring, toxicity, urls
from .texts import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_url_filter(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query
def op2_bpe(spark, sf_dir):
    return bpe.token_report(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query
def op4_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op6_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query
def op7_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.pii_spans(docs, pii.fit_pii(docs))


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op9_substring_dedup(spark, sf_dir):
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op10_license_scan(spark, sf_dir):
    return license.license_scan(table(spark, sf_dir, "documents"))


@query
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_vector_codes(spark, sf_dir):
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query
def op13_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can state; the others are tested against brute force and held-out rows."""
    return {
        "op6_exact_dedup": EXACT_SQL, "op10_license_scan": license.license_sql(),
        "op11_collocations": collocations.collocation_sql(), "op12_vector_codes": codes.codes_sql(),
    }


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
