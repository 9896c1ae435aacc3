"""The corpus pipeline: quality rules, exact and near deduplication, mixing, tokens. Each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberfield.llm import bpe, exact, mixing, quality, simhash
from emberfield.llm.queries import tokenizer_path
from emberfield.llm.texts import table
from emberfield.session import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the trees keep."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, the row with the largest doc_id."""
    return exact.drop_copies(docs)


def distant_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, the document with the smallest doc_id."""
    return simhash.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a source's last one only as far as its quota reaches."""
    return mixing.mix(docs).drop("mix_shard", "mix_order")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and the decoded text of every row of the mix."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"), decoded=True)


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", distant_documents),
    ("mixing to target weights", mixed_documents),
    ("BPE encoding and decoding", token_ids),
]

#: The quality model and the fingerprints' bits are out of reach of SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
