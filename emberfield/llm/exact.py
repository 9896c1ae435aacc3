"""Exact deduplication by a 128-bit content hash, with a byte comparison inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .texts import whole


def content_digest(text: Column) -> Column:
    """The 128-bit hash of a text's bytes."""
    return F.unhex(F.md5(text))


def text_classes(docs: DataFrame, keep: str = "max", digest: Callable[[Column], Column] = content_digest) -> DataFrame:
    """(digest, text, group_size, keep_id): one row per distinct text.

    Grouping by hash and text compares the bytes of all texts that share a hash. Copies meet in the
    map-side aggregate, so a text with many copies leaves each map task once.
    """
    stay = F.max if keep == "max" else F.min
    rows = docs.select("doc_id", whole("text").alias("text")).withColumn("digest", digest(F.col("text")))
    return rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), stay("doc_id").alias("keep_id"))


def exact_groups(docs: DataFrame, keep: str = "max", digest: Callable[[Column], Column] = content_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``, dropped rows too.

    Of rows with identical text (null counts as empty) the one with the largest doc_id stays
    (``keep="min"``: the smallest). Rows that repeat one doc_id with one text all carry ``kept``, as they
    are the same document; a null doc_id stays only in a group without any id. Other columns are ignored.
    An empty table gives an empty result.

    Only (hash, size, id) of groups with copies goes back to the rows; a large group is the long side
    of that join, which adaptive execution splits. Hashes that two different texts share (none expected)
    are joined by hash and text.
    """
    classes = text_classes(docs, keep, digest)
    stay = F.max if keep == "max" else F.min
    groups = written(
        classes.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("group_size"), stay("keep_id").alias("keep_id"))
        .where("group_size > 1"),
        "exact-groups",
    )
    rows = docs.select("doc_id", whole("text").alias("text")).select(
        "doc_id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"), "text"
    )
    clashes = groups.where("texts > 1").select("digest")
    sound = rows.drop("text").join(groups, "digest", "left")
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    if clashes.isEmpty():
        found = sound.select(*out)
    else:
        shared = classes.join(clashes, "digest", "left_semi")
        found = sound.where("texts is null or texts = 1").select(*out).unionByName(
            rows.join(shared, ["digest", "text"]).select(*out)
        )
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row per distinct text, all columns as they were.

    The same choice as ``exact_groups``; of rows that repeat one doc_id with one text, one stays.
    The row's other columns ride along in the aggregate, so that no second pass over the texts is needed.
    """
    pick = F.max_by if keep == "max" else F.min_by
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(
        F.col("text").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    )
    kept = (
        docs.select(whole("text").alias("text"), F.struct("doc_id").alias("rank"), row.alias("row"))
        .withColumn("digest", content_digest(F.col("text")))
        .groupBy("digest", "text")
        .agg(pick("row", "rank").alias("row"))
    )
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    place["text"] = F.when(~F.col("row.no_text"), F.col("text"))
    return kept.select(*[place[c].alias(c) for c in docs.columns])
