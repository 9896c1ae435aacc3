"""What the text operators share: reading tables, words, bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular-expression class body and as a string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, as long.

    Every word with the white space before it becomes one letter, so memory stays within the text's own size.
    """
    tail = F.regexp_replace(text, f"[{SPACE_CLASS}]+$", "")
    return F.length(F.regexp_replace(tail, f"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+", "x")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*key: Column | str) -> Column:
    """A double in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0**-53)


def bounded_sample(rows: DataFrame, bound: int, *key: str) -> DataFrame:
    """At most ``bound`` rows, the same ones at every run: those of lowest hash of ``key``.

    A hash threshold from the row count thins the rows first, so that no task and not the driver
    receives more than about twice the bound. Meant for labelled rows of a fit.
    """
    n = rows.count()
    rank = unit(F.lit("sample"), *key)
    if n > 2 * bound:
        rows = rows.where(rank < 2.0 * bound / n)
    return rows.orderBy(rank, *key).limit(bound)


def sampled_texts(docs: DataFrame, known: DataFrame, bound: int, *values: str) -> DataFrame:
    """(doc_id, digest, text, *values): the texts of a bounded table ``known`` (sample_id, *values).

    An id can repeat in ``docs``, so (id, text) pairs are counted and bounded once more, before any text leaves its
    task. Equal rows come as often as in ``docs``; drop duplicates of (doc_id, digest, *values) once texts are measured.
    """
    rows = docs.select("doc_id", "text").withColumn("digest", F.md5(whole("text")))
    at = F.col("doc_id") == F.col("sample_id")
    pairs = rows.join(F.broadcast(known), at).select("sample_id", "digest", *values).distinct()
    chosen = bounded_sample(pairs, bound, "sample_id", "digest", *values).withColumnRenamed("digest", "sample_digest")
    both = at & (F.col("digest") == F.col("sample_digest"))
    return rows.join(F.broadcast(chosen), both).select("doc_id", "digest", "text", *values)


#: Bytes of Arrow data that a worker turns into Python objects at once (one row at least).
SLICE_BYTES = 4 << 20


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``, in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * slice_bytes // max(batch.nbytes, 1))
            for start in range(0, batch.num_rows, step):
                yield fn(batch.slice(start, step))

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """A text column of an Arrow batch with null as empty."""
    return [x or "" for x in column.to_pylist()]
