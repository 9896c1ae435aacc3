"""Joins that stay balanced when one key holds much of the data.

A key is *heavy* when it holds more than 1/``SLOTS`` of all rows, so there can
never be more than ``SLOTS`` heavy keys: the list of them is the one thing that
comes to the driver and is broadcast, and that bound does not grow with the
data. Rows of a heavy key are spread over several salts in proportion to its
size. Without heavy keys, which one small aggregate job finds out, the join is
a plain equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A heavy key is one above 1/SLOTS of the rows, and above MIN_ROWS rows in any case.
SLOTS = 1000
MIN_ROWS = 200_000

_FAN, _SALT = "_fan", "_salt"


def heavy_keys(
    counts: DataFrame, keys: Sequence[str], rows: str = "_rows",
    slots: int | None = None, min_rows: int | None = None,
) -> DataFrame | None:
    """At most ``slots`` rows: the heavy keys and the number of salts for each; None if none."""
    slots = slots or SLOTS
    total, largest = counts.agg(F.sum(rows), F.max(rows)).first()
    share = max((total or 0) / slots, float(MIN_ROWS if min_rows is None else min_rows))
    if (largest or 0) <= share:
        return None
    heavy = counts.where(F.col(rows) > share).select(
        *keys, F.ceil(F.col(rows) / share).cast("int").alias(_FAN)
    )
    return counts.sparkSession.createDataFrame(heavy.collect(), heavy.schema)


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    how: str = "left", counts: DataFrame | None = None,
    slots: int | None = None, min_rows: int | None = None, heavy_work: bool = False,
) -> DataFrame:
    """Equi-join where heavy keys of ``left`` are split over salts and ``right`` follows.

    ``counts`` (keys plus ``_rows``) may be passed when the caller has it
    already. ``spread_by`` are columns of ``left`` that vary within a key.
    The salt is a hash of them, so a re-run task gives the same rows.
    ``heavy_work`` spreads the left rows by key even if ``right`` can be broadcast.
    """
    keys = list(keys)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = heavy_keys(counts, keys, slots=slots, min_rows=min_rows)
    if heavy is None:
        return (spread_out(left, *keys) if heavy_work else left).join(right, keys, how)
    heavy = F.broadcast(heavy)  # at most SLOTS rows
    fan = F.coalesce(F.col(_FAN), F.lit(1))
    spread = (
        left.join(heavy, keys, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), fan).cast("int"))
        .drop(_FAN)
    )
    copies = (
        right.join(heavy, keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), fan - 1)))
        .drop(_FAN)
    )
    if heavy_work:
        spread = spread_out(spread, *keys, _SALT)
    return spread.join(copies, [*keys, _SALT], how).drop(_SALT)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` over the shuffle partitions.

    For rows that are few bytes but much work each: adaptive execution sizes
    partitions by bytes and would leave such work to a handful of tasks. A
    shuffled join on the same keys afterwards needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
