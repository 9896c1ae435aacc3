"""Global row numbers without a one-partition sort of large inputs."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows one ordered window is used; beyond it, ranges are ranked apart.
ONE_WINDOW_ROWS = 1_000_000
_MAX_RANGES = 4096


def with_rank_desc(
    df: DataFrame, value: str, id_col: str, rank: str = "rank",
    one_window_rows: int = ONE_WINDOW_ROWS,
) -> DataFrame:
    """Adds the 1-based position by ``value`` descending (nulls last); ties go by the
    md5 of the id, then the id.

    The tie order is a hash so that a value shared by very many rows can be
    ranked in parts: value ranges come from approximate quantiles, a range that
    is one heavy value is split by hash prefix, rows are numbered inside each
    part, and the part sizes (a bounded list) give the offsets.
    """
    tie = F.md5(F.col(id_col).cast("string"))
    order = [F.col(value).desc_nulls_last(), tie, F.col(id_col)]
    n = df.count()
    if n <= one_window_rows:
        return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))

    ranges = min(_MAX_RANGES, -(-n // one_window_rows) * 4)
    cuts = df.agg(
        F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)
    ).first()[0] or []
    # a value that fills whole ranges is heavy; the more ranges, the longer its hash prefix
    heavy: dict[int, list[float]] = {}
    for v, repeats in Counter(cuts).items():
        if repeats > 1:
            parts = repeats / ranges * n / one_window_rows
            heavy.setdefault(max(1, math.ceil(math.log(max(parts, 2), 16))), []).append(v)
    prefix = F.when(F.col(value).isNull(), F.substring(tie, 1, 3))
    for digits, vs in heavy.items():
        prefix = prefix.when(F.col(value).isin(vs), F.substring(tie, 1, digits))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    known = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))))
    placed = (
        Bucketizer(splits=splits, inputCol="_v", outputCol="_b", handleInvalid="keep")
        .transform(known)
        # a heavy value is the low end of its range; its parts come after the empty prefix
        .withColumn("_h", F.coalesce(prefix, F.lit("")))
        .withColumn("_null", F.when(F.col(value).isNull(), 1).otherwise(0))
    )
    part = ["_null", "_b", "_h"]
    sizes = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.orderBy("_null", F.col("_b").desc(), "_h")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*part, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        placed.withColumn("_r", inside)
        .join(offsets, part)  # same partitioning as the window, so no further shuffle of rows
        .withColumn(rank, (F.col("_before") + F.col("_r")).cast("bigint"))
        .drop(*part, "_v", "_before", "_r")
    )
