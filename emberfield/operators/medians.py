"""Exact medians without gathering a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest number of values handed to the built-in exact aggregate.
DIRECT_ROWS = 2_000_000
_SLACK = 0.002
_ACCURACY = 10_000


def exact_median(df: DataFrame, value: Column, direct_rows: int = DIRECT_ROWS) -> float | None:
    """The exact median of ``value`` as a scalar; None when there is no value (null and NaN are none).

    Small inputs use the built-in aggregate. Larger ones are narrowed first:
    an approximate percentile with a guaranteed rank error brackets the middle,
    the values below the bracket are counted, and only the bracket is searched
    again, each pass leaving about 0.4 % of the values. When a bracket is a
    single value, that value is the answer.
    """
    values = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    total = None
    below = 0
    while True:
        n, low, high = values.agg(
            F.count(F.lit(1)), F.min("v"), F.max("v"),
        ).first()
        if total is None:
            total = n
            if n == 0:
                return None
        first, second = (total + 1) // 2 - below, (total + 2) // 2 - below
        if low == high:
            return low
        if n <= direct_rows:
            if below == 0 and n == total:
                return values.agg(F.median("v")).first()[0]
            return _at_ranks(values, first, second)
        middle = first / n
        cuts = values.agg(
            F.percentile_approx(
                "v",
                [max(0.0, middle - _SLACK), min(1.0, middle + _SLACK)],
                _ACCURACY,
            )
        ).first()[0]
        if cuts != [low, high]:
            below += values.where(F.col("v") < cuts[0]).count()
            values = values.where(F.col("v").between(*cuts))
            continue
        # The middle spans both ends: two values hold nearly everything. Peel them off.
        v = F.col("v")
        at_low, at_high, next_up, next_down = values.agg(
            F.count_if(v == low), F.count_if(v == high),
            F.min(F.when(v > low, v)), F.max(F.when(v < high, v)),
        ).first()
        if second <= at_low:
            return low
        if first > n - at_high:
            return high
        if first <= at_low:
            return (low + next_up) / 2
        if second > n - at_high:
            return (next_down + high) / 2
        below += at_low
        values = values.where((v > low) & (v < high))


def _at_ranks(values: DataFrame, first: int, second: int) -> float:
    """Mean of the values at two ranks; the caller has bounded the number of values."""
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("v"))
    ranked = counts.select("v", (running - F.col("n")).alias("before"), running.alias("upto"))
    pick = lambda r: F.max(F.when((F.col("before") < r) & (F.col("upto") >= r), F.col("v")))
    a, b = ranked.agg(pick(first), pick(second)).first()
    return (a + b) / 2
