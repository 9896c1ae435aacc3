"""Sensor value clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence words and their codes.
CONFIDENCE_WORDS = {"l": 0, "low": 0, "n": 1, "nominal": 1, "h": 2, "high": 2}


def confidence_code(value: Column) -> Column:
    """Words and percentages on one 0..2 scale.

    A null is a number that meets no threshold, hence 0; unreadable text is 1.
    """
    text = value.cast("string")
    word = F.lower(F.trim(text))
    by_word = None
    for code in (0, 1, 2):
        words = [w for w, c in CONFIDENCE_WORDS.items() if c == code]
        by_word = (F.when if by_word is None else by_word.when)(word.isin(words), code)
    number = text.try_cast("double")
    by_number = (
        F.when(number.isNull(), 1)
        .when(F.isnan(number), 0)
        .when(number >= 80, 2)
        .when(number >= 30, 1)
        .otherwise(0)
    )
    return F.when(text.isNull(), 0).otherwise(F.coalesce(by_word, by_number)).cast("int")


def clipped_frp(value: Column) -> Column:
    """Missing, NaN and negative values as 0."""
    return F.greatest(F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def truthy(value: Column) -> Column:
    """0/1 flag; a missing flag counts as set."""
    return F.coalesce(value.cast("boolean"), F.lit(True)).cast("int")
