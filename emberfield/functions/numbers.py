"""Rounding that agrees with IEEE half-even rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Scale, round to the nearest integer (ties to even), scale back."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def exact_fixed(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` decimals by its exact binary value, ties to even.

    This is what C-style ``%.Nf`` does. The JVM formatter rounds the shortest
    decimal text half up instead, which differs for values such as 12.25 and
    0.15. The value is split into two parts whose products with the scale
    carry no rounding error, so the comparison with the midpoint is exact.
    """
    scale = float(10**digits)
    below = F.floor(value * scale).cast("double")
    high = value.cast("float").cast("double")
    low = value - high
    past_middle = (high * (2 * scale) - (below * 2 + 1)) + low * (2 * scale)
    odd = (below % 2) != 0
    up = (past_middle > 0) | ((past_middle == 0) & odd)
    return (below + up.cast("double")) / scale


def fixed_text(value: Column, digits: int) -> Column:
    """``%.Nf`` text of ``value``; null in, null out."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", exact_fixed(value, digits)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, unrounded; null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0
