"""Calendar and overpass-time expressions. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_date(value: Column) -> Column:
    """A date, or null where the text is not one."""
    return value.try_cast("date")


def month_or_june(value: Column) -> Column:
    """Month of the date; 6 for an unreadable date."""
    return F.coalesce(F.month(lenient_date(value)), F.lit(6))


def hhmm_text(value: Column) -> Column:
    """HHMM integer as text of at least four digits (longer values are kept whole)."""
    text = value.cast("bigint").cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def minute_of_day(value: Column) -> Column:
    """HHMM to minutes: the first two digits are hours, the rest minutes; unreadable gives 0."""
    text = hhmm_text(value)
    minutes = F.substring(text, 1, 2).try_cast("bigint") * 60 + F.substring(
        text, 3, 18
    ).try_cast("bigint")
    return F.coalesce(minutes, F.lit(0)).cast("bigint")


def time_of_day(value: Column) -> Column:
    hour = F.substring(hhmm_text(F.coalesce(value, F.lit(0))), 1, 2).try_cast("int")
    return (
        F.when(hour < 6, "Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon")
        .otherwise("Evening")
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Summer")
        .when(month.isin(6, 7, 8, 9), "Monsoon")
        .otherwise("Post-Monsoon")
    )


def clock_display(value: Column) -> Column:
    """``HH:MM UTC``; a missing time shows midnight."""
    text = F.coalesce(hhmm_text(value), F.lit("0000"))
    return F.concat(F.substring(text, 1, 2), F.lit(":"), F.substring(text, 3, 18), F.lit(" UTC"))
