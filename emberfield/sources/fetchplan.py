"""Which (feed, period) requests an archive run needs, and which are still missing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days per request, age from which the standard-processing feed is used, feed names.
CHUNK_DAYS = 5
STANDARD_AFTER_DAYS = 150
STANDARD_FEED = {
    "VIIRS_SNPP_NRT": "VIIRS_SNPP_SP",
    "MODIS_NRT": "MODIS_SP",
    "VIIRS_NOAA20_NRT": "VIIRS_NOAA20_SP",
}
MODIS_MAX_DAYS = 5


def chunk_starts(start: Column, end: Column, days: int = CHUNK_DAYS) -> Column:
    """Array of chunk starts for the half-open period [start, end)."""
    step = F.make_interval(days=F.lit(days))
    return F.when(end > start, F.sequence(start, F.date_sub(end, 1), step)).otherwise(
        F.array().cast("array<date>")
    )


def fetch_plan(
    feeds: DataFrame, as_of: date | Column, days: int = CHUNK_DAYS
) -> DataFrame:
    """One row per request from (feed, start, end) rows; the last chunk may be short.

    ``end`` itself is not covered. Chunks older than 150 days at ``as_of`` use
    the standard-processing feed when there is one.
    """
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    chunks = feeds.withColumn(
        "chunk_start", F.explode(chunk_starts(F.col("start"), F.col("end"), days))
    )
    routed = F.col("feed")
    old = F.datediff(at, F.col("chunk_start")) > STANDARD_AFTER_DAYS
    for name, standard in STANDARD_FEED.items():
        routed = F.when(old & (F.col("feed") == name), standard).otherwise(routed)
    return chunks.select(
        "feed", routed.alias("request_feed"), "chunk_start",
        F.least(F.lit(days), F.datediff("end", "chunk_start")).cast("int").alias("days"),
        chunk_key(F.col("feed"), F.col("chunk_start")).alias("chunk_key"),
    )


def chunk_key(feed: Column, start: Column) -> Column:
    """Stable name: feed without its suffix, month, start date."""
    name = F.replace(F.replace(feed, F.lit("_NRT"), F.lit("")), F.lit("_"), F.lit("-"))
    return F.concat_ws("_", name, F.date_format(start, "yyyy-MM"), F.date_format(start, "yyyy-MM-dd"))


def pending(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Requests whose chunk has not landed yet."""
    return plan.join(landed.select("chunk_key"), "chunk_key", "left_anti")


def recent_days(feed: Column, days: int) -> Column:
    """Days to request of a near-real-time feed; MODIS allows five at most."""
    if not 1 <= days <= 10:
        raise ValueError("day range must be between 1 and 10")
    return F.when(feed == "MODIS_NRT", F.least(F.lit(days), F.lit(MODIS_MAX_DAYS))).otherwise(days)
