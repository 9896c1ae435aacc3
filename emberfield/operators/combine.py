"""Combining feeds: source tags, brightness layout, union, exact duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns that make two records the same detection.
SAME_DETECTION = ("latitude", "longitude", "acq_date", "acq_time", "satellite_source")

# Name parts that identify a sensor, in the order each feed tests them.
NRT_TAGS = (("VIIRS_SNPP", "VIIRS_SNPP"), ("MODIS", "MODIS"), ("NOAA20", "VIIRS_NOAA20"))
ARCHIVE_TAGS = (("VIIRS_SNPP", "VIIRS_SNPP"), ("VIIRS_NOAA20", "VIIRS_NOAA20"), ("MODIS", "MODIS"))


def source_name(feed: Column, tags: Sequence[tuple[str, str]] = NRT_TAGS) -> Column:
    """Sensor name of a feed; a feed that matches no tag keeps its own name."""
    out = None
    for part, name in tags:
        out = (F.when if out is None else out.when)(feed.contains(part), name)
    return out.otherwise(feed)


def tag_source(
    df: DataFrame, feed: str = "feed", tags: Sequence[tuple[str, str]] = NRT_TAGS
) -> DataFrame:
    """Adds ``satellite_source`` and, only if the feed lacks it, ``instrument``."""
    name = source_name(F.col(feed), tags)
    out = df.withColumn("satellite_source", name)
    if "instrument" not in df.columns:
        out = out.withColumn(
            "instrument",
            F.when(name.isin("VIIRS_SNPP", "VIIRS_NOAA20"), "VIIRS").when(name == "MODIS", "MODIS"),
        )
    return out


def share_brightness(df: DataFrame) -> DataFrame:
    """Per feed, before the union: when only one mid-infrared column exists, copy it to the other."""
    have4, have = "bright_ti4" in df.columns, "brightness" in df.columns
    if have4 and not have:
        return df.withColumn("brightness", F.col("bright_ti4"))
    if have and not have4:
        return df.withColumn("bright_ti4", F.col("brightness"))
    return df


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a feed lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def drop_exact_duplicates(
    df: DataFrame, keys: Sequence[str] = SAME_DETECTION, id_col: str = "detection_id"
) -> DataFrame:
    """Keeps the record with the lowest id per key; null keys are equal to each other.

    An aggregate, not a window: copies collapse before the shuffle, so a group
    holding much of the data costs no more than any other.
    """
    keys = [k for k in keys if k in df.columns]
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(id_col, *[c for c in rest if c != id_col])).alias("_first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def with_detection_id(df: DataFrame, keys: Sequence[str] = SAME_DETECTION) -> DataFrame:
    """A stable id from the natural key, for files that carry none. Unique after
    :func:`drop_exact_duplicates` on the same keys, up to hash collisions."""
    keys = [k for k in keys if k in df.columns]
    return df.withColumn("detection_id", F.xxhash64(*keys))
