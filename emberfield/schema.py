"""Canonical detection schema and alignment of feeds to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTION = T.StructType(
    [
        T.StructField("detection_id", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("acq_time", T.IntegerType()),
        T.StructField("satellite_source", T.StringType()),
        T.StructField("frp", T.DoubleType()),
        T.StructField("bright_ti4", T.DoubleType()),
        T.StructField("bright_ti5", T.DoubleType()),
        T.StructField("brightness", T.DoubleType()),
        T.StructField("bright_t31", T.DoubleType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("scan", T.DoubleType()),
        T.StructField("track", T.DoubleType()),
    ]
)

# Column order of the model input; the three *_enc text codes come last.
NUMERIC_FEATURES = (
    "brightness", "frp", "log_frp", "distance_to_industrial", "historical_frequency", "month",
)
OPTIONAL_FEATURES = ("scan", "track", "confidence_enc", "delta_brightness", "co_confirmed")
TEXT_FEATURES = ("land_use_type", "time_of_day", "season")

CATEGORIES = (
    "Agricultural Burning", "Anomaly/Unclassified", "Industrial (Normal)", "Wildfire Risk",
)


def align(df: DataFrame, schema: T.StructType = DETECTION) -> DataFrame:
    """Cast known columns to ``schema``, add the missing ones as typed nulls, keep any extras.

    An absent column and an all-null column mean different things to some
    features (see ``operators.features``), so call this only where that no
    longer matters, such as before writing a shared table.
    """
    known = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    names = set(schema.names)
    return df.select(*known, *[F.col(c) for c in df.columns if c not in names])


def drop_without_coordinates(df: DataFrame) -> DataFrame:
    """Plain null tests rather than ``dropna``, whose condition does not reach the file scan; NaN counts as missing."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.where(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
