"""Per-detection features and the rule-based category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, radiometry
from ..functions.numbers import half_even
from ..functions.places import round_cell
from ..mode import Mode, NRT
from ..schema import drop_without_coordinates
from .landuse import with_land_use_defaults
from .medians import exact_median
from .skew import salted_join

# Fixed values of the feature step.
DEFAULT_BRIGHTNESS_K = 300.0
DEFAULT_DELTA_K = 15.0
FREQUENCY_CELL_DEG = 0.01
NEAR_INDUSTRY_M = 1000.0
FOREST_FRP = 4.0

FEATURE_COLUMNS = (
    "brightness", "frp", "log_frp", "delta_brightness", "confidence_enc", "land_use_type",
    "distance_to_industrial", "historical_frequency", "time_of_day", "season", "month", "category",
)


def with_calendar(df: DataFrame) -> DataFrame:
    """Adds month, season and time_of_day."""
    time = F.col("acq_time") if "acq_time" in df.columns else F.lit(0)
    return (
        df.withColumn("month", clock.month_or_june(F.col("acq_date")))
        .withColumn("season", clock.season(F.col("month")))
        .withColumn("time_of_day", clock.time_of_day(time))
    )


def with_brightness(df: DataFrame) -> DataFrame:
    """One brightness column over both sensors; gaps get the exact median of what is there."""
    have = [c for c in ("bright_ti4", "brightness") if c in df.columns]
    if not have:
        return df.withColumn("brightness", F.lit(DEFAULT_BRIGHTNESS_K))
    value = F.coalesce(*[F.col(c) for c in have])
    middle = exact_median(df, value)
    return df.withColumn("brightness", F.coalesce(value, F.lit(middle).cast("double")))


def with_delta_brightness(df: DataFrame) -> DataFrame:
    """Difference of the two infrared bands; call after :func:`with_brightness`.

    Zeros, also those of rows lacking a band, become the median of the positive
    differences.
    """
    cols = set(df.columns)
    delta = F.lit(0.0)
    if {"brightness", "bright_t31"} <= cols:
        difference = F.coalesce(F.col("brightness") - F.col("bright_t31"), F.lit(0.0))
        if "bright_ti4" in cols:
            delta = F.when(F.col("bright_ti4").isNull(), difference).otherwise(delta)
        else:
            delta = difference
    if {"bright_ti4", "bright_ti5"} <= cols:
        delta = F.coalesce(F.col("bright_ti4") - F.col("bright_ti5"), delta)
    middle = exact_median(df, F.when(delta > 0, delta))
    middle = DEFAULT_DELTA_K if middle is None else middle
    return df.withColumn(
        "delta_brightness", half_even(F.when(delta == 0, F.lit(middle)).otherwise(delta), 3)
    )


def with_confidence_code(df: DataFrame) -> DataFrame:
    code = radiometry.confidence_code(F.col("confidence")) if "confidence" in df.columns else F.lit(1)
    return df.withColumn("confidence_enc", code.cast("int"))


def with_confirmation_flag(df: DataFrame) -> DataFrame:
    """``co_confirmed`` as 0/1: a null flag counts as 1, an absent column as 0."""
    flag = radiometry.truthy(F.col("co_confirmed")) if "co_confirmed" in df.columns else F.lit(0)
    return df.withColumn("co_confirmed", flag.cast("int"))


def with_frp(df: DataFrame) -> DataFrame:
    return df.withColumn("frp", radiometry.clipped_frp(F.col("frp"))).withColumn(
        "log_frp", F.log1p("frp")
    )


def with_historical_frequency(
    df: DataFrame, cell: float = FREQUENCY_CELL_DEG, window_days: int | None = None
) -> DataFrame:
    """Number of other detections in the same 0.01 degree cell, over the whole input or the last ``window_days``.

    Counts are aggregated before the shuffle and then looked up, so a cell that
    holds much of the data never sits in one task. With ``window_days``, a detection counts those of its own date and
    of the days before it that the window reaches; one without a date counts none. Trailing sums run over
    daily counts, so a cell has one row per day however many detections it has.
    """
    keys = ["_fi", "_fj"]
    if window_days is not None:
        return _with_trailing_frequency(df, cell, window_days)
    rows = df.withColumn("_fi", round_cell(F.col("latitude"), cell)).withColumn(
        "_fj", round_cell(F.col("longitude"), cell)
    )
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    per_cell = counts.select(*keys, (F.col("_rows") - 1).alias("historical_frequency"))
    return salted_join(
        rows.drop("historical_frequency"), per_cell, keys, ["detection_id"], counts=counts
    ).drop(*keys)


def _with_trailing_frequency(df: DataFrame, cell: float, window_days: int) -> DataFrame:
    keys = ["_fi", "_fj", "_day"]
    day = F.unix_date(F.col("acq_date").cast("date"))
    rows = df.withColumn("_fi", round_cell(F.col("latitude"), cell)).withColumn(
        "_fj", round_cell(F.col("longitude"), cell)
    ).withColumn("_day", day)
    daily = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    trailing = Window.partitionBy("_fi", "_fj").orderBy("_day").rangeBetween(1 - window_days, 0)
    per_day = daily.where("_day is not null").select(*keys, (F.sum("_rows").over(trailing) - 1).alias("historical_frequency"))
    found = salted_join(rows.drop("historical_frequency"), per_day, keys, ["detection_id"], counts=daily)
    return found.withColumn("historical_frequency", F.coalesce("historical_frequency", F.lit(0).cast("bigint"))).drop(*keys)


def category(mode: Mode = NRT) -> Column:
    """The category rule over land_use_type, distance_to_industrial, frp, historical_frequency."""
    use = F.lower(F.coalesce(F.col("land_use_type"), F.lit("unknown")))
    frp = F.coalesce(F.col("frp"), F.lit(0.0))
    distance = F.coalesce(F.col("distance_to_industrial"), F.lit(50_000.0))
    repeats = F.coalesce(F.col("historical_frequency"), F.lit(0))

    industrial = (use == "industrial") | (distance < NEAR_INDUSTRY_M)
    forest = use.isin("forest", "wood")
    farm = use.isin("farmland", "farmyard", "orchard")

    persistent = (repeats >= mode.frequent) | (industrial & (repeats >= 1))
    strong = (frp >= mode.wildfire_frp) | (forest & (frp >= FOREST_FRP))
    field = (repeats >= 1) & (repeats < mode.repeat_below) & (frp < mode.wildfire_frp)
    return (
        F.when(persistent, "Industrial (Normal)")
        .when(strong & (repeats <= 1) & ~industrial, "Wildfire Risk")
        .when(field | (farm & (repeats >= 1)), "Agricultural Burning")
        .otherwise("Anomaly/Unclassified")
    )


def with_category(df: DataFrame, mode: Mode = NRT) -> DataFrame:
    return df.withColumn("category", category(mode))


def all_features(df: DataFrame, mode: Mode = NRT) -> DataFrame:
    """All features and the category, original columns first.

    Runs two scalar jobs (the medians); everything else is one lazy plan.
    """
    df = drop_without_coordinates(df)
    df = with_calendar(df)
    df = with_brightness(df)
    df = with_delta_brightness(df)
    df = with_confidence_code(df)
    df = with_confirmation_flag(df)
    df = with_frp(df)
    df = with_land_use_defaults(df)
    df = with_historical_frequency(df)
    df = with_category(df, mode)
    return ordered_output(df)


def ordered_output(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    first = [c for c in df.columns if c not in features]
    return df.select(*first, *[c for c in features if c in df.columns])
