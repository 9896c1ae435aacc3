"""Summary tables over detections and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numbers import fixed_text, half_even, percent
from ..functions.places import FEED_LINK, map_link, zone
from ..mode import Mode, NRT
from ..schema import drop_without_coordinates
from .landuse import MAX_DISTANCE_M
from .medians import exact_median
from .sampling import sample_exactly

HIGH_FRP_MW = 50.0

# Per category the risk badge, the heading and the marker colour.
BADGES = {
    "Wildfire Risk": "High Risk",
    "Agricultural Burning": "Moderate Risk",
    "Industrial (Normal)": "Low Risk",
    "Anomaly/Unclassified": "Anomaly",
}
HEADINGS = {
    "Wildfire Risk": "High Wildfire Risk detected",
    "Agricultural Burning": "Agricultural Stubble Burning",
    "Industrial (Normal)": "Industrial Thermal Emitter",
    "Anomaly/Unclassified": "Thermal Anomaly detected",
}
COLOURS = {
    "Wildfire Risk": "#E5383B",
    "Agricultural Burning": "#F4A259",
    "Industrial (Normal)": "#4A8FE7",
    "Anomaly/Unclassified": "#9D4EDD",
}
# Response procedure per category.
PROCEDURES = {
    "Wildfire Risk": (
        "🚨 PRIORITY ALPHA DISPATCH: Immediate escalation to District Emergency Operations "
        "Center (DEOC) & State Forest Fire Force. High-intensity thermal plume detected in "
        "non-industrial terrain."
    ),
    "Agricultural Burning": (
        "🌾 FARM RESIDUE MONITOR: Seasonal post-harvest stubble burning observed. Routed to "
        "Tehsil Agriculture Registry and regional AQI plume trajectory tracking."
    ),
    "Industrial (Normal)": (
        "🏭 VERIFIED INDUSTRIAL EMITTER: Persistent stationary thermal signature co-located with "
        "registered industrial furnace/flare coordinates. Alert suppressed to eliminate false alarms."
    ),
    "Anomaly/Unclassified": (
        "🔍 UNCLASSIFIED HEAT ANOMALY: Atypical thermal profile requiring secondary satellite "
        "verification swath or UAV reconnaissance."
    ),
}


def by_category(category: Column, values: dict[str, str]) -> Column:
    """Lookup per category; a category that is not listed reads as an anomaly."""
    out = None
    for name, value in values.items():
        if name != "Anomaly/Unclassified":
            out = (F.when if out is None else out.when)(category == name, value)
    return out.otherwise(values["Anomaly/Unclassified"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, pct of the non-null rows); order by n when showing."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the counts only
    return counts.withColumn("pct", half_even(percent(F.col("n"), total), 6))


def radiometric_stats(df: DataFrame) -> DataFrame:
    """Min, mean and max of brightness and FRP in one pass."""
    cols = []
    for c in ("brightness", "frp"):
        cols += [
            F.min(c).alias(f"{c}_min"), half_even(F.avg(c), 6).alias(f"{c}_mean"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.agg(*cols, F.count_if(F.col("frp") >= HIGH_FRP_MW).alias("high_frp"))


def frequency_bands(df: DataFrame, mode: Mode = NRT) -> DataFrame:
    f = F.col("historical_frequency")
    return df.agg(
        F.count_if(f == 0).alias("once"),
        F.count_if((f >= 1) & (f < mode.frequent)).alias("repeated"),
        F.count_if(f >= mode.frequent).alias("persistent"),
    )


def distance_summary(df: DataFrame, col: str = "distance_to_industrial") -> DataFrame:
    """How many detections have a real distance, and its minimum and exact median."""
    d = F.col(col)
    real = F.when(d < MAX_DISTANCE_M, d)
    middle = exact_median(df, real)
    return df.agg(
        F.count(real).alias("with_distance"),
        F.count_if(d >= MAX_DISTANCE_M).alias("at_limit"),
        half_even(F.min(real), 3).alias("min_m"),
    ).withColumn("median_m", half_even(F.lit(middle).cast("double"), 3))


def monthly_top(df: DataFrame, n: int = 6) -> DataFrame:
    return (
        df.where(F.col("acq_date").isNotNull())
        .groupBy(F.date_format("acq_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "month").limit(n)
    )


def date_span(df: DataFrame) -> DataFrame:
    span = df.agg(F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"))
    return span.withColumn("days", F.datediff("last_date", "first_date"))


def daily_trend(df: DataFrame, days: int = 7) -> DataFrame:
    """The last active days, oldest first, padded at the front to ``days`` rows with zeros.

    ``level`` scales the counts to 0..1 (0.5 when they are all equal) and
    ``chart_y`` is the height of the point in the trend chart.
    """
    latest = (
        df.where(F.col("acq_date").isNotNull()).groupBy("acq_date")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("acq_date").desc()).limit(days)
    )
    back = Window.orderBy(F.col("acq_date").desc())
    placed = latest.select("acq_date", "n", (days + 1 - F.row_number().over(back)).alias("slot"))
    slots = df.sparkSession.range(1, days + 1).select(F.col("id").cast("int").alias("slot"))
    every = Window.partitionBy(F.lit(1))  # over `days` rows
    low, high = F.min("n").over(every), F.max("n").over(every)
    level = F.when(high > low, (F.col("n") - low) / (high - low)).otherwise(0.5)
    return (
        slots.join(placed, "slot", "left").na.fill({"n": 0})
        .withColumn("level", level)
        .select(
            "slot", "acq_date",
            F.coalesce(
                F.date_format("acq_date", "MMM dd"),
                F.concat(F.lit("Day "), (days + 1 - F.col("slot")).cast("string")),
            ).alias("day_label"),
            "n", half_even(F.col("level"), 6).alias("level"),
            F.rint(85 - F.col("level") * 60).cast("int").alias("chart_y"),
        )
    )


def zone_ranking(df: DataFrame, n: int = 5) -> DataFrame:
    counts = df.groupBy(zone(F.col("latitude"), F.col("longitude")).alias("zone")).agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.orderBy(F.col("n").desc(), "zone")  # over the seven zones
    bar = F.greatest(F.lit(15.0), F.rint(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))) * 100))
    return (
        counts.select(F.row_number().over(order).alias("rank"), "zone", "n", bar.cast("int").alias("bar_pct"))
        .where(F.col("rank") <= n)
    )


def kpi_summary(df: DataFrame, col: str = "category") -> DataFrame:
    """Totals per category and their rounded shares, in one pass."""
    names = {
        "wildfire": "Wildfire Risk", "agricultural": "Agricultural Burning",
        "industrial": "Industrial (Normal)", "anomaly": "Anomaly/Unclassified",
    }
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(col) == v).alias(k) for k, v in names.items()],
    )
    share = lambda k: F.rint(F.try_divide(F.col(k).cast("double"), F.col("total").cast("double")) * 100)
    return totals.select("*", *[share(k).cast("int").alias(f"{k}_pct") for k in names])


def sensor_gain(df: DataFrame) -> DataFrame:
    """What the other sensors add to the VIIRS detections."""
    viirs = F.coalesce(F.col("satellite_source").contains("VIIRS"), F.lit(False))
    totals = df.agg(F.count_if(viirs).alias("viirs"), F.count(F.lit(1)).alias("combined"))
    gain = F.col("combined") - F.col("viirs")
    pct = F.coalesce(percent(gain, F.when(F.col("viirs") > 0, F.col("viirs"))), F.lit(0.0))
    return totals.select("*", gain.alias("gain"), half_even(pct, 6).alias("gain_pct"))


def confirmation_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("satellite_source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("co_confirmed").alias("confirmed")
    )


def priority_feed(df: DataFrame, col: str = "category") -> DataFrame:
    """The short list: two strongest wildfires, two strongest others, first three."""
    wild = F.col(col) == "Wildfire Risk"
    order = [F.col("frp").desc_nulls_last(), F.col("detection_id")]
    pick = lambda rows, group: rows.orderBy(*order).limit(2).withColumn("_group", F.lit(group))
    top = pick(df.where(wild), 0).unionByName(pick(df.where(~wild), 1))
    chosen = top.orderBy("_group", *order).limit(3)
    number = F.row_number().over(Window.orderBy("_group", *order))  # over three rows
    cat, lat, lon = F.col(col), F.col("latitude"), F.col("longitude")
    return chosen.select(
        number.alias("position"), "detection_id", cat.alias("category"),
        by_category(cat, BADGES).alias("badge"),
        F.concat(
            by_category(cat, HEADINGS), F.lit(" ("), fixed_text(F.col("frp"), 1), F.lit(" MW)")
        ).alias("heading"),
        F.concat(F.col("acq_date").cast("string"), F.lit(" "), clock.clock_display(F.col("acq_time"))).alias("seen"),
        F.concat(fixed_text(lat, 3), F.lit("°N, "), fixed_text(lon, 3), F.lit("°E")).alias("position_text"),
        F.upper(F.coalesce("confidence", F.lit("nominal"))).alias("confidence"),
        map_link(lat, lon, FEED_LINK).alias("map_url"),
        by_category(cat, PROCEDURES).alias("procedure"),
    )


def map_points(df: DataFrame, k: int | None = None, col: str = "category", seed: int = 42) -> DataFrame:
    """All detections with coordinates (``k``: a uniform sample of that size) as JSON points with colour and marker radius."""
    placed = drop_without_coordinates(df)
    sample = sample_exactly(placed, k, seed=seed) if k else placed
    frp = F.coalesce("frp", F.lit(15.0))
    point = F.struct(
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), frp.alias("frp"),
        F.col(col).alias("cat"), by_category(F.col(col), COLOURS).alias("color"),
        F.col("acq_date").cast("string").alias("date"), F.col("land_use_type").alias("land"),
    )
    radius = F.greatest(F.lit(4.0), F.least(F.lit(12.0), F.sqrt(frp)))
    return sample.select("detection_id", half_even(radius, 6).alias("radius"), F.to_json(point).alias("point"))
