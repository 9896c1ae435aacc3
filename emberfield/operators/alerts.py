"""Wildfire alert tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_text
from ..functions.places import map_link
from .ranking import with_rank_desc


def alert_rows(df: DataFrame, frp_threshold: float = 0.0) -> DataFrame:
    """Wildfire rows, by the predicted category when there is one; a threshold of 0 keeps all."""
    col = "predicted_category" if "predicted_category" in df.columns else "category"
    rows = df.where(F.col(col) == "Wildfire Risk")
    if frp_threshold > 0 and "frp" in df.columns:
        rows = rows.where(F.col("frp") >= frp_threshold)
    return rows


def wildfire_alerts(df: DataFrame, frp_threshold: float = 0.0) -> DataFrame:
    """Alert rows with their rank by FRP (all of them) and a map link."""
    ranked = with_rank_desc(alert_rows(df, frp_threshold), "frp", "detection_id")
    return ranked.withColumn("map_url", map_link(F.col("latitude"), F.col("longitude")))


def alert_digest(df: DataFrame, frp_threshold: float = 0.0) -> DataFrame:
    """One digest line and its table fields per alert."""
    alerts = wildfire_alerts(df, frp_threshold)
    lat, lon = F.col("latitude"), F.col("longitude")
    text = lambda c, default: (
        F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in df.columns else F.lit(default)
    )
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    use = text("land_use_type", "unknown")
    frp = F.coalesce(F.concat(fixed_text(F.col("frp"), 1), F.lit(" MW")), raw("frp"))
    point = F.coalesce(
        F.concat(fixed_text(lat, 4), F.lit("N, "), fixed_text(lon, 4), F.lit("E")),
        F.concat(raw("latitude"), F.lit(", "), raw("longitude")),
    )
    date = F.substring(text("acq_date", ""), 1, 10)
    url = F.coalesce(F.col("map_url"), F.lit("N/A"))
    line = F.concat(
        F.lit("#"), F.col("rank").cast("string"), F.lit("  FRP: "), frp, F.lit("  |  "), point,
        F.lit("  |  "), date, F.lit("  |  "), use, F.lit("  |  "), url,
    )
    return alerts.select(
        "detection_id", "rank", line.alias("line"),
        F.coalesce(F.concat(fixed_text(F.col("frp"), 1), F.lit(" MW")), F.lit("N/A")).alias("frp_text"),
        F.concat(fixed_text(lat, 4), F.lit("°N, "), fixed_text(lon, 4), F.lit("°E")).alias("position_text"),
        F.concat_ws(" ", date, F.substring(text("acq_time", ""), 1, 4)).alias("seen"),
        F.concat(F.upper(F.substring(use, 1, 1)), F.lower(F.substring(use, 2, 1000))).alias("land_use"),
        F.concat(text("time_of_day", ""), F.lit(" · "), text("season", "")).alias("period"),
        (F.col("historical_frequency") if "historical_frequency" in df.columns else F.lit(0))
        .cast("bigint").alias("repeats"),
        url.alias("map_url"),
    )


def sent_log_entry(alerts: DataFrame, frp_threshold: float = 0.0) -> DataFrame:
    """One row for the sent log: time, number of alerts, threshold."""
    return alerts.agg(F.count(F.lit(1)).alias("hotspots")).select(
        F.current_timestamp().alias("sent_at"), "hotspots",
        F.lit(float(frp_threshold)).alias("frp_threshold"),
    )
