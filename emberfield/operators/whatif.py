"""Batch scoring of scenarios by the additive rule scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Month that stands for each season, and the sensor defaults of a scenario.
SEASON_MONTH = {"Summer": 4, "Monsoon": 7, "Post-Monsoon": 10, "Winter": 1}
SCENARIO_PIXEL = 0.4
SCENARIO_CONFIDENCE = 2


def scenario_features(df: DataFrame) -> DataFrame:
    """Completes a scenario table to the model's feature columns."""
    month = None
    for name, m in SEASON_MONTH.items():
        month = (F.when if month is None else month.when)(F.col("season") == name, m)
    return (
        df.withColumn("month", month.otherwise(4).cast("int"))
        .withColumn("log_frp", F.log1p("frp"))
        .withColumn("scan", F.lit(SCENARIO_PIXEL))
        .withColumn("track", F.lit(SCENARIO_PIXEL))
        .withColumn("confidence_enc", F.lit(SCENARIO_CONFIDENCE))
    )


def rule_scores(df: DataFrame) -> DataFrame:
    """Four additive scores, their softmax in percent, and the winner.

    Ties go to wildfire, then agricultural, industrial, anomaly.
    """
    frp, delta = F.col("frp"), F.col("delta_brightness")
    repeats, use = F.col("historical_frequency"), F.col("land_use_type")
    industrial = (use == "industrial") | (F.col("distance_to_industrial") < 1000)
    forest, farm = use == "forest", use == "farmland"
    stubble = F.col("month").isin(10, 11)
    plus = lambda base, cond, gain: F.lit(base) + F.when(cond, gain).otherwise(0.0)
    bonus = lambda cond, gain: F.when(cond, gain).otherwise(0.0)

    industry = plus(0.05, (repeats >= 3) | (industrial & (repeats >= 1)), 8.5 + repeats * 1.5)
    sudden = ~industrial & (repeats <= 1) & ((frp >= 7.0) | (forest & (frp >= 4.0)))
    wild = plus(0.05, sudden, 6.0 + frp / 25.0 + bonus(forest, 4.0) + delta / 20.0)
    field = farm & (stubble | (repeats >= 1)) & (frp < 15.0)
    agri = plus(0.05, field, 5.5 + bonus(stubble, 3.5) + repeats * 1.2)
    odd = plus(0.10, (frp < 6.0) & (repeats == 0) & ~forest & ~industrial, 4.5)

    scored = df.withColumns({"_w": wild, "_a": agri, "_i": industry, "_o": odd})
    top = F.greatest("_w", "_a", "_i", "_o")
    raised = scored.withColumns({f"_e{k}": F.exp(F.col(f"_{k}") - top) for k in "waio"})
    total = F.col("_ew") + F.col("_ea") + F.col("_ei") + F.col("_eo")
    share = {
        "p_wildfire": "_ew", "p_agricultural": "_ea", "p_industrial": "_ei", "p_anomaly": "_eo",
    }
    out = raised.withColumns({name: F.col(c) / total * 100 for name, c in share.items()})
    best = F.greatest(*share)
    return (
        out.withColumn("confidence_pct", best)
        .withColumn(
            "verdict",
            F.when(F.col("p_wildfire") == best, "Wildfire Risk")
            .when(F.col("p_agricultural") == best, "Agricultural Burning")
            .when(F.col("p_industrial") == best, "Industrial (Normal)")
            .otherwise("Anomaly/Unclassified"),
        )
        .drop("_w", "_a", "_i", "_o", "_ew", "_ea", "_ei", "_eo")
    )
