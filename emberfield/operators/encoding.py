"""Label encoding of text columns and the model input columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NUMERIC_FEATURES, OPTIONAL_FEATURES, TEXT_FEATURES


def label_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, code): the distinct values in sorted order numbered from 0; null is ``unknown``."""
    values = df.select(F.coalesce(F.col(col).cast("string"), F.lit("unknown")).alias("value"))
    order = Window.orderBy("value")
    return values.distinct().select(
        "value", (F.row_number().over(order) - 1).cast("int").alias("code")
    )


def encode(df: DataFrame, col: str, dictionary: DataFrame, out: str | None = None) -> DataFrame:
    """Adds the code of ``col``; a value the dictionary lacks gets code 0.

    The dictionary goes to the rows: its labels are few, and joined by shuffle each would have all its rows in one task.
    """
    out = out or f"{col}_enc"
    known = F.broadcast(dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    text = F.coalesce(F.col(col).cast("string"), F.lit("unknown"))
    return (
        df.withColumn("_text", text)
        .join(known, F.col("_text") == F.col("_value"), "left")
        .withColumn(out, F.coalesce("_code", F.lit(0)))
        .drop("_text", "_value", "_code")
    )


def feature_names(columns: Sequence[str]) -> list[str]:
    have = set(columns)
    return (
        [c for c in NUMERIC_FEATURES if c in have]
        + [c for c in OPTIONAL_FEATURES if c in have]
        + [f"{c}_enc" for c in TEXT_FEATURES if c in have]
    )


def feature_matrix(
    df: DataFrame, dictionaries: dict[str, DataFrame] | None = None,
    keep: Sequence[str] = ("detection_id", "category"),
) -> DataFrame:
    """``keep`` plus the model inputs as doubles, nulls as 0, in model order."""
    names = feature_names(df.columns)
    for col in TEXT_FEATURES:
        if col in df.columns:
            dictionary = (dictionaries or {}).get(col)
            df = encode(df, col, label_dictionary(df, col) if dictionary is None else dictionary)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return df.select(*[c for c in keep if c in df.columns], *[value(c) for c in names])
