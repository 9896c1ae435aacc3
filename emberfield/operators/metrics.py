"""Classifier evaluation tables, all derived from one confusion count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, truth: str = "category", predicted: str = "predicted_category") -> DataFrame:
    """(truth, predicted, n): one row per pair of classes that occurs."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence[str], truth: str = "category",
    predicted: str = "predicted_category",
) -> DataFrame:
    """Rows are true classes, columns predicted ones; absent cells are 0."""
    return (
        df.groupBy(F.col(truth).alias("truth")).pivot(predicted, list(classes))
        .agg(F.count(F.lit(1))).na.fill(0)
    )


def _per_class(counts: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support; an undefined ratio is 0."""
    both = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")),
            )
        ).alias("c"),
        F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    # each hit is seen twice, once per side of the pair
    sums = both.groupBy("c.label").agg(
        F.sum("c.t").alias("support"), F.sum("c.p").alias("picked"), (F.sum("hit") / 2).alias("hits")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return (
        sums.withColumn("precision", ratio("hits", "picked"))
        .withColumn("recall", ratio("hits", "support"))
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
                ),
                F.lit(0.0),
            ),
        )
    )


def classification_report(df: DataFrame, truth: str = "category", predicted: str = "predicted_category") -> DataFrame:
    """Per-class rows followed by ``macro avg`` and ``weighted avg`` rows."""
    rows = _per_class(confusion_counts(df, truth, predicted)).select(
        "label", "precision", "recall", "f1", "support"
    )
    weighted = lambda c: F.coalesce(
        F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")), F.lit(0.0)
    ).alias(c)
    names = ("precision", "recall", "f1")
    macro = rows.agg(
        F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    by_support = rows.agg(
        F.lit("weighted avg").alias("label"), *[weighted(c) for c in names],
        F.sum("support").alias("support"),
    )
    return rows.unionByName(macro).unionByName(by_support)


def overall_metrics(df: DataFrame, truth: str = "category", predicted: str = "predicted_category") -> DataFrame:
    """One row: n, accuracy, balanced accuracy (mean recall of true classes), macro scores."""
    rows = _per_class(confusion_counts(df, truth, predicted))
    return rows.agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("hits").cast("double"), F.sum("support").cast("double")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def class_weights(df: DataFrame, label: str = "category") -> DataFrame:
    """Balanced weights n / (k * n_class) from the class counts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # over the class counts only
    return counts.select(
        label, "n",
        (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"),
    )


def with_class_weights(df: DataFrame, label: str = "category", col: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(col))
    return df.join(weights, label)


def write_report(
    df: DataFrame, path: str, truth: str = "category", predicted: str = "predicted_category"
) -> None:
    """Stores the per-class report, the confusion counts and the overall figures as Parquet tables."""
    for name, table in (
        ("per_class", classification_report(df, truth, predicted)),
        ("confusion", confusion_counts(df, truth, predicted)),
        ("overall", overall_metrics(df, truth, predicted)),
    ):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
