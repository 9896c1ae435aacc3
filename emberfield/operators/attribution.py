"""Why a model decided as it did: sampled Shapley values and their wording."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import fixed_text
from ..session import work_path
from .sampling import hash_key, sample_exactly

#: Rows whose values stand in for a feature that is not yet known.
BACKGROUND_ROWS = 128
# Reader-friendly feature names.
FRIENDLY = {
    "frp": "Fire Radiative Power (FRP)",
    "log_frp": "High Thermal Energy (log-FRP)",
    "brightness": "Elevated Brightness Temperature",
    "delta_brightness": "Split-Window IR Thermal Contrast",
    "historical_frequency": "Historical Recurrence Rate",
    "distance_to_industrial": "Distance to Industrial Infrastructure",
    "land_use_type_enc": "OSM Land-Use Context",
    "time_of_day_enc": "Diurnal Overpass Timing",
    "season_enc": "Seasonal Climate Factor",
    "confidence_enc": "Satellite Radiometric Confidence",
    "co_confirmed": "Multi-Sensor Co-Confirmation",
}


BASE = "(base)"


#: Rows that are walked through the trees at once.
_WALK_ROWS = 2048


def contributions(
    model, rows: DataFrame, features: list[str], classes: list[str],
    max_rows: int | None = None, orders: int = 6, seed: int = 42, background_rows: int = BACKGROUND_ROWS,
) -> DataFrame:
    """The columns of ``rows`` but ``features``, plus ``base`` and ``values``: sampled Shapley contributions to a forest's scores.

    ``rows`` has detection_id and a ``features`` vector. All rows are explained (``max_rows``: a uniform
    sample of that size), each against one of ``background_rows`` sampled rows, picked by a hash of its id.
    Along a feature order the row's values replace those of the other row one by one, and a feature's contribution is the
    change it causes, averaged over ``orders`` orders. ``base`` holds the class probabilities of the other row, ``values`` the
    contributions, class after class and in each by feature (:func:`of_class`): with ``base``, a class's values add up to the
    probability that the model gives the detection. A row is explained where it lies; nothing is shuffled.
    """
    kept = [c for c in rows.columns if c != "features"]
    vectors = rows.select(*kept, vector_to_array("features").alias("_x"))
    chosen = sample_exactly(vectors, max_rows, seed=seed) if max_rows else vectors
    ring = Window.orderBy(hash_key("detection_id", seed), "detection_id")  # over the background rows
    background = sample_exactly(vectors, background_rows, seed=seed + 1).select(
        (F.row_number().over(ring) - 1).alias("_slot"), F.col("_x").alias("_base")
    )
    slots = background.count()
    slot = F.pmod(F.xxhash64(F.lit(seed), "detection_id"), F.lit(max(slots, 1)))
    paired = chosen.withColumn("_slot", slot).join(F.broadcast(background), "_slot").select(*kept, "_x", "_base")
    rng = random.Random(seed)
    taken = [rng.sample(range(len(features)), len(features)) for _ in range(orders)]
    coded, score = _forest(model)
    n, k = len(features), len(classes)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _WALK_ROWS):
                part = batch.slice(at, _WALK_ROWS)
                x, base = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in ("_x", "_base"))
                start, values = _walk(coded(x), coded(base), score, taken, n, k)
                lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype="int32") * v[0].size, v.ravel()) for v in (start, values)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + lists, [*kept, "base", "values"])

    schema = T.StructType([*paired.select(*kept).schema, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("base", "values")]])
    return paired.mapInArrow(explain, schema)


def _walk(x: list, base: list, score: Callable, orders: list, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(class probabilities of ``base``, contributions by class and feature) of coded rows, averaged over ``orders``."""
    rows = len(x[0])
    every = lambda columns: np.concatenate(columns, axis=1)
    start = score(every(base))
    values = np.zeros((rows, k, n))
    edge = np.cumsum([0, *[c.shape[1] for c in x]])
    differs = [np.flatnonzero((x[f] != base[f]).any(axis=1)) for f in range(n)]  # elsewhere the switch changes nothing
    for order in orders:
        z, p = every(base), start.copy()
        for f in order:
            at = differs[f]
            if len(at):
                z[at, edge[f]:edge[f + 1]] = x[f][at]
                after = score(z[at])
                values[at, :, f] += after - p[at]
                p[at] = after
    return start, values / max(len(orders), 1)


def _forest(model) -> tuple[Callable, Callable]:
    """(codes of vectors, class probabilities of codes) of a forest, from its stored nodes.

    Per feature, ``coded`` gives one column with the place among the thresholds of the forest and one per set of categories
    that a node sends left, 0 inside; a node sends a row left when its column is at most a code.
    """
    spark = SparkSession.active()
    path = work_path(spark, "explained-forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    place = {(r.treeID, r.id): i for i, r in enumerate(nodes)}
    inner = [r for r in nodes if r.leftChild >= 0]
    width = model.numFeatures
    steps = [np.unique([r.split.leftCategoriesOrThreshold[0] for r in inner if r.split.featureIndex == f and r.split.numCategories < 0]) for f in range(width)]
    lefts = [sorted({tuple(sorted(r.split.leftCategoriesOrThreshold)) for r in inner if r.split.featureIndex == f and r.split.numCategories >= 0}) for f in range(width)]
    first = np.cumsum([0, *[1 + len(s) for s in lefts]])
    column, limit = np.zeros(len(nodes), "int64"), np.full(len(nodes), np.iinfo("int32").max, "int32")
    child = np.repeat(np.arange(len(nodes)), 2)  # a leaf leads to itself
    votes = np.zeros((len(nodes), model.numClasses))
    for i, r in enumerate(nodes):
        if r.leftChild < 0:
            votes[i] = np.array(r.impurityStats) / sum(r.impurityStats)
            continue
        f, split = r.split.featureIndex, r.split
        child[2 * i], child[2 * i + 1] = place[r.treeID, r.rightChild], place[r.treeID, r.leftChild]
        if split.numCategories < 0:
            column[i], limit[i] = first[f], np.searchsorted(steps[f], split.leftCategoriesOrThreshold[0])
        else:
            column[i], limit[i] = first[f] + 1 + lefts[f].index(tuple(sorted(split.leftCategoriesOrThreshold))), 0
    roots = np.array([place[t, 0] for t in sorted({r.treeID for r in nodes})])
    depth = max(t.depth for t in model.trees)

    def coded(x: np.ndarray) -> list:
        return [
            np.stack([np.searchsorted(steps[f], x[:, f]), *[~np.isin(x[:, f], s) for s in lefts[f]]], axis=1).astype("int32")
            for f in range(width)
        ]

    def score(z: np.ndarray) -> np.ndarray:
        node = np.tile(roots, (len(z), 1))
        flat, row = z.ravel(), (np.arange(len(z)) * z.shape[1])[:, None]
        for _ in range(depth):
            left = np.take(flat, row + np.take(column, node)) <= np.take(limit, node)
            node = np.take(child, 2 * node + left)
        return sum(votes[node[:, t]] for t in range(len(roots))) / len(roots)

    return coded, score


def of_class(which: Column | int, features: list[str]) -> Column:
    """The contributions to class number ``which`` from 0, by feature, of a row of :func:`contributions`."""
    n = len(features)
    return F.slice("values", which * n + 1 if isinstance(which, int) else (which * n + 1).cast("int"), n)


def shapley_values(
    model, rows: DataFrame, features: list[str], classes: list[str],
    max_rows: int | None = None, orders: int = 6, seed: int = 42, background_rows: int = BACKGROUND_ROWS,
    with_base: bool = False,
) -> DataFrame:
    """(detection_id, feature, class, value): :func:`contributions` with a row each, ``with_base`` also the feature ``(base)``."""
    wide = contributions(model, rows.select("detection_id", "features"), features, classes, max_rows, orders, seed, background_rows)
    names = F.array(*[F.lit(f) for f in features], F.lit(BASE))
    labels = F.array(*[F.lit(c) for c in classes])
    n, k = len(features), len(classes)
    at, whole = F.col("at"), n * k
    is_base = at >= whole
    return wide.select("detection_id", F.posexplode(F.concat("values", "base") if with_base else F.col("values")).alias("at", "value")).select(
        "detection_id", F.element_at(names, F.when(is_base, n + 1).otherwise(at % n + 1)).alias("feature"),
        F.element_at(labels, F.when(is_base, at - whole + 1).otherwise(F.floor(at / n).cast("int") + 1)).alias("class"), "value")


def decision_values(values: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(detection_id, feature, value) for the class that each row of ``verdicts`` (detection_id, verdict) names.

    The input of :func:`explain_text`, without the base.
    """
    own = values.join(verdicts.select("detection_id", "verdict"), "detection_id")
    return own.where((F.col("class") == F.col("verdict")) & (F.col("feature") != BASE)).select("detection_id", "feature", "value")


def importance(values: DataFrame, top: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature, over rows and classes."""
    table = values.where(F.col("feature") != BASE).groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    table = table.orderBy(F.col("mean_abs").desc(), "feature")
    return table.limit(top) if top else table


def explain_text(values: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One sentence per row from its two strongest supporting and one opposing contribution.

    ``values`` is (detection_id, feature, value) for the verdict's class, a row per feature;
    ``verdicts`` is (detection_id, verdict).
    """
    parts = values.groupBy("detection_id").agg(F.collect_list(F.struct("feature", "value")).alias("_parts"))
    rows = verdicts.select("detection_id", "verdict").join(parts, "detection_id", "left")
    return with_explanation(rows, F.col("_parts")).select("detection_id", "verdict", "explanation")


def with_explanation(rows: DataFrame, parts: Column) -> DataFrame:
    """Adds ``explanation``, the sentence of :func:`explain_text`, from ``verdict`` and a row's own list of (feature, value).

    The list, its strongest entries and their wording are columns of their own, so that each is worked out once a row.
    """
    friendly = F.create_map(*[F.lit(v) for pair in FRIENDLY.items() for v in pair])

    def strongest(some: Callable) -> Column:
        order = lambda p: F.struct((-F.abs(p["value"])).alias("weight"), p["feature"].alias("feature"))
        return F.array_sort(F.transform(F.filter(F.coalesce("_list", F.array()), some), order))

    def say(p: Column, sign: str) -> Column:
        name = F.coalesce(F.try_element_at(friendly, p["feature"]), p["feature"])
        return F.concat(F.lit("<b>"), name, F.lit(f"</b> ({sign}"), fixed_text(-p["weight"], 2), F.lit(")"))

    steps = [
        {"_list": parts},
        {"_for": strongest(lambda p: p["value"] > 0), "_not": strongest(lambda p: p["value"] < 0)},
        {"_first": F.get("_for", F.lit(0)), "_second": F.get("_for", F.lit(1)), "_other": F.get("_not", F.lit(0))},
        {"_first": say(F.col("_first"), "impact: +"), "_second": say(F.col("_second"), "impact: +"), "_other": say(F.col("_other"), "counter: -")},
    ]
    out = rows
    for step in steps:
        out = out.withColumns(step)
    reasons = F.coalesce(F.concat("_first", F.lit(" and "), "_second"), "_first", F.lit("baseline radiometric indicators"))
    tail = F.concat(F.lit(", despite counter-evidence from "), "_other", F.lit("."))
    text = F.concat(
        F.lit("This hotspot was classified as <b>"), "verdict", F.lit("</b> primarily driven by "), reasons, F.coalesce(tail, F.lit(".")),
    )
    return out.withColumn("explanation", text).drop("_list", "_for", "_not", "_first", "_second", "_other")
