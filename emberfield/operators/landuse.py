"""Land-use context: the class of the polygons around a detection, distance to the nearest industrial shape.

Shapes are a table (poly_id, landuse, rings) as described in :mod:`emberfield.operators.shapes`, where the joins are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import shapes

# Distance when no industrial polygon is in reach, and the polygon tags measured.
MAX_DISTANCE_M = 50_000.0
DISTANCE_TAGS = ("industrial", "quarry")

# Map tags and the land-use class each one stands for.
TAG_CLASS = {
    "industrial": "industrial",
    "quarry": "industrial",
    "military": "industrial",
    "factory": "industrial",
    "works": "industrial",
    "forest": "forest",
    "wood": "forest",
    "farmland": "farmland",
    "farmyard": "farmland",
    "orchard": "farmland",
    "vineyard": "farmland",
    "meadow": "farmland",
    "residential": "residential",
    "commercial": "residential",
    "retail": "residential",
    "village_green": "residential",
}
# Which class wins when polygons overlap.
CLASS_PRIORITY = ("industrial", "forest", "farmland", "residential")

CLUSTER_DEG = 0.5
CLUSTER_MARGIN_DEG = 0.03


def land_class(tag: Column) -> Column:
    """Class of a raw map tag; tags not listed and missing ones are ``unknown``."""
    out = None
    for cls in CLASS_PRIORITY:
        tags = [t for t, c in TAG_CLASS.items() if c == cls]
        out = (F.when if out is None else out.when)(F.lower(tag).isin(tags), cls)
    return out.otherwise("unknown")


def with_cluster(df: DataFrame, size: float = CLUSTER_DEG) -> DataFrame:
    return df.withColumn("cluster_lat", F.floor(F.col("latitude") / size) * size).withColumn(
        "cluster_lon", F.floor(F.col("longitude") / size) * size
    )


def cluster_boxes(df: DataFrame, margin: float = CLUSTER_MARGIN_DEG) -> DataFrame:
    """Bounding box of the detections of each 0.5 degree cluster, with a margin."""
    return (
        with_cluster(df)
        .groupBy("cluster_lat", "cluster_lon")
        .agg(
            (F.min("longitude") - margin).alias("west"),
            (F.min("latitude") - margin).alias("south"),
            (F.max("longitude") + margin).alias("east"),
            (F.max("latitude") + margin).alias("north"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def polygon_hits(df: DataFrame, polygons: DataFrame) -> DataFrame:
    """(detection_id, poly_id, landuse) for each area that strictly contains a detection; lines and points contain none."""
    return shapes.containment(shapes.placed_rows(df), shapes.edges_of(polygons))


def with_land_use(df: DataFrame, polygons: DataFrame) -> DataFrame:
    """Adds ``land_use_type``: the winning class among the polygons around a detection."""
    order = F.array(*[F.lit(c) for c in CLASS_PRIORITY])
    place = F.array_position(order, land_class(F.col("landuse")))
    ranked = shapes.with_least(df.drop("land_use_type"), shapes.edges_of(polygons), F.when(place > 0, place), "_place")
    use = F.when(F.col("_place").isNull(), "unknown").otherwise(F.element_at(order, F.col("_place")))
    return ranked.withColumn("land_use_type", use).drop("_place")


def with_industrial_distance(df: DataFrame, polygons: DataFrame, max_m: float = MAX_DISTANCE_M) -> DataFrame:
    """Adds ``distance_to_industrial`` in web-mercator metres, 0 inside, at most ``max_m``.

    Industrial shapes may be areas, lines or points.
    """
    rows = written(shapes.placed_rows(df), "placed")
    edges = written(shapes.edges_of(polygons.where(F.col("landuse").isin(*DISTANCE_TAGS))), "industrial-edges")
    inside = written(shapes.least_containing(rows, edges, F.lit(0)).select("detection_id", F.lit(0.0).alias("_dist")), "inside")
    outside = rows.join(inside, "detection_id", "left_anti")  # the nearest edge is asked for these only
    nearest = shapes.nearest_distance(outside, edges, max_m).withColumnRenamed("distance", "_dist").unionByName(inside).groupBy("detection_id").agg(F.min("_dist").alias("_dist"))
    return (
        df.drop("distance_to_industrial").join(nearest, "detection_id", "left")
        .withColumn("distance_to_industrial", F.coalesce("_dist", F.lit(max_m)))
        .drop("_dist")
    )


def with_land_use_defaults(df: DataFrame) -> DataFrame:
    """Fills or adds the two context columns when no polygons are at hand."""
    for name, default in (("land_use_type", "unknown"), ("distance_to_industrial", MAX_DISTANCE_M)):
        value = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(value, F.lit(default)))
    return df
