"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on (u, v): every node's neighbours (larger ones, or smaller ones and itself) turn to its least neighbour."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    near = sides.join(least, "u")
    if large:
        near = near.where("v > u")
        return near.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("least").alias("v"))
    turned = near.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return turned.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from every node of the links (u, v).

    Alternating star rounds need a logarithmic number of passes whatever the shape of a component. A node with
    very many links is reduced by a map-side minimum, and its rows are the long side of a join that adaptive
    execution splits. Each round is stored in the shared folder, so lost executors cost no earlier round;
    the driver only sees a count and a checksum.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    state = edges.agg(mark.alias("m")).first()["m"]
    while state[0]:
        edges = written(_star(_star(edges, large=True), large=False), "links")
        after = edges.agg(mark.alias("m")).first()["m"]
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
