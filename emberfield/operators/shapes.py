"""Polygons, lines and points as edge tables on grids: containment by a cell cover, nearest by a pyramid of cells.

A shape is a row (poly_id, landuse, rings): ``rings`` is an array of parts, a part an array of points (x = longitude,
y = latitude). A part of three or more points is a ring, all rings of a shape together bound its area (parts or holes by
the even-odd rule); a part of two points is a line, of one a point. Where a column ``shape`` says ``line``, all
parts are open lines. ``poly_id`` is unique; missing points are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import crossing_x, edge_distance, floor_cell, mercator, touches_edge
from ..schema import drop_without_coordinates
from ..session import written
from .skew import salted_join, spread_out

CONTAIN_DEG = 0.05
#: Where only the least rank counts, cells this many times wider are asked first; what they leave open goes to the fine grid.
COARSER = 8
#: A cell of one shape with more edges than this is divided by REFINE each way, at most DEPTH times.
CROWDED_EDGES = 256
REFINE = 16
DEPTH = 3
#: Cells of the nearest search, in projected metres, and how many times wider each level of the pyramid is.
NEAREST_M = 800
WIDER = 4
# cells are taken this much larger when edges are assigned to them (degrees, metres): far more than rounding, far less
# than a cell
_GROW_DEG, _GROW_M = 1e-9, 1e-2
_COLUMN_BLOCK = 10
_POLAR = 89.9  # the projection ends short of the poles

_CELL = ["_ci", "_cj"]


def edges_of(shapes: DataFrame) -> DataFrame:
    """(poly_id, landuse, ring, k, n, closed, x1, y1, x2, y2): a row per edge; a lone point is an edge of length 0.

    ``k`` numbers the ``n`` edges of a part in order.
    """
    ok = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
    area = F.lit(True) if "shape" not in shapes.columns else F.coalesce(F.col("shape") != "line", F.lit(True))
    parts = shapes.select("poly_id", "landuse", area.alias("_area"), F.posexplode("rings").alias("ring", "_part"))
    parts = parts.withColumn("_part", F.filter("_part", ok)).withColumn("_size", F.size("_part")).where("_size > 0")
    parts = parts.withColumn("closed", F.col("_area") & (F.col("_size") > 2)).withColumn(
        "n", F.when(F.col("closed"), F.col("_size")).otherwise(F.greatest(F.col("_size") - 1, F.lit(1)))
    )
    rows = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a, b = F.col("_part")[F.col("k")], F.col("_part")[(F.col("k") + 1) % F.col("_size")]
    return rows.select(
        "poly_id", "landuse", "ring", "k", "n", "closed",
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"),
    )


def touched_cells(edges: DataFrame, size: float, grow: float) -> DataFrame:
    """A row per edge and grid cell (_ci, _cj) that it may touch: as many as the edge is long, not as its box is large."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("_ci", F.explode(F.sequence(floor_cell(low - grow, size), floor_cell(high + grow, size))))
    at = lambda y: F.coalesce(F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1"))
    from_y = F.greatest(low, F.col("_ci") * size - grow)
    to_y = F.least(high, (F.col("_ci") + 1) * size + grow)
    flat = F.col("y1") == F.col("y2")
    xa, xb = F.when(flat, F.col("x1")).otherwise(at(from_y)), F.when(flat, F.col("x2")).otherwise(at(to_y))
    rows = rows.withColumn("_xa", F.least(xa, xb)).withColumn("_xb", F.greatest(xa, xb))
    return rows.withColumn(
        "_cj", F.explode(F.sequence(floor_cell(F.col("_xa") - grow, size), floor_cell(F.col("_xb") + grow, size)))
    ).drop("_xa", "_xb")


def _centre(cell: str, size: float) -> Column:
    return (F.col(cell) + 0.5) * size


def _inside_centres(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(cell, poly_id, landuse) of the cells whose centre lies in a shape, from where its edges cross each row's centre line."""
    row = F.explode(F.sequence(floor_cell(F.least("y1", "y2"), size), floor_cell(F.greatest("y1", "y2"), size)))
    y = _centre("_ci", size)
    crossings = edges.withColumn("_ci", row).where((F.col("y1") > y) != (F.col("y2") > y)).select(
        "poly_id", "landuse", "_ci", crossing_x(y, F.struct("x1", "y1", "x2", "y2")).alias("_x"))
    sorted_x = crossings.groupBy("poly_id", "landuse", "_ci").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    pair = lambda i: F.struct(F.col("_xs")[2 * i].alias("from"), F.col("_xs")[2 * i + 1].alias("to"))
    spans = sorted_x.select(
        "poly_id", "landuse", "_ci", F.explode(F.transform(F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1), pair)).alias("_span")
    ).select("poly_id", "landuse", "_ci", F.col("_span.from").alias("_from"), F.col("_span.to").alias("_to"))
    wide = size * _COLUMN_BLOCK
    spans = spans.withColumn("_block", F.explode(F.sequence(floor_cell(F.col("_from"), wide) - 1, floor_cell(F.col("_to"), wide) + 1)))
    placed = cells.select(*_CELL).withColumn("_block", F.floor(F.col("_cj") / _COLUMN_BLOCK).cast("bigint"))
    x = _centre("_cj", size)
    return placed.join(spans, ["_ci", "_block"]).where((F.col("_from") <= x) & (x < F.col("_to"))).select(*_CELL, "poly_id", "landuse")


def cell_cover(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(cell, poly_id, landuse, edges, loose, odd) for the given cells that a shape covers or borders.

    Inside cells have no edges and need no test. A border cell carries only its own edges. The edges elsewhere
    matter through a parity: on their way out of the cell, chains of edges leave a loose end (the y of every vertex
    between an edge listed here and one that is not, to the right), so that for any point of the cell the crossings of a ray to
    the right are those with the listed edges, plus one per loose end above the point, plus ``odd``. ``odd`` comes from the
    cell's centre, where all crossings are known. Vertices are only compared, so the test equals the whole ring's.
    """
    bounds = touched_cells(edges, size, _GROW_DEG).join(cells.select(*_CELL), _CELL, "left_semi")
    of_ring = Window.partitionBy(*_CELL, "poly_id", "ring")
    order = of_ring.orderBy("k")
    first, last = F.min("k").over(of_ring), F.max("k").over(of_ring)
    wraps = (F.min("k").over(of_ring) == 0) & (F.max("k").over(of_ring) == F.col("n") - 1)
    follows = F.when(F.col("k") == first, wraps).otherwise(F.lag("k").over(order) == F.col("k") - 1)
    followed = F.when(F.col("k") == last, wraps).otherwise(F.lead("k").over(order) == F.col("k") + 1)
    x, y = _centre("_cj", size), _centre("_ci", size)
    ends = F.array_compact(F.array(
        F.when(~follows & (F.col("x1") > x), F.col("y1")), F.when(~followed & (F.col("x2") > x), F.col("y2"))
    ))
    border = bounds.withColumn("_loose", ends).groupBy(*_CELL, "poly_id", "landuse").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), F.flatten(F.collect_list("_loose")).alias("loose")
    )
    centres = _inside_centres(edges, cells, size).withColumn("_inside", F.lit(True))
    cover = border.join(centres, [*_CELL, "poly_id", "landuse"], "full")
    here = _local_crossings(x, y, F.col("edges"), F.col("loose"))
    odd = (F.coalesce(F.col("_inside"), F.lit(False)).cast("int") + F.coalesce(here, F.lit(0))) % 2 == 1
    return cover.withColumn("odd", odd).drop("_inside")


def _local_crossings(x: Column, y: Column, edges: Column, loose: Column) -> Column:
    hit = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < crossing_x(y, e))
    return F.size(F.filter(edges, lambda e: F.coalesce(hit(e), F.lit(False)))) + F.size(F.filter(loose, lambda v: v > y))


def containment(rows: DataFrame, edges: DataFrame, size: float = CONTAIN_DEG, depth: int = DEPTH) -> DataFrame:
    """(detection_id, poly_id, landuse) for each area that strictly contains a row; ``edges`` from :func:`edges_of`.

    Work follows the cells that have rows. Crowded border cells are covered again on a finer grid, so a row is never
    tested against more than about ``CROWDED_EDGES`` edges of a shape, however many it has.
    """
    hits, finer = _contained(rows, edges, size, depth, None)
    return hits.select("detection_id", "poly_id", "landuse") if finer is None else hits.select(
        "detection_id", "poly_id", "landuse").unionByName(finer).dropDuplicates(["detection_id", "poly_id"])


def least_containing(rows: DataFrame, edges: DataFrame, rank: Column, size: float = CONTAIN_DEG, depth: int = DEPTH) -> DataFrame:
    """(detection_id, rank): the least ``rank`` of the areas that strictly contain a row, for rows that are in one.

    ``rank`` is a whole number from 0, from ``landuse``; areas where it is null do not count. A cell wholly inside an area has an answer
    that only lower ranks can change, so of the areas on a cell one of the least rank and the borders of lower ones are met:
    the work does not grow with the areas that lie over each other. Wide cells come first: one that no border of a lower rank
    touches is settled for all its rows, and the fine grid is made only of the areas and rows of the others.
    """
    edges = written(spread_out(edges.where("closed").where(rank.isNotNull()), "poly_id"), "ranked-edges")
    sure, rows, edges = _settled(rows, edges, rank, size * COARSER)
    return sure.unionByName(_least_on_grid(rows, edges, rank, size, depth)).groupBy("detection_id").agg(F.min("rank").alias("rank"))


def with_least(df: DataFrame, edges: DataFrame, rank: Column, to: str, size: float = CONTAIN_DEG, depth: int = DEPTH) -> DataFrame:
    """``df`` with the rank of :func:`least_containing` as column ``to``, null for rows that are in no area or have no place.

    What a wide cell settles is looked up by cell, a small table, so the rows stay where they are. Only if cells are left
    open are rows joined by id with what the fine grid finds.
    """
    edges = written(spread_out(edges.where("closed").where(rank.isNotNull()), "poly_id"), "ranked-edges")
    rows, wide = placed_rows(df), size * COARSER
    placed, cells, least, lower = _wide_ranks(rows, edges, rank, wide)
    y, x = F.col("latitude"), F.col("longitude")
    here = y.isNotNull() & x.isNotNull() & ~F.isnan(y) & ~F.isnan(x)
    at = df.drop(to).withColumn("_ci", F.when(here, floor_cell(y, wide))).withColumn("_cj", F.when(here, floor_cell(x, wide)))
    out = salted_join(at, least, _CELL, ["detection_id"], counts=cells).withColumnRenamed("_least", to)
    out = out.select("detection_id", *[c for c in df.columns if c not in ("detection_id", to)], to)
    if lower.isEmpty():
        return out
    # stored, so that its size is known before the join and few open rows move no others
    fine = written(_least_on_grid(*_open(placed, edges, lower), rank, size, depth).withColumnRenamed("rank", "_fine"), "fine-ranks")
    return out.join(fine, "detection_id", "left").withColumn(to, F.least(to, "_fine")).drop("_fine")


def _settled(rows: DataFrame, edges: DataFrame, rank: Column, size: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((detection_id, rank) from areas wholly over a row's cell, the rows that another area could change, edges of such areas)."""
    placed, cells, least, lower = _wide_ranks(rows, edges, rank, size)
    sure = salted_join(placed, least, _CELL, ["detection_id"], how="inner", counts=cells).select("detection_id", F.col("_least").alias("rank"))
    return sure, *_open(placed, edges, lower)


def _wide_ranks(rows: DataFrame, edges: DataFrame, rank: Column, size: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with their cells, rows per cell, least rank of the areas wholly over a cell, the areas by cell that could change it)."""
    placed = rows.withColumn("_ci", floor_cell(F.col("latitude"), size)).withColumn("_cj", floor_cell(F.col("longitude"), size))
    cells = written(placed.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_rows")), "wide-cells")
    area = [*_CELL, "poly_id", rank.cast("int").alias("_rank")]
    border = touched_cells(edges, size, _GROW_DEG).join(cells.select(*_CELL), _CELL, "left_semi").select(*area).distinct()
    border = written(border, "wide-borders")
    whole = _inside_centres(edges, cells, size).select(*area).join(border, [*_CELL, "poly_id"], "left_anti")
    least = written(whole.groupBy(*_CELL).agg(F.min("_rank").alias("_least")), "wide-ranks")
    lower = border.join(least, _CELL, "left").where(F.col("_least").isNull() | (F.col("_rank") < F.col("_least")))
    return placed, cells, least, written(lower.select(*_CELL, "poly_id"), "wide-open")


def _open(placed: DataFrame, edges: DataFrame, lower: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the cells that are not settled, and the edges of the areas that matter there."""
    left = placed.join(lower.select(*_CELL).distinct(), _CELL, "left_semi").select("detection_id", "longitude", "latitude")
    return left, edges.join(lower.select("poly_id").distinct(), "poly_id", "left_semi")


def _least_on_grid(rows: DataFrame, edges: DataFrame, rank: Column, size: float, depth: int) -> DataFrame:
    """:func:`least_containing` on one grid and those below it."""
    hits, finer = _contained(rows, edges, size, depth, rank)
    found = hits.select("detection_id", "_rank") if finer is None else hits.select("detection_id", "_rank").unionByName(
        finer.withColumnRenamed("rank", "_rank"))
    return found.groupBy("detection_id").agg(F.min("_rank").alias("rank"))


def _contained(rows: DataFrame, edges: DataFrame, size: float, depth: int, rank: Column | None) -> tuple[DataFrame, DataFrame | None]:
    """(hits on this grid, what the finer grids find in the crowded cells or None)."""
    x, y = F.col("longitude"), F.col("latitude")
    placed = rows.withColumn("_ci", floor_cell(y, size)).withColumn("_cj", floor_cell(x, size))
    cells = placed.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_rows"))
    closed = edges.where("closed") if rank is None else edges.where("closed").where(rank.isNotNull())
    cover = cell_cover(closed, cells, size)
    if rank is not None:
        cover = _least_cover(cover.withColumn("_rank", rank.cast("int")))
    cover = written(cover, "cell-cover")
    crowded = F.coalesce(F.size("edges"), F.lit(0)) > (CROWDED_EDGES if depth else 2**31 - 1)
    tested = salted_join(placed, cover.where(~crowded), _CELL, ["detection_id"], how="inner", counts=cells, heavy_work=True)
    inside = (_local_crossings(x, y, F.col("edges"), F.col("loose")) + F.col("odd").cast("int")) % 2 == 1
    off_edge = ~F.exists("edges", lambda e: touches_edge(x, y, e))
    hits = tested.where(F.when(F.col("edges").isNull(), F.col("odd")).otherwise(inside & off_edge))
    full = cover.where(crowded)
    if not depth or full.isEmpty():
        return hits, None
    some = placed.join(full.select(*_CELL).distinct(), _CELL, "left_semi").select("detection_id", "longitude", "latitude")
    again = closed.join(full.select("poly_id").distinct(), "poly_id", "left_semi")
    if rank is None:
        return hits, containment(some, again, size / REFINE, depth - 1)
    return hits, _least_on_grid(some, again, rank, size / REFINE, depth - 1)


def _least_cover(cover: DataFrame) -> DataFrame:
    """Of the areas over a cell, one of the least rank that is wholly over it, and the borders of those of a lower one."""
    whole = F.col("edges").isNull()
    least = cover.where(whole & F.col("odd")).groupBy(*_CELL).agg(F.min("_rank").alias("_least"))
    borders = cover.where(~whole).join(least, _CELL, "left").where(F.col("_least").isNull() | (F.col("_rank") < F.col("_least")))
    nothing = lambda c: F.lit(None).cast(cover.schema[c].dataType).alias(c)
    one = least.select(*_CELL, nothing("poly_id"), nothing("edges"), nothing("loose"), F.lit(True).alias("odd"), F.col("_least").alias("_rank"))
    return borders.select(*_CELL, "poly_id", "edges", "loose", "odd", "_rank").unionByName(one)


def _projected(edges: DataFrame) -> DataFrame:
    a, b = mercator(F.col("y1"), F.col("x1")), mercator(F.col("y2"), F.col("x2"))
    held = edges.where((F.abs("y1") < _POLAR) & (F.abs("y2") < _POLAR))
    return held.select("poly_id", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def _near_cells(cells: DataFrame, occupied: DataFrame, max_m: float, size: float) -> DataFrame:
    """(cell, _si, _sj): for each cell of ``cells`` the occupied cells that can hold the edge nearest to one of its points.

    Both sides are taken up a pyramid of wider cells. From the top, where the nine cells around are all within reach, each
    pair of cells is replaced by its pairs of children; a pair goes when its least distance exceeds the greatest distance of
    another pair of the same cell, or ``max_m``. So the search opens only what lies between those two rings.
    """
    levels = 0
    while size * WIDER**levels < max_m:
        levels += 1
    up = lambda name, k: F.floor(F.col(name) / WIDER**k).cast("bigint")
    # the pyramid's first level is shared by all others, and small: distinct cells only
    own = lambda k: cells.select(up("_ci", k).alias("_ci"), up("_cj", k).alias("_cj")).distinct()
    other = lambda k: occupied.select(up("_ci", k).alias("_si"), up("_cj", k).alias("_sj")).distinct()
    around = F.array(*[F.lit(d).cast("bigint") for d in (-1, 0, 1)])
    pairs = own(levels).withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around)).select(
        *_CELL, (F.col("_ci") + F.col("_di")).alias("_si"), (F.col("_cj") + F.col("_dj")).alias("_sj")
    ).join(other(levels), ["_si", "_sj"])
    for level in range(levels, -1, -1):
        if level < levels:
            mine = own(level).withColumnsRenamed({"_ci": "_mi", "_cj": "_mj"}).withColumn("_ci", up("_mi", 1)).withColumn("_cj", up("_mj", 1))
            theirs = other(level).withColumnsRenamed({"_si": "_ti", "_sj": "_tj"}).withColumn("_si", up("_ti", 1)).withColumn("_sj", up("_tj", 1))
            pairs = pairs.join(mine, _CELL).join(theirs, ["_si", "_sj"]).select(
                F.col("_mi").alias("_ci"), F.col("_mj").alias("_cj"), F.col("_ti").alias("_si"), F.col("_tj").alias("_sj"))
        metres = size * WIDER**level
        apart_i, apart_j = F.abs(F.col("_ci") - F.col("_si")), F.abs(F.col("_cj") - F.col("_sj"))
        least = F.hypot(F.greatest(apart_i - 1, F.lit(0)), F.greatest(apart_j - 1, F.lit(0))) * metres - 4 * _GROW_M
        most = F.hypot(apart_i + 1, apart_j + 1) * metres + 4 * _GROW_M
        bound = F.least(F.min("_most").over(Window.partitionBy(*_CELL)), F.lit(max_m))
        pairs = pairs.withColumn("_most", most).withColumn("_bound", bound).where(least <= F.col("_bound")).drop("_most", "_bound")
    return pairs


def nearest_distance(rows: DataFrame, edges: DataFrame, max_m: float, size: float = NEAREST_M) -> DataFrame:
    """(detection_id, distance): web-mercator metres to the nearest edge, for the rows that have one within ``max_m``.

    Rows are (detection_id, latitude, longitude). Edges are listed by the cells they touch, so a cell's rows meet only
    edges of the cells that can hold the nearest one, and of those only such whose distance from the cell's centre is not
    beyond the best by more than the cell's diagonal.
    """
    x, y = mercator(F.col("latitude"), F.col("longitude"))
    placed = rows.where(F.abs("latitude") < _POLAR).withColumn("_px", x).withColumn("_py", y)
    placed = placed.withColumn("_ci", floor_cell(F.col("_py"), size)).withColumn("_cj", floor_cell(F.col("_px"), size))
    counts = placed.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_rows"))
    cells = written(counts, "row-cells")
    listed = written(touched_cells(_projected(edges), size, _GROW_M).select(*_CELL, "x1", "y1", "x2", "y2"), "edge-cells")
    near = _near_cells(cells, written(listed.select(*_CELL).distinct(), "edge-cell-keys"), max_m, size)
    around = near.join(listed.withColumnsRenamed({"_ci": "_si", "_cj": "_sj"}), ["_si", "_sj"])
    edge = F.struct("x1", "y1", "x2", "y2")
    away = edge_distance(_centre("_cj", size), _centre("_ci", size), F.array(edge))
    # the distance must not be computed again for the filters below
    measured = around.withColumn("_away", away).withColumn("_best", F.min("_away").over(Window.partitionBy(*_CELL)))
    kept = measured.where(F.col("_away") <= F.col("_best") + 2**0.5 * size + 4 * _GROW_M)
    lists = kept.groupBy(*_CELL).agg(F.collect_set(edge).alias("_edges"))
    met = salted_join(placed, lists, _CELL, ["detection_id"], how="inner", counts=cells, heavy_work=True)
    out = met.select("detection_id", edge_distance(F.col("_px"), F.col("_py"), F.col("_edges")).alias("distance"))
    return out.where(F.col("distance") <= max_m)


def placed_rows(df: DataFrame) -> DataFrame:
    return drop_without_coordinates(df.select("detection_id", "latitude", "longitude"))
