"""Containment and nearest distance over areas, lines and points, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberfield.operators import encoding, landuse, shapes

SHAPES = "poly_id long, landuse string, rings array<array<struct<x:double,y:double>>>, shape string"
ROWS = "detection_id long, latitude double, longitude double"


def star(rng, cx, cy, r, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(t), cy + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]


def ring_edges(part, closed=True):
    if len(part) < 3 or not closed:
        return list(zip(part, part[1:])) or [(part[0], part[0])]
    return list(zip(part, part[1:] + part[:1]))


def inside(x, y, rings):
    odd = False
    for part in rings:
        if len(part) < 3:
            continue
        for (x1, y1), (x2, y2) in ring_edges(part):
            turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return odd


def merc(x, y):
    return math.radians(x) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * 6378137.0


def away(x, y, shape):
    kind, rings = shape
    if kind != "line" and inside(x, y, rings):
        return 0.0
    px, py = merc(x, y)
    best = math.inf
    for part in rings:
        for a, b in ring_edges(part, kind != "line"):
            (x1, y1), (x2, y2) = merc(*a), merc(*b)
            dx, dy = x2 - x1, y2 - y1
            t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(px - x1 - t * dx, py - y1 - t * dy))
    return best


def frames(spark, kinds, points):
    table = [(i, "industrial", rings, kind) for i, (kind, rings) in enumerate(kinds)]
    rows = [(i, y, x) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(table, SHAPES), spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(11)
    kinds = []
    for i in range(40):
        cx, cy, r = rng.uniform(69.6, 70.4), rng.uniform(19.7, 20.3), rng.choice([0.002, 0.03, 0.2, 0.6])
        rings = [star(rng, cx, cy, r, rng.choice([3, 4, 9, 60]))]
        if i % 3 == 0:
            rings.append(star(rng, cx, cy, r / 4, 5))  # a hole, or an island that crosses the outline
        if i % 5 == 0:
            rings.append(star(rng, cx + 2 * r, cy, r / 2, 6))
        kinds.append((None if i % 2 else "polygon", rings))
    # vertices and edges on cell borders and corners
    kinds += [("polygon", [[(70.0, 20.0), (70.1, 20.0), (70.1, 20.1), (70.0, 20.1)]]), ("polygon", [[(69.95, 19.95), (70.2, 20.2), (69.95, 20.2)]]),
              ("polygon", [[(70.05, 20.0), (70.15, 20.05), (70.05, 20.1), (69.95, 20.05), (70.05, 20.0)]])]
    kinds += [("line", [star(rng, 70.3, 20.2, 0.3, 7)]), (None, [[(70.7, 20.1), (70.9, 20.4)]]), (None, [[(71.4, 20.0)]]), ("point", [[(69.0, 19.0)], [(69.2, 19.0)]])]
    points = [(rng.uniform(69.0, 71.5), rng.uniform(19.2, 20.8)) for _ in range(400)]
    points += [(69.9 + 0.05 * i, 19.9 + 0.05 * j) for i in range(8) for j in range(8)] + [(70.05, 20.03), (70.075, 20.0)]
    points += [p for _, rings in kinds[:5] for p in rings[0][:2]]
    return kinds, points


def test_containment_mixed(spark, mixed):
    kinds, points = mixed
    polygons, rows = frames(spark, kinds, points)
    expected = {(i, k) for i, (x, y) in enumerate(points) for k, (kind, rings) in enumerate(kinds) if kind != "line" and inside(x, y, rings)}
    assert len(expected) > 300
    assert {(r["detection_id"], r["poly_id"]) for r in landuse.polygon_hits(rows, polygons).collect()} == expected


def test_containment_refined(spark, mixed, monkeypatch):
    kinds, points = mixed
    polygons, rows = frames(spark, kinds, points)
    monkeypatch.setattr(shapes, "CROWDED_EDGES", 2)
    got = [(r["detection_id"], r["poly_id"]) for r in landuse.polygon_hits(rows, polygons).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, k) for i, (x, y) in enumerate(points) for k, (kind, rings) in enumerate(kinds) if kind != "line" and inside(x, y, rings)}


@pytest.mark.parametrize("max_m", [50_000.0, 3_000.0])
def test_nearest_mixed(spark, mixed, max_m):
    kinds, points = mixed
    polygons, rows = frames(spark, kinds, points)
    got = {r["detection_id"]: r["distance_to_industrial"] for r in landuse.with_industrial_distance(rows, polygons, max_m).collect()}
    for i, (x, y) in enumerate(points):
        assert got[i] == pytest.approx(min(max_m, *(away(x, y, s) for s in kinds)), abs=1e-6)


def test_nearest_points_and_lines_count(spark):
    """An industrial point 0.001 degrees of longitude away is 111 projected metres away, whatever its geometry."""
    for kind, rings in ((None, [[(75.001, 20.0)]]), ("line", [[(75.001, 19.9), (75.001, 20.1), (75.5, 20.1)]]), (None, [[(75.001, 20.1), (75.001, 19.9)]])):
        polygons, rows = frames(spark, [(kind, rings)], [(75.0, 20.0)])
        assert landuse.with_industrial_distance(rows, polygons).first()["distance_to_industrial"] == pytest.approx(111.3195, abs=1e-3)
        assert landuse.polygon_hits(rows, polygons).count() == 0


def test_awkward_shapes(spark):
    table = [(1, "industrial", None, None), (2, "industrial", [], None), (3, "industrial", [[]], None), (4, "quarry", [[(None, 1.0)], [(75.0, None), (75.2, 20.0)]], None),
             (5, None, [[(70.0, 20.0)]], None), (6, "industrial", [[(0.0, 90.0)]], None)]
    rows = spark.createDataFrame([(1, 20.0, 75.1), (2, None, 75.0), (3, 20.0, None), (4, -90.0, 3.0)], ROWS)
    polygons = spark.createDataFrame(table, SHAPES)
    got = {r["detection_id"]: r["distance_to_industrial"] for r in landuse.with_industrial_distance(rows, polygons).collect()}
    assert got[1] == pytest.approx(11131.949, abs=1e-2) and got[2] == got[3] == got[4] == 50_000.0
    nothing = polygons.where(F.lit(False))
    assert landuse.with_industrial_distance(rows, nothing).agg(F.min("distance_to_industrial")).first()[0] == 50_000.0
    assert landuse.polygon_hits(rows.where(F.lit(False)), polygons).count() == 0


def test_one_shape_of_many_vertices(spark):
    """10^5 vertices: no cell carries more than its own edges, and results equal the closed form of a wavy disc."""
    n, cx, cy = 100_000, 75.0, 20.0
    rim = lambda t: 0.6 + 0.05 * math.sin(40 * t)
    ring = [(cx + rim(t) * math.cos(t), cy + rim(t) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    rng = random.Random(2)
    points = [(cx + rng.uniform(-0.8, 0.8), cy + rng.uniform(-0.8, 0.8)) for _ in range(3000)]
    polygons, rows = frames(spark, [("polygon", [ring])], points)
    edges = shapes.edges_of(polygons)
    cells = rows.select(F.floor(F.col("latitude") / 0.05).alias("_ci"), F.floor(F.col("longitude") / 0.05).alias("_cj")).distinct()
    cover = shapes.cell_cover(edges, cells, 0.05)
    assert cover.agg(F.max(F.size("edges"))).first()[0] < n / 30
    got = {r["detection_id"] for r in landuse.polygon_hits(rows, polygons).collect()}
    for i, (x, y) in enumerate(points):
        gap = math.hypot(x - cx, y - cy) - rim(math.atan2(y - cy, x - cx))
        if abs(gap) > 1e-6:
            assert (i in got) == (gap < 0)


def test_many_shapes_in_one_block(spark):
    """10^5 small squares within half a degree."""
    side = 316
    squares = spark.range(side * side).select(
        F.col("id").alias("poly_id"), F.lit("industrial").alias("landuse"),
        (F.lit(75.0) + (F.col("id") % side) * 0.0015).alias("x"), (F.lit(20.0) + F.floor(F.col("id") / side) * 0.0015).alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    squares = squares.select("poly_id", "landuse", F.array(F.array(corner(0.0, 0.0), corner(0.001, 0.0), corner(0.001, 0.001), corner(0.0, 0.001))).alias("rings"))
    rng = random.Random(4)
    points = [(75.0 + rng.randrange(side) * 0.0015 + rng.choice([0.0005, 0.00125]), 20.0 + rng.randrange(side) * 0.0015 + 0.0004) for _ in range(2000)]
    rows = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], ROWS)
    got = {r["detection_id"]: r["distance_to_industrial"] for r in landuse.with_industrial_distance(rows, squares).collect()}
    for i, (x, y) in enumerate(points):
        column = (x - 75.0) / 0.0015
        in_square = column - math.floor(column + 1e-6) < 0.5
        assert got[i] == 0.0 if in_square else 0 < got[i] < 40


def test_areas_over_each_other_are_met_once(spark):
    """Many areas over the same cells: a row meets the least rank and the borders of lower ones, not every area."""
    square = lambda i: [[(70.0 - i / 1000, 20.0), (72.0, 20.0), (72.0, 22.0), (70.0 - i / 1000, 22.0)]]
    kinds = ["farmland", "forest", "residential"]
    areas = spark.createDataFrame([(i, kinds[i % 3], square(i)) for i in range(60)] + [(60, "industrial", [[(71.0, 21.0), (71.013, 21.0), (71.0, 21.013)]])],
                                  "poly_id long, landuse string, rings array<array<struct<x:double,y:double>>>")
    rows = spark.createDataFrame([(i, 20.003 + i % 40 * 0.05, 69.9 + i // 40 * 0.05) for i in range(1600)] + [(1600, 21.001, 71.001)],
                                 "detection_id long, latitude double, longitude double")
    rank = F.array_position(F.array(*[F.lit(c) for c in landuse.CLASS_PRIORITY]), landuse.land_class(F.col("landuse")))
    edges = shapes.edges_of(areas)
    all_hits = shapes.containment(rows, edges)
    want = {r[0]: r[1] for r in all_hits.groupBy("detection_id").agg(F.min(rank)).collect()}
    got = {r[0]: r[1] for r in shapes.least_containing(rows, edges, rank).collect()}
    assert got == want and got[1600] == 1 and set(want.values()) == {1, 2}
    hits, _ = shapes._contained(rows, edges, shapes.CONTAIN_DEG, shapes.DEPTH, rank)
    assert hits.count() < all_hits.count() / 10


def test_a_common_label_stays_with_its_rows(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") > 3, "industrial").otherwise("forest").alias("land_use_type"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = encoding.encode(rows, "land_use_type", encoding.label_dictionary(rows, "land_use_type"))
        assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wide_areas_settle_wide_cells(spark):
    """Areas over whole wide cells leave only rows near lower borders, and only the areas there, to the fine grid."""
    square = lambda i: [[(70.0 - i / 1000, 20.0), (72.0, 20.0), (72.0, 22.0), (70.0 - i / 1000, 22.0)]]
    areas = spark.createDataFrame([(i, "forest", square(i)) for i in range(40)] + [(60, "industrial", [[(71.0, 21.0), (71.013, 21.0), (71.0, 21.013)]])],
                                  "poly_id long, landuse string, rings array<array<struct<x:double,y:double>>>")
    rows = spark.createDataFrame([(i, 20.003 + i % 40 * 0.05, 69.9 + i // 40 * 0.05) for i in range(1600)] + [(1600, 21.001, 71.001)],
                                 "detection_id long, latitude double, longitude double")
    rank = F.array_position(F.array(*[F.lit(c) for c in landuse.CLASS_PRIORITY]), landuse.land_class(F.col("landuse")))
    edges = shapes.edges_of(areas)
    want = {r[0]: r[1] for r in shapes.containment(rows, edges).groupBy("detection_id").agg(F.min(rank)).collect()}
    assert {r[0]: r[1] for r in shapes.least_containing(rows, edges, rank).collect()} == want and want[1600] == 1
    sure, left, near = shapes._settled(rows, edges, rank, shapes.CONTAIN_DEG * shapes.COARSER)
    assert all(want[r[0]] <= r[1] for r in sure.collect())
    inner = rows.where("latitude between 20.45 and 20.75 and longitude between 70.45 and 71.55")
    assert inner.count() > 100 and inner.join(left, "detection_id", "left_semi").count() == 0
    assert near.where("poly_id = 60").count() == 3
