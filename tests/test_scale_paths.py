"""The code paths that only large or skewed inputs take, forced on small ones."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from emberfield.operators import coincidence, combine, features, landuse, medians, ranking, sampling, shapes, skew
from emberfield.plans import views

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def skewed(monkeypatch):
    """Every key above 1 % of the rows counts as heavy."""
    monkeypatch.setattr(skew, "MIN_ROWS", 3)
    monkeypatch.setattr(skew, "SLOTS", 100)


def crowd(spark, n=600):
    """A third of the rows in one cell, on one day; two sources, some exact copies."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        near = i % 3 == 0
        lat = 20.0 + rng.random() * (0.004 if near else 0.05)
        lon = 80.0 + rng.random() * (0.004 if near else 0.05)
        if i % 7 == 0:
            lat, lon = 20.02, 80.02
        source = rng.choice(["VIIRS_SNPP", "VIIRS_NOAA20", "MODIS"]) if i % 5 else "MODIS"
        rows.append((i, lat, lon, f"2024-01-0{1 + i % 2}", rng.choice([30, 500, 900, 1430, 2300, None]),
                     source, rng.choice([None, 1.0, 5.0, 9.5])))
    return spark.createDataFrame(
        rows, "detection_id bigint, latitude double, longitude double, acq_date string, acq_time int, "
        "satellite_source string, frp double")


def brute_pairs(df):
    rows = coincidence.located(df).select(
        "detection_id", "satellite_source", "_d", "_m", "_x", "_y", "_cx", "_cy").collect()
    pairs = []
    for a in rows:
        for b in rows:
            if (a["_d"] == b["_d"] and a["satellite_source"] != b["satellite_source"]
                    and abs(a["_m"] - b["_m"]) <= 360
                    and ((a["_x"] - b["_x"]) ** 2 + (a["_y"] - b["_y"]) ** 2) ** 0.5 <= 1000):
                pairs.append((a, b))
    return pairs


@pytest.mark.parametrize("crowded", [coincidence.CROWDED, 0])
def test_confirmation_equals_brute_force(spark, skewed, monkeypatch, crowded):
    monkeypatch.setattr(coincidence, "CROWDED", crowded)
    df = crowd(spark)
    want = {a["detection_id"] for a, _ in brute_pairs(df)}
    got = {r[0] for r in coincidence.with_co_confirmed(df).where("co_confirmed").select("detection_id").collect()}
    assert got == want and 0 < len(want) < df.count()


@pytest.mark.parametrize("crowded", [coincidence.CROWDED, 0])
def test_merge_equals_greedy(spark, skewed, monkeypatch, crowded):
    monkeypatch.setattr(coincidence, "CROWDED", crowded)
    df = crowd(spark, 300)
    pairs = brute_pairs(df)
    frp = {r["detection_id"]: r["frp"] for r in df.collect()}
    gone, order = {}, coincidence.KEEP_ORDER
    for source in order[1:]:
        found = {}
        for a, b in pairs:
            earlier = order.index(b["satellite_source"]) < order.index(source)
            if a["satellite_source"] == source and earlier and b["detection_id"] not in gone:
                mm = int(((a["_x"] - b["_x"]) ** 2 + (a["_y"] - b["_y"]) ** 2) ** 0.5 * 1000)
                found.setdefault(a["detection_id"], []).append((mm, b["detection_id"]))
        gone.update({k: min(v)[1] for k, v in found.items()})
    got = {r["detection_id"]: r for r in coincidence.merge_coincident(df).collect()}
    assert set(got) == set(frp) - set(gone)
    for keeper in set(gone.values()):
        took = [frp[d] for d, k in gone.items() if k == keeper and frp[d] is not None]
        want = None if frp[keeper] is None else max([frp[keeper], *took])
        assert got[keeper]["frp"] == want and got[keeper]["satellite_source"].endswith("+MODIS")


def test_partners_do_not_depend_on_the_grid(spark):
    """Moved along the meridian, three detections and their distances stay as they are."""
    degree = 1 / 111_194.93
    rows = [(1, "VIIRS_SNPP", -600.0), (2, "VIIRS_SNPP", 20.0), (3, "MODIS", 30.0), (4, "LANDSAT", 45.0)]
    for shift in (0.0, 100.0, 333.0, 650.0):
        df = spark.createDataFrame(
            [(i, s, 20 + (m + shift) * degree, 80.0, 600, float(i)) for i, s, m in rows],
            "detection_id long, satellite_source string, latitude double, longitude double, acq_time int, frp double",
        ).withColumn("acq_date", F.to_date(F.lit("2024-01-01")))
        got = {tuple(r) for r in coincidence.first_partners(df).collect()}
        assert got == {(1, 3), (2, 3), (3, 2), (4, 3)}
        merged = {r["detection_id"]: (r["frp"], r["satellite_source"]) for r in coincidence.merge_coincident(df).collect()}
        assert merged == {1: (1.0, "VIIRS_SNPP"), 2: (4.0, "VIIRS_SNPP+MODIS")}


def test_frequency_with_hot_cell(spark, skewed):
    df = crowd(spark)
    cell = [F.rint(F.col(c) / 0.01).cast("bigint") for c in ("latitude", "longitude")]
    counts = {tuple(r)[:2]: r["count"] for r in df.groupBy(*cell).count().collect()}
    rows = features.with_historical_frequency(df).select(*cell, "historical_frequency").collect()
    assert len(rows) == df.count()
    assert all(r[2] == counts[(r[0], r[1])] - 1 for r in rows)


def test_salted_join_keeps_all_rows(spark):
    left = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        for heavy_work in (False, True):
            got = skew.salted_join(left, right, ["k"], ["id"], how=how, min_rows=5, slots=50, heavy_work=heavy_work)
            want = left.join(right, "k", how)
            assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == sorted(
                map(tuple, want.select("id", "k", "v").collect()), key=str)
    heavy = skew.heavy_keys(left.groupBy("k").agg(F.count("*").alias("_rows")), ["k"], min_rows=5, slots=50)
    assert [tuple(r) for r in heavy.collect()] == [(0, 20)]


def test_land_use_with_hot_cell(spark, skewed):
    df = views.hotspots(spark, SF_DIR).dropna(subset=["latitude", "longitude"])
    polygons = views.landuse(spark, SF_DIR)
    want = df.join(polygons, F.abs(F.col("longitude") - F.col("lon0")) + F.abs(F.col("latitude") - F.col("lat0")) < F.col("r"))
    got = landuse.polygon_hits(df, polygons)
    key = lambda rows: {(r["detection_id"], r["poly_id"]) for r in rows.collect()}
    assert key(got) == key(want)


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "even", "one"])
def test_exact_median(spark, kind):
    rng = random.Random(11)
    values = {
        "spread": [rng.gauss(300, 20) for _ in range(5001)],
        "ties": [7.0] * 3000 + [rng.uniform(0, 100) for _ in range(2000)],
        "two": [1.0] * 2500 + [9.0] * 2500 + [5.0],
        "even": [rng.expovariate(1) for _ in range(4000)],
        "one": [4.0] * 10,
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for direct in (10, 10**6):
        assert medians.exact_median(df, F.col("v"), direct_rows=direct) == statistics.median(values)


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert medians.exact_median(df, F.col("v")) is None


def test_rank_in_parts_equals_one_window(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 7.0, 7.0, 8.5, rng.uniform(4, 60)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "detection_id bigint, frp double")
    whole = ranking.with_rank_desc(df, "frp", "detection_id")
    parts = ranking.with_rank_desc(df, "frp", "detection_id", one_window_rows=100)
    read = lambda d: {r["detection_id"]: r["rank"] for r in d.collect()}
    assert read(whole) == read(parts) and sorted(read(parts).values()) == list(range(1, 3001))


def test_hash_cuts_refine(spark):
    df = spark.range(5000).select(F.col("id").alias("detection_id"), (F.col("id") % 3).cast("string").alias("category"))
    plan = lambda n: {s: [c // 2] for s, c in n.items()}
    near = sampling.hash_cuts(df, "detection_id", 1, plan, by="category")
    deep = sampling.hash_cuts(df, "detection_id", 1, plan, by="category", window_rows=1)
    assert near.keys == deep.keys


def test_sample_split_folds_noise(spark):
    df = spark.range(1000).select(
        F.col("id").alias("detection_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("category"))
    assert sampling.sample_exactly(df, 123).count() == 123
    assert sampling.sample_exactly(df, 5000).count() == 1000
    split = sampling.stratified_split(df).groupBy("category", "is_test").count().collect()
    assert {(r[0], r[1]): r[2] for r in split} == {("a", True): 180, ("a", False): 720, ("b", True): 20, ("b", False): 80}
    folds = sampling.stratified_folds(df).groupBy("category", "fold").count().collect()
    assert {(r[0], r[1]): r[2] for r in folds} == {("a", f): 300 for f in range(3)} | {
        ("b", 0): 33, ("b", 1): 33, ("b", 2): 34}
    noisy = sampling.with_label_noise(df).withColumnRenamed("category", "new").join(df, "detection_id")
    changed = noisy.where("new <> category").count()
    assert 0 < changed <= 50
    lone = df.where("category = 'a'").unionByName(df.where("detection_id = 0"))
    assert sampling.stratified_split(lone).where("is_test").count() == 180


def test_dedup_keeps_lowest_id_and_equal_nulls(spark):
    rows = [(3, 1.0, None, "d", 1, "s", 5.0), (1, 1.0, None, "d", 1, "s", None), (2, 1.0, 2.0, "d", 1, "s", 7.0)]
    df = spark.createDataFrame(
        rows, "detection_id bigint, latitude double, longitude double, acq_date string, acq_time int, "
        "satellite_source string, frp double")
    got = {r["detection_id"]: r["frp"] for r in combine.drop_exact_duplicates(df).collect()}
    assert got == {1: None, 2: 7.0}


def test_nearest_is_free_of_the_grid(spark):
    rows = shapes.placed_rows(views.hotspots(spark, SF_DIR))
    edges = shapes.edges_of(views.landuse(spark, SF_DIR).where("landuse = 'industrial'"))
    coarse, fine = (shapes.nearest_distance(rows, edges, 50_000.0, size) for size in (7000, 450))
    both = coarse.join(fine.withColumnRenamed("distance", "d"), "detection_id", "full")
    assert both.where("not (abs(distance - d) <= 1e-6) or distance is null or d is null").count() == 0


def test_discard_removes_only_stored_tables(spark, tmp_path):
    from emberfield.session import discard, written

    outside = str(tmp_path / "table")
    spark.range(3).write.parquet(outside)
    kept, gone = spark.read.parquet(outside), written(spark.range(5), "short-lived")
    folder = gone.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    discard(kept)
    discard(gone)
    assert kept.count() == 3 and not os.path.exists(folder)


def test_trailing_frequency_awkward(spark):
    """The window's edges, days without a date, several rows of one day, a hot cell."""
    rows = [(1, 20.0, 75.0, "2024-01-01"), (2, 20.0, 75.0, "2024-01-03"), (3, 20.0, 75.0, "2024-01-03"), (4, 20.0, 75.0, "2024-01-04"),
            (5, 20.0, 75.0, None), (6, 20.0, 75.0, None), (7, 21.0, 75.0, "2024-01-03")]
    df = spark.createDataFrame(rows, "detection_id long, latitude double, longitude double, acq_date string")
    df = df.withColumn("acq_date", F.to_date("acq_date"))
    got = {r["detection_id"]: r["historical_frequency"] for r in features.with_historical_frequency(df, window_days=3).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 2, 5: 0, 6: 0, 7: 0}
