"""Pinned values of the row expressions, and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from emberfield.functions import clock, numbers, places, radiometry
from emberfield.mode import ARCHIVE, NRT
from emberfield.operators import alerts, combine, features, landuse, reports, whatif
from emberfield.sources import fetchplan, landing


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_time_of_day(spark):
    got = column(spark, [230, 815, 1420, 2045, None, 0, 2460], "int", clock.time_of_day)
    assert got == ["Night", "Morning", "Afternoon", "Evening", "Night", "Night", "Evening"]


def test_season(spark):
    got = column(spark, [1, 4, 7, 10, 11, 12], "int", clock.season)
    assert got == ["Winter", "Summer", "Monsoon", "Post-Monsoon", "Post-Monsoon", "Winter"]


def test_unreadable_date_is_june(spark):
    assert column(spark, ["x", None, "2024-11-05"], "string", clock.month_or_june) == [6, 6, 11]


def test_minutes(spark):
    assert column(spark, [None, 5, 130, 2359, 12345], "int", clock.minute_of_day) == [0, 5, 90, 1439, 1065]


def test_confidence(spark):
    values = [None, "bad", " High ", "80", "30", "29.9", "inf", "l", "Nominal", "NaN"]
    got = column(spark, values, "string", radiometry.confidence_code)
    assert got == [0, 1, 2, 2, 1, 0, 2, 0, 1, 0]


def test_confidence_column_absent(spark):
    df = spark.range(3)
    assert {r["confidence_enc"] for r in features.with_confidence_code(df).collect()} == {1}


def test_confirmation_flag(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "co_confirmed boolean")
    assert sorted(r[0] for r in features.with_confirmation_flag(df).collect()) == [0, 1, 1]
    absent = features.with_confirmation_flag(spark.range(2)).select("co_confirmed").collect()
    assert [r[0] for r in absent] == [0, 0]


def test_fixed_text_equals_c_formatting(spark):
    rng = random.Random(5)
    values = [12.25, 0.15, 0.25, 12.35, 2.675, 1e-9, 0.5, 99.95, 8.0, 33.333335]
    values += [round(rng.uniform(0, 500), rng.randint(0, 6)) for _ in range(2000)]
    for digits in (1, 2, 5):
        got = column(spark, values, "double", lambda v: numbers.fixed_text(v, digits))
        assert got == [f"{v:.{digits}f}" for v in values]


def test_cell_rounding_is_half_even(spark):
    assert column(spark, [0.5, 1.5, 2.5], "double", lambda v: places.round_cell(v, 1.0)) == [0, 2, 2]


def test_box(spark):
    df = spark.createDataFrame([(22.5, 82.0), (51.5, -0.12), (None, 80.0)], "a double, b double")
    got = [r[0] for r in df.select(places.in_box(F.col("a"), F.col("b"), places.PLAUSIBLE_BOX)).collect()]
    assert got == [True, False, False]


def test_map_link(spark):
    df = spark.createDataFrame([(28.6139, 77.2090)], "a double, b double")
    got = df.select(places.map_link(F.col("a"), F.col("b"))).first()[0]
    assert got == "https://www.google.com/maps?q=28.61390,77.20900"


def test_tags(spark):
    got = column(spark, ["forest", "Industrial", "wood", "unknown_tag", None], "string", landuse.land_class)
    assert got == ["forest", "industrial", "forest", "unknown", "unknown"]


LABELS = [
    ("industrial", 15.0, 0.0, 4, "Industrial (Normal)"),
    ("farmland", 12.0, 400.0, 2, "Industrial (Normal)"),
    ("forest", 25.0, 20000.0, 0, "Wildfire Risk"),
    ("farmland", 3.5, 15000.0, 1, "Agricultural Burning"),
    ("unknown", 3.5, 50000.0, 0, "Anomaly/Unclassified"),
]


def test_labels(spark):
    df = spark.createDataFrame(
        LABELS, "land_use_type string, frp double, distance_to_industrial double, "
        "historical_frequency bigint, want string")
    for row in features.with_category(df, NRT).collect():
        assert row["category"] == row["want"]
    assert features.with_category(df, ARCHIVE).where("category IS NULL").count() == 0


def test_frequency(spark):
    df = spark.createDataFrame(
        [(1, 28.6139, 77.2090), (2, 28.6140, 77.2091), (3, 28.6141, 77.2092), (4, 19.0760, 72.8777)],
        "detection_id bigint, latitude double, longitude double")
    got = {r["detection_id"]: r["historical_frequency"] for r in features.with_historical_frequency(df).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0}


def test_delta_zero_and_no_positive(spark):
    schema = "bright_ti4 double, bright_ti5 double"
    some = spark.createDataFrame([(300.0, 300.0), (310.0, 300.0), (320.0, 300.0)], schema)
    got = features.with_delta_brightness(features.with_brightness(some)).collect()
    assert sorted(r["delta_brightness"] for r in got) == [10.0, 15.0, 20.0]
    none = spark.createDataFrame([(300.0, 300.0), (290.0, 300.0)], schema)
    got = features.with_delta_brightness(features.with_brightness(none)).collect()
    assert sorted(r["delta_brightness"] for r in got) == [-10.0, 15.0]


def test_brightness_absent(spark):
    assert features.with_brightness(spark.range(1)).first()["brightness"] == 300.0


def test_share_brightness(spark):
    df = spark.createDataFrame([(1.0,)], "brightness double")
    assert combine.share_brightness(df).first()["bright_ti4"] == 1.0


def test_chunks(spark):
    df = spark.createDataFrame([("MODIS_NRT", "2024-01-01", "2024-01-13")], "feed string, start string, end string")
    df = df.select("feed", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    rows = fetchplan.fetch_plan(df, F.to_date(F.lit("2024-02-01"))).orderBy("chunk_start").collect()
    assert [(str(r["chunk_start"]), r["days"]) for r in rows] == [("2024-01-01", 5), ("2024-01-06", 5), ("2024-01-11", 2)]
    assert {r["request_feed"] for r in rows} == {"MODIS_NRT"}
    late = fetchplan.fetch_plan(df, F.to_date(F.lit("2025-02-01"))).first()
    assert late["request_feed"] == "MODIS_SP" and late["chunk_key"].startswith("MODIS_2024-01_")
    with pytest.raises(ValueError):
        fetchplan.recent_days(F.lit("MODIS_NRT"), 11)


def test_rejected_payloads(spark):
    bodies = ["", "  ", "Invalid key", "bad MAP_KEY here", "an Error", "lat,lon\n1,2", "x" * 200 + "error", None]
    assert column(spark, bodies, "string", landing.is_rejected) == [True, True, True, True, True, False, False, True]


def test_landed_files(spark, tmp_path):
    viirs, modis = tmp_path / "v", tmp_path / "m"
    for folder, text in ((viirs, "latitude,longitude,bright_ti4\n20.5,80.5,330\n"),
                         (modis, "latitude,longitude,brightness\n21.5,81.5,310\n")):
        folder.mkdir()
        (folder / "a.csv").write_text(text)
    schema = "latitude double, longitude double, {} double"
    out = landing.load_feeds(spark, {
        "VIIRS_SNPP_NRT": (str(viirs), schema.format("bright_ti4")),
        "MODIS_NRT": (str(modis), schema.format("brightness")),
    }).collect()
    assert {(r["satellite_source"], r["instrument"], r["bright_ti4"], r["brightness"]) for r in out} == {
        ("VIIRS_SNPP", "VIIRS", 330.0, 330.0), ("MODIS", "MODIS", 310.0, 310.0)}
    (viirs / "b.csv").write_text("Invalid MAP_KEY")
    good, bad = landing.screen(landing.read_payloads(spark, str(viirs)))
    assert (good.count(), bad.count()) == (1, 1)


def test_csv_bad_line_is_kept_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text("detection_id,latitude\n1,20.5\n2,oops\n")
    rows = landing.read_csv(spark, str(tmp_path), landing.DETECTION.__class__(landing.DETECTION.fields[:2]))
    got = {r["detection_id"]: (r["latitude"], r[landing.BAD_LINE]) for r in rows.collect()}
    assert got[1] == (20.5, None) and got[2][0] is None and got[2][1] == "2,oops"


def test_digest(spark):
    df = spark.createDataFrame(
        [(1, 21.5, 84.2, 75.5, "2026-04-15", "1330", "forest", 0, "Afternoon", "Summer", "Wildfire Risk"),
         (2, 20.5, 80.5, 65.0, "2026-03-01", "900", "forest", 1, "Morning", "Summer", "Wildfire Risk"),
         (3, None, 80.5, 90.0, "2026-03-01", "900", "forest", 1, "Morning", "Summer", "Wildfire Risk"),
         (4, 22.0, 82.0, 25.0, "2026-03-01", "900", "farm", 1, "Morning", "Summer", "Industrial (Normal)")],
        "detection_id bigint, latitude double, longitude double, frp double, acq_date string, acq_time string, "
        "land_use_type string, historical_frequency bigint, time_of_day string, season string, category string")
    rows = {r["detection_id"]: r for r in alerts.alert_digest(df, 50.0).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1]["frp_text"] == "75.5 MW" and rows[1]["position_text"] == "21.5000°N, 84.2000°E"
    assert "65.0 MW" in rows[2]["line"] and "20.5000N, 80.5000E" in rows[2]["line"]
    assert rows[3]["map_url"] == "N/A" and rows[3]["rank"] == 1


def test_trend_is_padded(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01",), ("2024-01-05",), ("2024-02-01",)], "d string")
    rows = reports.daily_trend(df.select(F.to_date("d").alias("acq_date"))).orderBy("slot").collect()
    assert [r["n"] for r in rows] == [0, 0, 0, 0, 2, 1, 1]
    assert [r["day_label"] for r in rows][:5] == ["Day 7", "Day 6", "Day 5", "Day 4", "Jan 01"]


def test_scenarios(spark):
    df = spark.createDataFrame(
        [(75.0, 368.0, 56.0, "forest", 0, "Summer", 42000.0, "Wildfire Risk"),
         (24.0, 332.0, 22.0, "industrial", 14, "Winter", 0.0, "Industrial (Normal)"),
         (15.0, 334.0, 26.0, "farmland", 2, "Post-Monsoon", 18000.0, "Anomaly/Unclassified"),
         (14.0, 334.0, 26.0, "farmland", 2, "Post-Monsoon", 18000.0, "Agricultural Burning"),
         (3.5, 308.0, 12.0, "unknown", 0, "Monsoon", 28000.0, "Anomaly/Unclassified")],
        "frp double, brightness double, delta_brightness double, land_use_type string, "
        "historical_frequency int, season string, distance_to_industrial double, want string")
    for r in whatif.rule_scores(whatif.scenario_features(df)).collect():
        assert r["verdict"] == r["want"]
        assert abs(r["p_wildfire"] + r["p_agricultural"] + r["p_industrial"] + r["p_anomaly"] - 100) < 1e-9


def test_ring_with_hole_and_boundary(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame(
        [(1, "forest", [square(0.0, 10.0), square(4.0, 6.0)])],
        "poly_id int, landuse string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame(
        [(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 11.0, 5.0), (5, 4.0, 5.0), (6, 9.99, 9.99)],
        "detection_id bigint, latitude double, longitude double")
    got = {r["detection_id"] for r in landuse.polygon_hits(points, df).collect()}
    assert got == {1, 6}
