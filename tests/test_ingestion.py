"""Feeds by column name, missing values, and the shared folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield import session
from emberfield.functions.radiometry import clipped_frp
from emberfield.operators.medians import exact_median
from emberfield.schema import drop_without_coordinates
from emberfield.sources import landing

COLUMNS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "frp")])


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("longitude,latitude,extra,frp\n80.5,20.25,x,NaN\n81,21,y,7\n")
    rows = landing.read_csv(spark, str(tmp_path / "a.csv"), COLUMNS).orderBy("latitude").collect()
    assert [(r.latitude, r.longitude, r.frp, r.extra) for r in rows] == [(20.25, 80.5, None, "x"), (21.0, 81.0, 7.0, "y")]
    (tmp_path / "b.csv").write_text("latitude\n1.5\n")
    row = landing.read_csv(spark, str(tmp_path / "b.csv"), COLUMNS).first()
    assert (row.latitude, row.longitude, row.frp) == (1.5, None, None)


def test_payload_columns_go_by_name(spark):
    bodies = [(1, "frp,latitude,longitude\n9.0,20.5,80.5\nnan,21.5,81.5"), (2, "latitude,longitude\n1,2"), (3, "latitude,frp\n")]
    got = landing.parse_payloads(spark.createDataFrame(bodies, "id int, body string"), COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 20.5, 80.5, 9.0), (1, 21.5, 81.5, None), (2, 1.0, 2.0, None)]


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0, nan), (2.0, nan, 1.0), (nan, 1.0, 2.0), (1.0, 1.0, nan)], "latitude double, longitude double, frp double")
    assert drop_without_coordinates(df).count() == 2
    assert exact_median(df, F.col("frp")) == 1.5
    assert sorted(r[0] for r in df.select(clipped_frp(F.col("frp"))).collect()) == [0.0, 0.0, 1.0, 2.0]


def test_only_one_process_needs_no_shared_folder():
    assert [session.needs_no_shared_folder(m) for m in ("local", "local[8]", "local-cluster[2,1,512]", "yarn", "spark://h:1")] == [
        True, True, False, False, False]


def test_chunks_of_different_layout_load_together(spark, tmp_path):
    texts = {
        "a.csv": "latitude,longitude,bright_ti4,extra\n1.5,2,300,q\n2.5,NaN,301,w\n",
        "b.csv": "﻿longitude,latitude,brightness\r\n3,4,310\r\n",
        "c.csv": "", "d.csv": "foo,bar\n1,2\n", "e.csv": "latitude,longitude\n1,2,3\n3,4\n",
        "f.csv": "latitude,longitude,latitude\n1,2,3\n", "g.csv": "latitude,longitude\n", "h.txt": "latitude,longitude\n7,7\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows, report = landing.load_chunks(spark, str(tmp_path))
    got = rows.select("latitude", "longitude", "bright_ti4", "brightness", "extra", "frp").collect()
    assert sorted(map(tuple, got)) == [(1.5, 2.0, 300.0, None, "q", None), (2.5, None, 301.0, None, "w", None), (4.0, 3.0, None, 310.0, None, None)]
    assert {r.path.rsplit("/", 1)[1]: (r.reason, r.n_rows, r.n_bad) for r in report.collect()} == {
        "a.csv": (None, 2, 0), "b.csv": (None, 1, 0), "c.csv": ("empty", 0, 0), "d.csv": ("no column latitude, longitude", 0, 0),
        "e.csv": ("damaged line", 2, 1), "f.csv": ("repeated column", 0, 0), "g.csv": (None, 0, 0),
    }
    nothing, report = landing.load_chunks(spark, str(tmp_path), glob="*.none")
    assert (nothing.count(), report.count()) == (0, 0)


def test_damaged_lines_are_seen_whatever_columns_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,frp\n1,2,3\n4,5,6,7\n")
    rows = landing.read_csv(spark, str(tmp_path / "a.csv"), COLUMNS)
    assert [r.latitude for r in rows.where(F.col(landing.BAD_LINE).isNull()).select("latitude").collect()] == [1.0]


def test_a_stopped_landing_leaves_every_chunk_once(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = spark.createDataFrame(
        [("A", "2024-01", "k1", 1), ("A", "2024-01", "k2", 2), ("A", "2024-01", "k2", 3), ("B", "2024-02", "k3", 4)],
        "source string, month string, chunk_key string, n int",
    )
    assert landing.landed_keys(spark, root).count() == 0
    landing.land_chunks(rows.where("chunk_key = 'k1'"), root)
    landing.write_table(rows.where("n = 2"), f"{root}/chunks")  # stopped before its manifest
    assert [r.n for r in landing.read_landed(spark, root).collect()] == [1]
    landing.land_chunks(rows, root)
    landing.land_chunks(rows.withColumn("n", F.col("n") + 100), root)  # all landed already
    assert sorted(r.n for r in landing.read_landed(spark, root).collect()) == [1, 2, 3, 4]
    assert sorted(map(tuple, landing.landed_keys(spark, root).collect())) == [("k1", 1), ("k2", 2), ("k3", 1)]


def test_payload_files_are_read_by_line_as_by_body(spark, tmp_path):
    texts = {
        "plain": "latitude,longitude,frp\n1,2,3\n4,5,nan\n", "crlf": "\r\n \tfrp,latitude\r\n7, 8 \r\n\r\n9,10\t\r\n\n  ", "empty": "", "blank": " \n\t\n",
        "invalid": "\n  Invalid API call.\n1,2,3\n", "key": "latitude\n1\nmy MAP_KEY\n", "early": "  \n latitude,note\n1,an Error here\n",
        "late": "latitude,note\n" + "1,x\n" * 25 + "2,error\n", "edge": "latitude\n" + "1" * 85 + "\nerror", "past": "latitude\n" + "1" * 86 + "\nerror",
        "edge2": "  latitude\n" + "1" * 85 + "\nerror", "head": "latitude,longitude\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    good, _ = landing.screen(landing.read_payloads(spark, str(tmp_path)))
    want = landing.parse_payloads(good, COLUMNS)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        got = sorted(map(tuple, landing.load_payloads(spark, str(tmp_path), COLUMNS).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(map(tuple, want.collect()), key=repr)
    assert {r[0].rsplit("/", 1)[1] for r in got} == {"plain", "crlf", "late", "past"}


def test_no_row_of_a_payload_carries_its_body(spark):
    many = "latitude,frp\n" + "1,2\n" * 30_000
    rows = spark.createDataFrame([(1, many)], "id int, body string")
    plan = landing.parse_payloads(rows, COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    generate = plan.index("Generate explode")
    assert "transform(split(" not in plan[:generate]
    assert landing.parse_payloads(rows, COLUMNS).count() == 30_000
