"""Streams over several batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from emberfield.operators import coincidence
from emberfield.plans import views
from emberfield.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The detections as three files, and a stream that takes one file per batch."""
    folder = str(tmp_path_factory.mktemp("landed"))
    rows = views.hotspots(spark, SF_DIR)
    for part in range(3):
        rows.where(F.col("detection_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows, stream


def test_confirmation_over_batches(landed):
    rows, stream = landed
    got = {r[0] for r in jobs.stream_co_confirmed(stream(), delay="60 days").collect()}
    want = {r["detection_id"] for r in coincidence.with_co_confirmed(rows).where("co_confirmed").collect()}
    assert got == want


def test_frequency_over_batches(landed):
    rows, stream = landed
    got = jobs.stream_frequency(stream())
    assert got.agg(F.sum("n")).first()[0] == rows.dropna(subset=["latitude", "longitude"]).count()
    assert got.count() == got.select("cell_lat", "cell_lon").distinct().count()


def test_window_counts_over_batches(landed):
    rows, stream = landed
    assert jobs.stream_window_counts(stream(), delay="60 days").agg(F.sum("n")).first()[0] == rows.count()


def test_counted_and_late_rows_are_all_rows(landed):
    rows, stream = landed
    counted = jobs.stream_window_counts(stream()).agg(F.sum("n")).first()[0]
    late = jobs.late_counts(stream()).agg(F.sum("n")).first()[0]
    assert late > 0 and counted + late == rows.count()


@pytest.fixture(scope="module")
def shuffled_days(spark, tmp_path_factory):
    """Files of five days each, with every other file late by one: out of order within seven days."""
    folder = str(tmp_path_factory.mktemp("days"))
    rows = views.hotspots(spark, SF_DIR)
    day = F.floor((F.dayofmonth("acq_date") - 1) / 5)
    for part in (1, 0, 3, 2, 5, 4):
        rows.where(day == part).coalesce(1).write.mode("append").parquet(folder)
    return rows, folder


def stream_of(spark, rows, folder):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_out_of_order_batches_confirm_the_same(spark, shuffled_days):
    rows, folder = shuffled_days
    want = {r["detection_id"] for r in coincidence.with_co_confirmed(rows).where("co_confirmed").collect()}
    got = [r[0] for r in jobs.stream_co_confirmed(stream_of(spark, rows, folder), delay="11 days").collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_confirmation_state_expires(spark, shuffled_days):
    rows, folder = shuffled_days
    held = {}
    for delay in ("1 hour", "60 days"):
        moves = jobs.confirmations(stream_of(spark, rows, folder), delay=delay)
        query = jobs._run(moves, lambda w: w.outputMode("append").format("noop").start(), jobs.work_path(spark, "expiry"))
        held[delay] = max(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    assert held["1 hour"] < held["60 days"] / 5


def transitions_of(rows, quiet, frequent, until):
    """New, repeated, persistent and expired by a plain walk over each cell's times."""
    cells = {}
    timed = jobs.with_event_time(rows.dropna(subset=["latitude", "longitude"]))
    for r in timed.select(*jobs._cell_keys(0.01), F.unix_millis("seen_at").alias("t")).collect():
        cells.setdefault((r[0], r[1]), []).append(r["t"])
    out = []
    for key, times in cells.items():
        n = 0
        for t in sorted(t for t in times if t <= until):
            if n and t - last > quiet:
                out.append((*key, "expired", last + quiet, n))
                n = 0
            n, last = n + 1, t
            if n in (1, 2, frequent + 1):
                out.append((*key, {1: "new", 2: "repeated"}.get(n, "persistent"), t, n))
        if n and last + quiet <= until:
            out.append((*key, "expired", last + quiet, n))
    return sorted(out)


def test_transitions_whatever_the_order(spark, shuffled_days):
    rows, folder = shuffled_days
    moves = jobs.stream_transitions(stream_of(spark, rows, folder), quiet_days=4, delay="11 days")
    got = sorted(tuple(r) for r in moves.select("cell_lat", "cell_lon", "kind", F.unix_millis("at"), "n").collect())
    latest = jobs.with_event_time(rows.dropna(subset=["latitude", "longitude"])).agg(F.unix_millis(F.max("seen_at"))).first()[0]
    want = transitions_of(rows, 4 * 86_400_000, 3, latest - 11 * 86_400_000)
    assert got == want and {k for _, _, k, _, _ in got} == {"new", "repeated", "persistent", "expired"}


def test_histories_are_kept_by_block(spark, shuffled_days):
    """A block of cells has a few rows of state and one timer, however many cells and times wait in it."""
    rows, folder = shuffled_days
    moves = jobs.transitions(stream_of(spark, rows, folder), delay="60 days")
    query = jobs._run(moves, lambda w: w.outputMode("append").format("noop").start(), jobs.work_path(spark, "blocks"))
    held = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    blocks = rows.dropna(subset=["latitude", "longitude"]).select(
        *[F.floor(c / jobs.BLOCK_CELLS) for c in jobs._cell_keys(0.01)]).distinct().count()
    assert 0 < held <= 4 * blocks


def test_a_place_waits_in_few_blocks(spark, shuffled_days):
    rows, folder = shuffled_days
    moves = jobs.confirmations(stream_of(spark, rows, folder), delay="60 days")
    query = jobs._run(moves, lambda w: w.outputMode("append").format("noop").start(), jobs.work_path(spark, "few-blocks"))
    joined = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"] if "Join" in s["operatorName"])
    assert 0 < joined < 5 * rows.dropna(subset=["latitude", "longitude"]).count()


def test_alerts_go_on_where_they_stopped(spark, shuffled_days, tmp_path):
    """Two batches, a stop, the rest: the same log as without a stop, and nothing twice when files come again."""
    rows, folder = shuffled_days
    whole = sorted(tuple(r) for r in jobs.stream_alerts(stream_of(spark, rows, folder), 7.0).collect())
    part, out = str(tmp_path / "landing"), str(tmp_path / "log")
    day = F.floor((F.dayofmonth("acq_date") - 1) / 5)
    sizes = []
    for group in ((1, 0), (3, 2, 5, 4), (1, 4)):  # the last two are delivered again
        for p in group:
            rows.where(day == p).coalesce(1).write.mode("append").parquet(part)
        log = jobs.stream_alerts(stream_of(spark, rows, part), 7.0, out=out)
        sizes.append(log.count())
    assert sorted(tuple(r) for r in log.collect()) == whole
    assert 0 < sizes[0] < sizes[1] == sizes[2] == log.select("detection_id").distinct().count()


def test_hot_cell_keeps_a_few_ids(spark, tmp_path):
    """A cell seen very often costs neither alerts nor state."""
    folder = str(tmp_path / "hot")
    schema = "detection_id long, latitude double, longitude double, frp double"
    for turn in range(3):
        n = [1, 1, 5000][turn]
        spark.createDataFrame([(turn * 10_000 + i, 20.0, 75.0, 50.0) for i in range(n)] + [(900 + turn, 21.0 + turn, 75.0, 50.0)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert {r["detection_id"] for r in jobs.stream_alerts(stream, 7.0).collect()} == {0, 10_000, 900, 901, 902}
