"""Streaming forms of the detection operators.

Every job takes a streaming DataFrame, runs with ``availableNow`` unless told otherwise, and leaves its result as
Parquet. ``out`` is the folder of the result and ``<out>.state`` that of offsets and state: give a job the same ``out``
again and it goes on where it stopped, whether that was between two batches or in one. Without ``out`` both lie in
the session's shared folder. State is held by RocksDB on the executors' disks and written to the state folder, so it is
not bounded by memory; nothing a batch does depends on how many batches came before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import minute_of_day
from ..functions.places import round_cell, zone
from ..mode import Mode, NRT
from ..operators.alerts import alert_rows
from ..operators.coincidence import RADIUS_M, WINDOW_MIN, located
from ..operators.combine import SAME_DETECTION
from ..operators.features import FREQUENCY_CELL_DEG, with_category, with_frp
from ..operators.landuse import with_land_use_defaults
from ..schema import drop_without_coordinates
from ..session import work_path
from .cells import FRESH, TRANSITIONS, CellHistory, FreshDetections

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A detection with more repeats than this is no wildfire, whatever its power (see ``features.category``).
ALERT_REPEATS = 1
#: Cells along each side of a block whose histories are kept together.
BLOCK_CELLS = 32
#: Width of the blocks in which a confirmation looks for partners, in radii.
BLOCK_RADII = 4


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files as they land in ``folder``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def with_event_time(df: DataFrame, col: str = "seen_at") -> DataFrame:
    """Adds the UTC time of the overpass, whatever the session's time zone."""
    seconds = F.unix_date("acq_date").cast("bigint") * 86400
    return df.withColumn(
        col, F.timestamp_seconds(seconds + minute_of_day(F.col("acq_time")) * 60)
    )


def _run(stream: DataFrame, start: Callable, out: str) -> StreamingQuery:
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        query = start(stream.writeStream.option("checkpointLocation", f"{out}.state").trigger(availableNow=True))
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return query


def append_table(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Runs an append-mode stream into a Parquet table, each row exactly once, and returns the table."""
    out = out or work_path(stream.sparkSession, name)
    _run(stream, lambda w: w.outputMode("append").format("parquet").start(out), out)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def latest_table(aggregate: DataFrame, keys: Sequence[str], name: str, out: str | None = None) -> DataFrame:
    """Runs an update-mode aggregate and returns the newest state of every key.

    A batch overwrites its own sub-folder, so a batch that is replayed after a failure leaves the same result.
    """
    spark = aggregate.sparkSession
    out = out or work_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(aggregate, lambda w: w.outputMode("update").foreachBatch(keep).start(), out)
    values = [c for c in aggregate.columns if c not in keys]
    rows = spark.read.schema(
        T.StructType([*aggregate.schema.fields, T.StructField("batch", T.LongType())])
    ).parquet(out)
    newest = F.max(F.struct("batch", *values)).alias("_n")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_n.{v}") for v in values])


def deduplicated(
    stream: DataFrame, keys: Sequence[str] = SAME_DETECTION, delay: str = "2 days"
) -> DataFrame:
    """One row per key among rows that arrive within the delay; state older than it is dropped."""
    return (
        with_event_time(stream).withWatermark("seen_at", delay)
        .dropDuplicatesWithinWatermark(list(keys)).drop("seen_at")
    )


def stream_dedup(stream: DataFrame, keys: Sequence[str] = SAME_DETECTION, out: str | None = None) -> DataFrame:
    return append_table(deduplicated(stream, keys), "dedup", out)


def _group(by: dict[str, Column] | None) -> dict[str, Column]:
    return by or {"zone": zone(F.col("latitude"), F.col("longitude"))}


def stream_window_counts(
    stream: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "2 days",
    by: dict[str, Column] | None = None, out: str | None = None,
) -> DataFrame:
    """Detections per group (the zone, unless ``by`` names others) and time window (tumbling, or sliding when ``slide`` is given).

    Partial counts are combined before the shuffle; windows behind the watermark leave the state, and rows that come for
    them are dropped. :func:`late_counts` counts those.
    """
    groups = _group(by)
    timed = with_event_time(stream).withWatermark("seen_at", delay)
    window = F.window("seen_at", length, slide) if slide else F.window("seen_at", length)
    counts = (
        timed.groupBy(window.alias("w"), *[c.alias(n) for n, c in groups.items()])
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *groups, "n")
    )
    return latest_table(counts, ["window_start", *groups], "windows", out)


def late_counts(
    stream: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "2 days",
    by: dict[str, Column] | None = None, out: str | None = None,
) -> DataFrame:
    """(window_start, group, n): rows per window that came when the window was closed, which the counts leave out.

    A window is closed for a batch when it ends before the watermark that the batch before it ran with, or, in the first
    batch of a run, before the latest time of all earlier batches less the delay: so the engine decides in the counting stream.
    Each batch stores those times beside its late rows, and the next one reads one small file, whatever came before.
    """
    groups = _group(by)
    spark = stream.sparkSession
    out = out or work_path(spark, "late")
    timed = with_event_time(stream)
    window = F.window("seen_at", length, slide) if slide else F.window("seen_at", length)
    begun: list[int] = []

    def split(batch: DataFrame, batch_id: int) -> None:
        times = spark.read.parquet(f"{out}.times/batch={batch_id - 1}").first() if batch_id else {"latest": None, "before": None}
        closed_by = times["before"] if begun else times["latest"]
        begun.append(batch_id)
        late = F.lit(False) if closed_by is None else F.col("w.end") <= F.lit(closed_by) - F.expr(f"INTERVAL {delay}")
        counts = batch.where("seen_at is not null").select(window.alias("w"), *[c.alias(n) for n, c in groups.items()]).where(late)
        counts.groupBy(F.col("w.start").alias("window_start"), *groups).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        known = F.lit(times["latest"]).cast("timestamp")
        batch.agg(F.greatest(F.max("seen_at"), known).alias("latest"), F.first(known).alias("before")).write.mode("overwrite").parquet(f"{out}.times/batch={batch_id}")

    _run(timed, lambda w: w.foreachBatch(split).start(), out)
    return spark.read.parquet(out).groupBy("window_start", *groups).agg(F.sum("n").alias("n"))


def stream_frequency(stream: DataFrame, cell: float = FREQUENCY_CELL_DEG, mode: Mode = NRT, out: str | None = None) -> DataFrame:
    """Running number of detections per cell and whether it is new, repeated or persistent.

    The state is one counter per cell and never expires, as the batch feature counts over the whole data;
    :func:`stream_transitions` forgets quiet cells.
    """
    counts = (
        drop_without_coordinates(stream)
        .groupBy(*_cell_keys(cell))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kind = (
        F.when(F.col("n") == 1, "new").when(F.col("n") > mode.frequent, "persistent")
        .otherwise("repeated")
    )
    return latest_table(counts, ["cell_lat", "cell_lon"], "cells", out).withColumn("kind", kind)


def _cell_keys(cell: float) -> list[Column]:
    return [round_cell(F.col("latitude"), cell).alias("cell_lat"), round_cell(F.col("longitude"), cell).alias("cell_lon")]


def transitions(
    stream: DataFrame, quiet_days: int = 30, cell: float = FREQUENCY_CELL_DEG, mode: Mode = NRT, delay: str = "2 days",
) -> DataFrame:
    """The stream of :func:`stream_transitions`, times as ``at_ms``. Histories are kept by block of neighbouring cells."""
    timed = with_event_time(drop_without_coordinates(stream)).withWatermark("seen_at", delay)
    rows = timed.select(*_cell_keys(cell), "seen_at", F.unix_millis("seen_at").alias("at_ms"))
    block = [F.floor(F.col(c) / BLOCK_CELLS).alias(f"block_{c}") for c in ("cell_lat", "cell_lon")]
    return rows.select(*block, "*").groupBy("block_cell_lat", "block_cell_lon").transformWithStateInPandas(
        CellHistory(mode.frequent, quiet_days * 86_400_000), TRANSITIONS, "append", "EventTime")


def stream_transitions(
    stream: DataFrame, quiet_days: int = 30, cell: float = FREQUENCY_CELL_DEG, mode: Mode = NRT, delay: str = "2 days",
    out: str | None = None,
) -> DataFrame:
    """(cell_lat, cell_lon, kind, at, n): when a cell becomes new, repeated, persistent, and when it expires.

    A cell expires when ``quiet_days`` have passed without a detection; it then leaves the state, and a later detection is
    new again. Times count, not the order of arrival; a transition is told once the watermark has passed it.
    """
    moves = transitions(stream, quiet_days, cell, mode, delay)
    return append_table(moves, "transitions", out).withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")


def confirmations(stream: DataFrame, radius_m: float = RADIUS_M, window_min: int = WINDOW_MIN, delay: str = "2 days") -> DataFrame:
    """The detections of a stream that another sensor confirms, each once, as soon as the second of the two is there.

    Two reads of the stream meet in a left-semi join: every detection, in its block of a few radii, and the distinct
    places and minutes that a sensor saw, in each block that their reach touches, about 2.25. The time bound on both sides lets a row leave
    the state when the watermark has passed its last possible partner. A detection leaves a place to itself, so many
    detections of one place cost one partner row, and no pairs are listed.
    """
    def rows(source: DataFrame) -> DataFrame:
        placed = located(drop_without_coordinates(source), radius_m)
        return with_event_time(placed).select("detection_id", "acq_date", "_x", "_y", "_s", "seen_at")

    block = lambda c, by=0.0: F.floor((F.col(c) + by) / (BLOCK_RADII * radius_m))
    reach = radius_m + 0.01  # more than rounding
    touched = lambda c: F.explode(F.sequence(block(c, -reach), block(c, reach)))
    left = rows(stream).withColumn("_bx", block("_x")).withColumn("_by", block("_y")).withWatermark("seen_at", delay)
    names = {"acq_date": "p_date", "_x": "px", "_y": "py", "_s": "p_source", "seen_at": "p_seen"}
    sites = rows(stream).drop("detection_id").withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["acq_date", "_x", "_y", "_s", "seen_at"])
    right = sites.withColumnsRenamed(names).withColumn("p_bx", touched("px")).withColumn("p_by", touched("py"))
    apart = F.expr(f"INTERVAL {window_min} MINUTES")
    dx, dy = F.col("_x") - F.col("px"), F.col("_y") - F.col("py")
    return left.join(
        right,
        (F.col("acq_date") == F.col("p_date")) & (F.col("_bx") == F.col("p_bx")) & (F.col("_by") == F.col("p_by"))
        & (F.col("_s") != F.col("p_source")) & (F.sqrt(dx * dx + dy * dy) <= radius_m)
        & (F.col("p_seen") >= F.col("seen_at") - apart) & (F.col("p_seen") <= F.col("seen_at") + apart),
        "left_semi",
    ).select("detection_id")


def stream_co_confirmed(
    stream: DataFrame, radius_m: float = RADIUS_M, window_min: int = WINDOW_MIN, delay: str = "2 days", out: str | None = None
) -> DataFrame:
    """Ids of detections confirmed by another sensor, also when the partner lands later (within the delay)."""
    return append_table(confirmations(stream, radius_m, window_min, delay), "confirmed", out)


def stream_alerts(stream: DataFrame, frp_threshold: float = 0.0, mode: Mode = NRT, out: str | None = None) -> DataFrame:
    """Wildfire alerts, each detection at most once; returns the alert log, to which every run adds.

    A row is labelled with the repeats of its cell known when its batch arrives, kept as a few ids per cell in the state.
    A detection that is delivered again is neither counted nor alerted again.
    """
    rows = drop_without_coordinates(stream).select(*_cell_keys(FREQUENCY_CELL_DEG), "detection_id", "frp", "latitude", "longitude")
    fresh = rows.groupBy("cell_lat", "cell_lon").transformWithStateInPandas(
        FreshDetections(ALERT_REPEATS), FRESH, "append", "None")
    labelled = with_category(with_land_use_defaults(with_frp(fresh)), mode)
    return append_table(alert_rows(labelled, frp_threshold).select("detection_id", "frp", "latitude", "longitude"), "alert-log", out)
