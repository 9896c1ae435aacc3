"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "emberfield", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and the local bench. On a cluster, use the one the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EMBERFIELD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def needs_no_shared_folder(master: str) -> bool:
    """Whether driver and executors are one process, so that they see the same files."""
    return master == "local" or master.startswith("local[")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder every executor can reach.

    The session's setting comes first, then the context's checkpoint folder. Only a local session without
    either gets a temporary folder, recorded in the session; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = root or spark.conf.get("emberfield.work.dir", None)
    if not root:
        if not needs_no_shared_folder(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="emberfield-")
        spark.conf.set("emberfield.work.dir", root)
    return f"{root.rstrip('/')}/emberfield/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once as a Parquet table in the shared folder and read back.

    Cuts the lineage of frames that several jobs read, and survives the loss
    of executors.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING = {"lock": threading.Lock(), "inside": 0, "before": None}


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that end in here drop their shuffle files at once, and not when the driver next collects its garbage.

    For steps that store their result, as nothing reads their shuffles again. The session's own setting comes back after the
    last of several threads.
    """
    with _FREEING["lock"]:
        if not _FREEING["inside"]:
            _FREEING["before"] = spark.conf.get(_FREES, None)
            spark.conf.set(_FREES, "true")
        _FREEING["inside"] += 1
    try:
        yield
    finally:
        with _FREEING["lock"]:
            _FREEING["inside"] -= 1
            if not _FREEING["inside"]:
                spark.conf.set(_FREES, _FREEING["before"] or "false")


_CHECKPOINTS = {"lock": threading.Lock(), "inside": 0, "own": False}


@contextmanager
def checkpointed(spark: SparkSession) -> Iterator[None]:
    """The context has a checkpoint folder in here, so that the library's long loops cut their lineage.

    A folder that is set already is used; else one under :func:`work_path` is set until the last of several threads is done.
    """
    with _CHECKPOINTS["lock"]:
        if not _CHECKPOINTS["inside"] and not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(work_path(spark, "checkpoints"))
            _CHECKPOINTS["own"] = True
        _CHECKPOINTS["inside"] += 1
    try:
        yield
    finally:
        with _CHECKPOINTS["lock"]:
            _CHECKPOINTS["inside"] -= 1
            if not _CHECKPOINTS["inside"] and _CHECKPOINTS["own"]:
                spark.sparkContext._jsc.sc().setCheckpointDir(None)
                _CHECKPOINTS["own"] = False


def discard(df: DataFrame) -> None:
    """Deletes the stored tables that ``df`` reads, if they lie in the shared working folder.

    For a table from ``written`` once nothing reads it any more; inputs are never touched.
    """
    spark = df.sparkSession
    root = work_path(spark, "").rsplit("/emberfield/", 1)[0] + "/emberfield/"
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    base = path_of(root).toUri().getPath()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = path_of(folder)
        if path.toUri().getPath().startswith(base):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
