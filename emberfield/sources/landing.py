"""Landed sensor files: payload screening, parsing, CSV and Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.combine import share_brightness, tag_source, union_feeds
from ..operators.skew import salted_join
from ..schema import DETECTION, align
from ..session import discard, written

BAD_LINE = "_bad_line"
MAX_LAYOUTS = 200


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str = DETECTION) -> DataFrame:
    """Header CSV by column name: no inference, damaged lines kept aside.

    The header of the first file gives the order; columns of ``schema`` that it lacks come as null, others as
    text after them. A further file whose header differs is an error, never read by position; ``load_chunks`` reads
    such folders. Lines that do not parse have ``_bad_line`` set. ``NaN`` in number columns is null.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.csv(path, header=True).columns
    rows = _parsed(spark, path, header, schema, enforceSchema=False, columnPruning=False)
    return _without_nan(align(rows, schema), schema)


def _parsed(spark: SparkSession, path: str | list[str], header: Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """The lines of files that all have ``header``, columns of ``schema`` in their types and others as text.

    Without ``columnPruning=False``, ``_bad_line`` judges the columns that a query uses only.
    """
    known = {f.name: f for f in schema}
    fields = [known.get(c, T.StructField(c, T.StringType())) for c in header]
    return spark.read.options(**options).csv(
        path, schema=T.StructType([*fields, T.StructField(BAD_LINE, T.StringType())]), header=True, mode="PERMISSIVE",
        columnNameOfCorruptRecord=BAD_LINE, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def _without_nan(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.withColumns({
        f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV for interchange, one file per partition."""
    df.write.mode(mode).csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("source", "month", "chunk_key")) -> None:
    """Parquet partitioned by source, month and chunk, the layout later reads prune on.

    Only the partitions that ``df`` has rows for are replaced. Rows are gathered per partition before they are written;
    adaptive execution splits a partition that holds much of the data over several files.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def landed_keys(spark: SparkSession, root: str) -> DataFrame:
    """(chunk_key, n_rows) of every chunk that landed completely under ``root``; empty before the first."""
    try:
        return spark.read.parquet(f"{root}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "chunk_key string, n_rows long")


def land_chunks(rows: DataFrame, root: str) -> None:
    """Adds the chunks of ``rows`` (source, month, chunk_key and any others) that have not landed under ``root`` yet.

    Data first, then the manifest, whose counts are read from the stored files. A run that was stopped in between, or
    while files were moved, leaves partitions that the manifest does not name: nothing reads them, and the next run
    replaces them. Chunks without rows stay out of the manifest. One run at a time may land under a root.
    """
    spark = rows.sparkSession
    fresh = written(rows.join(landed_keys(spark, root).select("chunk_key"), "chunk_key", "left_anti"), "fresh-chunks")
    keys = fresh.select("chunk_key").distinct()
    write_table(fresh, f"{root}/chunks")
    stored = spark.read.parquet(f"{root}/chunks").join(keys, "chunk_key", "left_semi")
    stored.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n_rows")).write.mode("append").parquet(f"{root}/manifest")
    discard(fresh)


def read_landed(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all chunks that the manifest names."""
    return spark.read.parquet(f"{root}/chunks").join(landed_keys(spark, root).select("chunk_key"), "chunk_key", "left_semi")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed response file: (path, body). A response covers a few days of one feed."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def write_bodies(lines: DataFrame, path: str) -> None:
    """One text file per ``grp`` of (grp, at, line), its lines in the order of ``at``, as responses land."""
    parts = lines.repartition("grp").sortWithinPartitions("grp", "at")
    parts.select("grp", "line").write.partitionBy("grp").text(path)


def is_rejected(body: Column) -> Column:
    """Empty bodies and error messages of the feed service."""
    text = F.lower(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", ""))
    return (
        (text == "")
        | text.startswith("invalid")
        | text.contains("map_key")
        | F.substring(text, 1, 100).contains("error")
    )


def screen(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) payloads."""
    bad = is_rejected(F.col(body))
    return payloads.where(~bad), payloads.where(bad)


def parse_payloads(payloads: DataFrame, columns: T.StructType | str, body: str = "body") -> DataFrame:
    """The data lines of usable payloads as rows of ``columns``, matched by the names in each body's own header.

    A column that a header lacks is null; columns beyond ``columns`` are left out; NaN is null.
    """
    columns = T.StructType.fromDDL(columns) if isinstance(columns, str) else columns
    rest = [c for c in payloads.columns if c != body]
    split = payloads.select(*rest, F.split(F.regexp_replace(F.col(body), r"^\s+|\s+$", ""), r"\r?\n").alias("_lines"))
    # the header is taken before the lines are unfolded, so that no row carries its whole body along
    headed = split.select(*rest, _header(F.col("_lines")[0]), F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))).alias("_data"))
    return _cells(headed.select(*rest, "_header", F.explode("_data").alias("_line")), columns, rest)


def _header(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.trim(c)).alias("_header")


def _cells(lines: DataFrame, columns: T.StructType, rest: Sequence[str]) -> DataFrame:
    """``rest`` and ``columns`` of (_header, _line)."""
    lines = lines.withColumn("_cells", F.split("_line", ","))

    def cell(f: T.StructField) -> Column:
        at = F.array_position("_header", f.name)
        value = F.when(at > 0, F.trim(F.get("_cells", (at - 1).cast("int"))))
        value = F.when(~F.lower(value).isin("", "nan"), value)
        return value.try_cast(f.dataType).alias(f.name)

    return lines.select(*rest, *[cell(f) for f in columns])


def load_payloads(spark: SparkSession, path: str, columns: T.StructType | str) -> DataFrame:
    """(path, columns) of the usable response files: what :func:`read_payloads`, :func:`screen` and :func:`parse_payloads` give.

    The files are read line by line, so a file may be larger than a task's memory. The lines are stored once with their
    places, since a second scan could split the files elsewhere. What decides about a file (its first and last line
    with content, the first ``error``, any ``map_key``) comes from one aggregate over its lines.
    """
    columns = T.StructType.fromDDL(columns) if isinstance(columns, str) else columns
    lines = written(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value",
    ), "payload-lines")
    text = F.lower("value")
    content, error = F.col("value").rlike(r"\S"), F.instr(text, "error")
    files = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(F.when(content, F.col("at"))).alias("first"), F.max(F.when(content, F.col("at"))).alias("last"),
        F.min_by("value", F.when(content, F.col("at"))).alias("head"),
        F.min(F.when(error > 0, F.col("at"))).alias("error_at"), F.min_by(error, F.when(error > 0, F.col("at"))).alias("error_in"),
        F.bool_or(text.contains("map_key")).alias("key_message"),
    ).where("first is not null")
    files = written(files.withColumn("head", F.regexp_replace("head", r"^\s+|\s+$", "")), "payload-files")
    # characters before the first error, counted as in the body without the white space around it
    told = F.broadcast(files.where("error_at is not null").select("path", "first", "error_at"))
    before = lines.join(told, "path").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("error_at"))).groupBy("path").agg(
        F.sum(F.length(F.lower("value")) + 1).alias("before"))
    indent = lines.join(told, "path").where(F.col("at") == F.col("first")).select(
        "path", F.length(F.regexp_extract(F.lower("value"), r"^\s*", 0)).alias("indent"))
    place = F.coalesce("before", F.lit(0)) - F.coalesce("indent", F.lit(0)) + F.col("error_in")
    usable = files.join(before, "path", "left").join(indent, "path", "left").where(
        ~F.lower("head").startswith("invalid") & ~F.col("key_message") & (F.col("error_at").isNull() | (place + len("error") - 1 > 100))
    ).select("path", "_rows", "first", "last", _header(F.col("head")))
    usable = written(usable, "payload-headers")
    data = salted_join(lines, usable.drop("_rows"), ["path"], ["at"], how="inner", counts=usable.select("path", "_rows"))
    data = data.where((F.col("at") > F.col("first")) & (F.col("at") <= F.col("last")))
    end = F.when(F.col("at") == F.col("last"), r"\s+$").otherwise("\r$")
    return _cells(data.select("path", "_header", F.regexp_replace("value", end, "").alias("_line")), columns, ["path"])


def load_feeds(spark: SparkSession, paths: dict[str, tuple[str, T.StructType | str]]) -> DataFrame:
    """Union of landed CSV folders, one per feed: {feed: (path, schema of that feed)}.

    Columns are matched by name. Each feed gets its source tag and brightness layout before the union, since both
    depend on which columns it has.
    """
    frames = []
    for feed, (path, schema) in paths.items():
        header = set(spark.read.csv(path, header=True).columns)
        rows = read_csv(spark, path, schema).where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
        rows = rows.select(*[c for c in rows.columns if c in header])
        tagged = tag_source(rows.withColumn("feed", F.lit(feed)))
        frames.append(share_brightness(tagged).drop("feed"))
    return union_feeds(frames)


def chunk_headers(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, header) of every file: its first line, null if the file is empty.

    One scan of the lines; a file's first block goes to one task, in order, so its first line has the lowest row
    number. Only one line per file is shuffled.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(folder)
    first = (
        lines.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), "value")
        .withColumn("at", F.monotonically_increasing_id()).groupBy(_one_slash("path").alias("key"))
        .agg(F.regexp_replace(F.min_by("value", "at"), "^\\uFEFF", "").alias("header"))
    )
    # a scan leaves empty files out, the listing that it is planned from does not
    listed = spark.createDataFrame([(f,) for f in lines.inputFiles()], "path string").withColumn("key", _one_slash("path"))
    return listed.join(first, "key", "left").select("path", "header")


def _one_slash(path: str) -> Column:
    """A file's name in one spelling: listings and scans write ``file:/a`` or ``file:///a``."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def _names(header: Column) -> Column:
    """Column names of a header line."""
    return F.transform(F.split(header, ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


def load_chunks(
    spark: SparkSession, folder: str, schema: T.StructType | str = DETECTION,
    required: Sequence[str] = ("latitude", "longitude"), glob: str = "*.csv",
) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a folder of CSV chunks whose headers may differ.

    Files of one header are read together, by one typed scan; the scans are united by name. Columns of ``schema`` that
    a file lacks are null, others follow as text. The report has one row per file: path, reason (null if it was
    read), n_rows, n_placed (rows with the first of ``required``) and n_bad. Files without content, without a required
    column, with a repeated column name or with a line that does not parse are left out as a whole. An empty
    folder gives no rows. File names and up to ``MAX_LAYOUTS`` different headers are known to the driver.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = _names(F.col("header"))
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]), names)
    reason = (
        F.when(F.coalesce(F.trim("header"), F.lit("")) == "", "empty")
        .when(F.size(lacking) > 0, F.concat(F.lit("no column "), F.array_join(lacking, ", ")))
        .when(F.size(F.array_distinct(names)) < F.size(names), "repeated column")
    )
    files = written(chunk_headers(spark, folder, glob).select("path", names.alias("names"), reason.alias("reason")), "chunk-files")
    layouts = files.where("reason IS NULL").groupBy("names").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    layouts = sorted(layouts.limit(MAX_LAYOUTS + 1).collect(), key=lambda r: r.names)
    if len(layouts) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers in {folder}")
    read = lambda r, paths, **options: _parsed(spark, paths, r.names, schema, enforceSchema=True, **options)
    nothing = spark.createDataFrame([], "key string, n_rows long, n_placed long, n_bad long")
    counted = [
        read(r, r.paths, columnPruning=False).groupBy(_one_slash("_metadata.file_path").alias("key")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(required[0]).alias("n_placed"), F.count(BAD_LINE).alias("n_bad")
        ) for r in layouts
    ]
    report = files.withColumn("key", _one_slash("path")).join(union_feeds([nothing, *counted]), "key", "left").select(
        "path", F.coalesce("reason", F.when(F.col("n_bad") > 0, "damaged line")).alias("reason"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_placed", "n_bad")],
    )
    report = written(report, "chunk-report")
    damaged = {r.path for r in report.where("reason = 'damaged line'").select("path").collect()}
    kept = [(r, [p for p in r.paths if p not in damaged]) for r in layouts]
    frames = [read(r, paths).drop(BAD_LINE) for r, paths in kept if paths]
    rows = align(union_feeds([spark.createDataFrame([], schema), *frames]), schema)
    return _without_nan(rows, schema), report
