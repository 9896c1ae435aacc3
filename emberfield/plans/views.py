"""Detections and land-use polygons derived from the given tables.

The SQL text runs unchanged in Spark SQL and DuckDB. The detections are stored
once per session and input folder, as landed detections would be: later scans
prune columns and push filters down to the file, and the derivation (regular
expressions, nested conditions) is not inlined into every plan, where it makes
generated code too long for the JVM to compile.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

HOTSPOTS_SQL = """
WITH e AS (
 SELECT event_id, user_id, event_type, value, ts,
        CAST(regexp_extract(props,'[0-9]+',0) AS INT) AS k,
        CAST(ts AS DATE) AS acq_date, day(ts) AS dd,
        CAST(hour(ts)*100+minute(ts) AS INT) AS acq_time
 FROM events),
s AS (
 SELECT *, CASE WHEN event_type IN ('view','click') THEN 'VIIRS_SNPP'
                WHEN event_type='purchase' THEN 'VIIRS_NOAA20' ELSE 'MODIS' END AS satellite_source,
  CASE WHEN k<15 THEN user_id*7919
       WHEN k<60 THEN user_id*7919 + (dd%8)*613 + 211
       ELSE event_id*7907 + 101 END AS a,
  CASE WHEN k<15 THEN user_id*4729
       WHEN k<60 THEN user_id*4729 + (dd%8)*389 + 97
       ELSE event_id*4733 + 59 END AS b
 FROM e)
SELECT event_id AS detection_id,
  CASE WHEN event_id%211=0 THEN CAST(NULL AS DOUBLE) ELSE CAST(800+(a%2700) AS DOUBLE)/100e0 + CAST(k%5 AS DOUBLE)/1000e0 END AS latitude,
  CASE WHEN event_id%223=0 THEN CAST(NULL AS DOUBLE) ELSE CAST(6850+(b%2850) AS DOUBLE)/100e0 + CAST(k%3 AS DOUBLE)/1000e0 END AS longitude,
  acq_date, CASE WHEN event_id%197=0 THEN CAST(NULL AS INT) ELSE acq_time END AS acq_time, satellite_source,
  CASE WHEN event_id%97=0 THEN CAST(NULL AS DOUBLE) WHEN event_id%89=0 THEN -1e0 ELSE value/8e0 END AS frp,
  CASE WHEN satellite_source='MODIS' OR event_id%53=0 THEN CAST(NULL AS DOUBLE) ELSE 295e0+CAST(k AS DOUBLE)/2e0 END AS bright_ti4,
  CASE WHEN satellite_source='MODIS' THEN CAST(NULL AS DOUBLE) ELSE 280e0+CAST(k%41 AS DOUBLE) END AS bright_ti5,
  CASE WHEN satellite_source='MODIS' AND event_id%59<>0 THEN 300e0+CAST(k AS DOUBLE)/4e0 ELSE CAST(NULL AS DOUBLE) END AS brightness,
  CASE WHEN satellite_source='MODIS' THEN 285e0+CAST(k%29 AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END AS bright_t31,
  CASE WHEN event_id%61=0 THEN CAST(NULL AS STRING) WHEN event_id%67=0 THEN 'bad'
       WHEN satellite_source='MODIS' THEN CAST(k AS STRING)
       WHEN event_id%4=0 THEN 'l' WHEN event_id%4=1 THEN 'n' WHEN event_id%4=2 THEN ' High ' ELSE 'nominal' END AS confidence,
  CAST(4+k%7 AS DOUBLE)/10e0 AS scan, CAST(4+k%5 AS DOUBLE)/10e0 AS track
FROM s
"""

# Diamonds |lon - lon0| + |lat - lat0| < r.
LANDUSE_SQL = """
SELECT s_suppkey AS poly_id,
 CASE s_suppkey%7 WHEN 0 THEN 'industrial' WHEN 1 THEN 'farmland' WHEN 2 THEN 'forest' WHEN 3 THEN 'quarry'
   WHEN 4 THEN 'residential' WHEN 5 THEN 'military' ELSE 'commercial' END AS landuse,
 CAST(800+(s_suppkey*7919)%2700 AS DOUBLE)/100e0 AS lat0, CAST(6850+(s_suppkey*4729)%2850 AS DOUBLE)/100e0 AS lon0,
 0.1005e0+CAST(s_suppkey%5 AS DOUBLE)/5e0 AS r FROM supplier
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    source = table(spark, sf_dir, name)
    return spark.sql(text.replace(f"FROM {name}", "FROM {source}"), source=source)


_STORED: dict[tuple[str, str], str] = {}


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored detections, derived on first use and spread evenly over files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:  # the shared folder was cleaned meanwhile
            del _STORED[key]
    path = work_path(spark, "detections")
    derived = _derive(spark, sf_dir, "events", HOTSPOTS_SQL)
    derived.repartition("detection_id").write.parquet(path)
    _STORED[key] = path
    return spark.read.parquet(path)


def landuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diamonds with one ring each, as polygon tables arrive."""
    lat, lon, r = F.col("lat0"), F.col("lon0"), F.col("r")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(lon + r, lat), corner(lon, lat + r), corner(lon - r, lat), corner(lon, lat - r))
    return _derive(spark, sf_dir, "supplier", LANDUSE_SQL).withColumn("rings", F.array(ring))


def mixed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons, with a third as open lines over three of the corners and a third as their centre points."""
    lat, lon, r = F.col("lat0"), F.col("lon0"), F.col("r")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    line = F.array(corner(lon + r, lat), corner(lon, lat + r), corner(lon - r, lat))
    kind = F.col("poly_id") % 3
    return landuse(spark, sf_dir).withColumn(
        "rings", F.when(kind == 1, F.array(line)).when(kind == 2, F.array(F.array(corner(lon, lat)))).otherwise(F.col("rings"))
    ).withColumn("shape", F.when(kind == 1, "line").when(kind == 2, "point").otherwise("polygon"))


def hotspots_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as a stream over the event file."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(HOTSPOTS_SQL.replace("FROM events", "FROM {source}"), source=events)


def landed_twice(df: DataFrame) -> DataFrame:
    """Every detection from two overlapping landings, the second under new ids."""
    copies = F.explode(F.array(F.lit(0), F.lit(10**9)).cast("array<bigint>"))
    return df.withColumn("_shift", copies).withColumn(
        "detection_id", F.col("detection_id") + F.col("_shift")
    ).drop("_shift")


# One response body per event; some are empty or carry a service message.
PAYLOADS_SQL = """
SELECT event_id AS payload_id,
  CASE WHEN event_id%41=0 THEN '   ' WHEN event_id%43=0 THEN ' Invalid API call.'
       WHEN event_id%47=0 THEN concat('latitude,longitude,frp', chr(10), 'Please check your MAP_KEY')
       WHEN event_id%53=0 THEN 'Internal ERROR, try again'
       ELSE concat('latitude,longitude,frp', chr(10),
                   CAST(8 + user_id%27 AS STRING), '.5,', CAST(69 + event_id%28 AS STRING), '.25,',
                   CAST(event_id%90 AS STRING), chr(10),
                   CAST(9 + user_id%26 AS STRING), '.75,', CAST(70 + event_id%27 AS STRING), '.5,',
                   CAST(event_id%80 AS STRING), chr(10)) END AS body
FROM events
"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "events", PAYLOADS_SQL)


# Response lines by user group: three column orders, every seventh group a message only.
PAYLOAD_LINES_SQL = """
SELECT user_id%40 AS grp, event_id AS at,
  CASE WHEN user_id%40%7=3 THEN 'Invalid request for this area'
       WHEN user_id%40%3=0 THEN concat(CAST(8 + event_id%27 AS STRING), '.5,', CAST(69 + user_id%28 AS STRING), '.25,', CAST(event_id%90 AS STRING))
       WHEN user_id%40%3=1 THEN concat(CAST(event_id%90 AS STRING), ',', CAST(8 + event_id%27 AS STRING), '.5,', CAST(69 + user_id%28 AS STRING), '.25')
       ELSE concat(CAST(8 + event_id%27 AS STRING), '.5,', CAST(69 + user_id%28 AS STRING), '.25') END AS line
FROM events
"""


def payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, at, line) with a header line of its own for every group."""
    lines = _derive(spark, sf_dir, "events", PAYLOAD_LINES_SQL)
    kind = F.col("grp") % 3
    header = F.when(kind == 0, "latitude,longitude,frp").when(kind == 1, "frp,latitude,longitude").otherwise("latitude,longitude")
    groups = lines.where(F.col("grp") % 7 != 3).select("grp").distinct()
    return lines.unionByName(groups.select("grp", F.lit(-1).cast("bigint").alias("at"), header.alias("line")))
