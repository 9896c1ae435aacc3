"""DuckDB SQL for the registered queries: independent brute-force forms over the same tables."""

from __future__ import annotations

from .views import HOTSPOTS_SQL, LANDUSE_SQL, PAYLOAD_LINES_SQL, PAYLOADS_SQL

# Common table expressions, in dependency order. Each query takes those it needs.
_CTES = {
    "hotspots": HOTSPOTS_SQL,
    "landuse": LANDUSE_SQL,
    "placed": "SELECT * FROM hotspots WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    "payloads": PAYLOADS_SQL,
    "payload_lines": PAYLOAD_LINES_SQL,
    "classed": """
SELECT *, CASE WHEN landuse IN ('industrial','quarry','military') THEN 1 WHEN landuse='forest' THEN 2
  WHEN landuse='farmland' THEN 3 WHEN landuse IN ('residential','commercial') THEN 4 END AS p FROM landuse""",
    "used": """
SELECT h.*, CASE b.p WHEN 1 THEN 'industrial' WHEN 2 THEN 'forest' WHEN 3 THEN 'farmland'
  WHEN 4 THEN 'residential' ELSE 'unknown' END AS land_use_type
FROM placed h LEFT JOIN (
  SELECT detection_id, min(p) AS p FROM placed JOIN classed
  ON abs(longitude-lon0)+abs(latitude-lat0) < r GROUP BY 1) b USING (detection_id)""",
    "xy": """
SELECT detection_id, acq_date, satellite_source, frp,
  radians(longitude)*6371000e0*cos(radians(latitude)) AS x, radians(latitude)*6371000e0 AS y,
  coalesce(acq_time//100*60 + acq_time%100, 0) AS m FROM placed""",
    "pairs": """
SELECT a.detection_id AS id, b.detection_id AS other, a.satellite_source AS s, b.satellite_source AS os,
  floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*1000) AS mm
FROM xy a JOIN xy b ON a.acq_date=b.acq_date AND a.satellite_source<>b.satellite_source
WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 1000e0 AND abs(a.m-b.m) <= 360""",
    "flagged": """
SELECT h.*, h.detection_id IN (SELECT id FROM pairs) AS co_confirmed FROM hotspots h""",
    "corners": """
SELECT poly_id, k, radians(lon)*6378137e0 AS x, ln(tan(pi()/4+radians(lat)/2))*6378137e0 AS y FROM (
 SELECT poly_id, 0 AS k, lon0+r AS lon, lat0 AS lat FROM landuse WHERE landuse IN ('industrial','quarry')
 UNION ALL SELECT poly_id, 1, lon0, lat0+r FROM landuse WHERE landuse IN ('industrial','quarry')
 UNION ALL SELECT poly_id, 2, lon0-r, lat0 FROM landuse WHERE landuse IN ('industrial','quarry')
 UNION ALL SELECT poly_id, 3, lon0, lat0-r FROM landuse WHERE landuse IN ('industrial','quarry'))""",
    "segments": """
SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corners a JOIN corners b
ON a.poly_id=b.poly_id AND b.k=(a.k+1)%4""",
    "merc": """
SELECT detection_id, radians(longitude)*6378137e0 AS px,
  ln(tan(pi()/4+radians(latitude)/2))*6378137e0 AS py FROM placed""",
    "sides": """
SELECT detection_id, poly_id, (x2-x1)*(py-y1)-(y2-y1)*(px-x1) AS turn,
  least(1e0, greatest(0e0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t,
  px, py, x1, y1, x2, y2 FROM merc CROSS JOIN segments""",
    "reach": """
SELECT detection_id, poly_id,
  CASE WHEN min(turn)>0 OR max(turn)<0 THEN 0e0 ELSE min(sqrt((px-(x1+t*(x2-x1)))*(px-(x1+t*(x2-x1)))
    + (py-(y1+t*(y2-y1)))*(py-(y1+t*(y2-y1))))) END AS d FROM sides GROUP BY 1,2""",
    "distances": """
SELECT p.detection_id, coalesce(least(min(d),50000e0),50000e0) AS distance_to_industrial
FROM placed p LEFT JOIN reach USING (detection_id) GROUP BY 1""",
    "shaped": """
SELECT poly_id, lon0, lat0, r, poly_id%3 AS kind FROM landuse WHERE landuse IN ('industrial','quarry')""",
    "shape_points": """
SELECT poly_id, k, kind, radians(lon)*6378137e0 AS x, ln(tan(pi()/4+radians(lat)/2))*6378137e0 AS y FROM (
 SELECT poly_id, kind, 0 AS k, lon0+r AS lon, lat0 AS lat FROM shaped WHERE kind<2 UNION ALL SELECT poly_id, kind, 1, lon0, lat0+r FROM shaped WHERE kind<2
 UNION ALL SELECT poly_id, kind, 2, lon0-r, lat0 FROM shaped WHERE kind<2 UNION ALL SELECT poly_id, kind, 3, lon0, lat0-r FROM shaped WHERE kind=0
 UNION ALL SELECT poly_id, kind, 0, lon0, lat0 FROM shaped WHERE kind=2)""",
    "shape_sides": """
SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM shape_points a JOIN shape_points b
ON a.poly_id=b.poly_id AND b.k=CASE a.kind WHEN 0 THEN (a.k+1)%4 WHEN 1 THEN a.k+1 ELSE a.k END""",
    "shape_reach": """
SELECT detection_id, min(sqrt((px-(x1+t*(x2-x1)))*(px-(x1+t*(x2-x1))) + (py-(y1+t*(y2-y1)))*(py-(y1+t*(y2-y1))))) AS d FROM (
 SELECT *, CASE WHEN x1=x2 AND y1=y2 THEN 0e0 ELSE
  least(1e0, greatest(0e0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END AS t
 FROM merc CROSS JOIN shape_sides) GROUP BY 1""",
    "full_in": """
SELECT u.*, d.distance_to_industrial AS dist, CASE WHEN f.co_confirmed THEN 1 ELSE 0 END AS flag
FROM used u JOIN distances d USING (detection_id) JOIN flagged f USING (detection_id)""",
    "simple_in": "SELECT *, 50000e0 AS dist, 0 AS flag FROM used",
}


def _features(source: str) -> list[tuple[str, str]]:
    """The feature chain over `source` (land_use_type, dist, flag present)."""
    return [
        ("f1", f"""
SELECT *, coalesce(bright_ti4, brightness, (SELECT median(coalesce(bright_ti4, brightness)) FROM {source})) AS b,
  greatest(coalesce(frp,0e0),0e0) AS frp0,
  count(*) OVER (PARTITION BY round_even(latitude/0.01e0,0), round_even(longitude/0.01e0,0)) - 1 AS hf,
  month(acq_date) AS mon FROM {source}"""),
        ("f2", """
SELECT *, CASE WHEN bright_ti4 IS NOT NULL AND bright_ti5 IS NOT NULL THEN bright_ti4-bright_ti5
  WHEN bright_ti4 IS NULL AND bright_t31 IS NOT NULL THEN b-bright_t31 ELSE 0e0 END AS d0 FROM f1"""),
        ("f3", f"""
SELECT *, round_even((CASE WHEN d0=0 THEN coalesce((SELECT median(d0) FROM f2 WHERE d0>0),15e0) ELSE d0 END)*1000,0)/1000
   AS delta, {_CONFIDENCE} AS conf, {_SEASON} AS season, {_TIME_OF_DAY} AS time_of_day,
  {_category('nrt')} AS category, {_category('archive')} AS category_archive FROM f2"""),
    ]


_CONFIDENCE = """
CASE WHEN confidence IS NULL THEN 0 WHEN lower(trim(confidence)) IN ('l','low') THEN 0
 WHEN lower(trim(confidence)) IN ('n','nominal') THEN 1 WHEN lower(trim(confidence)) IN ('h','high') THEN 2
 WHEN TRY_CAST(confidence AS DOUBLE) IS NULL THEN 1 WHEN TRY_CAST(confidence AS DOUBLE)>=80 THEN 2
 WHEN TRY_CAST(confidence AS DOUBLE)>=30 THEN 1 ELSE 0 END"""
_SEASON = """
CASE WHEN month(acq_date) IN (12,1,2) THEN 'Winter' WHEN month(acq_date) IN (3,4,5) THEN 'Summer'
 WHEN month(acq_date) IN (6,7,8,9) THEN 'Monsoon' ELSE 'Post-Monsoon' END"""
_TIME_OF_DAY = """
CASE WHEN coalesce(acq_time,0)<600 THEN 'Night' WHEN acq_time<1200 THEN 'Morning'
 WHEN acq_time<1800 THEN 'Afternoon' ELSE 'Evening' END"""
_ZONE = """
CASE WHEN latitude<14 THEN 'Southern Zone (TN/KL/KA)'
 WHEN latitude<20 AND longitude<78 THEN 'Maharashtra / Western Ghats'
 WHEN latitude<20 AND longitude>=78 THEN 'Eastern Deccan (AP/Telangana)'
 WHEN latitude<25 AND longitude<75 THEN 'Gujarat / West Coast'
 WHEN latitude<25 AND longitude>=75 THEN 'Central India (MP/CG/OD)'
 WHEN latitude>=25 AND longitude<78 THEN 'Northwest (PB/HR/RJ)' ELSE 'Gangetic Plain (UP/BR/WB)' END"""


def _category(mode: str) -> str:
    hf, wf, rm = (3, "7e0", 3) if mode == "nrt" else (5, "14e0", 5)
    ind = "(land_use_type='industrial' OR dist<1000)"
    return f"""
CASE WHEN hf>={hf} OR ({ind} AND hf>=1) THEN 'Industrial (Normal)'
 WHEN (frp0>={wf} OR (land_use_type='forest' AND frp0>=4)) AND hf<=1 AND NOT {ind} THEN 'Wildfire Risk'
 WHEN (hf>=1 AND hf<{rm} AND frp0<{wf}) OR (land_use_type='farmland' AND hf>=1) THEN 'Agricultural Burning'
 ELSE 'Anomaly/Unclassified' END"""


_INGESTED = f"""
SELECT * REPLACE (CASE WHEN satellite_source='MODIS' THEN brightness ELSE bright_ti4 END AS bright_ti4,
 CASE WHEN satellite_source='MODIS' THEN brightness ELSE bright_ti4 END AS brightness)
FROM ({HOTSPOTS_SQL}) QUALIFY row_number() OVER (
 PARTITION BY latitude, longitude, acq_date, acq_time, satellite_source ORDER BY detection_id)=1"""


def _with(names: str, body: str, source: str | None = None, hotspots: str = HOTSPOTS_SQL) -> str:
    """WITH the named expressions and what they stand on, then the feature chain if asked."""
    order = list(_CTES)
    wanted, queue = set(), names.split()
    if source:
        queue.append(source)
    while queue:
        n = queue.pop()
        if n in wanted:
            continue
        wanted.add(n)
        queue += [m for m in order if m != n and _mentions(_CTES[n], m)]
    parts = [(n, hotspots if n == "hotspots" else _CTES[n]) for n in order if n in wanted]
    if source:
        parts += _features(source)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in parts) + "\n" + body


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(a in ("FROM", "JOIN") and b == name for a, b in zip(words, words[1:]))


def _simple(body: str) -> str:
    return _with("", body, "simple_in")


def _r(expr: str, digits: int = 6) -> str:
    scale = "1" + "0" * digits
    return f"round_even(({expr})*{scale},0)/{scale}"


def _counts(names: str, col: str, table: str) -> str:
    body = f"""SELECT {col}, count(*) AS n, {_r('count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100')} AS pct
FROM {table} WHERE {col} IS NOT NULL GROUP BY 1"""
    return _simple(body) if table == "f3" else _with(names, body)


_RANKED = """SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:'||detection_id), detection_id) AS rn,
 count(*) OVER (PARTITION BY category) AS c, count(*) OVER () AS n FROM f3"""
_NOISE = """SELECT detection_id, category AS truth, CASE WHEN rn <= greatest(1, CAST(floor(n*0.05e0) AS BIGINT))
  THEN list_extract((SELECT list(DISTINCT category ORDER BY category) FROM f3),
   CAST(CAST('0x'||substr(md5('7-label:'||detection_id),1,8) AS BIGINT)
        % (SELECT count(DISTINCT category) FROM f3) + 1 AS BIGINT))
  ELSE category END AS predicted
 FROM (SELECT detection_id, category, count(*) OVER () AS n,
  row_number() OVER (ORDER BY md5('7:'||detection_id), detection_id) AS rn FROM f3)"""
_SCORES = """SELECT label, support, CASE WHEN picked=0 THEN 0e0 ELSE hits/picked END AS p,
  CASE WHEN support=0 THEN 0e0 ELSE hits/support END AS r, hits,
  CASE WHEN hits=0 THEN 0e0 ELSE 2e0*hits/(picked+support) END AS f
FROM (SELECT label, (SELECT count(*) FROM noisy WHERE truth=label) AS support,
  (SELECT count(*) FROM noisy WHERE predicted=label) AS picked,
  (SELECT count(*)::DOUBLE FROM noisy WHERE predicted=label AND truth=label) AS hits
 FROM (SELECT truth AS label FROM noisy UNION SELECT predicted FROM noisy))"""


def _noisy(body: str) -> str:
    return _simple(f"SELECT * FROM (WITH noisy AS ({_NOISE}), scores AS ({_SCORES}) {body})")


def _chunks(start: str) -> str:
    """The fetch plan by a plain list of days."""
    return f"""
SELECT feed, CASE WHEN DATE '2024-06-10' - d > 150 THEN replace(feed,'_NRT','_SP') ELSE feed END AS request_feed,
  d AS chunk_start, CAST(least(5, e - d) AS INTEGER) AS days,
  replace(replace(feed,'_NRT',''),'_','-') || '_' || strftime(d,'%Y-%m') || '_' || strftime(d,'%Y-%m-%d') AS chunk_key
FROM (SELECT feed, s, e, s + CAST(5*i AS INTEGER) AS d FROM (
   SELECT satellite_source||'_NRT' AS feed, {start} AS s, max(acq_date)+1 AS e FROM hotspots GROUP BY 1)
  CROSS JOIN range(0, 4000) AS t(i)) WHERE d < e"""


_PRIORITY = f"""
WITH picked AS (
 SELECT *, 0 AS g FROM (SELECT * FROM f3 WHERE category='Wildfire Risk' ORDER BY frp0 DESC, detection_id LIMIT 2)
 UNION ALL SELECT *, 1 FROM (SELECT * FROM f3 WHERE category<>'Wildfire Risk' ORDER BY frp0 DESC, detection_id LIMIT 2))
SELECT CAST(row_number() OVER (ORDER BY g, frp0 DESC, detection_id) AS INTEGER) AS position, detection_id, category,
 CASE category WHEN 'Wildfire Risk' THEN 'High Risk' WHEN 'Agricultural Burning' THEN 'Moderate Risk'
  WHEN 'Industrial (Normal)' THEN 'Low Risk' ELSE 'Anomaly' END AS badge,
 CASE category WHEN 'Wildfire Risk' THEN 'High Wildfire Risk detected' WHEN 'Agricultural Burning' THEN
  'Agricultural Stubble Burning' WHEN 'Industrial (Normal)' THEN 'Industrial Thermal Emitter'
  ELSE 'Thermal Anomaly detected' END || printf(' (%.1f MW)', frp0) AS heading,
 CAST(acq_date AS VARCHAR) || ' ' || printf('%02d:%02d UTC', coalesce(acq_time,0)//100, coalesce(acq_time,0)%100) AS seen,
 printf('%.3f°N, %.3f°E', latitude, longitude) AS position_text,
 upper(coalesce(confidence,'nominal')) AS confidence,
 printf('https://maps.google.com/?q=%.5f,%.5f', latitude, longitude) AS map_url,
 CASE category
  WHEN 'Wildfire Risk' THEN '🚨 PRIORITY ALPHA DISPATCH: Immediate escalation to District Emergency Operations Center (DEOC) & State Forest Fire Force. High-intensity thermal plume detected in non-industrial terrain.' 
  WHEN 'Agricultural Burning' THEN '🌾 FARM RESIDUE MONITOR: Seasonal post-harvest stubble burning observed. Routed to Tehsil Agriculture Registry and regional AQI plume trajectory tracking.' 
  WHEN 'Industrial (Normal)' THEN '🏭 VERIFIED INDUSTRIAL EMITTER: Persistent stationary thermal signature co-located with registered industrial furnace/flare coordinates. Alert suppressed to eliminate false alarms.' 
  WHEN 'Anomaly/Unclassified' THEN '🔍 UNCLASSIFIED HEAT ANOMALY: Atypical thermal profile requiring secondary satellite verification swath or UAV reconnaissance.' END AS procedure
FROM picked ORDER BY g, frp0 DESC, detection_id LIMIT 3"""

_EXPLAINED = {"frp": "frp0", "log_frp": "ln(1+frp0)", "brightness": "b", "delta_brightness": "delta",
              "historical_frequency": "hf", "confidence_enc": "conf", "scan": "scan", "track": "track"}
_FRIENDLY_SQL = """CASE feature WHEN 'frp' THEN 'Fire Radiative Power (FRP)' WHEN 'log_frp' THEN
 'High Thermal Energy (log-FRP)' WHEN 'brightness' THEN 'Elevated Brightness Temperature' WHEN 'delta_brightness'
 THEN 'Split-Window IR Thermal Contrast' WHEN 'historical_frequency' THEN 'Historical Recurrence Rate'
 WHEN 'confidence_enc' THEN 'Satellite Radiometric Confidence' ELSE feature END"""


def _explain() -> str:
    long = " UNION ALL ".join(
        f"SELECT detection_id, '{n}' AS feature, coalesce(round_even(({e}-(SELECT avg({e}) FROM f3))"
        f"/nullif((SELECT stddev_pop({e}) FROM f3),0)*10000,0)/10000, 0) AS value FROM f3"
        for n, e in _EXPLAINED.items()
    )
    return _simple(f"""
SELECT detection_id, category AS verdict,
 'This hotspot was classified as <b>'||category||'</b> primarily driven by '||
 coalesce(p1||' and '||p2, p1, 'baseline radiometric indicators')||
 coalesce(', despite counter-evidence from '||n1||'.', '.') AS explanation
FROM f3 LEFT JOIN (
 SELECT detection_id, max(CASE WHEN value>0 AND k=1 THEN '<b>'||name||printf('</b> (impact: +%.2f)', value) END) AS p1,
  max(CASE WHEN value>0 AND k=2 THEN '<b>'||name||printf('</b> (impact: +%.2f)', value) END) AS p2,
  max(CASE WHEN value<0 AND k=1 THEN '<b>'||name||printf('</b> (counter: -%.2f)', -value) END) AS n1
 FROM (SELECT *, {_FRIENDLY_SQL} AS name,
   row_number() OVER (PARTITION BY detection_id, sign(value) ORDER BY abs(value) DESC, feature) AS k
  FROM ({long}) WHERE value<>0) GROUP BY 1) USING (detection_id)""")


_TURNS = f"""
SELECT *, acq_date + INTERVAL 1 DAY <= latest - INTERVAL 2 DAY AS late FROM (
 SELECT detection_id%3 AS turn, acq_date, {_ZONE} AS zone, CASE WHEN coalesce(frp,0e0)>=7 THEN 'Wildfire Risk' ELSE 'Anomaly/Unclassified' END AS category FROM hotspots)
 LEFT JOIN (SELECT t.turn, max(acq_date + to_minutes(coalesce(acq_time//100*60+acq_time%100, 0)::BIGINT)) AS latest
  FROM (VALUES (0),(1),(2)) AS t(turn) JOIN hotspots ON detection_id%3 < t.turn - 1 GROUP BY 1) USING (turn)"""


_HOT = "detection_id, latitude, longitude, acq_date, acq_time, satellite_source, frp"


def _windows(length_days: int) -> str:
    return _with("hotspots", f"""
SELECT CAST(acq_date - CAST(i AS INTEGER) AS DATE) AS window_start, {_ZONE} AS zone, count(*) AS n
FROM hotspots CROSS JOIN range(0, {length_days}) AS t(i) GROUP BY 1, 2""")


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_csv_roundtrip"] = _with("hotspots", "SELECT * FROM hotspots")
    q["reject_bad_payloads"] = _with("payloads", """
SELECT payload_id, split_part(line,',',1)::DOUBLE AS latitude, split_part(line,',',2)::DOUBLE AS longitude,
  split_part(line,',',3)::DOUBLE AS frp, false AS rejected
FROM (SELECT payload_id, unnest(string_split(trim(body, ' '||chr(10)), chr(10))[2:]) AS line FROM payloads
 WHERE NOT (trim(body, ' '||chr(10))='' OR lower(trim(body)) LIKE 'invalid%' OR lower(body) LIKE '%map_key%'
   OR lower(substr(trim(body),1,100)) LIKE '%error%'))
UNION ALL SELECT payload_id, NULL, NULL, NULL, true FROM payloads
 WHERE trim(body, ' '||chr(10))='' OR lower(trim(body)) LIKE 'invalid%' OR lower(body) LIKE '%map_key%'
   OR lower(substr(trim(body),1,100)) LIKE '%error%'""")
    q["landed_payloads"] = _with("payload_lines", """
SELECT CAST(split_part(line, ',', CASE grp%3 WHEN 1 THEN 2 ELSE 1 END) AS DOUBLE) AS latitude,
 CAST(split_part(line, ',', CASE grp%3 WHEN 1 THEN 3 ELSE 2 END) AS DOUBLE) AS longitude,
 CASE grp%3 WHEN 0 THEN CAST(split_part(line, ',', 3) AS DOUBLE) WHEN 1 THEN CAST(split_part(line, ',', 1) AS DOUBLE) END AS frp
FROM payload_lines WHERE grp%7<>3""")
    q["load_chunks"] = q["scan_csv_roundtrip"]
    q["chunk_report"] = _with("hotspots", """
SELECT 'read' AS reason, count(*) AS n_rows, 0 AS n_bad FROM hotspots
UNION ALL SELECT 'no column latitude, longitude', 0, 0
UNION ALL SELECT 'damaged line', count(*), count(*) FROM hotspots
 WHERE detection_id%50=1 AND latitude IS NOT NULL AND longitude IS NOT NULL""")
    q["landing_resume"] = _with("hotspots", """
SELECT *, count(*) OVER (PARTITION BY chunk_key) AS n_rows FROM (
 SELECT detection_id, frp, satellite_source AS source, strftime(acq_date,'%Y-%m') AS month,
  replace(satellite_source,'_','-')||'_'||strftime(b,'%Y-%m')||'_'||strftime(b,'%Y-%m-%d') AS chunk_key
 FROM (SELECT *, acq_date - CAST(day(acq_date)%5 AS INTEGER) AS b FROM hotspots))""")
    q["chunk_plan"] = _with("hotspots", f"""
SELECT *, CASE WHEN feed='MODIS_NRT' THEN 5 ELSE 7 END AS recent_days FROM ({_chunks('min(acq_date)')})""")
    q["pending_chunks"] = _with("hotspots", f"""
SELECT * FROM ({_chunks('min(acq_date)-30')}) WHERE chunk_key NOT IN (
 SELECT replace(satellite_source,'_','-')||'_'||strftime(acq_date,'%Y-%m')||'_'||strftime(acq_date,'%Y-%m-%d')
 FROM hotspots)""")
    q["union_sensors"] = q["scan_csv_roundtrip"]
    q["harmonise_ingest"] = _with("hotspots", """
SELECT detection_id, satellite_source, CASE WHEN satellite_source='MODIS' THEN brightness ELSE bright_ti4 END AS bright_ti4,
 CASE WHEN satellite_source='MODIS' THEN brightness ELSE bright_ti4 END AS brightness FROM hotspots""")
    q["tag_sources"] = _with("hotspots", """
SELECT detection_id, feed, CASE WHEN feed='LANDSAT_NRT' THEN feed ELSE s END AS satellite_source,
 CASE WHEN feed='LANDSAT_NRT' THEN NULL WHEN s='MODIS' THEN 'MODIS' ELSE 'VIIRS' END AS instrument,
 CASE WHEN feed='LANDSAT_NRT' THEN feed ELSE s END AS archive_source
FROM (SELECT detection_id, satellite_source AS s,
  CASE WHEN confidence='bad' THEN 'LANDSAT_NRT' ELSE satellite_source||'_NRT' END AS feed FROM hotspots)""")
    q["bbox_filter"] = _with("hotspots", """
SELECT detection_id, latitude, longitude,
 latitude BETWEEN 6.5e0 AND 37.5e0 AND longitude BETWEEN 68e0 AND 97.5e0 AS plausible
FROM hotspots WHERE latitude BETWEEN 7.9e0 AND 35.5e0 AND longitude BETWEEN 68.1e0 AND 97.4e0""")
    q["exact_dedup"] = _with("hotspots", """
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, acq_date, acq_time,
  satellite_source ORDER BY detection_id) AS k FROM (SELECT * FROM hotspots UNION ALL
  SELECT * REPLACE (detection_id+1000000000 AS detection_id) FROM hotspots)) WHERE k=1""")
    q["brightness_filled"] = _simple("SELECT detection_id, b AS brightness FROM f3")
    q["delta_brightness"] = _simple("SELECT detection_id, delta AS delta_brightness FROM f3")
    q["confidence_enc"] = _with("hotspots", f"SELECT detection_id, confidence, {_CONFIDENCE} AS confidence_enc FROM hotspots")
    q["frp_features"] = _with("hotspots", f"""
SELECT detection_id, {_r('greatest(coalesce(frp,0e0),0e0)')} AS frp,
 {_r('ln(1+greatest(coalesce(frp,0e0),0e0))')} AS log_frp FROM hotspots""")
    q["calendar_features"] = _with("hotspots", f"""
SELECT detection_id, CAST(month(acq_date) AS INTEGER) AS month, {_SEASON} AS season, {_TIME_OF_DAY} AS time_of_day FROM hotspots""")
    q["landuse_defaults"] = _with("placed", """
SELECT detection_id, 'unknown' AS land_use_type, 50000e0 AS distance_to_industrial FROM placed""")
    q["historical_frequency"] = _simple("SELECT detection_id, hf AS historical_frequency FROM f3")
    for days in (7, 30):
        q[f"historical_frequency_{days}d"] = _with("placed", f"""
SELECT a.detection_id, count(b.detection_id) - 1 AS historical_frequency
FROM placed a JOIN placed b ON round_even(a.latitude/0.01e0,0)=round_even(b.latitude/0.01e0,0)
 AND round_even(a.longitude/0.01e0,0)=round_even(b.longitude/0.01e0,0) AND b.acq_date BETWEEN a.acq_date-{days - 1} AND a.acq_date
GROUP BY 1""")
    q["category_nrt"] = _simple("SELECT detection_id, category FROM f3")
    q["category_archive"] = _simple("SELECT detection_id, category_archive AS category FROM f3")
    labeled = f"""
SELECT detection_id, latitude, longitude, acq_date, acq_time, satellite_source, bright_ti4, bright_ti5, bright_t31,
 confidence, scan, track, flag AS co_confirmed, b AS brightness, frp0 AS frp, {_r('ln(1+frp0)')} AS log_frp,
 delta AS delta_brightness, conf AS confidence_enc, land_use_type, {_r('dist', 3)} AS distance_to_industrial,
 hf AS historical_frequency, time_of_day, season, CAST(mon AS INTEGER) AS month, category FROM f3"""
    q["features_labeled"] = _with("", labeled, "full_in")
    q["features_labeled_ingest"] = _with("", labeled, "full_in", _INGESTED)
    q["co_confirmed"] = _with("flagged", "SELECT detection_id, co_confirmed FROM flagged")
    q["co_confirmed_counts"] = _with("flagged", """
SELECT satellite_source, count(*) AS n, count(*) FILTER (co_confirmed) AS confirmed FROM flagged GROUP BY 1""")
    q["co_pairs"] = _with("pairs", """
SELECT id AS detection_id, min({'mm': mm, 'o': other}).o AS partner_id FROM pairs GROUP BY 1""")
    q["coincident_merge"] = _with("flagged pairs", """
SELECT * FROM (WITH gone1 AS (
  SELECT id, min({'mm': mm, 'o': other}).o AS keeper FROM pairs
  WHERE s='VIIRS_NOAA20' AND os='VIIRS_SNPP' GROUP BY 1),
 gone2 AS (
  SELECT id, min({'mm': mm, 'o': other}).o AS keeper FROM pairs
  WHERE s='MODIS' AND other NOT IN (SELECT id FROM gone1) GROUP BY 1),
 gone AS (SELECT * FROM gone1 UNION ALL SELECT * FROM gone2),
 took AS (SELECT keeper, max(frp) AS f FROM gone JOIN hotspots ON id=detection_id GROUP BY 1)
 SELECT detection_id, CASE WHEN keeper IS NULL THEN satellite_source ELSE satellite_source||'+MODIS' END AS satellite_source,
  CASE WHEN keeper IS NULL OR frp IS NULL OR f IS NULL THEN frp ELSE greatest(frp, f) END AS frp, co_confirmed
 FROM flagged LEFT JOIN took ON keeper=detection_id WHERE detection_id NOT IN (SELECT id FROM gone))""")
    q["landuse_norm"] = _with("classed", """
SELECT poly_id, CASE WHEN poly_id%5=0 THEN upper(landuse) ELSE landuse END AS landuse,
 CASE p WHEN 1 THEN 'industrial' WHEN 2 THEN 'forest' WHEN 3 THEN 'farmland' WHEN 4 THEN 'residential'
  ELSE 'unknown' END AS land_use_type FROM classed""")
    q["landuse_pip"] = _with("used", "SELECT detection_id, land_use_type FROM used")
    q["landuse_hits"] = _with("placed landuse", """
SELECT detection_id, poly_id, landuse FROM placed JOIN landuse ON abs(longitude-lon0)+abs(latitude-lat0) < r""")
    q["distance_to_industrial"] = _with("distances", f"""
SELECT detection_id, {_r('distance_to_industrial', 3)} AS distance_to_industrial FROM distances""")
    q["distance_mixed_shapes"] = _with("placed shaped shape_reach", f"""
SELECT detection_id, {_r('CASE WHEN EXISTS (SELECT 1 FROM shaped WHERE kind=0 AND abs(longitude-lon0)+abs(latitude-lat0) < r) THEN 0e0 ELSE least(coalesce(d,50000e0),50000e0) END', 3)}
 AS distance_to_industrial FROM placed LEFT JOIN shape_reach USING (detection_id)""")
    q["cluster_bbox"] = _with("placed", f"""
SELECT floor(latitude/0.5e0)*0.5e0 AS cluster_lat, floor(longitude/0.5e0)*0.5e0 AS cluster_lon,
 {_r('min(longitude)-0.03e0')} AS west, {_r('min(latitude)-0.03e0')} AS south,
 {_r('max(longitude)+0.03e0')} AS east, {_r('max(latitude)+0.03e0')} AS north, count(*) AS n FROM placed GROUP BY 1,2""")
    q["category_distribution"] = _counts("", "category", "f3")
    q["landuse_distribution"] = _counts("used", "land_use_type", "used")
    q["season_distribution"] = _counts("", "season", "f3")
    q["source_breakdown"] = _counts("hotspots", "satellite_source", "hotspots")
    q["radiometric_stats"] = _with("hotspots", f"""
SELECT min(brightness) AS brightness_min, {_r('avg(brightness)')} AS brightness_mean, max(brightness) AS brightness_max,
 min(frp) AS frp_min, {_r('avg(frp)')} AS frp_mean, max(frp) AS frp_max, count(*) FILTER (frp>=50) AS high_frp FROM hotspots""")
    q["frequency_bands"] = _simple("""
SELECT count(*) FILTER (hf=0) AS once, count(*) FILTER (hf>=1 AND hf<3) AS repeated, count(*) FILTER (hf>=3) AS persistent FROM f3""")
    q["distance_summary"] = _with("distances", f"""
SELECT count(*) FILTER (distance_to_industrial<50000) AS with_distance, count(*) FILTER (distance_to_industrial>=50000) AS at_limit,
 {_r('min(CASE WHEN distance_to_industrial<50000 THEN distance_to_industrial END)', 3)} AS min_m,
 {_r('median(CASE WHEN distance_to_industrial<50000 THEN distance_to_industrial END)', 3)} AS median_m FROM distances""")
    q["monthly_top6"] = _with("hotspots", """
SELECT strftime(acq_date,'%Y-%m') AS month, count(*) AS n FROM hotspots WHERE acq_date IS NOT NULL
GROUP BY 1 ORDER BY n DESC, month LIMIT 6""")
    q["date_span"] = _with("hotspots", """
SELECT min(acq_date) AS first_date, max(acq_date) AS last_date, CAST(max(acq_date)-min(acq_date) AS INTEGER) AS days FROM hotspots""")
    q["daily_trend7"] = _with("hotspots", f"""
SELECT * EXCLUDE (lv), {_r('lv')} AS level, CAST(round_even(85-lv*60,0) AS INTEGER) AS chart_y FROM (
 SELECT slot, acq_date, coalesce(strftime(acq_date,'%b %d'), 'Day '||(8-slot)) AS day_label, n,
  CASE WHEN max(n) OVER () > min(n) OVER () THEN (n-min(n) OVER ())/(max(n) OVER ()-min(n) OVER ()) ELSE 0.5e0 END AS lv
 FROM (SELECT CAST(i AS INTEGER) AS slot, acq_date, coalesce(n,0) AS n FROM range(1,8) AS t(i) LEFT JOIN (
   SELECT acq_date, count(*) AS n, 8 - row_number() OVER (ORDER BY acq_date DESC) AS k FROM hotspots
   WHERE acq_date IS NOT NULL GROUP BY 1 QUALIFY k>=1) ON k=i))""")
    q["zone_top5"] = _with("hotspots", f"""
SELECT CAST(rank AS INTEGER) AS rank, zone, n, CAST(greatest(15e0, round_even(n/max(n) OVER ()*100,0)) AS INTEGER) AS bar_pct
FROM (SELECT {_ZONE} AS zone, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {_ZONE}) AS rank
 FROM hotspots GROUP BY 1) WHERE rank<=5""")
    pct = lambda k: f"CAST(round_even({k}/total*100,0) AS INTEGER) AS {k}_pct"
    q["kpi_summary"] = _simple(f"""
SELECT *, {pct('wildfire')}, {pct('agricultural')}, {pct('industrial')}, {pct('anomaly')} FROM (
 SELECT count(*) AS total, count(*) FILTER (category='Wildfire Risk') AS wildfire,
 count(*) FILTER (category='Agricultural Burning') AS agricultural,
 count(*) FILTER (category='Industrial (Normal)') AS industrial,
 count(*) FILTER (category='Anomaly/Unclassified') AS anomaly FROM f3)""")
    q["sensor_gain"] = _with("hotspots", f"""
SELECT *, combined-viirs AS gain, {_r('(combined-viirs)/viirs*100')} AS gain_pct FROM (
 SELECT count(*) FILTER (satellite_source LIKE '%VIIRS%') AS viirs, count(*) AS combined FROM hotspots)""")
    q["priority_feed"] = _simple(f"SELECT * FROM ({_PRIORITY})")
    points = f"""
SELECT detection_id, {_r('greatest(4e0, least(12e0, sqrt(frp0)))')} AS radius, latitude AS lat, longitude AS lon, frp0 AS frp,
 category AS cat, CASE category WHEN 'Wildfire Risk' THEN '#E5383B' WHEN 'Agricultural Burning' THEN '#F4A259'
  WHEN 'Industrial (Normal)' THEN '#4A8FE7' ELSE '#9D4EDD' END AS color, CAST(acq_date AS VARCHAR) AS date,
 land_use_type AS land FROM f3"""
    q["map_export"] = _simple(points)
    q["map_points"] = _simple(f"{points} ORDER BY md5('42:'||detection_id), detection_id LIMIT 1200")
    alerts = """SELECT *, row_number() OVER (ORDER BY frp0 DESC, md5(CAST(detection_id AS VARCHAR)), detection_id) AS rank
 FROM f3 WHERE category='Wildfire Risk'"""
    url = "printf('https://www.google.com/maps?q=%.5f,%.5f', latitude, longitude)"
    q["wildfire_alerts"] = _simple(f"""
SELECT rank, detection_id, frp0 AS frp, latitude, longitude, {url} AS map_url FROM ({alerts} AND frp0>=7)""")
    q["alert_digest"] = _simple(f"""
SELECT detection_id, rank, printf('#%d  FRP: %.1f MW  |  %.4fN, %.4fE  |  ', rank, frp0, latitude, longitude)
  || CAST(acq_date AS VARCHAR) || '  |  ' || land_use_type || '  |  ' || {url} AS line,
 printf('%.1f MW', frp0) AS frp_text, printf('%.4f°N, %.4f°E', latitude, longitude) AS position_text,
 CAST(acq_date AS VARCHAR) || ' ' || coalesce(CAST(acq_time AS VARCHAR),'') AS seen,
 upper(land_use_type[1]) || land_use_type[2:] AS land_use, time_of_day || ' · ' || season AS period,
 hf AS repeats, {url} AS map_url FROM ({alerts})""")
    q["alert_log"] = _simple("""
SELECT count(*) FILTER (category='Wildfire Risk' AND frp0>=t) AS hotspots, t AS frp_threshold FROM f3, (VALUES (7e0), (14e0)) AS x(t) GROUP BY t""")
    q["label_encode"] = _with("used", """
SELECT detection_id, land_use_type, CAST(coalesce(code,0) AS INTEGER) AS land_use_type_enc FROM used LEFT JOIN (
 SELECT land_use_type, dense_rank() OVER (ORDER BY land_use_type)-1 AS code FROM
  (SELECT DISTINCT land_use_type FROM used WHERE land_use_type<>'unknown')) USING (land_use_type)""")
    code = lambda c: f"(dense_rank() OVER (ORDER BY {c})-1)::DOUBLE AS {c}_enc"
    q["feature_matrix"] = _simple(f"""
SELECT detection_id, category, {_r('b')} AS brightness, {_r('frp0')} AS frp, {_r('ln(1+frp0)')} AS log_frp,
 dist AS distance_to_industrial, hf::DOUBLE AS historical_frequency, mon::DOUBLE AS month, {_r('scan')} AS scan,
 {_r('track')} AS track, conf::DOUBLE AS confidence_enc, {_r('delta')} AS delta_brightness, flag::DOUBLE AS co_confirmed,
 {code('land_use_type')}, {code('time_of_day')}, {code('season')} FROM f3""")
    q["label_noise"] = _noisy("SELECT detection_id, predicted AS category FROM noisy")
    q["stratified_split"] = _simple(f"""
SELECT detection_id, category, rn <= floor(c*0.2e0+0.5e0) AS is_test FROM ({_RANKED})""")
    q["stratified_subset"] = _simple(f"""
SELECT detection_id, category FROM ({_RANKED}) WHERE n<=5000 OR rn <= greatest(1, floor(c*(3000e0/n)+0.5e0))""")
    q["kfold_assign"] = _simple(f"""
SELECT detection_id, category, CASE WHEN rn<=c//3 THEN 0 WHEN rn<=c*2//3 THEN 1 ELSE 2 END AS fold FROM ({_RANKED})""")
    q["class_weights"] = _simple(f"""
SELECT category, count(*) AS n, {_r('(sum(count(*)) OVER ())::DOUBLE/(count(*) OVER ()*count(*))')} AS weight
FROM f3 GROUP BY 1""")
    cell = lambda c: f"count(*) FILTER (predicted='{c}') AS \"{c}\""
    q["confusion_matrix"] = _noisy(f"""
SELECT truth, {cell('Agricultural Burning')}, {cell('Anomaly/Unclassified')}, {cell('Industrial (Normal)')},
 {cell('Wildfire Risk')} FROM noisy GROUP BY 1""")
    q["classification_report"] = _noisy(f"""
SELECT label, {_r('p')} AS precision, {_r('r')} AS recall, {_r('f')} AS f1, support FROM scores
UNION ALL SELECT 'macro avg', {_r('avg(p)')}, {_r('avg(r)')}, {_r('avg(f)')}, CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', {_r('sum(p*support)/sum(support)')}, {_r('sum(r*support)/sum(support)')},
 {_r('sum(f*support)/sum(support)')}, CAST(sum(support) AS BIGINT) FROM scores""")
    q["overall_metrics"] = _noisy(f"""
SELECT CAST(sum(support) AS BIGINT) AS n, {_r('sum(hits)/sum(support)')} AS accuracy,
 {_r('avg(r) FILTER (support>0)')} AS balanced_accuracy, {_r('avg(p)')} AS macro_precision,
 {_r('avg(r)')} AS macro_recall, {_r('avg(f)')} AS macro_f1 FROM scores""")
    q["score_validity"] = _noisy("""
SELECT detection_id, CAST((SELECT count(DISTINCT predicted) FROM noisy) AS INTEGER) AS n_classes, 1e0 AS probability_sum,
 true AS confident FROM noisy""")
    q["evaluation_support"] = _noisy("""
SELECT predicted AS category, CAST(floor(count(*)*0.2e0+0.5e0) AS BIGINT) AS support, true AS beats_largest
FROM noisy GROUP BY 1""")
    q["boosted_support"] = q["evaluation_support"]
    q["search_support"] = f"SELECT *, 2 AS trials FROM ({q['evaluation_support']})"
    q["decision_balance"] = _simple("SELECT detection_id, 15 AS parts, true AS adds_up, true AS shares FROM f3")
    q["curve_rows"] = _noisy(f"""
SELECT share, {_r('sum(floor(n*share+0.5e0))/3')} AS train_rows, true AS in_range FROM (
 SELECT unnest([c-c//3, c-(c*2//3-c//3), c*2//3]) AS n FROM (SELECT count(*) AS c FROM noisy GROUP BY predicted)),
 (VALUES (0.5e0), (1e0)) AS t(share) GROUP BY share""")
    q["whatif_scores"] = _simple(f"""
SELECT detection_id, month, {_r('100*ew/t')} AS p_wildfire, {_r('100*ea/t')} AS p_agricultural,
 {_r('100*ei/t')} AS p_industrial, {_r('100*eo/t')} AS p_anomaly, {_r('100*greatest(ew,ea,ei,eo)/t')} AS confidence_pct,
 CASE WHEN ew>=greatest(ea,ei,eo) THEN 'Wildfire Risk' WHEN ea>=greatest(ei,eo) THEN 'Agricultural Burning'
  WHEN ei>=eo THEN 'Industrial (Normal)' ELSE 'Anomaly/Unclassified' END AS verdict
FROM (SELECT *, ew+ea+ei+eo AS t FROM (
 SELECT detection_id, month, exp(w) AS ew, exp(a) AS ea, exp(i) AS ei, exp(o) AS eo FROM (
 SELECT detection_id, month, 0.05e0 + CASE WHEN NOT ind AND hf<=1 AND (frp0>=7 OR (land_use_type='forest' AND frp0>=4))
   THEN 6 + frp0/25 + CASE WHEN land_use_type='forest' THEN 4e0 ELSE 0e0 END + delta/20 ELSE 0e0 END AS w,
  0.05e0 + CASE WHEN land_use_type='farmland' AND (month IN (10,11) OR hf>=1) AND frp0<15
   THEN 5.5e0 + CASE WHEN month IN (10,11) THEN 3.5e0 ELSE 0e0 END + hf*1.2e0 ELSE 0e0 END AS a,
  0.05e0 + CASE WHEN hf>=3 OR (ind AND hf>=1) THEN 8.5e0+hf*1.5e0 ELSE 0e0 END AS i,
  0.1e0 + CASE WHEN frp0<6 AND hf=0 AND land_use_type<>'forest' AND NOT ind THEN 4.5e0 ELSE 0e0 END AS o
 FROM (SELECT *, land_use_type='industrial' OR dist<1000 AS ind,
   CASE season WHEN 'Monsoon' THEN 7 WHEN 'Post-Monsoon' THEN 10 WHEN 'Winter' THEN 1 ELSE 4 END AS month FROM f3))))""")
    q["explain_text"] = _explain()
    q["stream_dedup"] = _with("hotspots", """
SELECT DISTINCT latitude, longitude, acq_date, acq_time, satellite_source FROM hotspots""")
    q["stream_daily_counts"] = _windows(1)
    q["stream_weekly_counts"] = _windows(7)
    q["stream_co_confirmed"] = _with("flagged", "SELECT detection_id FROM flagged WHERE co_confirmed")
    turns = "SELECT acq_date AS window_start, category, zone, count(*) AS n FROM ({}) WHERE {} GROUP BY ALL"
    q["stream_category_counts"] = _with("hotspots", turns.format(_TURNS, "late IS NOT TRUE"))
    q["stream_late_rows"] = _with("hotspots", turns.format(_TURNS, "late"))
    q["stream_transitions"] = _with("placed", """
SELECT * FROM (WITH seen AS (
  SELECT CAST(round_even(latitude/0.01e0,0) AS BIGINT) AS cell_lat, CAST(round_even(longitude/0.01e0,0) AS BIGINT) AS cell_lon,
   CAST(epoch(acq_date + to_minutes(coalesce(acq_time//100*60+acq_time%100, 0)::BIGINT)) AS BIGINT) AS moment FROM placed),
 due AS (SELECT *, CASE WHEN moment - lag(moment) OVER w <= 3*86400 THEN 0 ELSE 1 END AS fresh FROM seen
  WHERE moment <= (SELECT max(moment) FROM seen) - 2*86400 WINDOW w AS (PARTITION BY cell_lat, cell_lon ORDER BY moment)),
 visits AS (SELECT *, sum(fresh) OVER (PARTITION BY cell_lat, cell_lon ORDER BY moment ROWS UNBOUNDED PRECEDING) AS visit FROM due),
 counted AS (SELECT *, row_number() OVER (PARTITION BY cell_lat, cell_lon, visit ORDER BY moment) AS n FROM visits)
 SELECT cell_lat, cell_lon, CASE n WHEN 1 THEN 'new' WHEN 2 THEN 'repeated' ELSE 'persistent' END AS kind, moment AS "at", n FROM counted WHERE n IN (1, 2, 4)
 UNION ALL SELECT cell_lat, cell_lon, 'expired', max(moment) + 3*86400, count(*) FROM counted GROUP BY cell_lat, cell_lon, visit
 HAVING max(moment) + 3*86400 <= (SELECT max(moment) FROM seen) - 2*86400)""")
    q["stream_frequency"] = _with("placed", """
SELECT CAST(round_even(latitude/0.01e0,0) AS BIGINT) AS cell_lat, CAST(round_even(longitude/0.01e0,0) AS BIGINT) AS cell_lon,
 count(*) AS n, CASE WHEN count(*)=1 THEN 'new' WHEN count(*)>3 THEN 'persistent' ELSE 'repeated' END AS kind
FROM placed GROUP BY 1,2""")
    q["stream_alerts"] = _with("", """
SELECT detection_id, frp0 AS frp, latitude, longitude FROM f3 WHERE category='Wildfire Risk' AND frp0>=7""", "bare_in")
    return q


_CTES["bare_in"] = "SELECT *, 'unknown' AS land_use_type, 50000e0 AS dist, 0 AS flag FROM placed"
