"""Queries over the pings fixture: scans, functions, stops, places, flows, selection, distributions; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, geo, slots
from ..operators import flows, grid, places, stops
from ..session import cut_lineage
from .fixtures import PINGS_SQL, pings

STOP = {"distance_threshold": 50.0, "time_threshold": 43_200.0, "min_stop_duration": 300.0}
RES = 8
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def hav(a: str, b: str, c: str, d: str, r: float = geo.R_MEAN_M) -> str:
    x = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2e0 * {r!r} * atan2(sqrt(least({x}, 1e0)), sqrt(greatest(1e0 - {x}, 0e0))))"


def vincenty_sql(src: str, keys: str, lat1: str, lon1: str, lat2: str, lon2: str, turns: int = 12) -> str:
    """CTEs ending in ``vd`` (``keys``, km): Vincenty's inverse formula on WGS-84 for the rows of ``src``, ``turns`` times round."""
    f, a = "(1e0 / 298.257223563e0)", "6378137e0"
    b = f"({a} * (1e0 - {f}))"
    out = [f"v0 AS (SELECT {keys}, atan((1e0 - {f}) * tan(radians({lat1}))) u1, atan((1e0 - {f}) * tan(radians({lat2}))) u2, radians({lon2}) - radians({lon1}) ell, radians({lon2}) - radians({lon1}) lam FROM {src})"]
    ss = "sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2))"
    one = f"""SELECT *, atan2(ss, cs) sig, 1e0 - sa * sa c2, CASE WHEN 1e0 - sa * sa = 0 THEN 0e0 ELSE cs - 2e0 * sin(u1) * sin(u2) / (1e0 - sa * sa) END cm FROM (
      SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END sa FROM (SELECT *, {ss} ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) cs FROM v{{k}}))"""
    cc = f"({f} / 16e0 * c2 * (4e0 + {f} * (4e0 - 3e0 * c2)))"
    for k in range(turns):
        out.append(f"v{k + 1} AS (SELECT {keys}, u1, u2, ell, ell + (1e0 - {cc}) * {f} * sa * (sig + {cc} * ss * (cm + {cc} * cs * (2e0 * cm * cm - 1e0))) lam FROM ({one.format(k=k)}))")
    usq = f"(c2 * ({a} * {a} - {b} * {b}) / ({b} * {b}))"
    aa = f"(1e0 + {usq} / 16384e0 * (4096e0 + {usq} * (-768e0 + {usq} * (320e0 - 175e0 * {usq}))))"
    bb = f"({usq} / 1024e0 * (256e0 + {usq} * (-128e0 + {usq} * (74e0 - 47e0 * {usq}))))"
    ds = f"({bb} * ss * (cm + {bb} / 4e0 * (cs * (2e0 * cm * cm - 1e0) - {bb} / 6e0 * cm * (4e0 * ss * ss - 3e0) * (4e0 * cm * cm - 3e0))))"
    out.append(f"vd AS (SELECT {keys}, {b} * {aa} * (sig - {ds}) / 1000e0 km FROM ({one.format(k=turns)}))")
    return ", ".join(out)


def cell_sql(lat: str, lon: str, res: int) -> str:
    n, k = 1 << (res + 6), (9 << 59) | (res << 52)
    x = f"least(CAST(floor(({lon} + 180e0) / 360e0 * {n}e0) AS BIGINT), {n - 1})"
    y = f"least(CAST(floor(({lat} + 90e0) / 180e0 * {n}e0) AS BIGINT), {n - 1})"
    return f"(CASE WHEN {lat} IS NOT NULL THEN {k} + {y} * {n} + {x} END)"


def parent_sql(c: str, frm: int, res: int) -> str:
    n, up, m, k = 1 << (frm + 6), 1 << (frm - res), 1 << (res + 6), (9 << 59) | (res << 52)
    pos = f"({c} & {(1 << 52) - 1})"
    return f"({k} + (({pos} // {n}) // {up}) * {m} + ({pos} % {n}) // {up})"


def center_sql(c: str, res: int) -> tuple[str, str]:
    n = 1 << (res + 6)
    pos = f"({c} & {(1 << 52) - 1})"
    return f"((({pos} // {n}) + 0.5e0) / {n}e0 * 180e0 - 90e0)", f"((({pos} % {n}) + 0.5e0) / {n}e0 * 360e0 - 180e0)"


# --- SQL of the pipeline ---------------------------------------------------------------------

D, T, M = STOP["distance_threshold"], STOP["time_threshold"], STOP["min_stop_duration"]
_W = "OVER (PARTITION BY caid ORDER BY t, la, lo)"
_EVENTS = f"""p AS ({PINGS_SQL}), q AS (SELECT DISTINCT caid, latitude la, longitude lo, utc_timestamp t FROM p),
e AS (SELECT *, lead(la) {_W} la2, lead(lo) {_W} lo2, lead(t) {_W} t2 FROM q),
f AS (SELECT caid, la, lo, t, {hav("la", "lo", "la2", "lo2")} d, t2 - t td FROM e),
g AS (SELECT *, lag(d) {_W} pd, lag(td) {_W} ptd FROM f),
h AS (SELECT *, coalesce((d <= {D} AND (td <= {T} OR td IS NULL)) OR (pd <= {D} AND (ptd <= {T} OR ptd IS NULL)), false) st FROM g),
i AS (SELECT *, CASE WHEN st AND (lag(st) {_W} IS NULL OR NOT lag(st) {_W} OR pd > {D}) THEN 1 ELSE 0 END b FROM h),
j AS (SELECT *, sum(b) OVER (PARTITION BY caid ORDER BY t, la, lo ROWS UNBOUNDED PRECEDING) ev FROM i),
k AS (SELECT caid, ev, t, la, lo FROM j WHERE st AND ev > 0)"""
_AGG = "min(t) start_timestamp, max(t) end_timestamp, quantile_disc(la, 0.5) median_latitude, quantile_disc(lo, 0.5) median_longitude"
_NUMBER = "row_number() OVER (PARTITION BY caid ORDER BY start_timestamp)"
UNREFINED_SQL = f"WITH {_EVENTS}, s AS (SELECT caid, ev, {_AGG} FROM k GROUP BY caid, ev HAVING max(t) - min(t) >= {M}) SELECT caid, start_timestamp, end_timestamp, median_latitude, median_longitude, CAST({_NUMBER} AS INT) stop_events FROM s"
STOPS_SQL = f"""WITH {_EVENTS}, s AS (SELECT caid, ev, {_AGG} FROM k GROUP BY caid, ev HAVING max(t) - min(t) >= {M}),
r AS (SELECT k.* FROM k JOIN s ON k.caid = s.caid AND k.ev = s.ev WHERE {hav("k.la", "k.lo", "s.median_latitude", "s.median_longitude")} <= {D}),
z AS (SELECT caid, ev, {_AGG} FROM r GROUP BY caid, ev HAVING max(t) - min(t) >= {M})
SELECT caid, start_timestamp, end_timestamp, median_latitude, median_longitude, CAST({_NUMBER} AS INT) stop_events FROM z"""

_X = "stop_events, start_timestamp, end_timestamp, end_timestamp - start_timestamp stay_duration, median_latitude stop_latitude, median_longitude stop_longitude"


def places_sql(min_points: int = 2, metres: float = 20.0) -> str:
    """Connected components of the core stops; a border stop joins the component of the earliest core that reaches it first in cluster order."""
    return f"""WITH RECURSIVE st AS ({STOPS_SQL}),
ed AS (SELECT a.caid, a.stop_events a, b.stop_events b FROM st a JOIN st b ON a.caid = b.caid AND {hav("a.median_latitude", "a.median_longitude", "b.median_latitude", "b.median_longitude")} <= {metres}),
co AS (SELECT caid, a FROM ed GROUP BY caid, a HAVING count(*) >= {min_points}),
ce AS (SELECT ed.* FROM ed JOIN co x ON ed.caid = x.caid AND ed.a = x.a JOIN co y ON ed.caid = y.caid AND ed.b = y.a),
re AS (SELECT caid, a, b FROM ce UNION SELECT re.caid, re.a, ce.b FROM re JOIN ce ON re.caid = ce.caid AND re.b = ce.a),
cc AS (SELECT caid, a, min(b) c FROM re GROUP BY caid, a),
al AS (SELECT ed.caid, ed.a, min(cc.c) c FROM ed JOIN cc ON ed.caid = cc.caid AND ed.b = cc.a WHERE (ed.caid, ed.a) NOT IN (SELECT (caid, a) FROM co) GROUP BY ed.caid, ed.a UNION ALL SELECT caid, a, c FROM cc),
cl AS (SELECT st.*, al.c FROM st LEFT JOIN al ON st.caid = al.caid AND st.stop_events = al.a),
ag AS (SELECT caid, c, count(*) n, avg(median_latitude) mla, avg(median_longitude) mlo, median(median_latitude) cla, median(median_longitude) clo FROM cl WHERE c IS NOT NULL GROUP BY caid, c),
nu AS (SELECT *, row_number() OVER (PARTITION BY caid ORDER BY mla, mlo) - 1 lab FROM ag)
SELECT cl.caid, {_X}, CAST(coalesce(lab, -1) AS INT) cluster_label, CAST(coalesce(n, 1) AS INT) cluster_counts,
  coalesce(cla, median_latitude) cluster_latitude, coalesce(clo, median_longitude) cluster_longitude
FROM cl LEFT JOIN nu ON cl.caid = nu.caid AND cl.c = nu.c"""


PLACES_SQL = places_sql()
# Session and fixture zone is UTC: Monday is day 2.
LOCAL_SQL = f"""SELECT *, start_timestamp lt, CAST(to_timestamp(start_timestamp) AT TIME ZONE 'UTC' AS DATE) date, hour(to_timestamp(start_timestamp) AT TIME ZONE 'UTC') hour_of_day,
  dayofweek(to_timestamp(start_timestamp) AT TIME ZONE 'UTC') + 1 day_of_week, dayofweek(to_timestamp(start_timestamp) AT TIME ZONE 'UTC') IN (0, 6) weekend FROM ({PLACES_SQL})"""
_ATHOME, _ATWORK = "(weekend OR hour_of_day >= 22 OR hour_of_day < 7)", "(NOT weekend AND hour_of_day BETWEEN 8 AND 18)"
_HOME = f"""lo AS ({LOCAL_SQL}),
ca AS (SELECT caid, cluster_label l, count(DISTINCT date) nd, count(*) FILTER ({_ATHOME}) hv, count(DISTINCT date) FILTER ({_ATHOME}) hd, avg(cluster_latitude) FILTER ({_ATHOME}) hla, avg(cluster_longitude) FILTER ({_ATHOME}) hlo,
  count(*) FILTER ({_ATWORK}) wv, count(DISTINCT date) FILTER ({_ATWORK}) wd, avg(cluster_latitude) FILTER ({_ATWORK}) wla, avg(cluster_longitude) FILTER ({_ATWORK}) wlo FROM lo WHERE cluster_label >= 0 GROUP BY caid, cluster_label),
ho AS (SELECT * FROM (SELECT caid, l home_label, hla, hlo, hv, hd, row_number() OVER (PARTITION BY caid ORDER BY hv DESC, hd DESC, l) r FROM ca WHERE hv > 0 AND nd >= 7) WHERE r = 1)"""
_WORK = f"""wo AS (SELECT * FROM (SELECT ca.caid, l work_label, wla, wlo, wv, wd, row_number() OVER (PARTITION BY ca.caid ORDER BY wv DESC, wd DESC, l) r FROM ca JOIN ho ON ca.caid = ho.caid
  WHERE wv > 0 AND wd >= 4 AND l <> home_label AND {hav("ho.hla", "ho.hlo", "wla", "wlo")} >= 50e0) WHERE r = 1)"""
_TYPE = "CASE WHEN cluster_label = -1 THEN 0 WHEN cluster_label = home_label THEN 1 WHEN cluster_label = work_label THEN 2 ELSE 0 END"
LABELS_SQL = f"WITH {_HOME}, {_WORK} SELECT lo.*, home_label, hla, hlo, work_label, wla, wlo, CAST({_TYPE} AS INT) type FROM lo LEFT JOIN ho ON lo.caid = ho.caid LEFT JOIN wo ON lo.caid = wo.caid"
STAYS_SQL = f"""SELECT caid, CAST(stop_events AS BIGINT) h3_region_stay_id, start_timestamp stay_start, end_timestamp stay_end, stay_duration * 1000000 stay_duration,
  CAST({cell_sql("cluster_latitude", "cluster_longitude", RES)} AS VARCHAR) h3_id_region, lt local_time, upper(to_hex({cell_sql("cluster_latitude", "cluster_longitude", RES)})) h3_index,
  CAST(day_of_week AS INT) day_of_week, CAST(hour_of_day AS INT) hour_of_day,
  upper(to_hex({cell_sql("hla", "hlo", RES)})) home_h3_index, type, upper(to_hex({cell_sql("wla", "wlo", RES)})) work_h3_index, cluster_label, stop_latitude latitude, stop_longitude longitude,
  {cell_sql("cluster_latitude", "cluster_longitude", RES)} cell, {cell_sql("hla", "hlo", RES)} home_cell, {cell_sql("wla", "wlo", RES)} work_cell FROM ({LABELS_SQL})"""


# --- DataFrames of the pipeline ----------------------------------------------------------------


def _local(spark: SparkSession, d: str) -> DataFrame:
    return places.add_local_time(places.cluster_stops(stops.find_stops(pings(spark, d), **STOP)), "UTC")


def canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical stays with their cells as ids."""
    return _canonical(spark, d, "grid")


def _canonical(spark: SparkSession, d: str, system: str) -> DataFrame:
    s = places.canonical_stays(places.classify_home_work(_local(spark, d)), RES, system)
    return s.withColumns({"cell": F.col("h3_id_region").cast("bigint"), "home_cell": cells.from_hex(F.col("home_h3_index")), "work_cell": cells.from_hex(F.col("work_h3_index"))})


# --- scans and functions -----------------------------------------------------------------------

query(PINGS_SQL)(pings)


@query(f"SELECT * FROM ({PINGS_SQL}) WHERE utc_timestamp BETWEEN 1704067200 AND 1719791999 AND latitude BETWEEN 34.05 AND 34.2 AND longitude BETWEEN -118.4 AND -118.2")
def pings_window_box(spark, d):
    """Cast, time window and box reach the scan as pushed filters where the source is numeric."""
    return stops.clean_pings(pings(spark, d), None, "UNIX", 1704067200, 1719791999, (34.2, 34.05), (-118.4, -118.2))


@query(f"SELECT caid, latitude, longitude, utc_timestamp FROM ({PINGS_SQL})")
def pings_pattern(spark, d):
    """Renamed columns and a datetime pattern instead of UNIX seconds."""
    p = pings(spark, d).withColumn("when", F.date_format(F.timestamp_seconds("utc_timestamp"), "dd/MM/yyyy HH:mm:ss")).drop("utc_timestamp").withColumnRenamed("caid", "device")
    return stops.clean_pings(p, {"device": "caid", "when": "utc_timestamp", "absent": "latitude"}, "dd/MM/yyyy HH:mm:ss")


_HERE = "34.05e0, -118.25e0".split(", ")


@query(f"SELECT caid, utc_timestamp, latitude, longitude, round({hav('latitude', 'longitude', *_HERE)}, 3) m, round({hav('latitude', 'longitude', *_HERE, r=6371.0)}, 6) km FROM ({PINGS_SQL})")
def haversine_distances(spark, d):
    at = F.lit(34.05), F.lit(-118.25)
    m = geo.haversine(F.col("latitude"), F.col("longitude"), *at)
    km = geo.haversine(F.col("latitude"), F.col("longitude"), *at, radius=geo.R_ROUND_M / 1000)
    return pings(spark, d).select("caid", "utc_timestamp", "latitude", "longitude", F.round(m, 3).alias("m"), F.round(km, 6).alias("km"))


@query(f"SELECT caid, utc_timestamp, latitude, longitude, round(2 * 6371e0 * asin(sqrt(least(1e0, pow(sin((radians(34.05e0) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(34.05e0)) * pow(sin((radians(-118.25e0) - radians(longitude)) / 2), 2)))), 6) km FROM ({PINGS_SQL})")
def haversine_asin_km(spark, d):
    km = geo.haversine_asin(F.col("latitude"), F.col("longitude"), F.lit(34.05), F.lit(-118.25))
    return pings(spark, d).select("caid", "utc_timestamp", "latitude", "longitude", F.round(km, 6).alias("km"))


@query(f"WITH pq AS (SELECT row_number() OVER () n, * FROM ({PINGS_SQL})), {vincenty_sql('pq', 'n, caid, utc_timestamp, latitude, longitude', 'latitude', 'longitude', '34.05e0', '(-118.25e0)')} SELECT caid, utc_timestamp, latitude, longitude, round(km, 4) km FROM vd")
def geodesic_km(spark, d):
    """Vincenty distance on WGS-84, in Arrow batches."""

    @F.pandas_udf("double")
    def km(lat, lon):
        import pandas as pd

        return pd.Series(geo.np_geodesic_km(lat, lon, [34.05] * len(lat), [-118.25] * len(lat)))

    return pings(spark, d).select("caid", "utc_timestamp", "latitude", "longitude", F.round(km("latitude", "longitude"), 4).alias("km"))


_C10 = cell_sql("latitude", "longitude", 10)
_CEN = center_sql("c", 10)


@query(f"""SELECT caid, utc_timestamp, c cell, to_hex(c) hex, CAST(c AS VARCHAR) dec, CAST((c >> 52) & 15 AS INT) res, {parent_sql("c", 10, 6)} parent6, round({_CEN[0]}, 9) lat, round({_CEN[1]}, 9) lng
 FROM (SELECT DISTINCT *, {_C10} c FROM ({PINGS_SQL}))""".replace("to_hex(c) hex", "lower(to_hex(c)) hex"))
def cell_functions(spark, d):
    """Encodings, resolution, parent and centre of built-in cells."""
    c = cells.latlng_to_cell(F.col("latitude"), F.col("longitude"), 10)
    p = pings(spark, d).distinct().select("caid", "utc_timestamp", c.alias("cell"))
    at = cells.cell_to_latlng(F.col("cell"))
    return p.select(
        "caid", "utc_timestamp", "cell", cells.to_hex(F.col("cell")).alias("hex"), F.col("cell").cast("string").alias("dec"), cells.resolution(F.col("cell")).alias("res"),
        cells.parent(cells.from_hex(cells.to_hex(F.col("cell"))), 6).alias("parent6"), F.round(at["lat"], 9).alias("lat"), F.round(at["lng"], 9).alias("lng"),
    )


@query("SELECT row_id, CAST((h3_id_region >> 52) & 15 AS INT) res, (h3_id_region & ~(CAST(15 AS BIGINT) << 52)) | (CAST(5 AS BIGINT) << 52) | 1073741823 parent5 FROM stay_regions_filtered")
def h3_parents(spark, d):
    """Bit operations on H3-shaped ids."""
    c = F.col("h3_id_region")
    return spark.read.parquet(f"{d}/stay_regions_filtered.parquet").select("row_id", cells.resolution(c).alias("res"), cells.h3_parent(c, 5).alias("parent5"))


_VERT = "round(((c & 4503599627370495) // 16384) / 16384e0 * 180e0 - 90e0, 9) lat, round(((c & 4503599627370495) % 16384) / 16384e0 * 360e0 - 180e0, 9) lng"


# Positions and cells given in public descriptions of H3.
_H3_KNOWN = ((37.7752702151959, -122.418307270836, 9, "8928308280fffff"), (37.3615593, -122.0553238, 7, "87283472bffffff"), (40.689167, -74.044444, 10, "8a2a1072b59ffff"), (67.150926864, -168.390888581, 5, "850dab63fffffff"), (20.0, 123.0, 2, "824b9ffffffffff"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {r}, '{h}')" for a, b, r, h in _H3_KNOWN) + ") t(latitude, longitude, res, hex)")
def h3_known(spark, d):
    """Known cells, computed."""
    out = None
    for a, b, r, _ in _H3_KNOWN:
        one = spark.createDataFrame([(a, b, r)], "latitude double, longitude double, res int")
        one = one.withColumn("hex", cells.to_hex(cells.latlng_to_cell(F.col("latitude"), F.col("longitude"), r, "h3")))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT count(*) n, CAST(0 AS BIGINT) moved, CAST(0 AS BIGINT) far, CAST(0 AS BIGINT) orphans FROM (SELECT DISTINCT latitude, longitude FROM ({PINGS_SQL}))")
def h3_round_trip(spark, d):
    """Of all positions: cells whose centre lies in another cell, positions over 0.7 km from their cell's centre (resolution 8), and cells of resolution 10 whose parent at 8 is more than that from the position's own."""
    # The filter keeps every row, and keeps the grouping apart: Spark would else draw the Python functions into it, and pull them out again with a copy of both columns for each mention.
    p = pings(spark, d).groupBy("latitude", "longitude").count().where("count > 0").drop("count")
    c = p.withColumn("c", cells.latlng_to_cell(F.col("latitude"), F.col("longitude"), 8, "h3")).withColumn("f", cells.latlng_to_cell(F.col("latitude"), F.col("longitude"), 10, "h3"))
    c = c.withColumn("at", cells.cell_to_latlng(F.col("c"), "h3")).withColumn("up", cells.cell_to_latlng(cells.parent(F.col("f"), 8), "h3"))
    c = c.withColumn("again", cells.latlng_to_cell(F.col("at.lat"), F.col("at.lng"), 8, "h3"))
    km = lambda x: geo.haversine(F.col("latitude"), F.col("longitude"), F.col(f"{x}.lat"), F.col(f"{x}.lng")) / 1000
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("again") != F.col("c")).alias("moved"), F.count_if(km("at") > 0.7).alias("far"), F.count_if(km("up") > 0.8).alias("orphans"))


@query(f"SELECT DISTINCT c cell, {_VERT} FROM (SELECT {cell_sql('latitude', 'longitude', 8)} c FROM ({PINGS_SQL}))")
def cell_first_vertex(spark, d):
    p = pings(spark, d).select(cells.latlng_to_cell(F.col("latitude"), F.col("longitude"), 8).alias("cell")).distinct()
    v = cells.first_vertex(F.col("cell"))
    return p.select("cell", F.round(v["lat"], 9).alias("lat"), F.round(v["lng"], 9).alias("lng"))


_LT = "(to_timestamp(utc_timestamp) AT TIME ZONE 'America/Los_Angeles')"


@query(f"""SELECT caid, utc_timestamp, CAST(epoch({_LT}) AS BIGINT) local_s, strftime({_LT}, '%Y-%m-%d') date, CAST(hour({_LT}) AS INT) hour_of_day, CAST(dayofweek({_LT}) + 1 AS INT) day_of_week, dayofweek({_LT}) IN (0, 6) weekend,
 round(hour({_LT}) + minute({_LT}) / 60e0 + second({_LT}) / 3600e0, 9) fractional_hour FROM ({PINGS_SQL})""")
def local_time_fields(spark, d):
    p = places.add_local_time(pings(spark, d), "America/Los_Angeles", "utc_timestamp")
    return p.select("caid", "utc_timestamp", F.unix_timestamp("local_time").alias("local_s"), F.date_format("date", "yyyy-MM-dd").alias("date"), "hour_of_day", "day_of_week", "weekend", F.round(slots.fractional_hour(F.col("local_time")), 9).alias("fractional_hour"))


@query("""SELECT event_id, label, CASE lower(trim(label)) WHEN 'home' THEN 1 WHEN 'h' THEN 1 WHEN 'work' THEN 2 WHEN 'w' THEN 2 ELSE 0 END AS type, CASE lower(trim(label)) WHEN 'home' THEN 'h' WHEN 'h' THEN 'h' WHEN 'work' THEN 'w' WHEN 'w' THEN 'w' ELSE 'o' END purpose
 FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' Home' WHEN 1 THEN 'W' WHEN 2 THEN 'work ' WHEN 3 THEN 'h' WHEN 4 THEN 'Other' WHEN 5 THEN 'gym' END label FROM events)""")
def type_labels(spark, d):
    r = F.col("event_id") % 7
    label = F.when(r == 0, " Home").when(r == 1, "W").when(r == 2, "work ").when(r == 3, "h").when(r == 4, "Other").when(r == 5, "gym")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", label.alias("label")).withColumn("type", slots.type_to_int(F.col("label")))
    return e.withColumn("purpose", slots.purpose_letter(F.col("type")))


_LOC = "(t - CASE WHEN t < 1667552400 THEN 14400 ELSE 18000 END)"


@query(f"SELECT event_id, {_LOC} local_s, ({_LOC} % 86400) // 600 slot, ({_LOC} // 86400) % 7 dow, ({_LOC} // 600) * 600 slot_start FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) t FROM events)")
def slot_fields(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "unix_seconds(CAST(ts AS TIMESTAMP)) t")
    loc = slots.fixed_offset_local(F.col("t"))
    e = e.select("event_id", loc.alias("local_s"))
    return e.select("event_id", "local_s", slots.slot_of_day(F.col("local_s")).alias("slot"), slots.day_number(F.col("local_s")).alias("dow"), slots.slot_start(F.col("local_s")).alias("slot_start"))


@query("SELECT user_id, min(s) first_slot, max(s) last_slot FROM (SELECT user_id, s, s - row_number() OVER (PARTITION BY user_id ORDER BY s) g FROM (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) % 86400 // 600 s FROM events)) GROUP BY user_id, g")
def slot_ranges(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "unix_seconds(CAST(ts AS TIMESTAMP)) % 86400 div 600 slot")
    return slots.consecutive_ranges(e, "user_id", "slot")


@query(f"SELECT caid, utc_timestamp, latitude, longitude, round(pow(k, -2e0), 9) power_law, round(exp(-0.2e0 * k), 9) exponential, CAST(ceil(k) AS BIGINT) bin, round(log10(k + 1), 9) log_km FROM (SELECT *, {hav('latitude', 'longitude', '35e0', '-118e0', 6371.008)} k FROM ({PINGS_SQL}))")
def deterrence_values(spark, d):
    k = geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(35.0), F.lit(-118.0), geo.R_MEAN_M / 1000)
    p = pings(spark, d).withColumn("k", k)
    return p.select("caid", "utc_timestamp", "latitude", "longitude", F.round(slots.deterrence(F.col("k"), "power_law", -2.0), 9).alias("power_law"), F.round(slots.deterrence(F.col("k"), "exponential", 0.2), 9).alias("exponential"), F.ceil("k").alias("bin"), F.round(F.log10(F.col("k") + 1), 9).alias("log_km"))


# --- stops and places ---------------------------------------------------------------------------


@query(STOPS_SQL)
def stops_refined(spark, d):
    return stops.find_stops(pings(spark, d), **STOP)


QUERIES["stops"], SQL["stops"] = QUERIES.pop("stops_refined"), SQL.pop("stops_refined")


@query(UNREFINED_SQL)
def stops_unrefined(spark, d):
    return stops.find_stops(pings(spark, d), **STOP, refine=False)


_CL = {"cluster_latitude": 9, "cluster_longitude": 9}
_RCL = "SELECT * REPLACE (round(cluster_latitude, 9) AS cluster_latitude, round(cluster_longitude, 9) AS cluster_longitude) FROM"


@query(f"{_RCL} ({PLACES_SQL})")
def place_clusters(spark, d):
    return rounded(places.cluster_stops(stops.find_stops(pings(spark, d), **STOP)), **_CL)


@query(f"{_RCL} ({places_sql(3, 20.0)})")
def place_clusters_min3(spark, d):
    return rounded(places.cluster_stops(stops.find_stops(pings(spark, d), **STOP), 20.0, 3), **_CL)


@query(f"WITH {_HOME} SELECT caid, home_label, round(hla, 9) home_latitude, round(hlo, 9) home_longitude, hv home_time_visits, hd home_time_unique_days FROM ho")
def home_places(spark, d):
    return rounded(places.home_locations(_local(spark, d)), home_latitude=9, home_longitude=9)


@query(f"WITH {_HOME}, {_WORK} SELECT caid, work_label, round(wla, 9) work_latitude, round(wlo, 9) work_longitude, wv work_time_visits, wd work_time_unique_days FROM wo")
def work_places(spark, d):
    return rounded(places.work_locations(_local(spark, d)), work_latitude=9, work_longitude=9)


@query(f"SELECT caid, stop_events, cluster_label, CAST(coalesce(home_label, -9) AS INT) home_label, CAST(coalesce(work_label, -9) AS INT) work_label, type FROM ({LABELS_SQL})")
def stay_labels(spark, d):
    s = places.classify_home_work(_local(spark, d))
    return s.select("caid", "stop_events", "cluster_label", *[F.coalesce(c, F.lit(-9)).alias(c) for c in ("home_label", "work_label")], "type")


def _plain(s: DataFrame) -> DataFrame:
    times = {"stay_start_timestamp": "stay_start", "stay_end_timestamp": "stay_end"}
    s = s.withColumns({c: F.unix_timestamp(c) for c in times}).withColumn("local_time", F.unix_timestamp("local_time"))
    return s.withColumnsRenamed(times)


@query(f"SELECT * EXCLUDE (cell, home_cell, work_cell) FROM ({STAYS_SQL})")
def canonical_stays(spark, d):
    return _plain(canonical(spark, d).drop("cell", "home_cell", "work_cell"))


@query(f"SELECT * EXCLUDE (cell, home_cell, work_cell, home_h3_index, work_h3_index, type) FROM ({STAYS_SQL})")
def stay_points(spark, d):
    return _plain(places.stay_points(canonical(spark, d).drop("cell", "home_cell", "work_cell")))


# --- flows ----------------------------------------------------------------------------------------

P6 = parent_sql("cell", RES, 6)


@query(f"SELECT lower(to_hex({P6})) h3_index, {P6} cell, CAST(count(*) AS BIGINT) AS count FROM ({STAYS_SQL}) GROUP BY {P6}")
def stay_count_res6(spark, d):
    return flows.stay_count(canonical(spark, d), 6).drop("boundary")


def _od_sql(where: str = "") -> str:
    a, b = center_sql("o", 6), center_sql("p", 6)
    return f"""SELECT lower(to_hex(o)) origin, lower(to_hex(p)) destination, CAST(count(*) AS BIGINT) flow, round({hav(a[0], a[1], b[0], b[1], 6371.0)}, 6) distance
 FROM (SELECT lag({P6}) OVER (PARTITION BY caid ORDER BY local_time, cell) o, {P6} p FROM ({STAYS_SQL})) WHERE o IS NOT NULL {where} GROUP BY o, p"""


@query(_od_sql())
def od_flow(spark, d):
    return rounded(flows.od_flow(canonical(spark, d), 6), distance=6)


@query(_od_sql("AND o <> p"))
def od_flow_moves(spark, d):
    return rounded(flows.od_flow(canonical(spark, d), 6, include_self=False), distance=6)


@query(f"SELECT CAST(count(*) AS BIGINT) flow, CAST((SELECT count(*) FROM ({STAYS_SQL})) AS BIGINT) stays, CAST(0 AS BIGINT) lost FROM (SELECT lead(cell) OVER (PARTITION BY caid ORDER BY local_time, cell) p FROM ({STAYS_SQL})) WHERE p IS NOT NULL")
def h3_flow_totals(spark, d):
    """Stays and flows on H3 cells: none is lost, and every flow has a distance."""
    s = cut_lineage(_canonical(spark, d, "h3"))
    f, n = flows.od_flow(s, 6, system="h3"), flows.stay_count(s, 6, system="h3")
    f = f.agg(F.sum("flow").alias("flow"), F.count_if(F.col("distance").isNull()).alias("lost"))
    return f.join(F.broadcast(n.agg(F.sum("count").alias("stays")))).select("flow", "stays", "lost")


def _hw_count_sql(c: str) -> str:
    return f"SELECT lower(to_hex({parent_sql('h', RES, 6)})) h3_index, CAST(count(*) AS BIGINT) AS count FROM (SELECT caid, min({c}) h FROM ({STAYS_SQL}) GROUP BY caid) WHERE h IS NOT NULL GROUP BY {parent_sql('h', RES, 6)}"


@query(_hw_count_sql("home_cell"))
def home_counts(spark, d):
    return flows.location_counts(canonical(spark, d), "home_h3_index", 6)


@query(_hw_count_sql("work_cell"))
def work_counts(spark, d):
    return flows.location_counts(canonical(spark, d), "work_h3_index", 6)


_C6 = center_sql(parent_sql("cell", RES, 6), 6)


@query(f"SELECT {P6} cell, CAST(count(*) AS BIGINT) AS count, round(log10(count(*)), 9) log_count, round({_C6[0]}, 9) latitude, round({_C6[1]}, 9) longitude FROM ({STAYS_SQL}) GROUP BY {P6}")
def count_map(spark, d):
    c = canonical(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("count"))
    return rounded(flows.count_map(c, 6), log_count=9, latitude=9, longitude=9)


@query(f"SELECT lower(to_hex({parent_sql('home_cell', RES, 6)})) origin, lower(to_hex({parent_sql('work_cell', RES, 6)})) destination, CAST(count(*) AS BIGINT) flow FROM (SELECT DISTINCT caid, home_cell, work_cell FROM ({STAYS_SQL})) WHERE home_cell IS NOT NULL AND work_cell IS NOT NULL GROUP BY {parent_sql('home_cell', RES, 6)}, {parent_sql('work_cell', RES, 6)}")
def home_work_od(spark, d):
    return flows.home_work_flow(canonical(spark, d).select("caid", "home_cell", "work_cell").distinct(), 6)


_FL = f"fl AS ({_od_sql()}), mx AS (SELECT max(flow) m FROM fl WHERE origin <> destination), ed AS (SELECT origin, destination, flow, least(greatest(flow / m * 5e0, 0.1e0), 3e0) thickness FROM fl, mx WHERE flow > 0.02 AND origin <> destination)"


@query(f"WITH {_FL} SELECT origin, destination, flow, round(thickness, 9) thickness FROM ed")
def flow_map_edges(spark, d):
    return rounded(flows.flow_map(flows.od_flow(canonical(spark, d), 6))[0], thickness=9)


@query(f"WITH {_FL}, nd AS (SELECT node, sum(thickness) weight FROM (SELECT origin node, thickness FROM ed UNION ALL SELECT destination, thickness FROM ed) GROUP BY node) SELECT node, round(weight, 6) weight, round(CASE WHEN weight > 0.1 THEN weight / ((SELECT max(weight) FROM nd) / 30e0) END, 6) radius FROM nd")
def flow_map_nodes(spark, d):
    return rounded(flows.flow_map(flows.od_flow(canonical(spark, d), 6))[1], weight=6, radius=6)


@query(f"SELECT caid, CAST(count(*) AS BIGINT) n_points, arg_min(latitude, local_time) first_lat, arg_max(longitude, local_time) last_lng FROM ({STAYS_SQL}) GROUP BY caid")
def trajectory_ends(spark, d):
    t = flows.trajectories(canonical(spark, d))
    return t.select("caid", F.size("path").cast("bigint").alias("n_points"), F.element_at("path", 1)["lat"].alias("first_lat"), F.element_at("path", -1)["lng"].alias("last_lng"))


# --- user selection ---------------------------------------------------------------------------------

_SUM = f"(SELECT caid, CAST(count(*) AS BIGINT) num_stays, CAST(round((max(stay_end) - min(stay_start)) / 86400e0) AS INT) duration_days FROM ({STAYS_SQL}) GROUP BY caid)"
_RANGE = ((3, 20), (5, 400))
_IN = "num_stays BETWEEN 3 AND 20 AND duration_days BETWEEN 5 AND 400"


@query(f"SELECT * FROM {_SUM}")
def user_summary(spark, d):
    return flows.user_summary(canonical(spark, d)).select("caid", "num_stays", "duration_days")


@query(f"SELECT duration_days, num_stays, CAST(count(*) AS BIGINT) AS count FROM {_SUM} GROUP BY duration_days, num_stays")
def activity_grid(spark, d):
    return flows.activity_grid(flows.user_summary(canonical(spark, d)))


@query(f"SELECT duration_days, num_stays, CAST(count(*) AS BIGINT) AS count, round(log10(count(*) + 1), 9) log_count FROM {_SUM} GROUP BY duration_days, num_stays")
def activity_heatmap(spark, d):
    return rounded(flows.activity_heatmap(flows.activity_grid(flows.user_summary(canonical(spark, d)))), log_count=9)


@query(f"SELECT caid, h3_region_stay_id, stay_start FROM ({STAYS_SQL}) WHERE caid IN (SELECT caid FROM {_SUM} WHERE {_IN})")
def filtered_users(spark, d):
    return _plain(flows.filter_users(canonical(spark, d), *_RANGE)).select("caid", "h3_region_stay_id", "stay_start")


@query(f"SELECT CAST(count(*) AS BIGINT) num_total_users, CAST(count(*) FILTER ({_IN}) AS BIGINT) num_filtered_users FROM {_SUM}")
def user_totals(spark, d):
    return flows.user_totals(flows.user_summary(canonical(spark, d)), *_RANGE)


# --- grid detector and distributions ----------------------------------------------------------------

GRID = {"delta_t": 43_200, "spatial_threshold": 300.0}
_GW = "OVER (PARTITION BY caid ORDER BY t, la, lo)"
_SEG = f"""q AS (SELECT DISTINCT caid, latitude la, longitude lo, utc_timestamp t FROM ({PINGS_SQL})),
sg AS (SELECT *, sum(b) OVER (PARTITION BY caid ORDER BY t, la, lo ROWS UNBOUNDED PRECEDING) seg FROM (SELECT *, CASE WHEN coalesce(t - lag(t) {_GW} > 43200, true) THEN 1 ELSE 0 END b,
  coalesce({hav("lag(la) " + _GW, "lag(lo) " + _GW, "la", "lo")} > 6e0 * (t - lag(t) {_GW}), false) pass FROM q))"""


@query(f"WITH {_SEG} SELECT caid, la latitude, lo longitude, t utc_timestamp, pass is_passing, CAST(seg AS BIGINT) segment FROM sg")
def grid_segments(spark, d):
    return grid.segments(pings(spark, d), GRID["delta_t"])


@query(f"WITH {_SEG}, kp AS (SELECT caid, la, lo, t, coalesce(t - lag(t) OVER (PARTITION BY caid ORDER BY t, la, lo) > 43200, true) b FROM sg WHERE NOT pass) SELECT caid, la latitude, lo longitude, t utc_timestamp, false is_passing, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY caid ORDER BY t, la, lo ROWS UNBOUNDED PRECEDING) AS BIGINT) segment FROM kp")
def grid_segments_standing(spark, d):
    """Without the pings that pass."""
    return grid.segments(pings(spark, d), GRID["delta_t"], passing=False)


def _means(df: DataFrame) -> DataFrame:
    """Means of a few six-digit numbers often end in a 5, so they are moved a little before rounding; the SQL does the same."""
    return df.withColumns({c: F.round(F.col(c) + 3.3e-10, 8) for c in ("latitude", "longitude")})


_FOLD = f"""WITH RECURSIVE {_SEG}, nn AS (SELECT *, row_number() OVER (PARTITION BY caid, seg ORDER BY t, la, lo) i FROM sg),
fo AS (SELECT caid, seg, i, 1 g, t t0, t t1, la mla, lo mlo, 1 n FROM nn WHERE i = 1
 UNION ALL SELECT nn.caid, nn.seg, nn.i, CASE WHEN near THEN g ELSE g + 1 END, CASE WHEN near THEN t0 ELSE t END, t, CASE WHEN near THEN (mla * n + la) / (n + 1) ELSE la END, CASE WHEN near THEN (mlo * n + lo) / (n + 1) ELSE lo END, CASE WHEN near THEN n + 1 ELSE 1 END
 FROM (SELECT nn.*, fo.g, fo.t0, fo.mla, fo.mlo, fo.n, {hav("fo.mla", "fo.mlo", "nn.la", "nn.lo")} <= 300e0 near FROM fo JOIN nn ON fo.caid = nn.caid AND fo.seg = nn.seg AND nn.i = fo.i + 1) nn),
sc AS (SELECT caid, seg, g, min(t0) t0, max(t1) t1, arg_max(mla, i) la, arg_max(mlo, i) lo, max(n) n FROM fo GROUP BY caid, seg, g)"""
_GRIDSTAYS = f"""{_FOLD}, lg AS (SELECT *, {cell_sql("la", "lo", RES)} cell FROM sc WHERE t1 - t0 >= 300),
rn AS (SELECT *, CASE WHEN coalesce(lag(cell) OVER u <> cell OR t0 - lag(t1) OVER u > 3600, true) THEN 1 ELSE 0 END b FROM lg WINDOW u AS (PARTITION BY caid ORDER BY t0, t1)),
rr AS (SELECT *, sum(b) OVER (PARTITION BY caid ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) k FROM rn),
gs AS (SELECT caid, CAST(k AS BIGINT) stay_id, min(t0) start_timestamp, max(t1) end_timestamp, min(cell) cell, sum(la * n) / sum(n) latitude, sum(lo * n) / sum(n) longitude, CAST(sum(n) AS BIGINT) n_pings FROM rr GROUP BY caid, k)"""


@query(f"{_FOLD} SELECT caid, t0 start_timestamp, t1 end_timestamp, round(la + 3.3e-10, 8) latitude, round(lo + 3.3e-10, 8) longitude, CAST(n AS BIGINT) n_pings FROM sc")
def sequential_centroids(spark, d):
    return _means(grid.sequential_centroids(grid.segments(pings(spark, d), GRID["delta_t"]), 300.0))


@query(f"{_GRIDSTAYS} SELECT * REPLACE (round(latitude + 3.3e-10, 8) AS latitude, round(longitude + 3.3e-10, 8) AS longitude) FROM gs")
def grid_stays(spark, d):
    return _means(grid.grid_stays(pings(spark, d), **GRID))


def _grid_local(spark, d):
    return places.add_local_time(grid.grid_stays(pings(spark, d), **GRID), "UTC")


_HC, _CC = center_sql("home_cell", RES), center_sql("cell", RES)


@query(f"""{_GRIDSTAYS}, lt AS (SELECT caid, cell, (start_timestamp % 86400) // 3600 h, (start_timestamp // 86400 + 4) % 7 IN (0, 6) we FROM gs),
cn AS (SELECT caid, cell, count(*) FILTER (h >= 19 OR h < 8 OR we) nh, count(*) FILTER (NOT (h >= 19 OR h < 8 OR we)) nw FROM lt GROUP BY caid, cell),
hm AS (SELECT caid, cell home_cell FROM (SELECT *, row_number() OVER (PARTITION BY caid ORDER BY nh DESC, cell) r FROM cn WHERE nh > 0) WHERE r = 1),
wk AS (SELECT caid, cell work_cell FROM (SELECT *, row_number() OVER (PARTITION BY caid ORDER BY round(nw * m, 3) DESC, cell) r FROM (SELECT cn.*, {hav(_HC[0], _HC[1], _CC[0], _CC[1])} m, home_cell FROM cn JOIN hm ON cn.caid = hm.caid) WHERE nw >= 3 AND m >= 500 AND cell <> home_cell) WHERE r = 1)
SELECT hm.caid, lower(to_hex(home_cell)) home_cell, lower(to_hex(work_cell)) work_cell FROM hm LEFT JOIN wk ON hm.caid = wk.caid""")
def grid_home_work(spark, d):
    g = grid.grid_home_work(_grid_local(spark, d))
    return g.withColumns({c: cells.to_hex(F.col(c)) for c in ("home_cell", "work_cell")})


@query(f'SELECT CAST(range AS INT) AS "range", round(n / sum(n) OVER (), 9) probability FROM (SELECT stay_duration // 3600000000 AS range, count(*) n FROM ({STAYS_SQL}) WHERE stay_duration // 3600000000 < 24 GROUP BY 1)')
def stay_duration_distribution(spark, d):
    return rounded(flows.duration_distribution(canonical(spark, d)), probability=9)


@query(f"SELECT locations, round(n / sum(n) OVER (), 9) probability FROM (SELECT locations, count(*) n FROM (SELECT caid, local_time // 86400 dy, count(DISTINCT cell) locations FROM ({STAYS_SQL}) GROUP BY 1, 2) GROUP BY 1)")
def daily_visited_locations(spark, d):
    return rounded(flows.daily_locations_distribution(canonical(spark, d)), probability=9)


@query(f"SELECT CAST(h AS INT) hour_of_day, round(n / sum(n) OVER (), 9) probability FROM (SELECT hour(to_timestamp(stay_end) AT TIME ZONE 'America/New_York') h, count(*) n FROM ({STAYS_SQL}) GROUP BY 1)")
def departure_time_distribution(spark, d):
    return rounded(flows.departure_distribution(canonical(spark, d), "America/New_York"), probability=9)


# --- tessellation and transitions ---------------------------------------------------------------------

_TC = center_sql("cell", RES)


@query(f"SELECT cell, CAST(count(*) AS BIGINT) stay_count, round({_TC[0]}, 9) latitude, round({_TC[1]}, 9) longitude FROM ({STAYS_SQL}) GROUP BY cell")
def tessellation(spark, d):
    return rounded(flows.tessellation(canonical(spark, d)).drop("boundary"), latitude=9, longitude=9)


_TR = f"""tl AS (SELECT DISTINCT cell FROM ({STAYS_SQL}) WHERE cell IS NOT NULL), ct AS (SELECT o origin, p destination, CAST(count(*) AS BIGINT) n FROM (SELECT cell o, lead(cell) OVER (PARTITION BY caid ORDER BY local_time, cell) p FROM ({STAYS_SQL}))
 WHERE o <> p AND o IN (SELECT cell FROM tl) AND p IN (SELECT cell FROM tl) GROUP BY o, p),
mt AS (SELECT origin, destination, n / sum(n) OVER (PARTITION BY origin) p FROM ct), nt AS (SELECT count(*) k FROM tl)"""


def _tiles(spark, d):
    s = canonical(spark, d)
    return s, flows.tessellation(s)


@query(f"WITH {_TR} SELECT * FROM ct")
def epr_transition_counts(spark, d):
    return flows.transition_counts(*_tiles(spark, d))


@query(f"WITH {_TR} SELECT origin, destination, round(p, 9) p FROM mt")
def epr_od_matrix(spark, d):
    return rounded(flows.transition_matrix(flows.transition_counts(*_tiles(spark, d))), p=9)


@query(f"WITH {_TR} SELECT cell origin, round(1e0 / (k - 1), 12) p FROM tl, nt WHERE cell NOT IN (SELECT origin FROM ct)")
def epr_idle_cells(spark, d):
    s, t = _tiles(spark, d)
    return rounded(flows.idle_cells(flows.transition_counts(s, t), t), p=12)


@query(f"WITH {_TR} SELECT (SELECT k FROM nt) num_locations, (SELECT count(DISTINCT caid) FROM ({STAYS_SQL})) num_users, CAST((SELECT sum(n) FROM ct) AS BIGINT) num_transitions")
def epr_fit_stats(spark, d):
    s, t = _tiles(spark, d)
    users = s.agg(F.countDistinct("caid").alias("num_users"))
    n = flows.transition_counts(s, t).agg(F.sum("n").alias("num_transitions"))
    return t.agg(F.count(F.lit(1)).alias("num_locations")).join(F.broadcast(users)).join(F.broadcast(n))
