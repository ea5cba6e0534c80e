"""Queries p1, p4, p5 and p6 over the project's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import normalize_timestamps
from ..operators.skew import aggregate_by_key
from ..operators.spatial import near_pairs, points_in_regions
from ..operators.trips import detect_stops, trips_between
from ..session import write_table


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pings(spark: SparkSession, d: str) -> DataFrame:
    return normalize_timestamps(table(spark, d, "raw_pings"), table(spark, d, "mobility_dataset"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pings(spark, d).where("ts_status = 'ok' and ts_form <> 'seconds'").select("ping_id", "utc_us")


def p1_status(spark: SparkSession, d: str) -> DataFrame:
    """Readings by dataset, form and outcome."""
    return _pings(spark, d).groupBy("dataset_id", "ts_form", "ts_status").agg(F.count(F.lit(1)).alias("n"))


def p4_stops(spark: SparkSession, d: str) -> DataFrame:
    return detect_stops(_pings(spark, d), extent_m=50.0, min_s=300.0, max_silence_s=3600.0, slack=2)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_stops(spark, d).select("caid", "first_ping_id", "last_ping_id")


def p4_trips(spark: SparkSession, d: str) -> DataFrame:
    return trips_between(p4_stops(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    counts = aggregate_by_key(table(spark, d, "raw_pings"), "caid", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, share=0.02, salt_on="ping_id")
    return counts.where("heavy").select("caid")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per caid: rows, first and last ping by arrival, and whether it is one of the keys that hold most rows."""
    count = F.count(F.lit(1))
    return aggregate_by_key(
        table(spark, d, "raw_pings"), "caid",
        {"n": count, "lo": F.min("ping_id"), "hi": F.max("ping_id"), "t0": F.min(F.unix_micros("ingested_at")), "t1": F.max(F.unix_micros("ingested_at"))},
        {"n_pings": F.sum("n"), "first_ping_id": F.min("lo"), "last_ping_id": F.max("hi"), "first_arrival_us": F.min("t0"), "last_arrival_us": F.max("t1")},
        salt_on="ping_id",
    )


def p5_per_caid(spark: SparkSession, d: str) -> DataFrame:
    """Per caid: rows, first and last resolved instant, and stops."""
    pings = write_table(_pings(spark, d).select("caid", "ping_id", "latitude", "longitude", "utc_us"))
    seen = aggregate_by_key(pings, "caid", {"n": F.count(F.lit(1)), "lo": F.min("utc_us"), "hi": F.max("utc_us")}, {"n_pings": F.sum("n"), "first_us": F.min("lo"), "last_us": F.max("hi")}, salt_on="ping_id")
    stops = detect_stops(pings).groupBy("caid").agg(F.count(F.lit(1)).alias("n_stops"))
    return seen.join(stops, "caid", "left").withColumn("n_stops", F.coalesce("n_stops", F.lit(0).cast("bigint")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    places = [("stop_latitude", "stop_longitude"), ("cluster_latitude", "cluster_longitude")]
    return near_pairs(table(spark, d, "cluster_stay_detection"), "stop_id", places, 50.0, "caid").toDF("stop_id_a", "stop_id_b")


def p6_regions(spark: SparkSession, d: str) -> DataFrame:
    """Pings inside each dataset's box, whichever dataset they came from."""
    ring = F.array(*[F.struct(F.col(f"longitude_{x}").alias("lng"), F.col(f"latitude_{y}").alias("lat")) for x, y in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"))])
    boxes = table(spark, d, "mobility_dataset").where("longitude_min is not null and latitude_min is not null").select(F.col("dataset_id").alias("region_id"), ring.alias("ring"))
    inside = points_in_regions(table(spark, d, "raw_pings"), "ping_id", "latitude", "longitude", boxes)
    return inside.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_pings"))


QUERIES = {f.__name__: f for f in (p1_found, p1_status, p4_found, p4_stops, p4_trips, p5_found, p5_counts, p5_per_caid, p6_found, p6_regions)}

_NEAR = """
WITH s AS (SELECT stop_id, caid, radians(stop_latitude) a, radians(stop_longitude) b, radians(cluster_latitude) c, radians(cluster_longitude) e FROM cluster_stay_detection
  WHERE stop_latitude IS NOT NULL AND stop_longitude IS NOT NULL AND cluster_latitude IS NOT NULL AND cluster_longitude IS NOT NULL),
v AS (SELECT stop_id, caid, cos(a)*cos(b) x, cos(a)*sin(b) y, sin(a) z, cos(c)*cos(e) x2, cos(c)*sin(e) y2, sin(c) z2 FROM s),
g AS (SELECT *, floor(x*1e5) gx, floor(y*1e5) gy, floor(z*1e5) gz FROM v),
o(d) AS (VALUES (-1), (0), (1)),
n AS (SELECT g.* EXCLUDE (gx, gy, gz), gx + p.d gx, gy + q.d gy, gz + r.d gz FROM g, o p, o q, o r)
SELECT g.stop_id stop_id_a, n.stop_id stop_id_b FROM g JOIN n ON g.gx = n.gx AND g.gy = n.gy AND g.gz = n.gz
WHERE g.stop_id < n.stop_id AND g.caid <> n.caid
  AND sqrt((g.x-n.x)**2 + (g.y-n.y)**2 + (g.z-n.z)**2) <= 2*sin(50/2/6371008.0)
  AND sqrt((g.x2-n.x2)**2 + (g.y2-n.y2)**2 + (g.z2-n.z2)**2) <= 2*sin(50/2/6371008.0)
"""



def _abbreviations() -> str:
    """(zone, abbr, off) of every zone's alphabetic abbreviations since 1970 that had one offset there."""
    import zoneinfo

    from ..functions.timestamps import _zone_info

    return ", ".join(f"('{z}', '{a}', {o})" for z in sorted(zoneinfo.available_timezones()) if "/" in z and not z.startswith(("Etc/", "posix/", "right/", "SystemV/")) for a, o in sorted(_zone_info(z)[1].items()))


_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_Z = r" ?(Z|[A-Z]{2,5}|[+-]\d{2}:?\d{2})?"
# (pattern, names of its groups), tried in this order.
_FORMS = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T}{_Z}(?:\[([A-Z0-9_/+-]+)\])?$", "y m d h mi s f z r"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_Z}$", "y m d h mi s f z"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "y m d h mi s"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_T}(?: (AM|PM))?{_Z}$", "m d y h mi s f ap z"),
    (rf"^(?:[A-Z]{{3}}, ?)?(\d{{1,2}})[- ]([A-Z]{{3}})[- ](\d{{4}}) {_T}(?: (AM|PM))?{_Z}$", "d m y h mi s f ap z"),
)


def _form(n: int) -> str:
    pattern, names = _FORMS[n]
    got = f"regexp_extract(u, '{pattern}', [{', '.join(repr(x) for x in names.split())}])"
    parts = ", ".join(f"{k} := " + (f"({got}).{k}" if k in names.split() else "''") for k in "y m d h mi s f ap z r".split())
    return f"WHEN regexp_matches(u, '{pattern}') THEN struct_pack(n := {n}, {parts})"


def _off(t: str) -> str:
    """Offset in micros of ``zone`` at the instant ``t`` in micros."""
    return f"(CASE WHEN fixed IS NOT NULL THEN fixed WHEN zone IS NOT NULL THEN epoch_us(timezone(zone, make_timestamptz({t}))) - ({t}) END)"


def clocks_sql() -> str:
    """CTEs ending in ``ts``: ping_id, dataset_id, ts_form, ts_status and utc_us of every raw ping."""
    num = lambda k: f"coalesce(try_cast(nullif(p.{k}, '') AS INT), 0)"
    return f"""ab(zone, abbr, off) AS (VALUES {_abbreviations()}),
md AS (SELECT dataset_id, trim(time_zone) tz, CASE WHEN regexp_matches(trim(time_format), '^''?d') THEN 'D' WHEN regexp_matches(trim(time_format), '^''?M') THEN 'M' END ord FROM mobility_dataset),
lk AS (SELECT dataset_id, ord, n.name zone, CASE WHEN n.name IS NULL AND regexp_matches(tz, '^(?:UTC|GMT)?\\s*[+-]\\d{{1,2}}:?(?:\\d{{2}})?$', 'i') THEN
  (CASE WHEN tz LIKE '%-%' THEN -1 ELSE 1 END) * (CAST(regexp_extract(tz, '[+-](\\d{{1,2}})', 1) AS BIGINT) * 60 + coalesce(try_cast(nullif(regexp_extract(tz, '[+-]\\d{{1,2}}:?(\\d{{2}})$', 1), '') AS BIGINT), 0)) * 60000000 END fixed
  FROM md LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names() WHERE name LIKE '%/%' OR name IN ('UTC', 'GMT')) n ON lower(n.name) = lower(replace(tz, ' ', '_'))),
ra AS (SELECT ping_id, r.dataset_id, upper(regexp_replace(utc_timestamp, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')) u, zone, fixed, ord FROM raw_pings r LEFT JOIN lk ON lk.dataset_id = r.dataset_id),
pa AS (SELECT *, CASE {' '.join(_form(n) for n in range(5))} END p FROM ra),
fi AS (SELECT *, {num('y')} y, {num('d')} dd, try_cast(p.m AS INT) mm, {num('h')} h0, {num('mi')} mi, {num('s')} s, CASE WHEN p.f = '' THEN 0 ELSE CAST(rpad(substr(p.f, 1, 6), 6, '0') AS INT) END us,
  list_position(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'], p.m) mn FROM pa),
sw AS (SELECT *, p.n = 3 AND mm <= 12 AND dd <= 12 AND mm <> dd AND ord IS NULL unsure, CASE WHEN p.n = 3 AND ((mm > 12 AND dd <= 12) OR (mm <= 12 AND dd <= 12 AND mm <> dd AND ord = 'D')) THEN dd WHEN p.n = 4 THEN mn ELSE mm END mo,
  CASE WHEN p.n = 3 AND ((mm > 12 AND dd <= 12) OR (mm <= 12 AND dd <= 12 AND mm <> dd AND ord = 'D')) THEN mm ELSE dd END da, CASE WHEN p.ap = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN p.ap = 'PM' THEN 12 ELSE 0 END END h FROM fi),
wa AS (SELECT *, CASE WHEN h BETWEEN 0 AND 23 AND mi < 60 AND s < 60 AND y >= 1 THEN epoch_us(try_cast(printf('%04d-%02d-%02d', y, mo, da) AS DATE)::TIMESTAMP) + ((h * 60 + mi) * 60 + s) * 1000000::BIGINT + us END wall FROM sw),
gi AS (SELECT wa.*, CASE WHEN p.z IN ('Z', 'UTC', 'GMT', 'UT') THEN 0 WHEN p.z LIKE '+%' OR p.z LIKE '-%' THEN (CASE WHEN p.z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(replace(p.z, ':', ''), 2, 2) AS BIGINT) * 60 + CAST(substr(replace(p.z, ':', ''), 4, 2) AS BIGINT)) * 60000000
  WHEN p.z <> '' THEN ab.off::BIGINT * 1000000 END given FROM wa LEFT JOIN ab ON ab.zone = wa.zone AND ab.abbr = wa.p.z),
lo AS (SELECT *, p.z = '' AND wall IS NOT NULL AND (p.r = '' OR p.r = upper(zone)) AND (zone IS NOT NULL OR fixed IS NOT NULL) bare FROM gi),
of AS (SELECT *, CASE WHEN bare THEN {_off('wall - 86400000000')} END o1, CASE WHEN bare THEN {_off('wall + 86400000000')} END o2 FROM lo),
cl AS (SELECT *, CASE WHEN bare THEN o1 = o2 OR {_off('wall - o1')} = o1 END v1, CASE WHEN bare THEN o1 <> o2 AND {_off('wall - o2')} = o2 END v2 FROM of),
nu AS (SELECT *, CASE WHEN regexp_matches(u, '^-?\\d+$') AND length(ltrim(u, '-')) <> 14 AND length(ltrim(u, '-')) <= 19 THEN try_cast(u AS BIGINT) END v, length(ltrim(u, '-')) n,
  CASE WHEN regexp_matches(u, '^-?(\\d{{1,11}}\\.\\d+|\\d\\.\\d+E\\+?\\d{{1,2}})$') THEN CASE WHEN u LIKE '%E%' THEN CASE WHEN (6 + CAST(replace(regexp_extract(u, 'E(.+)$', 1), '+', '') AS INT)) >= length(regexp_extract(u, '[.]([0-9]+)E', 1)) THEN CAST(CAST(replace(regexp_extract(u, '^([^E]+)E', 1), '.', '') AS HUGEINT) * CAST(pow(10, (6 + CAST(replace(regexp_extract(u, 'E(.+)$', 1), '+', '') AS INT)) - length(regexp_extract(u, '[.]([0-9]+)E', 1))) AS BIGINT) AS BIGINT) ELSE CAST(CAST(replace(regexp_extract(u, '^([^E]+)E', 1), '.', '') AS HUGEINT) // CAST(pow(10, length(regexp_extract(u, '[.]([0-9]+)E', 1)) - (6 + CAST(replace(regexp_extract(u, 'E(.+)$', 1), '+', '') AS INT))) AS BIGINT) AS BIGINT) END ELSE CAST(floor(CAST(u AS DECIMAL(24, 9)) * 1000000) AS BIGINT) END END dc FROM cl),
ut AS (SELECT *, CASE WHEN p IS NULL THEN coalesce(CASE WHEN n <= 11 THEN v * 1000000 WHEN n <= 13 THEN v * 1000 WHEN n IN (15, 16) THEN v WHEN n IN (18, 19) THEN v // 1000 END, dc) WHEN unsure THEN NULL WHEN p.z <> '' THEN wall - given WHEN v1 AND v2 THEN NULL WHEN v1 THEN wall - o1 WHEN v2 THEN wall - o2 END utc_us FROM nu),
ts AS (SELECT ping_id, dataset_id, utc_us, CASE WHEN p IS NULL THEN CASE WHEN regexp_matches(u, '^\\d{{10}}$') THEN 'seconds' WHEN v IS NOT NULL OR (regexp_matches(u, '^-?\\d+$') AND n <> 14 AND n <= 19) THEN 'count' WHEN dc IS NOT NULL THEN 'decimal' ELSE 'none' END WHEN p.z <> '' THEN 'offset' ELSE 'wall' END ts_form,
  CASE WHEN u IS NULL OR u = '' THEN 'missing' WHEN utc_us IS NOT NULL THEN 'ok' WHEN p IS NULL OR wall IS NULL OR p.z <> '' THEN 'invalid' WHEN unsure THEN 'day_or_month' WHEN NOT bare THEN 'no_zone' WHEN v1 AND v2 THEN 'ambiguous' WHEN NOT v1 AND NOT v2 THEN 'nonexistent' ELSE 'invalid' END ts_status FROM ut)"""


_SQL = {
    "p5_found": "SELECT caid FROM raw_pings WHERE caid IS NOT NULL GROUP BY caid HAVING count(*) >= 0.02 * (SELECT count(*) FROM raw_pings)",
    "p5_counts": """SELECT caid, CAST(count(*) AS BIGINT) n_pings, min(ping_id) first_ping_id, max(ping_id) last_ping_id, min(epoch_us(ingested_at)) first_arrival_us, max(epoch_us(ingested_at)) last_arrival_us,
        caid IS NOT NULL AND count(*) >= 0.02 * (SELECT count(*) FROM raw_pings) heavy FROM raw_pings GROUP BY caid""",
    "p6_found": _NEAR,
    "p6_regions": """SELECT d.dataset_id region_id, CAST(count(*) AS BIGINT) n_pings FROM raw_pings r, mobility_dataset d
        WHERE NOT isnan(r.latitude) AND NOT isnan(r.longitude) AND r.longitude >= d.longitude_min AND r.longitude < d.longitude_max AND r.latitude >= d.latitude_min AND r.latitude < d.latitude_max
        GROUP BY d.dataset_id""",
}


def __getattr__(name: str):
    """``SQL``, made when it is asked for: the list of abbreviations takes a few seconds."""
    if name != "SQL":
        raise AttributeError(name)
    ts = clocks_sql()
    return _SQL | {
        "p1_found": f"WITH {ts} SELECT ping_id, utc_us FROM ts WHERE ts_status = 'ok' AND ts_form <> 'seconds'",
        "p1_status": f"WITH {ts} SELECT dataset_id, ts_form, ts_status, CAST(count(*) AS BIGINT) n FROM ts GROUP BY 1, 2, 3",
    }
