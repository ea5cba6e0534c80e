"""Deterministic inputs derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "CASE WHEN hh >= 20 OR hh < 9 OR dw IN (0, 6) THEN 0 WHEN hh < 17 THEN 1 ELSE 2 + event_id % 5 END"
_LAT = "34e0 + (user_id % 40) * 1e-2 + place * 4e-3 + ((event_id * 7919) % 101 - 50) * 1e-6"
_LON = "-118.4e0 + (user_id % 37) * 1e-2 + place * 5e-3 + ((event_id * 104729) % 103 - 51) * 1e-6"
_HH, _DW = "CAST((t % 86400 - t % 3600) / 3600 AS BIGINT)", "CAST((t - t % 86400) / 86400 + 4 AS BIGINT) % 7"


def pings(spark: SparkSession, d: str) -> DataFrame:
    """caid, latitude, longitude, utc_timestamp made from the event table: home at night and on weekends, work by day, five other places."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "user_id", "unix_seconds(CAST(ts AS TIMESTAMP)) t")
    e = e.selectExpr("*", f"{_HH} hh", f"{_DW} dw").selectExpr("*", f"{_PLACE} place")
    return e.selectExpr("CAST(user_id AS STRING) caid", f"{_LAT} latitude", f"{_LON} longitude", "t utc_timestamp")


PINGS_SQL = f"""SELECT CAST(user_id AS VARCHAR) caid, {_LAT} latitude, {_LON} longitude, t utc_timestamp FROM (
  SELECT *, {_PLACE} place FROM (SELECT *, {_HH} hh, {_DW} dw FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) t FROM events)))"""

# A day of 144 slots per user of the event table: home before 8 and from 20 h, work from 9 to 16 h, else one of five places.
_KIND = "CASE WHEN (slot - 1) // 6 < 8 OR (slot - 1) // 6 >= 20 THEN 'h' WHEN (slot - 1) // 6 BETWEEN 9 AND 16 THEN 'w' ELSE 'o' END"
_SPOT = "CASE kind WHEN 'h' THEN 0 WHEN 'w' THEN 1 ELSE 2 + (uid + slot) % 5 END"
_TLAT, _TLON = "34e0 + (uid % 40) * 1e-2 + spot * 4e-3", "-118.4e0 + (uid % 37) * 1e-2 + spot * 5e-3"


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """user_id, timeslot (1-based, ten minutes), location_type, longitude, latitude."""
    u = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("uid")).distinct()
    t = u.select("uid", F.explode(F.sequence(F.lit(1), F.lit(144))).alias("slot"))
    t = t.selectExpr("*", _KIND.replace("//", "div") + " kind").selectExpr("*", _SPOT + " spot")
    return t.selectExpr("CAST(uid AS STRING) user_id", "CAST(slot AS BIGINT) timeslot", "kind location_type", f"{_TLON} longitude", f"{_TLAT} latitude")


TIMELINE_SQL = f"""SELECT CAST(uid AS VARCHAR) user_id, CAST(slot AS BIGINT) timeslot, kind location_type, {_TLON} longitude, {_TLAT} latitude FROM (
  SELECT *, {_SPOT} spot FROM (SELECT *, {_KIND} kind FROM (SELECT DISTINCT user_id uid FROM events), range(1, 145) s(slot)))"""
