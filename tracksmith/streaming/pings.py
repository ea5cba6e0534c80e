"""Pings as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ping_activity(stream: DataFrame, time: str = "ingested_at", lateness: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Pings and first and last position per device and event-time window, of a stream or a table; rows later than ``lateness`` are dropped by the watermark."""
    at = F.struct(time, "latitude", "longitude")
    d = stream.where(F.col("caid").isNotNull() & F.col(time).isNotNull()).withWatermark(time, lateness)
    d = d.groupBy(F.window(time, width).alias("w"), "caid").agg(F.count(F.lit(1)).alias("n_pings"), F.min(at).alias("_a"), F.max(at).alias("_z"))
    return d.select("caid", F.col("w.start").alias("window_start"), "n_pings", F.col("_a.latitude").alias("first_latitude"), F.col("_a.longitude").alias("first_longitude"), F.col("_z.latitude").alias("last_latitude"), F.col("_z.longitude").alias("last_longitude"))
