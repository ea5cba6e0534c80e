"""Threshold-based stops from pings, as one window pipeline.

Everything up to the ordinal runs on one exchange: rows are partitioned by
device once, and deduplication, lag windows, the sessionising sum and the
windowed medians reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine

PING_COLUMNS = ("caid", "latitude", "longitude", "utc_timestamp")


def clean_pings(
    df: DataFrame,
    column_mappings: dict[str, str] | None = None,
    time_format: str = "UNIX",
    start: int | None = None,
    end: int | None = None,
    latitude: tuple[float, float] | None = None,
    longitude: tuple[float, float] | None = None,
) -> DataFrame:
    """Canonical pings: columns renamed ({original: canonical}), cast, null-free, inside the time window and the box.

    ``time_format`` is UNIX (seconds) or a Spark datetime pattern read in UTC;
    values that do not cast count as null. Bounds are inclusive and may be given
    in either order. A mapping of an absent column is ignored.
    """
    names = {k: v for k, v in (column_mappings or {}).items() if k in df.columns and k != v}
    df = df.withColumnsRenamed(names)
    missing = [c for c in PING_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    ts = F.col("utc_timestamp")
    if time_format != "UNIX":
        ts = F.unix_timestamp(F.try_to_timestamp(ts, F.lit(time_format)))
    kinds = dict(df.dtypes)

    def cast(c: Column, name: str, to: str) -> Column:
        return c.try_cast(to) if kinds[name] == "string" else c.cast(to)

    d = df.select(
        F.col("caid").cast("string").alias("caid"),
        cast(F.col("latitude"), "latitude", "double").alias("latitude"),
        cast(F.col("longitude"), "longitude", "double").alias("longitude"),
        (cast(ts, "utc_timestamp", "bigint") if time_format == "UNIX" else ts).alias("utc_timestamp"),
    ).na.drop()
    if start is not None and end is not None:
        d = d.where(F.col("utc_timestamp").between(start, end))
    for c, box in (("latitude", latitude), ("longitude", longitude)):
        if box is not None:
            d = d.where(F.col(c).between(min(box), max(box)))
    return d


def stop_points(pings: DataFrame, distance_threshold: float = 20.0, time_threshold: float = 3600.0) -> DataFrame:
    """Pings that belong to a stationary event, with its number ``ev_id``.

    A ping is stationary when the step after it, or the step before it, is at
    most ``distance_threshold`` metres and ``time_threshold`` seconds. An event
    begins at a stationary ping whose predecessor is not stationary or lies too
    far away. Pings of one device and instant are taken in the order of their
    coordinates.
    """
    d = pings.select(*PING_COLUMNS).repartition("caid").dropDuplicates()
    w = W.partitionBy("caid").orderBy("utc_timestamp", "latitude", "longitude")
    nxt = lambda c: F.lead(c).over(w)
    near = (haversine(F.col("latitude"), F.col("longitude"), F.col("_la"), F.col("_lo")) <= distance_threshold)
    quick = F.coalesce(F.col("_t") - F.col("utc_timestamp") <= time_threshold, F.lit(True))
    d = d.select("*", nxt("latitude").alias("_la"), nxt("longitude").alias("_lo"), nxt("utc_timestamp").alias("_t"))
    # near_next is null on a device's last ping, as the step itself
    d = d.select(*PING_COLUMNS, near.alias("_near"), quick.alias("_quick"))
    ahead = F.col("_near") & F.col("_quick")
    d = d.withColumn("_pn", F.lag("_near").over(w)).withColumn("_pa", F.lag(ahead).over(w))
    d = d.withColumn("_still", F.coalesce(ahead, F.lit(False)) | F.coalesce("_pa", F.lit(False)))
    begins = F.col("_still") & (~F.coalesce(F.lag("_still").over(w), F.lit(False)) | ~F.coalesce("_pn", F.lit(True)))
    d = d.withColumn("_begin", F.when(begins, 1).otherwise(0))
    d = d.withColumn("ev_id", F.sum("_begin").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.where(F.col("_still") & (F.col("ev_id") > 0)).select(*PING_COLUMNS, "ev_id")


def find_stops(pings: DataFrame, distance_threshold: float = 20.0, time_threshold: float = 3600.0, min_stop_duration: float = 300.0, refine: bool = True) -> DataFrame:
    """Stops: caid, start and end timestamp, median position and 1-based ordinal per device.

    ``refine`` drops, from events that last long enough, pings farther than
    ``distance_threshold`` from the event's median and measures again. Medians
    are lower medians. Repeated pings count once; an empty table has no stops.
    """
    d = stop_points(pings, distance_threshold, time_threshold)
    median = lambda c: F.percentile_approx(c, 0.5, 1_000_000)
    if refine:
        e = W.partitionBy("caid", "ev_id")
        d = d.withColumn("_mla", median("latitude").over(e)).withColumn("_mlo", median("longitude").over(e))
        d = d.withColumn("_span", F.max("utc_timestamp").over(e) - F.min("utc_timestamp").over(e))
        d = d.where((F.col("_span") >= min_stop_duration) & (haversine(F.col("latitude"), F.col("longitude"), F.col("_mla"), F.col("_mlo")) <= distance_threshold))
    s = d.groupBy("caid", "ev_id").agg(
        F.min("utc_timestamp").alias("start_timestamp"),
        F.max("utc_timestamp").alias("end_timestamp"),
        median("latitude").alias("median_latitude"),
        median("longitude").alias("median_longitude"),
    ).where(F.col("end_timestamp") - F.col("start_timestamp") >= min_stop_duration)
    w = W.partitionBy("caid").orderBy("start_timestamp")
    return s.select("caid", "start_timestamp", "end_timestamp", "median_latitude", "median_longitude", F.row_number().over(w).alias("stop_events"))
