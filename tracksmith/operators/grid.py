"""Stays by sequential centroid on a cell grid, and home and work by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geo import haversine, np_haversine


def segments(pings: DataFrame, delta_t: int = 300, speed_threshold: float = 6.0, passing: bool = True) -> DataFrame:
    """Pings with ``is_passing`` (faster than ``speed_threshold`` m/s since the one before) and ``segment``, new after a gap over ``delta_t`` s.

    With ``passing`` false, pings that pass are dropped first.
    """
    w = W.partitionBy("caid").orderBy("utc_timestamp", "latitude", "longitude")
    prev = lambda c: F.lag(c).over(w)
    d = pings.select("caid", "latitude", "longitude", "utc_timestamp").repartition("caid").dropDuplicates()
    dt = F.col("utc_timestamp") - prev("utc_timestamp")
    d = d.withColumn("_m", haversine(prev("latitude"), prev("longitude"), F.col("latitude"), F.col("longitude"))).withColumn("_dt", dt)
    d = d.withColumn("is_passing", F.coalesce(F.col("_m") > F.lit(speed_threshold) * F.col("_dt"), F.lit(False)))
    if not passing:
        d = d.where(~F.col("is_passing"))
    new = F.coalesce(F.col("utc_timestamp") - prev("utc_timestamp") > delta_t, F.lit(True))
    d = d.drop("_m", "_dt").withColumn("_new", F.when(new, 1).otherwise(0))
    return d.withColumn("segment", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


class _Fold:
    """Streams pings sorted by (caid, segment, instant, position); holds the sums of the stay that is open."""

    COLUMNS = ("caid", "start_timestamp", "end_timestamp", "latitude", "longitude", "n_pings")

    def __init__(self, metres: float):
        self.metres, self.key, self.open = metres, None, None  # open: first and last instant, sums of both coordinates, count

    def _close(self, out: list) -> None:
        if self.open is not None:
            t0, t1, la, lo, n = self.open
            out.append((self.key[0], t0, t1, la / n, lo / n, n))
            self.open = None

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        for pdf in batches:
            caid, seg, t, lat, lon = (pdf[c].to_numpy() for c in ("caid", "segment", "utc_timestamp", "latitude", "longitude"))
            new = np.flatnonzero(np.r_[True, (caid[1:] != caid[:-1]) | (seg[1:] != seg[:-1])][: len(t)]).tolist()
            for s, e in zip(new, [*new[1:], len(t)]):
                if (caid[s], seg[s]) != self.key:
                    self._close(out)
                    self.key = caid[s], seg[s]
                at, ahead = s, 16
                while at < e:
                    if self.open is None:
                        self.open = [t[at], t[at], lat[at], lon[at], 1]
                        at, ahead = at + 1, 16
                        continue
                    # As if all of the next ones joined: each is compared with the mean of those before it.
                    z = min(e, at + ahead)
                    _, _, la, lo, n = self.open
                    sla, slo = np.cumsum(np.r_[la, lat[at:z]]), np.cumsum(np.r_[lo, lon[at:z]])
                    k = n + np.arange(z - at)
                    far = np.flatnonzero(~(np_haversine(sla[:-1] / k, slo[:-1] / k, lat[at:z], lon[at:z]) <= self.metres))
                    join = int(far[0]) if len(far) else z - at
                    if join:
                        self.open = [self.open[0], t[at + join - 1], sla[join], slo[join], n + join]
                    at += join
                    ahead = min(2 * ahead, 4096)
                    if len(far):
                        self._close(out)
            yield pd.DataFrame(out, columns=self.COLUMNS)
            out = []
        self._close(out)
        yield pd.DataFrame(out, columns=self.COLUMNS)


def sequential_centroids(segmented: DataFrame, spatial_threshold: float = 300.0) -> DataFrame:
    """Stays within segments: a ping within ``spatial_threshold`` m of the running mean joins the stay and moves the mean, else it opens the next.

    Segments are spread over tasks and stream through them in order, so neither a
    device nor a segment nor its stays are ever held.
    """
    d = segmented.select("caid", "segment", "utc_timestamp", "latitude", "longitude").repartition("caid", "segment").sortWithinPartitions("caid", "segment", "utc_timestamp", "latitude", "longitude")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _Fold(spatial_threshold).run(batches)

    return d.mapInPandas(run, "caid string, start_timestamp bigint, end_timestamp bigint, latitude double, longitude double, n_pings bigint")


def grid_stays(
    pings: DataFrame,
    delta_t: int = 300,
    spatial_threshold: float = 300.0,
    speed_threshold: float = 6.0,
    temporal_threshold: int = 300,
    resolution: int = 8,
    regional_temporal_threshold: int = 3600,
    passing: bool = True,
    system: str = "grid",
) -> DataFrame:
    """Stays snapped to cells: long enough stays, successive ones in one cell merged when at most ``regional_temporal_threshold`` s apart.

    A merged stay lies at the mean of its parts weighted by their pings.
    """
    s = sequential_centroids(segments(pings, delta_t, speed_threshold, passing), spatial_threshold)
    s = s.where(F.col("end_timestamp") - F.col("start_timestamp") >= temporal_threshold)
    s = s.withColumn("cell", cells.latlng_to_cell(F.col("latitude"), F.col("longitude"), resolution, system))
    w = W.partitionBy("caid").orderBy("start_timestamp", "end_timestamp")
    new = (F.lag("cell").over(w) != F.col("cell")) | (F.col("start_timestamp") - F.lag("end_timestamp").over(w) > regional_temporal_threshold)
    s = s.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    mean = lambda c: F.sum(F.col(c) * F.col("n_pings")) / F.sum("n_pings")
    s = s.groupBy("caid", "_run").agg(
        F.min("start_timestamp").alias("start_timestamp"), F.max("end_timestamp").alias("end_timestamp"), F.min("cell").alias("cell"),
        mean("latitude").alias("latitude"), mean("longitude").alias("longitude"), F.sum("n_pings").alias("n_pings"),
    )
    return s.withColumnRenamed("_run", "stay_id")


def grid_home_work(
    local: DataFrame,
    home_to_work: int = 8,
    work_to_home: int = 19,
    work_distance_limit: float = 500.0,
    work_freq_count_limit: int = 3,
    system: str = "grid",
) -> DataFrame:
    """(caid, home_cell, work_cell) from stays with local time.

    Home is the cell with most stays at night (hour >= ``work_to_home`` or <
    ``home_to_work``) or on weekends; work the weekday daytime cell, visited
    often enough and far enough from home, with the largest number of visits
    times distance. Ties go to the lower cell.
    """
    night = (F.col("hour_of_day") >= work_to_home) | (F.col("hour_of_day") < home_to_work) | F.col("weekend")
    c = local.groupBy("caid", "cell").agg(F.count_if(night).alias("n_home"), F.count_if(~night).alias("n_work"))
    w = W.partitionBy("caid")
    home = c.where("n_home > 0").withColumn("_r", F.row_number().over(w.orderBy(F.desc("n_home"), "cell"))).where("_r = 1").select("caid", F.col("cell").alias("home_cell"))
    a, b = cells.cell_to_latlng(F.col("home_cell"), system), cells.cell_to_latlng(F.col("cell"), system)
    m = haversine(a["lat"], a["lng"], b["lat"], b["lng"])
    work = c.where(F.col("n_work") >= work_freq_count_limit).join(home, "caid").withColumn("_m", m)
    work = work.where((F.col("cell") != F.col("home_cell")) & (F.col("_m") >= work_distance_limit))
    best = w.orderBy(F.desc(F.round(F.col("n_work") * F.col("_m"), 3)), "cell")
    work = work.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("caid", F.col("cell").alias("work_cell"))
    return home.join(work, "caid", "left")
