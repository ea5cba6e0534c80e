"""Places: density clusters of a device's stops, home and work, canonical stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geo import chord, haversine, np_unit_vectors
from ..session import cut_lineage

CLUSTERED = "caid string, stop_events int, start_timestamp bigint, end_timestamp bigint, stay_duration bigint, stop_latitude double, stop_longitude double, cluster_label int, cluster_counts int, cluster_latitude double, cluster_longitude double"


def _meets(a: np.ndarray, b: np.ndarray, r2: float, step: int = 1024) -> bool:
    """Whether a point of ``a`` lies within reach of one of ``b``; parts that cannot are passed over."""
    lo, hi = b.min(0), b.max(0)
    gap = np.maximum(0, np.maximum(lo - a, a - hi))
    a = a[(gap * gap).sum(1) <= r2]
    for s in range(0, len(a), step):
        for t in range(0, len(b), step):
            d = a[s : s + step, None, :] - b[None, t : t + step, :]
            if (np.einsum("ijk,ijk->ij", d, d) <= r2).any():
                return True
    return False


def _labels_by_cells(xyz: np.ndarray, reach: float, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """(core, component) of many points. In cells of side reach / sqrt(3) all points are neighbours, so cells are counted and united instead of pairs: nothing grows with the square of a crowded place."""
    r2, key = reach * reach, np.floor(xyz / (reach / np.sqrt(3.0) * (1 - 1e-9))).astype(np.int64)
    cell, of, size = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(size)
    points = [order[e - s : e] for s, e in zip(size, ends)]
    at = {tuple(k): n for n, k in enumerate(cell.tolist())}
    shifts = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) != (0, 0, 0)]
    around = [[m for d in shifts if (m := at.get((k[0] + d[0], k[1] + d[1], k[2] + d[2]))) is not None] for k in cell.tolist()]
    core = size[of] >= min_points
    for n in np.flatnonzero(size < min_points):
        count = np.full(size[n], size[n])
        for m in around[n]:
            for s in range(0, size[m], 4096):
                d = xyz[points[n]][:, None, :] - xyz[points[m][s : s + 4096]][None, :, :]
                count += (np.einsum("ijk,ijk->ij", d, d) <= r2).sum(1)
        core[points[n]] = count >= min_points
    inside = [p[core[p]] for p in points]
    up = list(range(len(cell)))

    def root(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for n in range(len(cell)):
        for m in around[n]:
            if m > n and len(inside[n]) and len(inside[m]) and root(n) != root(m) and _meets(xyz[inside[n]], xyz[inside[m]], r2):
                up[root(m)] = root(n)
    comp = np.full(len(xyz), -1)
    for n in range(len(cell)):
        comp[inside[n]] = root(n)
    # Components in the order of their first core point; a point that is no core takes the first component that reaches it.
    first = {}
    for c in comp[core]:
        first.setdefault(int(c), len(first))
    comp = np.array([first.get(int(c), -1) for c in comp])
    for n in range(len(cell)):
        for i in points[n][~core[points[n]]]:
            near = [inside[m] for m in (n, *around[n]) if len(inside[m])]
            got = [comp[q[((xyz[q] - xyz[i]) ** 2).sum(1) <= r2]] for q in near]
            got = np.concatenate(got) if got else got
            if len(got):
                comp[i] = got.min()
    return core, comp


def density_labels(lat: np.ndarray, lon: np.ndarray, metres: float, min_points: int, few: int = 300) -> np.ndarray:
    """DBSCAN over great-circle distance; ``min_points`` counts the point itself; noise is -1. A border point joins the earliest cluster that reaches it."""
    n = len(lat)
    labels = np.full(n, -1, np.int64)
    if n == 0:
        return labels
    xyz, reach = np_unit_vectors(lat, lon), chord(metres)
    if n > few:
        return _labels_by_cells(xyz, reach, min_points)[1]
    d = xyz[:, None, :] - xyz[None, :, :]
    near = (d * d).sum(2) <= reach * reach
    core = near.sum(1) >= min_points
    if not core.any():
        return labels
    link, nxt = near & core, 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        group, size = link[i], 0
        while group.sum() > size:
            size = group.sum()
            group = link[group].any(0)
        labels[group] = nxt
        nxt += 1
    edge = ~core & link.any(1)
    labels[edge] = np.where(link[edge], labels[None, :], n).min(1)
    return labels


def cluster_stops(stops: DataFrame, distance: float = 20.0, min_points: int = 2) -> DataFrame:
    """Each stop with the place it belongs to.

    Places of a device are numbered from 0 by mean latitude, then mean
    longitude; label -1 is a stop without a place, which keeps its own position
    and count 1. A place's position is the median latitude and, independently,
    the median longitude of its stops. Repeated (caid, stop_events) count once.

    Devices stream through a task in order, so many small ones make one batch;
    one device's stops are held together.
    """
    d = stops.select("caid", "start_timestamp", "end_timestamp", "median_latitude", "median_longitude", "stop_events")

    def one(lat: np.ndarray, lon: np.ndarray) -> tuple:
        raw = density_labels(lat, lon, distance, min_points)
        label, count, cla, clo = raw.copy(), np.ones(len(raw), np.int64), lat.copy(), lon.copy()
        order = np.argsort(raw, kind="stable")
        groups = np.split(order, np.searchsorted(raw[order], np.arange(raw.max(initial=-1) + 1)))[1:]
        groups.sort(key=lambda g: (lat[g].mean(), lon[g].mean()))
        for k, g in enumerate(groups):
            label[g], count[g], cla[g], clo[g] = k, len(g), np.median(lat[g]), np.median(lon[g])
        return label, count, cla, clo

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        """Rows of complete devices."""
        new = np.r_[True, (p["caid"].to_numpy()[1:] != p["caid"].to_numpy()[:-1])] if len(p) else np.zeros(0, bool)
        lat, lon = p["median_latitude"].to_numpy(float), p["median_longitude"].to_numpy(float)
        begin = np.flatnonzero(new)
        parts = [one(lat[s:e], lon[s:e]) for s, e in zip(begin, [*begin[1:], len(p)])]
        label, count, cla, clo = (np.concatenate(x) for x in zip(*parts)) if parts else ([],) * 4
        return pd.DataFrame(
            {
                "caid": p["caid"], "stop_events": p["stop_events"], "start_timestamp": p["start_timestamp"], "end_timestamp": p["end_timestamp"],
                "stay_duration": p["end_timestamp"] - p["start_timestamp"], "stop_latitude": lat, "stop_longitude": lon,
                "cluster_label": label, "cluster_counts": count, "cluster_latitude": cla, "cluster_longitude": clo,
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["caid"].iloc[-1]
            here = (pdf["caid"] == last).to_numpy()
            if held and held[0]["caid"].iloc[0] == last and here.all():
                held.append(pdf)
                continue
            yield whole(pd.concat([*held, pdf[~here]], ignore_index=True))
            held = [pdf[here]]
        if held:
            yield whole(pd.concat(held, ignore_index=True))

    # By the device itself, of which no null is a stop; rows that repeat a stop are told apart by their order alone.
    w = W.partitionBy("caid", "stop_events").orderBy("start_timestamp", "end_timestamp", "median_latitude", "median_longitude")
    d = d.where("caid is not null").repartition("caid").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return d.sortWithinPartitions("caid", "start_timestamp", "stop_events").mapInPandas(run, CLUSTERED)


def add_local_time(df: DataFrame, time_zone: str, timestamp: str = "start_timestamp") -> DataFrame:
    """local_time, date, hour_of_day, day_of_week (1 = Sunday) and weekend of epoch seconds in ``time_zone``."""
    d = df.withColumn("local_time", F.from_utc_timestamp(F.timestamp_seconds(F.col(timestamp)), time_zone))
    return d.withColumns(
        {
            "date": F.to_date("local_time"),
            "hour_of_day": F.hour("local_time"),
            "day_of_week": F.dayofweek("local_time"),
            "weekend": F.dayofweek("local_time").isin(1, 7),
        }
    )


def _candidates(d: DataFrame, home: tuple[int, int], work: tuple[int, int]) -> DataFrame:
    """One pass over the stops: per (caid, place) its visits and days, at home hours and at work hours."""
    evening, morning = home
    at_home = F.col("weekend") | (F.col("hour_of_day") >= evening) | (F.col("hour_of_day") < morning)
    at_work = ~F.col("weekend") & F.col("hour_of_day").between(*work)
    days = lambda c: F.size(F.collect_set(F.when(c, F.col("date"))))
    return d.where("cluster_label >= 0").groupBy("caid", "cluster_label").agg(
        F.countDistinct("date").alias("unique_days_visited"),
        F.count_if(at_home).alias("home_time_visits"),
        days(at_home).cast("bigint").alias("home_time_unique_days"),
        F.avg(F.when(at_home, F.col("cluster_latitude"))).alias("home_latitude"),
        F.avg(F.when(at_home, F.col("cluster_longitude"))).alias("home_longitude"),
        F.count_if(at_work).alias("work_time_visits"),
        days(at_work).cast("bigint").alias("work_time_unique_days"),
        F.avg(F.when(at_work, F.col("cluster_latitude"))).alias("work_latitude"),
        F.avg(F.when(at_work, F.col("cluster_longitude"))).alias("work_longitude"),
    )


def home_locations(local: DataFrame, home_min_days: int = 7, evening: int = 22, morning: int = 7, work_hours: tuple[int, int] = (8, 18)) -> DataFrame:
    """The home of each device: of places visited on ``home_min_days`` days, the one with most visits at home hours (ties: home days, then lower label)."""
    c = _candidates(local, (evening, morning), work_hours)
    w = W.partitionBy("caid").orderBy(F.desc("home_time_visits"), F.desc("home_time_unique_days"), "cluster_label")
    c = c.where((F.col("home_time_visits") > 0) & (F.col("unique_days_visited") >= home_min_days)).withColumn("_r", F.row_number().over(w))
    return c.where("_r = 1").select("caid", F.col("cluster_label").alias("home_label"), "home_latitude", "home_longitude", "home_time_visits", "home_time_unique_days")


def work_locations(local: DataFrame, home_min_days: int = 7, evening: int = 22, morning: int = 7, work_min_days: int = 4, work_hours: tuple[int, int] = (8, 18), min_distance: float = 50.0) -> DataFrame:
    """The work place of each device with a home: another place, far enough from home, with most visits in work hours on weekdays."""
    c = _candidates(local, (evening, morning), work_hours)
    home = home_locations(local, home_min_days, evening, morning, work_hours).select("caid", "home_label", F.col("home_latitude").alias("_hla"), F.col("home_longitude").alias("_hlo"))
    far = haversine(F.col("_hla"), F.col("_hlo"), F.col("work_latitude"), F.col("work_longitude")) >= min_distance
    c = c.where((F.col("work_time_visits") > 0) & (F.col("work_time_unique_days") >= work_min_days)).join(home, "caid").where((F.col("cluster_label") != F.col("home_label")) & far)
    w = W.partitionBy("caid").orderBy(F.desc("work_time_visits"), F.desc("work_time_unique_days"), "cluster_label")
    c = c.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return c.select("caid", F.col("cluster_label").alias("work_label"), "work_latitude", "work_longitude", "work_time_visits", "work_time_unique_days")


def classify_home_work(local: DataFrame, **params) -> DataFrame:
    """Every stop with ``type``: 1 at its device's home, 2 at its work place, else 0; and both places."""
    local = cut_lineage(local)  # read by three branches, and its clusters come from Python
    hp = {k: v for k, v in params.items() if k not in ("work_min_days", "min_distance")}
    home = home_locations(local, **hp).select("caid", "home_label", "home_latitude", "home_longitude")
    work = work_locations(local, **params).select("caid", "work_label", "work_latitude", "work_longitude")
    kind = F.when(F.col("cluster_label") == -1, 0).when(F.col("cluster_label") == F.col("home_label"), 1).when(F.col("cluster_label") == F.col("work_label"), 2).otherwise(0)
    return local.join(home, "caid", "left").join(work, "caid", "left").withColumn("type", kind.cast("int"))


def canonical_stays(labelled: DataFrame, resolution: int = 8, system: str = "grid") -> DataFrame:
    """The 16-column stay table every later step reads. Cells are those of ``system`` (``functions.cells``)."""
    hex_ = lambda la, lo: F.upper(cells.to_hex(cells.latlng_to_cell(F.col(la), F.col(lo), resolution, system)))
    cell = cells.latlng_to_cell(F.col("cluster_latitude"), F.col("cluster_longitude"), resolution, system)
    return labelled.select(
        "caid",
        F.col("stop_events").cast("bigint").alias("h3_region_stay_id"),
        F.timestamp_seconds("start_timestamp").alias("stay_start_timestamp"),
        F.timestamp_seconds("end_timestamp").alias("stay_end_timestamp"),
        (F.col("stay_duration") * 1_000_000).cast("bigint").alias("stay_duration"),
        cell.cast("string").alias("h3_id_region"),
        "local_time",
        hex_("cluster_latitude", "cluster_longitude").alias("h3_index"),
        F.col("day_of_week").cast("int").alias("day_of_week"),
        F.col("hour_of_day").cast("int").alias("hour_of_day"),
        F.when(F.col("home_latitude").isNotNull(), hex_("home_latitude", "home_longitude")).alias("home_h3_index"),
        "type",
        F.when(F.col("work_latitude").isNotNull(), hex_("work_latitude", "work_longitude")).alias("work_h3_index"),
        "cluster_label",
        F.col("stop_latitude").alias("latitude"),
        F.col("stop_longitude").alias("longitude"),
    )


def stay_points(canonical: DataFrame) -> DataFrame:
    """The same table without home, work and type, whether or not they were computed."""
    return canonical.drop("home_h3_index", "work_h3_index", "type")
