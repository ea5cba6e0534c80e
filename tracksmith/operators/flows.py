"""Flows between places, tessellations, user selection and mobility distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geo import R_ROUND_M, haversine


def stay_count(stays: DataFrame, res: int, cell: str = "cell", system: str = "grid") -> DataFrame:
    """Stays per parent cell: cell, h3_index (hex), count, boundary."""
    p = stays.select(cells.parent(F.col(cell), res).alias("cell")).where("cell is not null")
    return p.groupBy("cell").agg(F.count(F.lit(1)).alias("count")).select("cell", cells.to_hex(F.col("cell")).alias("h3_index"), "count", cells.cell_to_boundary(F.col("cell"), system).alias("boundary"))


def od_flow(stays: DataFrame, res: int, include_self: bool = True, cell: str = "cell", user: str = "caid", time: str = "local_time", system: str = "grid") -> DataFrame:
    """Flows between the parent cells of successive stays of each device: origin, destination (hex), flow, distance between centres in km."""
    d = stays.select(F.col(user).alias("_u"), F.col(time).alias("_t"), F.col(cell).alias("_c"), cells.parent(F.col(cell), res).alias("_p"))
    w = W.partitionBy("_u").orderBy("_t", "_c")
    d = d.select(F.lag("_p").over(w).alias("o"), F.col("_p").alias("d")).na.drop()
    if not include_self:
        d = d.where("o <> d")
    d = d.groupBy("o", "d").agg(F.count(F.lit(1)).alias("flow"))
    a, b = cells.cell_to_latlng(F.col("o"), system), cells.cell_to_latlng(F.col("d"), system)
    km = haversine(a["lat"], a["lng"], b["lat"], b["lng"], R_ROUND_M / 1000.0)
    return d.select(cells.to_hex(F.col("o")).alias("origin"), cells.to_hex(F.col("d")).alias("destination"), "flow", km.alias("distance"))


def home_work_flow(home_work: DataFrame, res: int) -> DataFrame:
    """Devices per (home, work) parent cell: origin, destination (hex), flow. Devices without either are left out."""
    hex_ = lambda c: cells.to_hex(cells.parent(F.col(c), res))
    d = home_work.where("home_cell is not null and work_cell is not null")
    return d.groupBy(hex_("home_cell").alias("origin"), hex_("work_cell").alias("destination")).agg(F.count(F.lit(1)).alias("flow"))


def location_counts(stays: DataFrame, column: str, res: int) -> DataFrame:
    """Devices per parent of their home (or work) cell in ``column``, upper-case hex; null and the text None do not count."""
    one = stays.groupBy("caid").agg(F.min(column).alias("_h")).where("_h is not null and _h <> 'None'")
    one = one.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    return one.groupBy(cells.to_hex(cells.parent(cells.from_hex(F.col("_h")), res)).alias("h3_index")).agg(F.sum("_n").alias("count"))


def count_map(counts: DataFrame, res: int, cell: str = "cell", system: str = "grid") -> DataFrame:
    """Map data: parent cell, summed count, log10 of it, centre."""
    d = counts.groupBy(cells.parent(F.col(cell), res).alias("cell")).agg(F.sum("count").alias("count"))
    at = cells.cell_to_latlng(F.col("cell"), system)
    return d.select("cell", "count", F.log10("count").alias("log_count"), at["lat"].alias("latitude"), at["lng"].alias("longitude"))


def flow_map(flows: DataFrame, min_thickness: float = 0.1, max_thickness: float = 3.0, factor: float = 5.0, cutoff_count: float = 0.02, max_circle_size: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Edge and node tables of a flow map: line thickness by flow relative to the largest flow between different places, node radius by the thickness that meets there."""
    top = flows.where("origin <> destination").agg(F.max("flow").alias("_max"))
    thick = F.least(F.greatest(F.col("flow") / F.col("_max") * factor, F.lit(min_thickness)), F.lit(max_thickness))
    edges = flows.join(F.broadcast(top)).where((F.col("flow") > cutoff_count) & (F.col("origin") != F.col("destination"))).select("origin", "destination", "flow", thick.alias("thickness"))
    ends = edges.select(F.explode(F.array("origin", "destination")).alias("node"), "thickness")
    nodes = ends.groupBy("node").agg(F.sum("thickness").alias("weight"))
    most = nodes.agg(F.max("weight").alias("_max"))
    nodes = nodes.join(F.broadcast(most)).select("node", "weight", F.when(F.col("weight") > 0.1, F.col("weight") / (F.col("_max") / max_circle_size)).alias("radius"))
    return edges, nodes


def trajectories(stays: DataFrame, user: str = "caid", time: str = "local_time", system: str = "grid") -> DataFrame:
    """Each device's positions in order, as an array of structs; stays without a position stand at their cell's centre."""
    at = cells.cell_to_latlng(F.col("cell"), system)
    p = F.struct(F.col(time).alias("t"), F.coalesce(F.col("latitude"), at["lat"]).alias("lat"), F.coalesce(F.col("longitude"), at["lng"]).alias("lng"))
    return stays.groupBy(user).agg(F.array_sort(F.collect_list(p)).alias("path"))


# --- tessellation and transition matrix -------------------------------------------------


def tessellation(stays: DataFrame, cell: str = "cell", system: str = "grid") -> DataFrame:
    """Cells in use with their stay count, centre and boundary."""
    d = stays.where(F.col(cell).isNotNull()).groupBy(F.col(cell).alias("cell")).agg(F.count(F.lit(1)).alias("stay_count"))
    at = cells.cell_to_latlng(F.col("cell"), system)
    return d.select("cell", "stay_count", at["lat"].alias("latitude"), at["lng"].alias("longitude"), cells.cell_to_boundary(F.col("cell"), system).alias("boundary"))


def transition_counts(stays: DataFrame, tiles: DataFrame, cell: str = "cell", user: str = "caid", time: str = "local_time") -> DataFrame:
    """Moves between different cells of the tessellation by successive rows of each device; a row outside breaks the chain."""
    w = W.partitionBy("_u").orderBy("_t", "_c")
    d = stays.select(F.col(user).alias("_u"), F.col(time).alias("_t"), F.col(cell).alias("_c")).select(F.col("_c").alias("origin"), F.lead("_c").over(w).alias("destination"))
    d = d.where("origin is not null and destination is not null and origin <> destination").groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n"))
    t = tiles.select(F.col("cell").alias("_tile"))
    return d.join(t, F.col("origin") == F.col("_tile"), "left_semi").join(t, F.col("destination") == F.col("_tile"), "left_semi")


def transition_matrix(counts: DataFrame) -> DataFrame:
    """Row-stochastic sparse matrix (origin, destination, p). Cells without departures have no rows here: theirs are even over all other cells; see :func:`idle_cells`."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("origin"))).select("origin", "destination", "p")


def idle_cells(counts: DataFrame, tiles: DataFrame) -> DataFrame:
    """(origin, p): the cells without departures, and the even probability of each other cell as their destination."""
    n = tiles.agg(F.count(F.lit(1)).alias("_n"))
    d = tiles.select(F.col("cell").alias("origin")).join(counts.select("origin").distinct(), "origin", "left_anti")
    return d.join(F.broadcast(n)).select("origin", (F.lit(1.0) / F.nullif(F.col("_n") - 1, F.lit(0))).alias("p"))


# --- user selection -----------------------------------------------------------------------


def user_summary(stays: DataFrame) -> DataFrame:
    """Per device: number of stays, first start, last end, and the days between, rounded half up."""
    d = stays.groupBy("caid").agg(F.count(F.lit(1)).alias("num_stays"), F.min("stay_start_timestamp").alias("first_start"), F.max("stay_end_timestamp").alias("last_end"))
    seconds = F.unix_timestamp("last_end") - F.unix_timestamp("first_start")
    return d.withColumn("duration_days", F.round(seconds / 86400.0).cast("int"))


def activity_grid(summary: DataFrame) -> DataFrame:
    return summary.groupBy("duration_days", "num_stays").agg(F.count(F.lit(1)).alias("count")).orderBy("duration_days", "num_stays")


def activity_heatmap(grid: DataFrame) -> DataFrame:
    """The grid with log10(count + 1), empty fields left out."""
    return grid.where("count > 0").withColumn("log_count", F.log10(F.col("count") + 1))


def in_ranges(num_stays: tuple[int, int], days: tuple[int, int]) -> Column:
    return F.col("num_stays").between(*num_stays) & F.col("duration_days").between(*days)


def filter_users(stays: DataFrame, num_stays: tuple[int, int], days: tuple[int, int]) -> DataFrame:
    """Stays of the devices whose counts lie in both ranges, bounds included."""
    keep = user_summary(stays).where(in_ranges(num_stays, days)).select("caid")
    return stays.join(keep, "caid", "left_semi")


def user_totals(summary: DataFrame, num_stays: tuple[int, int], days: tuple[int, int]) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("num_total_users"), F.count_if(in_ranges(num_stays, days)).alias("num_filtered_users"))


# --- distributions ------------------------------------------------------------------------


def shares(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    """(key, probability) from counts per key."""
    return df.select(key, (F.col(count) / F.sum(count).over(W.partitionBy(F.lit(1)))).alias("probability"))


def duration_distribution(stays: DataFrame) -> DataFrame:
    """Share of stays by whole hours of their duration, under 24."""
    h = F.floor(F.col("stay_duration") / F.lit(3_600_000_000.0)).cast("int")
    return shares(stays.select(h.alias("range")).where("range < 24").groupBy("range").agg(F.count(F.lit(1)).alias("n")), "range")


def daily_locations_distribution(stays: DataFrame) -> DataFrame:
    """Share of device days by the number of different cells visited."""
    d = stays.groupBy("caid", F.to_date("local_time").alias("_day")).agg(F.countDistinct("cell").alias("locations"))
    return shares(d.groupBy("locations").agg(F.count(F.lit(1)).alias("n")), "locations")


def departure_distribution(stays: DataFrame, time_zone: str) -> DataFrame:
    """Share of stays by the local hour at which they end."""
    h = F.hour(F.from_utc_timestamp("stay_end_timestamp", time_zone)).alias("hour_of_day")
    return shares(stays.groupBy(h).agg(F.count(F.lit(1)).alias("n")), "hour_of_day")
