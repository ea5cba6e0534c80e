"""Measures on simulated timelines (user_id, timeslot, location_type, longitude, latitude) and on observed stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_asin
from .flows import shares
from .sequences import fill_forward, running_total


def _in_order():
    return W.partitionBy("user_id").orderBy("timeslot")


def compress(timeline: DataFrame) -> DataFrame:
    """The slots at which the position changes, first slot included."""
    same = (F.lag("longitude").over(_in_order()) == F.col("longitude")) & (F.lag("latitude").over(_in_order()) == F.col("latitude"))
    return timeline.withColumn("_s", F.coalesce(same, F.lit(False))).where("not _s").drop("_s")


def nearest_node(points: DataFrame, nodes: DataFrame, max_nodes: int = 10_000) -> DataFrame:
    """Each different position with the node nearest in degrees (ties: lower node). ``nodes`` (node, longitude, latitude) is a stated set of at most ``max_nodes``."""
    p = points.select("longitude", "latitude").distinct()
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    n = nodes.agg(F.collect_list(F.struct("node", "longitude", "latitude")).alias("_n"))
    d2 = lambda x: F.pow(x["longitude"] - F.col("longitude"), 2) + F.pow(x["latitude"] - F.col("latitude"), 2)
    each = F.transform("_n", lambda x: F.struct(d2(x).alias("d"), x["node"].alias("node")))
    return p.join(F.broadcast(n)).select("longitude", "latitude", F.array_min(each)["node"].alias("node"))


def user_trajectories(timeline: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per change of place: departure minute of the day, dwell in minutes (null for the last), node and day."""
    c = compress(timeline)
    d = c.withColumn("dwell_min", (F.lead("timeslot").over(_in_order()) - F.col("timeslot")) * 10)
    d = d.join(nearest_node(timeline, nodes), ["longitude", "latitude"])
    return d.select("user_id", "timeslot", F.floor((F.col("timeslot") - 1) / 144).alias("day"), ((F.col("timeslot") % 144) * 10).alias("departure_min"), "dwell_min", "node")


def user_stats(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("user_id").agg(F.max("timeslot").alias("max_slot"), F.countDistinct("location_type").alias("n_types"), F.countDistinct("longitude").alias("n_longitudes"), F.countDistinct("latitude").alias("n_latitudes"))


def type_transitions(timeline: DataFrame) -> DataFrame:
    d = timeline.select(F.lag("location_type").over(_in_order()).alias("from_type"), F.col("location_type").alias("to_type")).where("from_type is not null")
    return d.groupBy("from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))


def activity_by_hour(timeline: DataFrame) -> DataFrame:
    """Slots by type, by hour of the day and by slot modulo 24 (kept because earlier reports were made that way)."""
    d = timeline.withColumn("hour", F.floor(((F.col("timeslot") - 1) % 144) / 6)).withColumn("slot_mod24", F.col("timeslot") % 24)
    return d.groupBy("hour", "slot_mod24", "location_type").agg(F.count(F.lit(1)).alias("n"))


def trip_purposes(timeline: DataFrame) -> DataFrame:
    """Trips by hour: home-work (hbw), home-other (hbo), neither end at home (nhb). Each user starts at home; between two other places a change of position is a trip."""
    kind, prev = F.col("location_type"), F.coalesce(F.lag("location_type").over(_in_order()), F.lit("h"))
    moved = (F.lag("longitude").over(_in_order()) != F.col("longitude")) | (F.lag("latitude").over(_in_order()) != F.col("latitude"))
    d = timeline.select("timeslot", kind.alias("k"), prev.alias("p"), F.coalesce(moved, F.lit(False)).alias("m"))
    pair = F.array_join(F.array_sort(F.array("k", "p")), "")
    trip = F.when(pair == "hw", "hbw").when(pair == "ho", "hbo").when(pair == "ow", "nhb").when((pair == "oo") & F.col("m"), "nhb")
    d = d.withColumn("trip", trip).where("trip is not null").withColumn("hour", F.floor((((F.col("timeslot") - 1) % 144 + 143) % 144) / 6))
    return d.groupBy("hour").agg(*[F.count_if(F.col("trip") == x).alias(x) for x in ("hbw", "hbo", "nhb")])


def commuter_counts(timeline: DataFrame) -> DataFrame:
    w = timeline.groupBy("user_id").agg(F.max((F.col("location_type") == "w").cast("int")).alias("_w"))
    return w.agg(F.count(F.lit(1)).alias("num_users"), F.sum("_w").alias("num_users_work"))


def work_times(timeline: DataFrame) -> DataFrame:
    """Slots at which work begins and ends, counted."""
    k, p = F.col("location_type"), F.lag("location_type").over(_in_order())
    d = timeline.select("timeslot", F.when((k == "w") & (F.coalesce(p, F.lit("h")) != "w"), "begin").when((k != "w") & (p == "w"), "end").alias("what"))
    return d.where("what is not null").groupBy("what", "timeslot").agg(F.count(F.lit(1)).alias("n"))


def purpose_shares(trips: DataFrame) -> DataFrame:
    """Each purpose's share by hour, to be compared with survey tables of the same form."""
    every = W.partitionBy(F.lit(1))
    return trips.select("hour", *[(F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0))).alias(c) for c in ("hbw", "hbo", "nhb")])


def departure_validation(trips: DataFrame, surveys: dict[str, DataFrame]) -> DataFrame:
    """Shares of trips by hour beside those of survey tables.

    ``trips`` and each survey: hour, hbw, hbo, nhb. Returns hour and, for
    ``tg`` (the trips) and each survey's name, ``hbw_<name>``, ``hbo_<name>``,
    ``nhb_<name>`` and ``all_<name>``, each adding up to 1 over the hours that
    all tables have; a column without trips is null.
    """
    names = ("hbw", "hbo", "nhb", "all")
    d = None
    for n, t in {**surveys, "tg": trips}.items():
        t = t.select("hour", *[F.col(c).cast("double").alias(f"{c}_{n}") for c in names[:3]]).withColumn(f"all_{n}", F.col(f"hbw_{n}") + F.col(f"hbo_{n}") + F.col(f"nhb_{n}"))
        d = t if d is None else d.join(t, "hour")
    total = d.agg(*[F.sum(c).alias(f"_{c}") for c in d.columns if c != "hour"])
    return d.join(F.broadcast(total)).select("hour", *[(F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in d.columns if c != "hour"])


def combined_analysis(timeline: DataFrame, stays: DataFrame | None = None) -> dict[str, DataFrame]:
    """The measures that are looked at together: stay durations, daily locations, trip distances, and departures by purpose; observed durations where ``stays`` (caid, timestamp) are given."""
    out = {
        "stay_duration": duration_pdf(simulated_durations(timeline), 1 / 6),
        "daily_locations": daily_locations_pmf(daily_locations(timeline)),
        "trip_distance": trip_distance_pmf(trip_distances(compress(timeline))),
        "departures": purpose_shares(trip_purposes(timeline)),
    }
    return out | ({"observed_stay_duration": duration_pdf(observed_durations(stays), 1 / 6)} if stays is not None else {})


#: Names a timeline's columns may bear.
TIMELINE_NAMES = {"user_id": ("user_id", "user", "caid"), "timeslot": ("timeslot", "slot"), "location_type": ("location_type", "type", "purpose"), "longitude": ("longitude", "lon", "lng"), "latitude": ("latitude", "lat")}


def normalize_timeline(df: DataFrame, slot_s: int = 600) -> DataFrame:
    """user_id, timeslot (from 1), location_type, longitude, latitude from columns of other names; a ``datetime`` column stands for the slot, counted from the first day there."""
    have = {c.lower(): c for c in df.columns}
    at = {k: next((have[a] for a in al if a in have), None) for k, al in TIMELINE_NAMES.items()}
    if at["timeslot"] is None and "datetime" in have:
        first = df.agg(F.date_trunc("day", F.min(have["datetime"])).alias("_day0"))
        df = df.join(F.broadcast(first)).withColumn("_slot", (F.floor((F.unix_timestamp(have["datetime"]) - F.unix_timestamp("_day0")) / slot_s) + 1).cast("bigint"))
        at["timeslot"] = "_slot"
    missing = [k for k, v in at.items() if v is None]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(v).alias(k) for k, v in at.items()])


def duration_cdf(slots_: DataFrame, column: str = "duration") -> DataFrame:
    """(duration, cdf) of the positive durations."""
    n = slots_.where(F.col(column) > 0).groupBy(F.col(column).alias("duration")).agg(F.count(F.lit(1)).alias("_n"))
    n = running_total(n, ["duration"], F.col("_n"), "_to")
    return n.join(F.broadcast(n.agg(F.max("_to").alias("_all")))).select("duration", (F.col("_to") / F.col("_all")).alias("cdf"))


def simulated_durations(timeline: DataFrame) -> DataFrame:
    """Slots between changes of position."""
    return compress(timeline).select("user_id", (F.lead("timeslot").over(_in_order()) - F.col("timeslot")).alias("duration")).where("duration > 0")


def observed_durations(stays: DataFrame, user: str = "caid", time: str = "timestamp") -> DataFrame:
    """Ten-minute slots between a device's successive stays."""
    w = W.partitionBy(user).orderBy(time)
    return stays.select(F.col(user).alias("user_id"), ((F.lead(time).over(w) - F.col(time)) / 600.0).alias("duration")).where("duration > 0")


def duration_pdf(durations: DataFrame, to_hours: float, width: float = 0.25, most: float = 24.0) -> DataFrame:
    """(bin, density) of durations in hours, bins of ``width`` up to ``most``, the last closed."""
    h = F.col("duration") * F.lit(to_hours)
    last = int(most / width) - 1
    d = durations.where(h <= most).select(F.least(F.floor(h / width), F.lit(last)).cast("int").alias("bin"))
    return shares(d.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin").select("bin", (F.col("probability") / width).alias("density"))


def daily_locations(timeline: DataFrame) -> DataFrame:
    """Different positions per user and day."""
    d = timeline.withColumn("day", F.floor((F.col("timeslot") - 1) / 144))
    return d.groupBy("user_id", "day").agg(F.countDistinct("longitude", "latitude").alias("locations"))


def daily_locations_pmf(counts: DataFrame) -> DataFrame:
    return shares(counts.groupBy("locations").agg(F.count(F.lit(1)).alias("n")), "locations")


def trip_distances(points: DataFrame, user: str = "user_id", time: str = "timeslot") -> DataFrame:
    """Kilometres between successive different positions."""
    w = W.partitionBy(user).orderBy(time)
    km = haversine_asin(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return points.select(F.col(user).alias("user_id"), km.alias("km")).where("km > 0")


def trip_distance_pmf(trips: DataFrame) -> DataFrame:
    """Share of trips by kilometres rounded up."""
    return shares(trips.groupBy(F.ceil("km").alias("km_bin")).agg(F.count(F.lit(1)).alias("n")), "km_bin")


def location_ranks(points: DataFrame, top_n: int = 20, user: str = "user_id") -> DataFrame:
    """Share of visits that fall on each user's most visited, second most visited, ... place."""
    n = points.groupBy(user, "longitude", "latitude").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("rank", F.row_number().over(W.partitionBy(user).orderBy(F.desc("n"), "longitude", "latitude"))).where(F.col("rank") <= top_n)
    return shares(n.groupBy("rank").agg(F.sum("n").alias("n")), "rank")


def parse_results(lines: DataFrame) -> DataFrame:
    """Timeline from text rows (line_no, value): a line with one field names the user, others hold kind, longitude, latitude."""
    d = lines.withColumn("_f", F.split(F.trim("value"), r"\s+"))
    d = fill_forward(d, ["line_no"], F.when((F.size("_f") == 1) & (F.col("value") != ""), F.get("_f", F.lit(0))), "user_id").where(F.size("_f") == 3)
    slot = F.row_number().over(W.partitionBy("user_id").orderBy("line_no")).cast("bigint")
    return d.select("user_id", slot.alias("timeslot"), F.get("_f", F.lit(0)).alias("location_type"), F.get("_f", F.lit(1)).try_cast("double").alias("longitude"), F.get("_f", F.lit(2)).try_cast("double").alias("latitude"))
