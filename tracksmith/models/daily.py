"""Slot-based daily activity model: preparation of stays, estimation, simulation.

Steps take and give DataFrames; every random step is seeded by (seed, user), so
results do not depend on partitioning.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells, slots
from ..operators.sequences import running_total
from ..session import cut_lineage
from ..sources import tables

# Column names a stay table may use instead of the canonical ones.
ALIASES = {
    "caid": ("caid", "user_id", "userid"),
    "stay_start_timestamp": ("stay_start_timestamp", "timestamp", "unix_timestamp"),
    "h3_id_region": ("h3_id_region", "h3_region", "cell"),
    "type": ("type", "stay_type"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
}
_OPTIONAL = ("home_h3_index", "work_h3_index", "day_of_week")


def _rng(seed: int, user) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(user).encode())])


def _spread(users: DataFrame) -> DataFrame:
    """One small row a user means much computing: a fixed number of partitions keeps them from being put together by their bytes. By a hash, since an exchange by the user alone is dropped where one is there already."""
    spark = users.sparkSession
    return users.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("caid"))


def resolve_columns(df: DataFrame) -> DataFrame:
    """Columns renamed to the canonical names by case-insensitive alias, the first alias that is there; no column serves twice."""
    have, names = {c.lower(): c for c in df.columns}, {}
    for name, aliases in ALIASES.items():
        found = next((have[a] for a in aliases if a in have and have[a] not in names), None)
        if name not in df.columns and found:
            names[found] = name
    return df.withColumnsRenamed(names)


def from_original(stays: DataFrame) -> DataFrame:
    """Stays of the older layout, in which ``type`` 0 is home and 1 is work, in the canonical one."""
    kind = F.when(F.col("type") == 0, 1).when(F.col("type") == 1, 2).otherwise(0)
    return resolve_columns(stays).withColumn("type", kind)


# --- preparation -----------------------------------------------------------------------------


def align(stays: DataFrame, compat: str | None = None, system: str = "grid") -> DataFrame:
    """caid, h3_id_region, timestamp (seconds), type 0/1/2, zero, position of the cell, and optional columns that are there.

    Columns may bear any of the ``ALIASES``. ``type`` may hold labels or
    integers. The position is the cell's centre, or
    its first vertex with ``compat="vertex0"``; ``system`` says whose cells they
    are, and cells of the other raise an error.
    """
    stays = resolve_columns(stays)
    missing = [c for c in ("caid", "h3_id_region", "stay_start_timestamp", "type") if c not in stays.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kinds = dict(stays.dtypes)
    kind = slots.type_to_int(F.col("type")) if kinds["type"] == "string" else F.coalesce(F.col("type").cast("int"), F.lit(0))
    t = F.col("stay_start_timestamp")
    t = F.unix_timestamp(t) if kinds["stay_start_timestamp"].startswith("timestamp") else t.cast("bigint")
    cell = F.col("h3_id_region").cast("bigint")
    if system == "h3":  # each cell is placed once
        place = cells.first_vertex(F.col("_c"), system) if compat == "vertex0" else cells.cell_to_latlng(F.col("_c"), system)
        at_cells = stays.select(cell.alias("_c")).distinct().select("_c", place.alias("_at"))
        stays = stays.join(at_cells, cell.eqNullSafe(F.col("_c")), "left").drop("_c")
    at = F.col("_at") if system == "h3" else cells.first_vertex(cell) if compat == "vertex0" else cells.cell_to_latlng(cell)
    keep = [c for c in _OPTIONAL if c in stays.columns]
    return stays.select("caid", cell.alias("h3_id_region"), t.alias("timestamp"), kind.alias("type"), F.lit(0).alias("zero"), at["lat"].alias("latitude"), at["lng"].alias("longitude"), *keep)


def without_repeats(aligned: DataFrame) -> DataFrame:
    """One row per (caid, h3_id_region, timestamp)."""
    return aligned.dropDuplicates(["caid", "h3_id_region", "timestamp"])


_ORDER = ("timestamp", "longitude", "latitude")


def moves_only(stays: DataFrame) -> DataFrame:
    """Rows whose position differs from the one before, per device in time order."""
    w = W.partitionBy("caid").orderBy(*_ORDER)
    same = F.col("longitude").eqNullSafe(F.lag("longitude").over(w)) & F.col("latitude").eqNullSafe(F.lag("latitude").over(w)) & (F.row_number().over(w) > 1)
    return stays.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def frequent_users(stays: DataFrame, min_unique_locations: int = 15) -> DataFrame:
    """Devices with more than that many different positions."""
    return stays.groupBy("caid").agg(F.countDistinct("longitude", "latitude").alias("n_locations")).where(F.col("n_locations") > min_unique_locations)


def frequent_stays(stays: DataFrame, min_unique_locations: int = 15) -> DataFrame:
    """Their stays without repeats of position, with UTC date, hour and fractional hour."""
    d = moves_only(stays.join(frequent_users(stays, min_unique_locations).select("caid"), "caid", "left_semi"))
    t = F.timestamp_seconds("timestamp")
    return d.withColumn("date", slots.date_text(t)).withColumn("time", slots.fractional_hour(t))


def formatted(stays: DataFrame) -> DataFrame:
    """Each stay with ``location_index``: h or w where the device first came to the position as home or work, else 1.. by first visit; repeats collapsed."""
    first = stays.groupBy("caid", "longitude", "latitude").agg(F.min("timestamp").alias("_t"), F.min_by("type", F.struct("timestamp", "type")).alias("_k"))
    w = W.partitionBy("caid", F.col("_k").isin(1, 2)).orderBy("_t", "longitude", "latitude")
    number = F.row_number().over(w).cast("string")
    first = first.withColumn("location_index", F.when(F.col("_k") == 1, "h").when(F.col("_k") == 2, "w").otherwise(number)).drop("_t", "_k")
    d = stays.join(first, ["caid", "longitude", "latitude"]).withColumn("purpose", slots.purpose_letter(F.col("type")))
    o = W.partitionBy("caid").orderBy(*_ORDER)
    return d.withColumn("_p", F.lag("location_index").over(o)).where("_p is null or _p <> location_index").drop("_p")


# --- estimation --------------------------------------------------------------------------------


def gated_users(stays: DataFrame) -> DataFrame:
    """(caid, home, work): the last known home and work cell; devices lacking a home are left out, ``is_commuter`` tells who has a work cell."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("timestamp", c)))
    d = stays.groupBy("caid").agg(last("home_h3_index").alias("home"), last("work_h3_index").alias("work"))
    return d.where("home is not null").withColumn("is_commuter", F.col("work").isNotNull())


def daily_counts(stays: DataFrame) -> DataFrame:
    """Per device and UTC day: records, and places visited (home and work once, others each time)."""
    d = stays.groupBy("caid", F.floor(F.col("timestamp") / 86_400).alias("day"))
    n = F.count_if(F.col("type") == 0) + F.max((F.col("type") == 1).cast("int")) + F.max((F.col("type") == 2).cast("int"))
    return d.agg(F.count(F.lit(1)).alias("n"), n.alias("n_loc"))


def average_locations(counts: DataFrame, factor: float = 1.3) -> DataFrame:
    return counts.groupBy("caid").agg((F.avg("n_loc") * factor).alias("avg_loc_count"))


def inter_event_times(stays: DataFrame) -> DataFrame:
    """Positive seconds to a device's next stay, and the same in rounded hours."""
    w = W.partitionBy("caid").orderBy(*_ORDER)
    d = stays.select("caid", (F.lead("timestamp").over(w) - F.col("timestamp")).alias("dt_s"))
    return d.where("dt_s > 0").withColumn("dt_h", F.round(F.col("dt_s") / 3600.0).cast("int"))


def activeness(stays: DataFrame, by: str = "slot") -> DataFrame:
    """Share of stays other than at work by slot of the day, by weekday, or by both."""
    d = stays.where("type <> 2").select(slots.slot_of_day(F.col("timestamp")).alias("slot"), slots.day_number(F.col("timestamp")).alias("dow"))
    keys = {"slot": ["slot"], "dow": ["dow"], "both": ["dow", "slot"]}[by]
    d = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return d.select(*keys, (F.col("_n") / F.sum("_n").over(W.partitionBy(F.lit(1)))).alias("weight"))


BINS = 10


def time_cdf(times: DataFrame, reach: DataFrame, bins: int = BINS) -> DataFrame:
    """(caid, t0, t1, cdf): the empirical distribution function of each device's ``timestamp`` at the ends of ``bins`` equal parts of t0..t1 in ``reach`` (caid, t0, t1). Devices whose range is a point are left out."""
    d = times.select("caid", "timestamp").join(reach.where("t1 > t0"), "caid")
    part = F.least(F.floor((F.col("timestamp") - F.col("t0")) / (F.col("t1") - F.col("t0")) * bins), F.lit(bins - 1))
    d = d.groupBy("caid", "t0", "t1").agg(*[F.avg((part <= k).cast("double")).alias(f"_c{k}") for k in range(bins)])
    return d.select("caid", "t0", "t1", F.array(*[f"_c{k}" for k in range(bins)]).alias("cdf"))


def area_statistic(a: DataFrame, b: DataFrame, bins: int = BINS) -> DataFrame:
    """(caid, statistic): mean absolute difference of the distribution functions of the times (caid, timestamp) of ``a`` and ``b`` over their common range, of devices that stand in both; null where that range is a point."""
    ends = a.select("caid", "timestamp").unionByName(b.select("caid", "timestamp")).groupBy("caid").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    both = a.select("caid").distinct().join(b.select("caid").distinct(), "caid", "left_semi")
    x, y = (time_cdf(t, ends, bins).select("caid", F.col("cdf").alias(n)) for t, n in ((a, "_x"), (b, "_y")))
    gap = F.aggregate(F.zip_with("_x", "_y", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v) / bins
    return both.join(x, "caid", "left").join(y, "caid", "left").select("caid", gap.alias("statistic"))


@dataclass(frozen=True)
class GridSearch:
    """The two parameters of leaving home, by simulating every candidate over each device's own span.

    A slot after another a device moves with the probability of its state: from
    home exp(-n1 (|s - S/2| / S)^n2) at slot s of S; from work 0.05 in the hours
    9 to 17 and 0.3 else; from another place 0.3. From home it goes to work with
    0.6 if it has one, else elsewhere; from the others home with 0.7, then to
    work with 0.4 if it has one and is not there, else elsewhere. The step is a
    slot and an even draw of -300 to 299 s.
    """

    n1: tuple[int, ...] = (16, 17, 18, 19, 20)
    n2: tuple[int, ...] = (1, 2, 3, 4, 5)
    seed: int = 0
    utc_offset_s: int = 0

    def simulate(self, users: list[tuple], t0: np.ndarray, t1: np.ndarray, has_work: np.ndarray, only: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray, list]:
        """(distribution functions, work visits a day) of users x candidates, and for the candidates ``only`` their (user, instant, state) events; states are 1 home, 2 work, 3 elsewhere.

        The draws of a user depend on the seed and its name only.
        """
        rngs, pairs = [_rng(self.seed, u) for u in users], [(a, b) for a in self.n1 for b in self.n2]
        n, c, slot = len(users), len(pairs), np.arange(slots.DAY_SLOTS)
        leave = np.exp(-np.array([[a] for a, _ in pairs]) * (np.abs(slot - slots.DAY_SLOTS // 2) / slots.DAY_SLOTS) ** np.array([[b] for _, b in pairs]))
        cand, row = np.arange(c)[None, :], np.arange(n)[:, None]
        start, end, works = t0[:, None].astype(np.int64), t1[:, None].astype(np.int64), np.asarray(has_work, bool)[:, None]
        now, state, work = np.repeat(start, c, 1), np.ones((n, c), np.int8), np.zeros((n, c))
        last, hist = now.copy(), np.zeros((n, c, BINS))
        hist[:, :, 0] = 1
        events = [(np.arange(n), t0.astype(np.int64), np.ones(n, np.int8))] if only is not None else []
        live, k = now < end, block
        while live.any():
            if k == block:
                draws, k = np.stack([r.random((block, c, 4), np.float32) for r in rngs], 1), 0
            d = draws[k]
            k += 1
            now = np.where(live, now + slots.SLOT_S - 300 + np.floor(d[..., 0] * 600).astype(np.int64), now)
            live = now < end
            s = (now + self.utc_offset_s) % 86_400 // slots.SLOT_S
            home, at_work, hour = state == 1, state == 2, s * slots.SLOT_S // 3600
            p = np.where(home, leave[cand, s], np.where(at_work & (hour >= 9) & (hour <= 17), 0.05, 0.3))
            move = live & (d[..., 1] < p)
            away = np.where(d[..., 2] < 0.7, 1, np.where(works & ~at_work & (d[..., 3] < 0.4), 2, 3))
            new = np.where(home, np.where(works & (d[..., 2] < 0.6), 2, 3), away)
            state = np.where(move, new, state).astype(np.int8)
            work += move & (state == 2)
            last = np.where(move, now, last)
            part = np.minimum((now - start) * BINS // np.maximum(end - start, 1), BINS - 1)
            hist[np.broadcast_to(row, (n, c))[move], np.broadcast_to(cand, (n, c))[move], part[move]] += 1
            if only is not None:
                u = np.flatnonzero(move[np.arange(n), only])
                events.append((u, now[u, only[u]], state[u, only[u]]))
        days = (last - start) / 86_400.0
        return np.cumsum(hist, 2) / hist.sum(2, keepdims=True), np.where(days > 0, work / np.where(days > 0, days, 1), work), events

    def _spans(self, stays: DataFrame, users: DataFrame) -> DataFrame:
        ends = stays.groupBy("caid").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
        return time_cdf(stays, ends).join(users.select("caid", F.col("is_commuter").alias("has_work")), "caid")

    def _best(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cdf, nw, _ = self.simulate(pdf["caid"].tolist(), pdf["t0"].to_numpy(), pdf["t1"].to_numpy(), pdf["has_work"].to_numpy())
        area = np.abs(cdf - np.stack(pdf["cdf"].to_list())[:, None, :]).mean(2)
        best = area.argmin(1)
        at = np.arange(len(pdf))
        return best, nw[at, best], area[at, best]

    def fit(self, stays: DataFrame, users: DataFrame, at_once: int = 64) -> DataFrame:
        """(caid, b1, b2, nw, statistic): of each device the candidate whose event times are nearest to its own by :func:`area_statistic`, the first of equals; b1 and b2 are its numbers from 1, nw its visits to work a day.

        ``stays``: caid, timestamp; ``users``: caid, is_commuter. Only ten
        numbers a device reach the simulation; devices with a single instant
        have no span and are left out.
        """
        me, m = self, len(self.n2)

        def run(batches):
            for pdf in batches:
                for s in range(0, len(pdf), at_once):
                    one = pdf.iloc[s : s + at_once]
                    best, nw, area = me._best(one)
                    yield pd.DataFrame({"caid": one["caid"], "b1": best // m + 1, "b2": best % m + 1, "nw": nw, "statistic": area})

        return _spread(self._spans(stays, users)).mapInPandas(run, "caid string, b1 int, b2 int, nw double, statistic double")

    def trajectories(self, stays: DataFrame, users: DataFrame, positions: DataFrame, at_once: int = 64) -> DataFrame:
        """(caid, timestamp, location_type, longitude, latitude) of each device's best candidate.

        ``positions``: caid, home_longitude, home_latitude, work_longitude,
        work_latitude (the home's where there is no work). Other places lie up
        to 0.005 degrees from home or from work.
        """
        me = self
        cols = ["home_longitude", "home_latitude", "work_longitude", "work_latitude"]

        def run(batches):
            for pdf in batches:
                for s in range(0, len(pdf), at_once):
                    one = pdf.iloc[s : s + at_once].reset_index(drop=True)
                    best, _, _ = me._best(one)
                    _, _, events = me.simulate(one["caid"].tolist(), one["t0"].to_numpy(), one["t1"].to_numpy(), one["has_work"].to_numpy(), best)
                    u, t, kind = (np.concatenate(x) for x in zip(*events))
                    order = np.lexsort((t, u))
                    u, t, kind = u[order], t[order], kind[order]
                    jitter = np.concatenate([_rng(me.seed + 1, c).integers([0, -50, -50], [2, 50, 50], (int((u == i).sum()), 3)) for i, c in enumerate(one["caid"])])
                    at = one[cols].to_numpy(float)[u]
                    near_work = (kind == 2) | ((kind == 3) & (jitter[:, 0] == 1))
                    off = np.where((kind == 3)[:, None], jitter[:, 1:] * 1e-4, 0.0)
                    where = np.where(near_work[:, None], at[:, 2:], at[:, :2]) + off
                    yield pd.DataFrame({"caid": one["caid"].to_numpy()[u], "timestamp": t, "location_type": np.array(["", "h", "w", "o"])[kind], "longitude": where[:, 0], "latitude": where[:, 1]})

        d = self._spans(stays, users).join(positions.select("caid", *[F.col(c).cast("double") for c in cols]), "caid")
        return _spread(d).mapInPandas(run, "caid string, timestamp bigint, location_type string, longitude double, latitude double")


def decode_parameters(params: DataFrame, b1: list[float], b2: list[float]) -> DataFrame:
    """Indices ``b1`` and ``b2`` (from 0) replaced by the values at them; rows whose index is not there are left out."""
    value = lambda c, xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), F.col(c).cast("int"))
    return params.withColumns({"b1": value("b1", b1), "b2": value("b2", b2)}).where("b1 is not null and b2 is not null")


def match_users(params: DataFrame, places: DataFrame) -> DataFrame:
    """``params`` under the names of ``places``: the k-th name of one in order stands for the k-th of the other; rows beyond the shorter list are left out."""
    a = running_total(params.select("caid").distinct(), ["caid"], F.lit(1).cast("bigint"), "_k")
    b = running_total(places.select("caid").distinct(), ["caid"], F.lit(1).cast("bigint"), "_k").withColumnRenamed("caid", "_new")
    names = a.join(b, "_k").drop("_k")
    return params.join(names, "caid").select(*[F.col("_new").alias(c) if c == "caid" else F.col(c) for c in params.columns])


# --- places and parameters of the simulation ---------------------------------------------------------


def location_blocks(fmt: DataFrame) -> DataFrame:
    """Per device and place number: kind, visits, position, order of first visit. Home is h, work w, another place its index + 1."""
    number = F.coalesce(F.col("location_index").try_cast("int") + 1, F.lit(1)).cast("string")
    place = F.when(F.col("purpose") == "h", "h").when(F.col("purpose") == "w", "w").otherwise(number)
    at = F.struct("timestamp", "longitude", "latitude")
    d = fmt.withColumn("loc_id", place).groupBy("caid", "loc_id").agg(F.count(F.lit(1)).alias("count"), F.min_by("longitude", at).alias("longitude"), F.min_by("latitude", at).alias("latitude"), F.min("timestamp").alias("first_seen"))
    return d


def renumbered(blocks: DataFrame) -> DataFrame:
    """Home first with count 1 (the earliest place where none is called home), work kept, other places from 2 by first visit."""
    w = W.partitionBy("caid").orderBy(F.when(F.col("loc_id") == "h", 0).otherwise(1), "first_seen", "loc_id")
    d = blocks.withColumn("_r", F.row_number().over(w)).withColumn("kind", F.when(F.col("_r") == 1, "h").when(F.col("loc_id") == "w", "w").otherwise("o"))
    o = W.partitionBy("caid", "kind").orderBy("first_seen", "loc_id")
    new = F.when(F.col("kind") == "h", 0).when(F.col("kind") == "w", 1).otherwise(F.row_number().over(o) + 1)
    return d.withColumn("place", new.cast("int")).withColumn("count", F.when(F.col("kind") == "h", 1).otherwise(F.col("count"))).select("caid", "place", "kind", "count", "longitude", "latitude")


def other_places(blocks: DataFrame, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """The pool of positions for exploration: every place but (0, 0); below 1, a share of them drawn without replacement, at least one, the same on any cluster. ``blocks``: caid, loc_id, longitude, latitude."""
    d = blocks.where("not (longitude = 0 and latitude = 0)")
    if fraction < 1.0:
        n = max(1, int(d.count() * fraction))
        d = d.orderBy(F.xxhash64(F.lit(seed), "caid", "loc_id"), "caid", "loc_id").limit(n)
    return d.select("longitude", "latitude")


def default_pool(seed: int = 0, n: int = 100) -> np.ndarray:
    """Positions around one town, used where there is no pool at all."""
    # The town's position and the half width of the box in degrees.
    return np.array([-97.7, 30.3]) + np.random.default_rng(seed).uniform(-0.1, 0.1, (n, 2))


def default_activeness() -> tuple[np.ndarray, np.ndarray]:
    """Weights of 7 days and of 144 slots used where a measured pattern is unusable."""
    hour = np.arange(slots.DAY_SLOTS) // 6
    # Hours of high and medium activity, the weights of high, medium, low and night hours, and of Monday to Sunday.
    high, medium = (7, 8, 12, 17, 18), (9, 10, 11, 13, 14, 15, 16, 19, 20)
    weights, week = (0.25, 0.15, 0.08, 0.02), (0.16, 0.16, 0.16, 0.16, 0.15, 0.11, 0.10)
    day = np.select([np.isin(hour, high), np.isin(hour, medium), (hour >= 6) & (hour <= 22)], weights[:3], weights[3])
    return np.array(week), day / day.sum()


def usable(weights: np.ndarray) -> bool:
    return (weights > 0).sum() > 1 and weights.sum() > 0.1


def activeness_patterns(stays: DataFrame, users: DataFrame) -> np.ndarray:
    """2 x 7 x 144: the weights by weekday times those by slot, of devices without work and of commuters.

    ``stays``: caid, timestamp, type; ``users``: caid, is_commuter. Unusable
    weights of the first are replaced by those of the second, and those by the
    default. At most 2 x 7 x 144 rows reach the driver.
    """
    d = stays.where("type <> 2").join(users.select("caid", "is_commuter"), "caid").select("is_commuter", slots.slot_of_day(F.col("timestamp")).alias("slot"), slots.day_number(F.col("timestamp")).alias("dow"))
    got = {k: (np.zeros(7), np.zeros(slots.DAY_SLOTS)) for k in (False, True)}
    for who, dow, slot, n in d.groupBy("is_commuter", "dow", "slot").agg(F.count(F.lit(1)).alias("n")).collect():
        got[who][0][int(dow)] += n
        got[who][1][int(slot)] += n
    share = lambda v: v / max(v.sum(), 1.0)
    out = []
    for who in (False, True):
        parts = []
        for i in (0, 1):
            choices = (share(got[who][i]), share(got[True][i]))
            parts.append(next((v for v in choices if usable(v)), default_activeness()[i]))
        out.append(np.outer(*parts))
    return np.stack(out)


# Per group (regular, flexible commuters) the means, covariances and weights of start and length of work in minutes.
WORK_MIXTURES = (
    (
        ((474.17242116, 450.36415361), (454.76611398, 540.17150463), (770.23785795, 396.00232714)),
        (
            ((8458.74571565, -9434.51634444), (-9434.51634444, 36040.22889202)),
            ((3367.38775228, -1123.19558628), (-1123.19558628, 2680.86063147)),
            ((48035.69002421, -15435.34143709), (-15435.34143709, 68729.0782976)),
        ),
        (0.29480400442746502, 0.53352099305834633, 0.17167500251418938),
    ),
    (
        ((453.1255362, 544.63138923), (722.8546238, 326.65475739), (445.33662957, 550.82705344)),
        (
            ((3748.5636386, -1087.7059591), (-1087.7059591, 2962.05884783)),
            ((53499.35557041, 2503.97833801), (2503.97833801, 34339.63653221)),
            ((6649.97753593, -6920.24538877), (-6920.24538877, 34135.84244881)),
        ),
        (0.47180641829031889, 0.25403472847233199, 0.27415885323734995),
    ),
)


@dataclass(frozen=True)
class WorkDays:
    """When commuters work: one start and length a user, drawn from a mixture; on weekdays and at weekends by different odds."""

    work_prob_weekday: float = 0.829
    work_prob_weekend: float = 0.354
    regular_prob: float = 0.846
    mixture: int = 0
    seed: int = 0

    def _draw(self, rng) -> tuple[int, int]:
        """Whole minutes inside one day; draws outside are repeated."""
        mean, cov, w = WORK_MIXTURES[self.mixture]
        while True:
            k = int(rng.choice(len(w), p=np.array(w) / sum(w)))
            s, n = np.array(mean[k]) + np.linalg.cholesky(np.array(cov[k])) @ rng.standard_normal(2)
            if 0 < s < 1440 and 0 < n < 1440:
                return int(s), int(n)

    def parameters(self, users: DataFrame, num_days: int) -> DataFrame:
        """(caid, b1, b2, nw, is_commuter, regular, work_slots) of users with caid, b1, b2, nw, is_commuter."""
        me = self

        def run(batches):
            for pdf in batches:
                out = []
                for u, b1, b2, nw, com in zip(pdf["caid"], pdf["b1"], pdf["b2"], pdf["nw"], pdf["is_commuter"]):
                    rng, got = _rng(me.seed, u), []
                    reg = bool(rng.random() < me.regular_prob)
                    start, length = me._draw(rng) if com else (0, 0)
                    for day in range(num_days if com else 0):
                        if rng.random() < (me.work_prob_weekday if day % 7 < 5 else me.work_prob_weekend):
                            got += range(start // 10 + 144 * day, start // 10 + length // 10 + 144 * day + 1)  # past midnight too
                    out.append((u, b1, b2, nw, bool(com), reg, got))
                yield pd.DataFrame(out, columns=["caid", "b1", "b2", "nw", "is_commuter", "regular", "work_slots"])

        return users.select("caid", "b1", "b2", "nw", "is_commuter").mapInPandas(run, "caid string, b1 int, b2 int, nw double, is_commuter boolean, regular boolean, work_slots array<int>")


def best_parameters(params: DataFrame) -> DataFrame:
    """One row per device: one with work slots before one without, then the one with more of them, then the lower values."""
    w = W.partitionBy("caid").orderBy(F.desc(F.size("work_slots") > 0), F.desc(F.size("work_slots")), "b1", "b2", "nw")
    return params.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# --- simulation --------------------------------------------------------------------------------------


class Pool:
    """Positions, found by the rank of their distance without looking at all of them.

    They are laid along a space-filling curve and halved down to ``leaf``
    positions; a part wholly nearer or farther than what is sought is counted,
    not opened. 48 bytes a position.
    """

    def __init__(self, lonlat: np.ndarray, rank_exp: float = 0.86, leaf: int = 64):
        lonlat = np.asarray(lonlat, float).reshape(-1, 2)
        lonlat = lonlat[np.isfinite(lonlat).all(1)]
        code = np.zeros(len(lonlat), np.uint64)
        grid = [np.clip((lonlat[:, i] + top) / (2 * top) * 2**31, 0, 2**31 - 1).astype(np.uint64) for i, top in ((0, 180.0), (1, 90.0))]
        for bit in range(31):
            for i in (0, 1):
                code |= ((grid[i] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(2 * bit + i)
        self.lonlat = lonlat[np.lexsort((lonlat[:, 1], lonlat[:, 0], code))]
        self.xyz = self.point(self.lonlat[:, 0], self.lonlat[:, 1])
        self.cdf = np.cumsum(np.arange(1, len(lonlat) + 1, dtype=float) ** -rank_exp)
        depth = 0
        while len(lonlat) > leaf << depth:
            depth += 1
        self.edges = [(np.arange((1 << d) + 1) * len(lonlat)) >> d for d in range(depth + 1)]
        low, high = (f.reduceat(self.xyz, self.edges[-1][:-1]) for f in (np.minimum, np.maximum)) if len(lonlat) else (np.zeros((1, 3)),) * 2
        self.boxes = [(low, high)]
        for _ in range(depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.boxes.insert(0, (low, high))

    @staticmethod
    def point(lon, lat) -> np.ndarray:
        a, b = np.radians(lon), np.radians(lat)
        return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], -1)

    @staticmethod
    def _square(v: np.ndarray) -> np.ndarray:
        return v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1] + v[:, 2] * v[:, 2]

    def _levels(self, at: np.ndarray):
        """For each level the parts kept by the caller's last ``send``: count, least and most squared chord."""
        parts = np.zeros(1, np.int64)
        for e, (low, high) in zip(self.edges, self.boxes):
            a, b = low[parts] - at, at - high[parts]
            keep = yield e[parts + 1] - e[parts], self._square(np.maximum(np.maximum(a, b), 0.0)), self._square(np.maximum(np.abs(a), np.abs(b)))
            kept = parts[keep]
            parts = np.concatenate([2 * kept, 2 * kept + 1])
        rows = np.concatenate([np.arange(self.edges[-1][k], self.edges[-1][k + 1]) for k in np.sort(kept)]) if len(kept) else np.zeros(0, np.int64)
        yield rows, self._square(self.xyz[rows] - at), None

    def within(self, at: np.ndarray, km: float) -> int:
        """Positions at most ``km`` away."""
        most, n, walk = 4 * np.sin(km / 2 / 6371.0) ** 2, 0, self._levels(at)
        count, near, far = next(walk)
        while far is not None:
            n += int(count[far <= most].sum())
            count, near, far = walk.send((far > most) & (near <= most))
        return n + int((near <= most).sum())

    def nth(self, at: np.ndarray, k: int) -> int:
        """The number of the position that ``k`` others are nearer than, those at the same distance in the order of the curve."""
        walk = self._levels(at)
        count, near, far = next(walk)
        while far is not None:
            least, most = (v[o][np.searchsorted(np.cumsum(count[o]), k, "right")] for v, o in ((near, np.argsort(near)), (far, np.argsort(far))))
            k -= int(count[far < least].sum())
            count, near, far = walk.send((far >= least) & (near <= most))
        return int(count[np.argsort(near, kind="stable")[k]])


@dataclass(frozen=True)
class DayModel:
    """The slot simulator. Defaults are those of the published model."""

    num_days: int = 1
    rho: float = 0.6
    gamma: float = -0.21
    seed: int = 0
    lunch_prob: float = 0.22194
    near_km: float = 0.6
    rank_exp: float = 0.86

    def _lunch(self, rng, spans: list[list[int]]) -> list[list[int]]:
        """Some work spans are split by a break of lognormal length, its middle shifted by a truncated Cauchy share of what is left."""
        out = []
        for a, z in spans:
            work = 10.0 * (z - a)
            if rng.random() >= self.lunch_prob or work <= 0:
                out.append([a, z])
                continue
            length, shift = next((x for x in rng.lognormal(3.75106, 0.681418, 10_000) if x < work), 0.0), 1.0
            while not -0.5 < shift < 0.5:
                shift = 0.1 * rng.standard_cauchy()
            middle = 5.0 * (a + z) + (work - length) * shift
            out += [[a, int((middle - length / 2) / 10)], [int((middle + length / 2) / 10), z]]
        return out

    def _other(self, rng, here: int, lon: list, lat: list, count: list, pool: Pool) -> int:
        """Back to a known other place by its visits, or to a new one by the rank of its distance beyond ``near_km``. Places 0 and 1 are home and work."""
        new = self.rho * (len(lon) - 1) ** self.gamma
        back = 0.6 * (1 - new)
        known = [j for j in range(2, len(lon)) if j != here and count[j] > 0]
        far = 0
        if not known or rng.random() >= back / (back + new):
            at = pool.point(lon[here], lat[here])
            near = pool.within(at, self.near_km)
            far = len(pool.lonlat) - near
        if far:
            k = pool.nth(at, near + int(np.searchsorted(pool.cdf[:far], rng.random() * pool.cdf[far - 1])))
            lon.append(float(pool.lonlat[k, 0]))
            lat.append(float(pool.lonlat[k, 1]))
            count.append(0)
            return len(lon) - 1
        if known:
            c = np.array([count[j] for j in known], float)
            return known[int(rng.choice(len(known), p=c / c.sum()))]
        return 0

    def one_user(self, user, b1, b2, nw, work_slots, places: list[tuple], pool: Pool, pattern: np.ndarray) -> list[tuple]:
        """(slot, kind, longitude, latitude) per slot; without any place nothing, without work the home stands for it."""
        if not places:
            return []
        rng = _rng(self.seed, user)
        at = {p: (lo, la, c) for p, lo, la, c in places}
        home = at.get(0) or at.get(1) or places[0][1:]
        work = at.get(1) or home
        lon, lat, count = [home[0], work[0]], [home[1], work[1]], [1, 1]
        for p in sorted(at):
            if p > 1:
                lon.append(at[p][0])
                lat.append(at[p][1])
                count.append(at[p][2])
        n = 144 * self.num_days
        spans: list[list[int]] = []
        for s in sorted({x for x in work_slots if x < n}):
            if spans and s == spans[-1][1] + 1:
                spans[-1][1] = s
            else:
                spans.append([s, s])
        at_work, between, days = np.zeros(n, bool), np.zeros(n, bool), {}
        for a, z in self._lunch(rng, spans):
            at_work[a : z + 1] = True
            days.setdefault(a // 144, []).append((a, z))
        for parts in days.values():
            for (_, z), (a, _) in zip(parts, parts[1:]):
                between[z + 1 : a] = True
        a_max, here, out = pattern.max(), 0, []
        for s in range(n):
            act = pattern[(s // 144) % 7, s % 144]
            if at_work[s]:
                here = 1
            else:
                left = here == 1 and s > 0 and at_work[s - 1]
                go = rng.random()
                leave = nw * act if here == 0 else b1 * nw * act
                if left or go < leave:
                    to_home = 0.0 if between[s] else 1 - b2 * nw * act
                    if s % 144 > 96 and not between[s]:
                        to_home = max(to_home, 1 - act / max(a_max, 1e-12))
                    if here != 0 and rng.random() < to_home:
                        here = 0
                    else:
                        here = self._other(rng, here, lon, lat, count, pool)
                        count[here] += 1
            out.append((s + 1, "h" if here == 0 else "w" if here == 1 else "o", lon[here], lat[here]))
        return out

    def simulate(self, params: DataFrame, places: DataFrame, pool: DataFrame, patterns: np.ndarray) -> DataFrame:
        """(user_id, timeslot, location_type, longitude, latitude) of every user with parameters and places; ``patterns`` are those of :func:`activeness_patterns`.

        The exploration pool, of any size, is sent to the tasks as a
        :class:`Pool`; the driver holds it once while it is built.
        """
        pts = pool.orderBy("longitude", "latitude").toPandas()[["longitude", "latitude"]].to_numpy(float)
        side = params.sparkSession.sparkContext.broadcast((Pool(pts if len(pts) else default_pool(self.seed), self.rank_exp), patterns))
        me = self
        p = places.groupBy("caid").agg(F.array_sort(F.collect_list(F.struct("place", "longitude", "latitude", "count"))).alias("places"))
        d = params.join(p, "caid")

        def run(batches):
            pts, patterns = side.value
            for pdf in batches:
                for u, b1, b2, nw, com, ws, pl in zip(*(pdf[c] for c in ("caid", "b1", "b2", "nw", "is_commuter", "work_slots", "places"))):
                    rows = me.one_user(u, b1, b2, nw, list(ws), [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in pl], pts, patterns[int(com)])
                    if rows:
                        yield pd.DataFrame(rows, columns=["timeslot", "location_type", "longitude", "latitude"]).assign(user_id=u)[["user_id", "timeslot", "location_type", "longitude", "latitude"]]

        return _spread(d.select("caid", "b1", "b2", "nw", "is_commuter", "work_slots", "places")).mapInPandas(run, "user_id string, timeslot bigint, location_type string, longitude double, latitude double")


@dataclass
class TimeGeo:
    """Fit and generate in one object; the steps above can be used without it."""

    num_days: int = 1
    min_unique_locations: int = 15
    rho: float = 0.6
    gamma: float = -0.21
    slot_interval: int = slots.SLOT_S
    sample_fraction: float = 1.0
    seed: int = 0
    system: str = "grid"
    fitted: dict | None = None

    def fit(self, stays: DataFrame) -> "TimeGeo":
        aligned = cut_lineage(without_repeats(align(stays, system=self.system)))
        some = frequent_stays(aligned, self.min_unique_locations)
        users = gated_users(some)
        fmt = cut_lineage(formatted(some.join(users.select("caid"), "caid", "left_semi")))
        b = GridSearch(seed=self.seed).fit(fmt, users).join(users, "caid")
        params = cut_lineage(best_parameters(WorkDays(seed=self.seed).parameters(b, self.num_days)))
        blocks = location_blocks(fmt)
        self.fitted = {"aligned": aligned, "params": params, "places": renumbered(blocks), "pool": other_places(blocks, self.sample_fraction, self.seed), "patterns": activeness_patterns(fmt, users), "users": users}
        return self

    def save(self, folder: str, block_mb: int = 64) -> list[str]:
        """The fitted tables under ``folder``, in row groups of at most ``block_mb`` for readers with little memory."""
        f = self._need()
        return [tables.write(f[name], folder, name, block_mb=block_mb) for name in ("aligned", "params", "places", "pool", "users")]

    def stats(self) -> dict[str, int]:
        f = self._need()
        return {"num_users": f["users"].count(), "num_commuters": f["users"].where("is_commuter").count(), "num_noncommuters": f["users"].where("not is_commuter").count(), "num_locations": f["places"].count()}

    def _need(self) -> dict:
        if self.fitted is None:
            raise RuntimeError("fit before generating")
        return self.fitted

    def generate(self, n_agents: int | None = None) -> DataFrame:
        """(user, datetime, location_type, longitude, latitude) of all users, or of the first ``n_agents`` by name where a number above 0 is given."""
        f = self._need()
        users = f["params"].orderBy("caid").limit(n_agents) if n_agents is not None and n_agents > 0 else f["params"]
        t = DayModel(self.num_days, self.rho, self.gamma, self.seed).simulate(users, f["places"], f["pool"], f["patterns"])
        return t.select(F.col("user_id").alias("user"), F.timestamp_seconds((F.col("timeslot") - 1) * self.slot_interval).alias("datetime"), "location_type", "longitude", "latitude")

    def cleanup(self) -> None:
        self.fitted = None
