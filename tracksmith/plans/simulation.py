"""Queries of the models: gravity, exploration and return, daily activity, timeline measures, areal interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, slots
from ..models import daily
from ..models.epr import EPR, trajectory_flows
from ..models.gravity import Gravity, pair_distances
from ..operators import areal, flows, timelines
from ..session import cut_lineage
from .fixtures import TIMELINE_SQL, timeline
from .mobility import RES, STAYS_SQL, canonical, center_sql, parent_sql, rounded, vincenty_sql

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- gravity ---------------------------------------------------------------------------------
# Tiles: the cells at resolution 6, relevance their stays, outflow their departures.

P6 = parent_sql("cell", RES, 6)
_C6 = center_sql("tile", 6)
_TILES = f"""st AS (SELECT caid, local_time, {P6} tile FROM ({STAYS_SQL})),
fl AS (SELECT o origin, tile destination, CAST(count(*) AS BIGINT) flow FROM (SELECT tile, lag(tile) OVER (PARTITION BY caid ORDER BY local_time, tile) o FROM st) WHERE o <> tile GROUP BY 1, 2),
ti AS (SELECT st.tile, CAST(count(*) AS DOUBLE) relevance, coalesce(max(w.s), 0e0) tot_outflow FROM st LEFT JOIN (SELECT origin, CAST(sum(flow) AS DOUBLE) s FROM fl GROUP BY origin) w ON w.origin = st.tile GROUP BY st.tile),
pr AS (SELECT a.tile i, b.tile j, {_C6[0].replace("tile", "a.tile")} la, {_C6[1].replace("tile", "a.tile")} lo, {_C6[0].replace("tile", "b.tile")} lb, {_C6[1].replace("tile", "b.tile")} lp FROM ti a, ti b WHERE a.tile < b.tile),
{vincenty_sql("pr", "i, j", "la", "lo", "lb", "lp")}, pa AS (SELECT i, j, km FROM vd UNION ALL SELECT j, i, km FROM vd),
sc AS (SELECT i, j, pow(km, -2e0) * y.relevance * x.relevance s, x.tot_outflow w FROM pa JOIN ti x ON x.tile = i JOIN ti y ON y.tile = j)"""


def _tiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = cut_lineage(canonical(spark, d).select("caid", "local_time", cells.parent(F.col("cell"), 6).alias("cell")))
    t = flows.tessellation(s)
    f = flows.transition_counts(s, t).withColumnRenamed("n", "flow")
    out = f.groupBy(F.col("origin").alias("cell")).agg(F.sum("flow").cast("double").alias("tot_outflow"))
    t = t.join(out, "cell", "left").select(F.col("cell").alias("tile"), F.col("stay_count").cast("double").alias("relevance"), F.coalesce("tot_outflow", F.lit(0.0)).alias("tot_outflow"), "latitude", "longitude")
    return t, f


@query(f"WITH {_TILES} SELECT i, j, round(km, 6) km FROM pa")
def gravity_distances(spark, d):
    return rounded(pair_distances(_tiles(spark, d)[0]), km=6)


@query(f"WITH {_TILES} SELECT i, j, round(km, 6) km FROM pa WHERE km <= 8e0")
def gravity_distances_near(spark, d):
    return rounded(pair_distances(_tiles(spark, d)[0], 8.0), km=6)


def _probs(spark, d, **params) -> DataFrame:
    t, _ = _tiles(spark, d)
    return rounded(Gravity(**params).generate(t, pair_distances(t), "probabilities"), probability=9)


@query(f"WITH {_TILES} SELECT i origin, j destination, round(s / sum(s) OVER (PARTITION BY i), 9) probability FROM sc WHERE s > 0")
def gravity_probabilities_single(spark, d):
    return _probs(spark, d)


@query(f"WITH {_TILES} SELECT i origin, j destination, round(s / sum(s) OVER (), 9) probability FROM sc WHERE s > 0")
def gravity_probabilities_global(spark, d):
    return _probs(spark, d, gravity_type="global")


@query(f"WITH {_TILES} SELECT j origin, i destination, round(s / sum(s) OVER (PARTITION BY j), 9) probability FROM sc WHERE s > 0")
def gravity_probabilities_compat(spark, d):
    return _probs(spark, d, compat=True)


@query(f"WITH {_TILES} SELECT i origin, j destination, round(p * w, 6) flow FROM (SELECT i, j, w, s / sum(s) OVER (PARTITION BY i) p FROM sc WHERE s > 0) WHERE p * w > 0")
def gravity_flows(spark, d):
    t, _ = _tiles(spark, d)
    return rounded(Gravity().generate(t, pair_distances(t), "flows"), flow=6)


@query(f"WITH {_TILES} SELECT i origin, j destination, round(p * w, 6) flow FROM (SELECT i, j, w, s / sum(s) OVER () p FROM sc WHERE s > 0) WHERE p * w > 0")
def gravity_flows_global(spark, d):
    t, _ = _tiles(spark, d)
    return rounded(Gravity(gravity_type="global").generate(t, pair_distances(t), "flows"), flow=6)


@query(f"WITH {_TILES} SELECT tile origin, CAST(tot_outflow AS BIGINT) flow FROM ti WHERE tot_outflow > 0")
def gravity_flows_sample(spark, d):
    """The draws of each origin add up to its outflow."""
    t, _ = _tiles(spark, d)
    return Gravity().generate(t, pair_distances(t), "flows_sample", seed=5).groupBy("origin").agg(F.sum("flow").cast("bigint").alias("flow"))


@query(f"WITH {_TILES} SELECT CAST(sum(tot_outflow) AS BIGINT) flow, CAST(0 AS BIGINT) strangers FROM ti")
def gravity_flows_sample_global(spark, d):
    """The draws add up to all outflow, and fall on pairs that have a probability."""
    t, _ = _tiles(spark, d)
    g, x = Gravity(gravity_type="global"), pair_distances(t)
    s = cut_lineage(g.generate(t, x, "flows_sample", seed=5))
    odd = s.join(g.generate(t, x, "probabilities"), ["origin", "destination"], "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    return s.agg(F.sum("flow").cast("bigint").alias("flow")).join(F.broadcast(odd))


@query(f"WITH {_TILES} SELECT origin, destination, flow, round(ln(x.relevance), 9) ln_origin, round(ln(y.relevance), 9) ln_destination, round(ln(km), 9) cost FROM fl JOIN ti x ON x.tile = origin JOIN ti y ON y.tile = destination JOIN pa ON i = origin AND j = destination")
def gravity_training(spark, d):
    t, f = _tiles(spark, d)
    return rounded(Gravity().training_set(f, t, pair_distances(t)), ln_origin=9, ln_destination=9, cost=9)


@query()
def gravity_fit(spark, d):
    t, f = map(cut_lineage, _tiles(spark, d))
    x = pair_distances(t)
    out = []
    for kind in ("single", "global"):
        g = Gravity(gravity_type=kind)
        g = g.fit(g.training_set(f, t, x))
        out.append((kind, g.origin_exp, g.destination_exp, g.deterrence_func_arg))
    return spark.createDataFrame(out, "gravity_type string, origin_exp double, destination_exp double, deterrence double")


# --- exploration and preferential return --------------------------------------------------------


def _epr(spark, d):
    s = cut_lineage(canonical(spark, d))
    t = cut_lineage(flows.tessellation(s))
    return EPR().generate(flows.transition_matrix(flows.transition_counts(s, t)), t, 200, "2024-01-01", "2024-01-15", seed=3)


@query()
def epr_trajectories(spark, d):
    return _epr(spark, d)


@query()
def epr_flows(spark, d):
    return trajectory_flows(_epr(spark, d))


@query(f"SELECT o origin, p destination, CAST(count(*) AS BIGINT) flow FROM (SELECT cell o, lead(cell) OVER (PARTITION BY CAST(caid AS BIGINT) ORDER BY stay_start, cell) p FROM ({STAYS_SQL})) WHERE p IS NOT NULL AND o <> p GROUP BY 1, 2")
def trajectory_flow_counts(spark, d):
    """Flows of given trajectories: the stays themselves."""
    s = canonical(spark, d).select(F.col("caid").cast("bigint").alias("user"), F.col("stay_start_timestamp").alias("datetime"), F.col("cell").alias("location"))
    return trajectory_flows(s)


# --- daily activity model ----------------------------------------------------------------------------

_CC = center_sql("cell", RES)
_AL = f"al AS (SELECT caid, cell h3_id_region, stay_start t, type, {_CC[0]} la, {_CC[1]} lo, home_h3_index, work_h3_index, day_of_week FROM ({STAYS_SQL}))"
_MV = f"""WITH {_AL}, mv AS (SELECT * FROM (SELECT *, lag(la) OVER u pla, lag(lo) OVER u plo FROM (SELECT DISTINCT ON (caid, h3_id_region, t) * FROM al) WINDOW u AS (PARTITION BY caid ORDER BY t, lo, la)) WHERE pla IS NULL OR pla <> la OR plo <> lo),
fq AS (SELECT caid, count(DISTINCT (lo, la)) n_locations FROM mv GROUP BY caid HAVING count(DISTINCT (lo, la)) > 1),
fs AS (SELECT mv.* FROM mv WHERE caid IN (SELECT caid FROM fq)),
fp AS (SELECT caid, lo, la, min(t) t0, arg_min(type, (t, type)) k FROM fs GROUP BY caid, lo, la),
fi AS (SELECT caid, lo, la, CASE k WHEN 1 THEN 'h' WHEN 2 THEN 'w' ELSE CAST(row_number() OVER (PARTITION BY caid, k IN (1, 2) ORDER BY t0, lo, la) AS VARCHAR) END ix FROM fp),
fm AS (SELECT * FROM (SELECT fs.*, ix, CASE type WHEN 1 THEN 'h' WHEN 2 THEN 'w' ELSE 'o' END purpose, lag(ix) OVER (PARTITION BY fs.caid ORDER BY t, fs.lo, fs.la) px FROM fs JOIN fi ON fs.caid = fi.caid AND fs.lo = fi.lo AND fs.la = fi.la) WHERE px IS NULL OR px <> ix)"""


def _aligned(spark, d):
    return daily.without_repeats(daily.align(canonical(spark, d)))


def _frequent(spark, d):
    return daily.frequent_stays(_aligned(spark, d), 1)


def _fmt(spark, d):
    return daily.formatted(_frequent(spark, d))


@query(f"WITH {_AL} SELECT caid, h3_id_region, t AS timestamp, type, 0 AS zero, round(la, 9) latitude, round(lo, 9) longitude, home_h3_index, work_h3_index, day_of_week FROM (SELECT DISTINCT ON (caid, h3_id_region, t) * FROM al)")
def tg_aligned(spark, d):
    return rounded(_aligned(spark, d), latitude=9, longitude=9)


@query(f"{_MV} SELECT caid, t AS timestamp, round(la, 9) latitude, round(lo, 9) longitude FROM mv")
def tg_moves(spark, d):
    return rounded(daily.moves_only(_aligned(spark, d)).select("caid", "timestamp", "latitude", "longitude"), latitude=9, longitude=9)


@query(f"{_MV} SELECT * FROM fq")
def tg_frequent_users(spark, d):
    return daily.frequent_users(daily.moves_only(_aligned(spark, d)), 1)


@query(f"{_MV} SELECT caid, t AS timestamp, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d') date, round((t % 86400) // 3600 + (t % 3600) // 60 / 60e0 + (t % 60) / 3600e0, 9) AS time FROM fs")
def tg_frequent_stays(spark, d):
    return rounded(_frequent(spark, d).select("caid", "timestamp", "date", "time"), time=9)


@query(f"{_MV} SELECT caid, t AS timestamp, ix location_index, purpose FROM fm")
def tg_formatted(spark, d):
    return _fmt(spark, d).select("caid", "timestamp", "location_index", "purpose")


@query(f"WITH {_AL} SELECT caid, arg_max(home_h3_index, t) home, arg_max(work_h3_index, t) FILTER (work_h3_index IS NOT NULL) work, arg_max(work_h3_index, t) FILTER (work_h3_index IS NOT NULL) IS NOT NULL is_commuter FROM al WHERE home_h3_index IS NOT NULL GROUP BY caid")
def tg_gated_users(spark, d):
    return daily.gated_users(_aligned(spark, d))


_DN = "dn AS (SELECT caid, t // 86400 AS day, CAST(count(*) AS BIGINT) n, CAST(count(*) FILTER (type = 0) + max(CAST(type = 1 AS INT)) + max(CAST(type = 2 AS INT)) AS BIGINT) n_loc FROM fm GROUP BY 1, 2)"


@query(f"{_MV}, {_DN} SELECT * FROM dn")
def tg_daily_counts(spark, d):
    return daily.daily_counts(_fmt(spark, d))


@query(f"{_MV}, {_DN} SELECT caid, round(avg(n_loc) * 1.3e0, 9) avg_loc_count FROM dn GROUP BY caid")
def tg_average_locations(spark, d):
    return rounded(daily.average_locations(daily.daily_counts(_fmt(spark, d))), avg_loc_count=9)


@query(f"{_MV} SELECT caid, dt_s, CAST(round(dt_s / 3600e0) AS INT) dt_h FROM (SELECT caid, lead(t) OVER (PARTITION BY caid ORDER BY t, lo, la) - t dt_s FROM fm) WHERE dt_s > 0")
def tg_inter_event_times(spark, d):
    return daily.inter_event_times(_fmt(spark, d))


@query(f"{_MV} SELECT dow, slot, round(n / sum(n) OVER (), 12) weight FROM (SELECT (t // 86400) % 7 dow, (t % 86400) // 600 slot, count(*) n FROM fm WHERE type <> 2 GROUP BY 1, 2)")
def tg_activeness(spark, d):
    return rounded(daily.activeness(_fmt(spark, d), "both"), weight=12)


@query(f"{_MV} SELECT slot, round(n / sum(n) OVER (), 12) weight FROM (SELECT (t % 86400) // 600 slot, count(*) n FROM fm WHERE type <> 2 GROUP BY 1)")
def tg_activeness_daily(spark, d):
    return rounded(daily.activeness(_fmt(spark, d), "slot"), weight=12)


@query(f"{_MV} SELECT dow, round(n / sum(n) OVER (), 12) weight FROM (SELECT (t // 86400) % 7 dow, count(*) n FROM fm WHERE type <> 2 GROUP BY 1)")
def tg_activeness_weekly(spark, d):
    return rounded(daily.activeness(_fmt(spark, d), "dow"), weight=12)


_BL = """bl AS (SELECT caid, CASE WHEN purpose IN ('h', 'w') THEN purpose ELSE CAST(coalesce(try_cast(ix AS INT) + 1, 1) AS VARCHAR) END loc_id, t, lo, la FROM fm),
lb AS (SELECT caid, loc_id, CAST(count(*) AS BIGINT) AS count, arg_min(lo, (t, lo, la)) longitude, arg_min(la, (t, lo, la)) latitude, min(t) first_seen FROM bl GROUP BY caid, loc_id)"""


@query(f"{_MV}, {_BL} SELECT caid, loc_id, count, round(longitude, 9) longitude, round(latitude, 9) latitude, first_seen FROM lb")
def tg_location_blocks(spark, d):
    return rounded(daily.location_blocks(_fmt(spark, d)), longitude=9, latitude=9)


@query(f"""{_MV}, {_BL}, rk AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY caid ORDER BY CASE WHEN loc_id = 'h' THEN 0 ELSE 1 END, first_seen, loc_id) = 1 THEN 'h' WHEN loc_id = 'w' THEN 'w' ELSE 'o' END kind FROM lb)
SELECT caid, CAST(CASE kind WHEN 'h' THEN 0 WHEN 'w' THEN 1 ELSE row_number() OVER (PARTITION BY caid, kind ORDER BY first_seen, loc_id) + 1 END AS INT) place, kind, CASE kind WHEN 'h' THEN 1 ELSE count END AS count, round(longitude, 9) longitude, round(latitude, 9) latitude FROM rk""")
def tg_places(spark, d):
    return rounded(daily.renumbered(daily.location_blocks(_fmt(spark, d))), longitude=9, latitude=9)


@query(f"{_MV}, {_BL} SELECT round(longitude, 9) longitude, round(latitude, 9) latitude FROM lb WHERE NOT (longitude = 0 AND latitude = 0)")
def tg_other_places(spark, d):
    return rounded(daily.other_places(daily.location_blocks(_fmt(spark, d))), longitude=9, latitude=9)


@query()
def tg_grid_search(spark, d):
    f = cut_lineage(_fmt(spark, d))
    return daily.GridSearch(seed=1).fit(f, daily.gated_users(f))


_AREA = """ht AS (SELECT caid, t FROM fm WHERE type = 1), xt AS (SELECT caid, t FROM fm WHERE type <> 1),
rg AS (SELECT caid, min(t) t0, max(t) t1 FROM fm WHERE caid IN (SELECT caid FROM ht) AND caid IN (SELECT caid FROM xt) GROUP BY caid),
ks AS (SELECT CAST(k AS BIGINT) k FROM range(0, 10) q(k)),
cf AS (SELECT rg.caid, k, avg(CASE WHEN least((h.t - t0) * 10 // (t1 - t0), 9) <= k THEN 1e0 ELSE 0e0 END) a FROM rg JOIN ht h ON h.caid = rg.caid, ks GROUP BY rg.caid, k),
cg AS (SELECT rg.caid, k, avg(CASE WHEN least((h.t - t0) * 10 // (t1 - t0), 9) <= k THEN 1e0 ELSE 0e0 END) b FROM rg JOIN xt h ON h.caid = rg.caid, ks GROUP BY rg.caid, k)"""


@query(f"{_MV}, {_AREA} SELECT caid, round(sum(abs(a - b)) / 10, 9) statistic FROM cf JOIN cg USING (caid, k) GROUP BY caid")
def tg_area_statistic(spark, d):
    """Of each device, how differently its arrivals at home and elsewhere are spread over its time."""
    f = cut_lineage(_fmt(spark, d))
    return rounded(daily.area_statistic(f.where("type = 1"), f.where("type <> 1")), statistic=9)


@query()
def tg_trajectories(spark, d):
    """The best candidate of each device, with positions."""
    f = cut_lineage(_fmt(spark, d))
    b = daily.renumbered(daily.location_blocks(f))
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    pos = b.groupBy("caid").agg(*[F.coalesce(at(k, c), at(0, c)).alias(f"{n}_{c}") for k, n in ((0, "home"), (1, "work")) for c in ("longitude", "latitude")])
    return daily.GridSearch(seed=1).trajectories(f, daily.gated_users(f), pos)


@query(f"{_MV}, {_BL}, pb AS (SELECT * FROM lb WHERE NOT (longitude = 0 AND latitude = 0)) SELECT greatest(1, CAST(floor(count(*) * 0.02e0) AS BIGINT)) n, CAST(0 AS BIGINT) strangers FROM pb")
def tg_other_sample(spark, d):
    """A fiftieth of the pool: how many positions, and how many of them are not in the pool."""
    b = cut_lineage(daily.location_blocks(_fmt(spark, d)))
    some = cut_lineage(daily.other_places(b, 0.02, 7))
    missing = some.join(daily.other_places(b), ["longitude", "latitude"], "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    return some.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(missing))


@query(f"{_MV} SELECT caid, CAST(1 + k % 6 AS DOUBLE) b1, CAST(10 * (1 + n % 6) AS DOUBLE) b2 FROM (SELECT caid, count(*) n, count(DISTINCT ix) k FROM fm GROUP BY caid) WHERE k % 6 < 5 AND n % 6 < 5")
def tg_decoded(spark, d):
    """Indices made of two counts, decoded; those beyond the table are left out."""
    p = _fmt(spark, d).groupBy("caid").agg((F.countDistinct("location_index") % 6).alias("b1"), (F.count(F.lit(1)) % 6).alias("b2"))
    return daily.decode_parameters(p, [1, 2, 3, 4, 5], [10, 20, 30, 40, 50])


@query(f"{_MV}, ky AS (SELECT caid, row_number() OVER (ORDER BY caid) k FROM (SELECT DISTINCT caid FROM fm)) SELECT 'm' || k caid, CAST(count(*) AS BIGINT) n FROM fm JOIN ky USING (caid) GROUP BY 1")
def tg_matched_users(spark, d):
    """Devices under numbered names, in order (names m1, m2, ... sorted as numbers by their width)."""
    n = _fmt(spark, d).groupBy("caid").agg(F.count(F.lit(1)).alias("n"))
    k = spark.range(1, n.count() + 1).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("caid"))
    return daily.match_users(n, k).select(F.concat(F.lit("m"), F.col("caid").cast("bigint").cast("string")).alias("caid"), "n")


def _tg(spark, d):
    return daily.TimeGeo(num_days=2, min_unique_locations=1, seed=1).fit(canonical(spark, d).withColumn("h3_id_region", F.col("cell")))


@query()
def tg_parameters(spark, d):
    return _tg(spark, d).fitted["params"]


@query()
def tg_generated(spark, d):
    return _tg(spark, d).generate()


# --- measures on timelines ------------------------------------------------------------------------------

_TL = f"tl AS ({TIMELINE_SQL}), cp AS (SELECT * FROM (SELECT *, lag(longitude) OVER u plo, lag(latitude) OVER u pla FROM tl WINDOW u AS (PARTITION BY user_id ORDER BY timeslot)) WHERE plo IS NULL OR plo <> longitude OR pla <> latitude)"
query(TIMELINE_SQL)(timeline)


@query(f"WITH {_TL} SELECT user_id, timeslot, location_type, longitude, latitude FROM cp")
def timeline_compressed(spark, d):
    return timelines.compress(timeline(spark, d))


_NODES = [(1, -118.4, 34.0), (2, -118.2, 34.2), (3, -118.3, 34.3), (4, -118.1, 34.1)]
_NN = f"nd(node, x, y) AS (VALUES {', '.join(f'({n}, {x}e0, {y}e0)' for n, x, y in _NODES)}), nn AS (SELECT longitude, latitude, arg_min(node, (pow(x - longitude, 2) + pow(y - latitude, 2), node)) node FROM (SELECT DISTINCT longitude, latitude FROM tl), nd GROUP BY 1, 2)"


@query(f"""WITH {_TL}, {_NN} SELECT user_id, timeslot, (timeslot - 1) // 144 AS day, (timeslot % 144) * 10 departure_min, coalesce((lead(timeslot) OVER (PARTITION BY user_id ORDER BY timeslot) - timeslot) * 10, -1) dwell_min, node FROM cp JOIN nn ON cp.longitude = nn.longitude AND cp.latitude = nn.latitude""")
def user_trajectories(spark, d):
    nodes = spark.createDataFrame(_NODES, "node int, longitude double, latitude double")
    t = timelines.user_trajectories(timeline(spark, d), nodes)
    return t.withColumn("dwell_min", F.coalesce("dwell_min", F.lit(-1).cast("bigint")))


@query(f"WITH {_TL} SELECT user_id, max(timeslot) max_slot, count(DISTINCT location_type) n_types, count(DISTINCT longitude) n_longitudes, count(DISTINCT latitude) n_latitudes FROM tl GROUP BY user_id")
def timeline_user_stats(spark, d):
    return timelines.user_stats(timeline(spark, d))


@query(f"WITH {_TL} SELECT p from_type, location_type to_type, CAST(count(*) AS BIGINT) n FROM (SELECT location_type, lag(location_type) OVER (PARTITION BY user_id ORDER BY timeslot) p FROM tl) WHERE p IS NOT NULL GROUP BY 1, 2")
def type_transitions(spark, d):
    return timelines.type_transitions(timeline(spark, d))


@query(f"WITH {_TL} SELECT (timeslot - 1) % 144 // 6 AS hour, timeslot % 24 slot_mod24, location_type, CAST(count(*) AS BIGINT) n FROM tl GROUP BY 1, 2, 3")
def activity_by_hour(spark, d):
    return timelines.activity_by_hour(timeline(spark, d))


_PU = """pu AS (SELECT CAST(floor((((timeslot - 1) % 144 + 143) % 144) / 6e0) AS BIGINT) AS hour, CASE WHEN k IN ('hw', 'wh') THEN 'hbw' WHEN k IN ('ho', 'oh') THEN 'hbo' WHEN k IN ('wo', 'ow') THEN 'nhb' WHEN k = 'oo' AND m THEN 'nhb' END trip
 FROM (SELECT timeslot, coalesce(lag(location_type) OVER u, 'h') || location_type k, coalesce(lag(longitude) OVER u <> longitude OR lag(latitude) OVER u <> latitude, false) m FROM tl WINDOW u AS (PARTITION BY user_id ORDER BY timeslot))),
pc AS (SELECT hour, CAST(count(*) FILTER (trip = 'hbw') AS BIGINT) hbw, CAST(count(*) FILTER (trip = 'hbo') AS BIGINT) hbo, CAST(count(*) FILTER (trip = 'nhb') AS BIGINT) nhb FROM pu WHERE trip IS NOT NULL GROUP BY hour)"""


@query(f"WITH {_TL}, {_PU} SELECT * FROM pc")
def trip_purposes_hourly(spark, d):
    return timelines.trip_purposes(timeline(spark, d))


@query(f"WITH {_TL}, {_PU} SELECT hour, round(hbw / sum(hbw) OVER (), 9) hbw, round(hbo / sum(hbo) OVER (), 9) hbo, round(nhb / sum(nhb) OVER (), 9) nhb FROM pc")
def trip_purpose_shares(spark, d):
    return rounded(timelines.purpose_shares(timelines.trip_purposes(timeline(spark, d))), hbw=9, hbo=9, nhb=9)


_SURVEY = [(h, 1.0 + h % 5, 2.0 + h % 7, 3.0 + h % 3) for h in range(24)]
_SV = f"sv(hour, hbw, hbo, nhb) AS (VALUES {', '.join(f'({h}, {a}e0, {b}e0, {c}e0)' for h, a, b, c in _SURVEY)}), jo AS (SELECT pc.hour, pc.hbw a, pc.hbo b, pc.nhb c, sv.hbw x, sv.hbo y, sv.nhb z FROM pc JOIN sv ON pc.hour = sv.hour)"
_COMPARED = (("x", "hbw_survey"), ("y", "hbo_survey"), ("z", "nhb_survey"), ("(x + y + z)", "all_survey"), ("a", "hbw_tg"), ("b", "hbo_tg"), ("c", "nhb_tg"), ("(a + b + c)", "all_tg"))


@query(f"WITH {_TL}, {_PU}, {_SV} SELECT hour, {', '.join(f'round({v} / nullif(sum({v}) OVER (), 0), 9) {n}' for v, n in _COMPARED)} FROM jo")
def departure_validation(spark, d):
    survey = spark.createDataFrame(_SURVEY, "hour bigint, hbw double, hbo double, nhb double")
    v = timelines.departure_validation(timelines.trip_purposes(timeline(spark, d)), {"survey": survey})
    return rounded(v, **{c: 9 for c in v.columns if c != "hour"})


@query(f"WITH {_TL} SELECT user_id, timeslot, location_type FROM tl")
def timeline_parsed(spark, d):
    """The timeline written as text, one line a user and one a slot, and read again."""
    t = timeline(spark, d)
    line = F.concat_ws(" ", "location_type", "longitude", "latitude")
    lines = t.select("user_id", "timeslot", line.alias("value")).unionByName(t.select("user_id").distinct().select("user_id", F.lit(0).cast("bigint").alias("timeslot"), F.col("user_id").alias("value")))
    lines = lines.select((F.col("user_id").cast("bigint") * 1000 + F.col("timeslot")).alias("line_no"), "value")
    return timelines.parse_results(lines).select("user_id", "timeslot", "location_type")


@query(f"WITH {_TL} SELECT count(*) num_users, CAST(sum(w) AS BIGINT) num_users_work FROM (SELECT user_id, max(CAST(location_type = 'w' AS INT)) w FROM tl GROUP BY user_id)")
def commuter_counts(spark, d):
    return timelines.commuter_counts(timeline(spark, d))


@query(f"WITH {_TL} SELECT what, timeslot, CAST(count(*) AS BIGINT) n FROM (SELECT timeslot, CASE WHEN location_type = 'w' AND coalesce(p, 'h') <> 'w' THEN 'begin' WHEN location_type <> 'w' AND p = 'w' THEN 'end' END what FROM (SELECT *, lag(location_type) OVER (PARTITION BY user_id ORDER BY timeslot) p FROM tl)) WHERE what IS NOT NULL GROUP BY 1, 2")
def work_times(spark, d):
    return timelines.work_times(timeline(spark, d))


_SD = "sd AS (SELECT user_id, lead(timeslot) OVER (PARTITION BY user_id ORDER BY timeslot) - timeslot duration FROM cp)"


@query(f"WITH {_TL}, {_SD} SELECT duration, round(sum(n) OVER (ORDER BY duration) / sum(n) OVER (), 9) cdf FROM (SELECT duration, count(*) n FROM sd WHERE duration > 0 GROUP BY duration)")
def stay_duration_cdf_simulated(spark, d):
    return rounded(timelines.duration_cdf(timelines.simulated_durations(timeline(spark, d))), cdf=9)


_OD = f"ob AS (SELECT (lead(t) OVER (PARTITION BY caid ORDER BY t) - t) / 600e0 duration FROM (SELECT caid, stay_start t FROM ({STAYS_SQL})))"


def _observed(spark, d):
    return timelines.observed_durations(canonical(spark, d).withColumn("timestamp", F.unix_timestamp("stay_start_timestamp")))


@query(f"WITH {_OD} SELECT round(duration, 6) duration, round(sum(n) OVER (ORDER BY duration) / sum(n) OVER (), 9) cdf FROM (SELECT duration, count(*) n FROM ob WHERE duration > 0 GROUP BY duration)")
def stay_duration_cdf_observed(spark, d):
    return rounded(timelines.duration_cdf(_observed(spark, d)), duration=6, cdf=9)


def _pdf_sql(ctes: str, table: str, hours: str) -> str:
    return f"WITH {ctes} SELECT bin, round(n / sum(n) OVER () / 0.25e0, 9) density FROM (SELECT CAST(least(floor(duration * {hours} / 0.25e0), 95) AS INT) bin, count(*) n FROM {table} WHERE duration > 0 AND duration * {hours} <= 24 GROUP BY 1)"


@query(_pdf_sql(f"{_TL}, {_SD}", "sd", repr(1 / 6)))
def stay_duration_pdf_simulated(spark, d):
    return rounded(timelines.duration_pdf(timelines.simulated_durations(timeline(spark, d)), 1 / 6), density=9)


@query(_pdf_sql(_OD, "ob", repr(1 / 6)))
def stay_duration_pdf_observed(spark, d):
    return rounded(timelines.duration_pdf(_observed(spark, d), 1 / 6), density=9)


@query(f"WITH {_TL} SELECT locations, round(n / sum(n) OVER (), 9) probability FROM (SELECT locations, count(*) n FROM (SELECT user_id, (timeslot - 1) // 144, count(DISTINCT (longitude, latitude)) locations FROM tl GROUP BY 1, 2) GROUP BY 1)")
def daily_locations_pmf(spark, d):
    return rounded(timelines.daily_locations_pmf(timelines.daily_locations(timeline(spark, d))), probability=9)


_TD = "td AS (SELECT * FROM (SELECT user_id, 2 * 6371e0 * asin(sqrt(least(1e0, pow(sin((radians(latitude) - radians(pla)) / 2), 2) + cos(radians(pla)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(plo)) / 2), 2)))) km FROM cp) WHERE km > 0)"


@query(f"WITH {_TL}, {_TD} SELECT user_id, round(km, 6) km FROM td")
def trip_distances(spark, d):
    return rounded(timelines.trip_distances(timelines.compress(timeline(spark, d))), km=6)


@query(f"WITH {_TL}, {_TD} SELECT CAST(ceil(km) AS BIGINT) km_bin, round(count(*) / (SELECT count(*) FROM td), 9) probability FROM td GROUP BY 1")
def trip_distance_pmf(spark, d):
    return rounded(timelines.trip_distance_pmf(timelines.trip_distances(timelines.compress(timeline(spark, d)))), probability=9)


@query(f"WITH {_TL} SELECT CAST(r AS INT) rank, round(sum(n) / sum(sum(n)) OVER (), 9) probability FROM (SELECT n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, longitude, latitude) r FROM (SELECT user_id, longitude, latitude, count(*) n FROM tl GROUP BY 1, 2, 3)) WHERE r <= 20 GROUP BY r")
def location_rank_frequency(spark, d):
    return rounded(timelines.location_ranks(timeline(spark, d)), probability=9)


# --- areal interpolation --------------------------------------------------------------------------------


def _county(spark) -> DataFrame:
    """Four square tracts of a made-up county."""
    rows = []
    for k, (x, y) in enumerate(((-118.5, 34.0), (-118.25, 34.0), (-118.5, 34.25), (-118.25, 34.25))):
        rows.append((k + 1, [(x, y), (x + 0.25, y), (x + 0.25, y + 0.25), (x, y + 0.25)], 1000.0 * (k + 1)))
    return spark.createDataFrame(rows, "tract_id int, ring array<struct<lng:double,lat:double>>, population double")


@query("SELECT x * 1 cell_x, y * 1 cell_y FROM range(0, 4096) a(x), range(0, 4096) b(y) WHERE (x + 0.5e0) / 4096e0 * 360e0 - 180e0 >= -118.5e0 AND (x + 0.5e0) / 4096e0 * 360e0 - 180e0 < -118e0 AND (y + 0.5e0) / 4096e0 * 180e0 - 90e0 >= 34e0 AND (y + 0.5e0) / 4096e0 * 180e0 - 90e0 < 34.5e0")
def polygon_cells(spark, d):
    c = areal.polygon_cells(_county(spark).select(F.col("tract_id").alias("region_id"), "ring"), 6)
    pos = F.col("cell").bitwiseAND(F.lit((1 << 52) - 1).cast("bigint"))
    return c.select((pos % 4096).alias("cell_x"), F.floor(pos / 4096).alias("cell_y")).distinct()


@query()
def areal_population(spark, d):
    t = _county(spark)
    c = areal.polygon_cells(t.select(F.col("tract_id").alias("region_id"), "ring"), 7)
    return rounded(areal.areal_population(c, t), population=6)


@query("SELECT tract_id, 1000e0 * tract_id population FROM range(1, 5) t(tract_id)")
def areal_population_by_tract(spark, d):
    """The parts of each tract in the cells around it add up to its population."""
    t = _county(spark)
    wide = spark.createDataFrame([(1, [(-118.7, 33.8), (-117.8, 33.8), (-117.8, 34.7), (-118.7, 34.7)])], "region_id int, ring array<struct<lng:double,lat:double>>")
    c = cut_lineage(areal.polygon_cells(wide, 6))
    out = None
    for k in range(1, 5):
        one = areal.areal_population(c, t.where(F.col("tract_id") == k)).agg(F.sum("population").alias("population")).select(F.lit(k).cast("bigint").alias("tract_id"), "population")
        out = one if out is None else out.unionByName(one)
    return rounded(out, population=3)
