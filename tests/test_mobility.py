import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith import api
from tracksmith.functions import cells
from tracksmith.functions.geo import np_geodesic_km, np_haversine
from tracksmith.models import daily
from tracksmith.models.epr import EPR, waiting_hours
from tracksmith.models.gravity import Gravity, pair_distances
from tracksmith.operators import areal, places, stops, timelines
from tracksmith.plans.fixtures import pings
from tracksmith.streaming.pings import ping_activity


def test_stop_invariants(spark, data):
    p = pings(spark, data)
    a = stops.find_stops(p, 50.0, 43_200.0, 300.0)
    b = stops.find_stops(p.orderBy(F.rand(1)), 50.0, 43_200.0, 300.0)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect()))
    assert all(r[2] - r[1] >= 300 for r in rows)
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(rows, rows[1:]))


def test_stop_plan_has_one_exchange(spark, data):
    plan = stops.find_stops(pings(spark, data), 50.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_box_is_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) caid", "id + 0.5d latitude", "id * 1d longitude", "id utc_timestamp").write.parquet(f"{tmp_path}/p")
    d = stops.clean_pings(spark.read.parquet(f"{tmp_path}/p"), None, "UNIX", 2, 8, (3, 6), (0, 9))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude,3.0)" in plan and "GreaterThanOrEqual(utc_timestamp,2)" in plan
    assert d.count() == 3
    with pytest.raises(ValueError):
        stops.clean_pings(spark.range(1))


def test_density_labels_against_brute_force():
    rng = np.random.default_rng(0)
    for n, few in ((0, 300), (1, 300), (60, 300), (60, 0), (150, 0), (150, 300)):
        lat, lon = 40 + rng.uniform(0, 2e-3, n), -70 + rng.uniform(0, 2e-3, n)
        for k in (2, 3, 4):
            got = places.density_labels(lat, lon, 25.0, k, few)
            assert (got == places.density_labels(lat, lon, 25.0, k)).all()
            near = np_haversine(lat[:, None], lon[:, None], lat, lon) <= 25.0
            core = near.sum(1) >= k
            for i in range(n):
                assert (got[i] >= 0) == bool((near[i] & core).any())
                for j in range(n):
                    if core[i] and core[j] and near[i, j]:
                        assert got[i] == got[j]


def test_a_crowded_place_costs_no_square():
    rng = np.random.default_rng(2)
    n = 100_000
    lat, lon = 40 + rng.normal(0, 5e-5, n), -70 + rng.normal(0, 5e-5, n)
    lat[:10] += 1
    got = places.density_labels(lat, lon, 20.0, 3)
    assert (got[10:] == got[10]).mean() > 0.999 and set(got[:10]) != {got[10]}


def test_devices_over_batches(spark):
    rows = [(f"u{u}", k, 100 * k, 100 * k + 50, 40.0 + u + (k % 3) * 0.01, -70.0) for u in range(40) for k in range(1, 30)]
    d = spark.createDataFrame(rows, "caid string, stop_events int, start_timestamp bigint, end_timestamp bigint, median_latitude double, median_longitude double")
    whole = sorted(map(tuple, places.cluster_stops(d).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, places.cluster_stops(d.unionByName(d)).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == len(rows) and places.cluster_stops(d.limit(0)).count() == 0


def test_cells(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 50), rng.uniform(-180, 180, 50))] + [(90.0, 180.0), (None, 1.0)], "lat double, lng double")
    c = cells.latlng_to_cell(F.col("lat"), F.col("lng"), 9)
    at = cells.cell_to_latlng(F.col("c"))
    d = df.withColumn("c", c).select("lat", "c", cells.parent(cells.parent(F.col("c"), 7), 5).alias("p"), cells.parent(F.col("c"), 5).alias("q"), cells.latlng_to_cell(at["lat"], at["lng"], 9).alias("again"), cells.from_hex(cells.to_hex(F.col("c"))).alias("h"), cells.h3_parent(F.col("c"), 5).alias("no"))
    for r in d.collect():
        assert r.p == r.q and r.c == r.again == r.h and r.no is None
        assert (r.c is None) == (r.lat is None)
    h = spark.createDataFrame([("85283473fffffff",)], "x string").select(cells.to_hex(cells.h3_parent(cells.from_hex(F.col("x")), 4))).first()[0]
    assert h == "8428347ffffffff"


def test_geodesic():
    assert abs(np_geodesic_km([0.0], [0.0], [0.0], [1.0])[0] - 111.319) < 1e-2
    assert np_geodesic_km([10.0], [20.0], [10.0], [20.0])[0] == 0


def test_gravity(spark):
    tiles = spark.createDataFrame([(i, 10.0 + i, -70.0 + (i * 7) % 5, 1.0 + i % 4, 100.0) for i in range(12)], "tile int, latitude double, longitude double, relevance double, tot_outflow double")
    pairs = pair_distances(tiles)
    assert pairs.count() == 132
    for kind in ("single", "global"):
        g = Gravity("exponential", 0.01, 1.0, 1.3, kind)
        f = g.generate(tiles, pairs, "flows")
        fitted = g.fit(g.training_set(f, tiles, pairs))
        assert abs(fitted.destination_exp - 1.3) < 1e-6 and abs(fitted.deterrence_func_arg - 0.01) < 1e-8
        s = g.generate(tiles, pairs, "flows_sample", seed=1)
        flat = lambda x: sorted(map(tuple, x.collect()))
        assert flat(s) == flat(g.generate(tiles, pairs.repartition(7), "flows_sample", seed=1))
    p = Gravity().generate(tiles, pairs, "probabilities").groupBy("origin").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-9 for r in p)
    for bad in ({"gravity_type": "x"}, {"deterrence_func_type": "x"}):
        with pytest.raises(ValueError):
            Gravity(**bad)
    with pytest.raises(ValueError):
        Gravity().generate(tiles, pairs, "x")


def test_epr(spark):
    tiles = spark.createDataFrame([(i,) for i in range(10)], "cell bigint")
    od = spark.createDataFrame([(i, (i + k) % 10, 0.5) for i in range(9) for k in (1, 2)], "origin bigint, destination bigint, p double")
    run = lambda n: EPR().generate(od, tiles, 6, "2024-01-01", "2024-01-08", seed=n).toPandas().sort_values(["user", "datetime"], ignore_index=True)
    a = run(1)
    assert a.equals(run(1)) and not a.equals(run(2)) and set(a.user) == set(range(6))
    with pytest.raises(ValueError):
        EPR().generate(od, tiles, 1, "2024-01-01", "2024-01-02", max_entries=3)
    rng = np.random.default_rng(0)
    x = np.array([waiting_hours(rng, 1 / 3, 0.8, 17.0) for _ in range(4000)])
    t = np.linspace(1 / 3, 400, 4_000_000)
    w = t**-1.8 * np.exp(-t / 17)
    assert x.min() >= 1 / 3 and abs(x.mean() - (t * w).sum() / w.sum()) < 0.15


def test_daily_model_keeps_its_users(spark):
    rows, n = [], 1 << 14
    cell = lambda la, lo: (9 << 59) | (8 << 52) | (int((la + 90) / 180 * n) << 14) | int((lo + 180) / 360 * n)
    for u in range(6):
        home, work = cell(34.05 + 0.01 * u, -118.25), cell(34.1 + 0.01 * u, -118.35)
        for day in range(21):
            k = day % 20
            for hour, c, t in ((2, home, "home"), (9, work, "Work "), (19, cell(34.0 + 0.01 * k, -118.1 - 0.03 * k), "other")):
                rows.append((f"u{u}", 1546300800 + day * 86400 + hour * 3600, c, t, format(home, "X"), format(work, "X"), day % 7 + 1))
    s = spark.createDataFrame(rows, "caid string, stay_start_timestamp bigint, h3_id_region bigint, type string, home_h3_index string, work_h3_index string, day_of_week int")
    a = daily.align(s)
    assert dict(a.dtypes)["type"] == "int" and {r.type for r in a.select("type").distinct().collect()} == {0, 1, 2}
    assert dict(a.dtypes)["home_h3_index"] == "string" and dict(a.dtypes)["h3_id_region"] == "bigint"
    with pytest.raises(ValueError):
        daily.align(s.drop("type"))
    m = daily.TimeGeo(num_days=1, min_unique_locations=10, seed=4)
    with pytest.raises(RuntimeError):
        m.generate(1)
    m.fit(s)
    assert m.stats()["num_users"] == 6 and m.stats()["num_commuters"] == 6
    g = m.generate(6).toPandas()
    assert set(g.user) == {f"u{u}" for u in range(6)} and len(g) == 6 * 144
    assert set(g.location_type) <= {"h", "w", "o"}
    m.cleanup()
    m.cleanup()


def test_daily_model_simulates_every_user(spark):
    users = [f"u{i:03d}" for i in range(60)]
    m = daily.TimeGeo(num_days=1, seed=2)
    params = spark.createDataFrame([(u, 5, 5, 10.0, True, [60, 61]) for u in users], "caid string, b1 int, b2 int, nw double, regular boolean, work_slots array<int>").withColumn("is_commuter", F.lit(True))
    places = spark.createDataFrame([(u, k, n, 1, -118.0 + 0.01 * i, 34.0 + 0.1 * k) for i, u in enumerate(users) for k, n in enumerate("hw")], "caid string, place int, kind string, count bigint, longitude double, latitude double")
    pool = spark.range(200_001).selectExpr("-119.0 + (id % 501) / 250 longitude", "33.0 + (id % 499) / 250 latitude")
    m.fitted = {"params": params, "places": places, "pool": pool, "patterns": np.stack([np.outer(*daily.default_activeness())] * 2)}
    g = m.generate().toPandas()
    assert sorted(set(g.user)) == users and len(g) == 60 * 144 and "o" in set(g.location_type)
    assert sorted(set(m.generate(7).toPandas().user)) == users[:7]


@pytest.mark.parametrize("n", [0, 1, 64, 65, 5000])
def test_pool_against_sorting(n):
    rng = np.random.default_rng(n)
    pts = np.stack([rng.uniform(-180, 180, n), rng.uniform(-89, 89, n)], 1)
    pts[: n // 2] = np.array([179.99, 10.0]) + 0.02 * rng.standard_normal((n // 2, 2))
    pts[: n // 8] = pts[:1]
    pool = daily.Pool(pts)
    for lo, la in ((179.999, 10.0), (-179.999, 10.01), (12.0, 60.0)):
        at = pool.point(lo, la)
        d = np.sort(((pool.xyz - at) ** 2).sum(1))
        assert pool.within(at, 1.5) == (2 * 6371 * np.arcsin(np.sqrt(d) / 2) <= 1.5).sum()
        for k in range(0, n, max(1, n // 40)):
            assert abs(((pool.xyz[pool.nth(at, k)] - at) ** 2).sum() - d[k]) < 1e-15


def _plain_candidate(rng, n1, n2, t0, t1, work):
    """The surveyed process, one step after another."""
    now, at, out = t0, 1, [(t0, 1)]
    while True:
        now += 600 + int(rng.integers(-300, 300))
        if now >= t1:
            return out
        s = now % 86_400 // 600
        if at == 1:
            if rng.random() < np.exp(-n1 * (abs(s - 72) / 144) ** n2):
                at = 2 if work and rng.random() < 0.6 else 3
                out.append((now, at))
        elif rng.random() < (0.3 if at == 3 or not 9 <= s * 600 // 3600 <= 17 else 0.05):
            if rng.random() < 0.7:
                at = 1
            elif work and at != 2 and rng.random() < 0.4:
                at = 2
            else:
                at = 3
            out.append((now, at))


@pytest.mark.parametrize("work", [True, False])
def test_candidates_follow_the_surveyed_process(work):
    g = daily.GridSearch(n1=(16,), n2=(2,), seed=3)
    users, t0, t1 = [f"u{i}" for i in range(40)], np.full(40, 1_700_000_000), np.full(40, 1_700_000_000 + 20 * 86_400)
    cdf, nw, events = g.simulate(users, t0, t1, np.full(40, work), np.zeros(40, int))
    ours = {u: [] for u in range(40)}
    for u, t, k in events:
        for a, b, c in zip(u.tolist(), t.tolist(), k.tolist()):
            ours[a].append((b, c))
    rng = np.random.default_rng(0)
    theirs = {i: _plain_candidate(rng, 16, 2, int(t0[0]), int(t1[0]), work) for i in range(40)}

    def shares(d):
        n = np.zeros((4, 4))
        for rows in d.values():
            for (_, a), (_, b) in zip(rows, rows[1:]):
                n[a, b] += 1
        return n[1:, 1:] / np.maximum(n[1:, 1:].sum(1, keepdims=True), 1), np.mean([len(r) for r in d.values()])

    (p, n), (q, m) = shares(ours), shares(theirs)
    assert np.abs(p - q).max() < 0.05 and abs(n - m) < 0.05 * m
    assert (nw.sum() > 0) == work and all(t == sorted(t) and t[-1][0] < t1[0] for t in ours.values())
    again = g.simulate(users[7:9], t0[:2], t1[:2], np.full(2, work))[0]
    assert np.allclose(again, cdf[7:9])


def test_grid_search_and_its_trajectories(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{u}", int(1_700_000_000 + d * 86_400 + h * 3600 + rng.integers(0, 600))) for u in range(5) for d in range(14) for h in (8, 17, 20)] + [("one", 5)]
    st = spark.createDataFrame(rows, "caid string, timestamp bigint")
    us = spark.createDataFrame([(f"u{u}", u < 3) for u in range(5)] + [("one", True)], "caid string, is_commuter boolean")
    fit = lambda s: sorted(map(tuple, daily.GridSearch(seed=2).fit(s, us, at_once=2).collect()))
    a = fit(st)
    assert a == fit(st.repartition(5)) and [r[0] for r in a] == [f"u{u}" for u in range(5)]
    assert all(1 <= r[1] <= 5 and 1 <= r[2] <= 5 and 0 <= r[4] < 0.3 for r in a) and all((r[3] > 0) == (r[0] < "u3") for r in a)
    pos = us.select("caid", F.lit(10.0).alias("home_longitude"), F.lit(1.0).alias("home_latitude"), F.lit(20.0).alias("work_longitude"), F.lit(2.0).alias("work_latitude"))
    t = daily.GridSearch(seed=2).trajectories(st, us, pos).toPandas()
    assert set(t[t.location_type == "h"].longitude) == {10.0} and set(t[t.location_type == "w"].longitude) == {20.0} and set(t[t.location_type == "w"].caid) <= {"u0", "u1", "u2"}
    o = t[t.location_type == "o"]
    assert len(o) and np.minimum(abs(o.longitude - 10), abs(o.longitude - 20)).max() <= 0.005 + 1e-9


def test_work_days_and_patterns(spark):
    users = spark.createDataFrame([(f"u{i}", 1, 2, 3.0, i % 2 == 0) for i in range(40)], "caid string, b1 int, b2 int, nw double, is_commuter boolean")
    for r in daily.WorkDays(seed=1).parameters(users, 6).collect():
        spans = {}
        for s in r.work_slots:
            spans.setdefault(s, 0)
        assert bool(r.is_commuter) or not r.work_slots
        first = min(r.work_slots, default=0) % 144
        assert all(s % 1 == 0 and s >= first for s in r.work_slots)
    st = spark.createDataFrame([("a", 3600 * 8 + 86_400 * d, 0) for d in range(4)] + [("a", 3600 * 18, 0)], "caid string, timestamp bigint, type int")
    us = spark.createDataFrame([("a", True), ("b", False)], "caid string, is_commuter boolean")
    p = daily.activeness_patterns(st, us)
    assert p.shape == (2, 7, 144) and np.allclose(p[0], p[1]) and abs(p[1].sum() - 1) < 1e-12 and p[1][0, 48] > p[1][1, 48] > 0
    assert np.allclose(daily.activeness_patterns(st.limit(0), us)[0], np.outer(*daily.default_activeness()))
    assert abs(daily.default_activeness()[1].sum() - 1) < 1e-9


def test_daily_helpers(spark):
    p = spark.createDataFrame([("b", 0, 4, 1.0), ("a", 1, 1, 2.0), ("c", 9, 0, 3.0)], "caid string, b1 int, b2 int, nw double")
    got = {r.caid: (r.b1, r.b2) for r in daily.decode_parameters(p, [1, 2, 3, 4, 5], [10, 20, 30, 40, 50]).collect()}
    assert got == {"b": (1.0, 50.0), "a": (2.0, 20.0)}
    places_ = spark.createDataFrame([("7",), ("8",), ("8",)], "caid string")
    assert sorted((r.caid, r.b1) for r in daily.match_users(p, places_).collect()) == [("7", 1), ("8", 0)]
    old = spark.createDataFrame([("u", 5, 0, 1, 9), ("u", 6, 1, 1, 9), ("u", 7, 2, 1, 9)], "UserID string, unix_timestamp bigint, type int, h3_id_region bigint, other int")
    assert daily.from_original(old).columns == ["caid", "stay_start_timestamp", "type", "h3_id_region", "other"]
    assert [r.type for r in daily.from_original(old).orderBy("stay_start_timestamp").collect()] == [1, 2, 0]
    b = spark.createDataFrame([("u", str(i), 1.0, 2.0) for i in range(50)] + [("v", "h", 0.0, 0.0)], "caid string, loc_id string, longitude double, latitude double")
    assert daily.other_places(b).count() == 50 and daily.other_places(b, 0.3, 1).count() == 15 and daily.other_places(b, 1e-9).count() == 1
    assert daily.default_pool().shape == (100, 2)
    x, y = (spark.createDataFrame([("u", t) for t in ts] + extra, "caid string, timestamp bigint") for ts, extra in ((range(0, 100, 10), [("v", 3)]), (range(5, 100, 10), [("v", 3), ("w", 1)])))
    assert {r.caid: r.statistic for r in daily.area_statistic(x, y).collect()}["v"] is None
    assert 0 <= {r.caid: r.statistic for r in daily.area_statistic(x, y).collect()}["u"] < 0.2


def test_areal(spark):
    xy = areal.albers([-120.0, -119.0], [34.0, 34.0])
    assert abs(xy[0, 0]) < 1e-6 and 91_000 < xy[1, 0] < 93_000
    sq = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert areal.area(areal.clip(sq + 1, sq)) == 1
    assert areal.area(areal.clip(sq + 5, sq)) == 0
    ring = [(-118.5, 34.0), (-118.0, 34.0), (-118.0, 34.5), (-118.5, 34.5)]
    t = spark.createDataFrame([(1, ring, 500.0), (2, None, 9.0)], "tract_id int, ring array<struct<lng:double,lat:double>>, population double")
    wide = spark.createDataFrame([(1, [(-119.0, 33.5), (-117.5, 33.5), (-117.5, 35.0), (-119.0, 35.0)])], "region_id int, ring array<struct<lng:double,lat:double>>")
    p = areal.areal_population(areal.polygon_cells(wide, 6), t)
    assert abs(p.agg(F.sum("population")).first()[0] - 500) < 1e-3


def test_timeline_text(spark):
    lines = spark.createDataFrame(list(enumerate(["u1", "h 1.0 2.0", "w 3.0 4.0", "u2", "o 5.0 6.0", ""])), "line_no int, value string")
    got = [tuple(r) for r in timelines.parse_results(lines).orderBy("user_id", "timeslot").collect()]
    assert got == [("u1", 1, "h", 1.0, 2.0), ("u1", 2, "w", 3.0, 4.0), ("u2", 1, "o", 5.0, 6.0)]


def test_workflow(spark, data, tmp_path):
    pings(spark, data).withColumnRenamed("caid", "device").write.parquet(f"{tmp_path}/raw")
    d = api.MobilityDataset("x", f"{tmp_path}/raw", {"device": "caid"}, f"{tmp_path}/out", "2023-01-01", "2025-01-01", (-119.0, -117.0), (33.0, 35.0), "UTC")
    s = api.ClusterStayDetection(d).get_stays(spark, 50.0, 43_200.0)
    assert s.count() == 180 and len(s.columns) == 16
    assert d.load_od_flow(spark, 6).count() > 0 and d.load_stay_count(spark, 6).agg(F.sum("count")).first()[0] == 180
    kept, grid, totals = api.UserSelection(d).filter_users(spark, (3, 100), (1, 1000))
    assert totals["num_total_users"] == 15 and kept.count() <= 180 and grid.count() > 0
    g = api.GridStayDetection(d)
    g.get_stays(spark, delta_t=43_200)
    assert g.get_home_work_od_matrix(spark, 6).count() > 0 and g.get_od_matrix(spark, 6).count() > 0
    with pytest.raises(ValueError):
        g.get_home_work_od_matrix(spark, 9)
    assert all(abs(m.agg(F.sum("probability")).first()[0] - 1) < 1e-9 for m in g.summarize(spark).values())
    with pytest.raises(ValueError):
        api.GridStayDetection(api.MobilityDataset("y", "z")).get_stays(spark)
    with pytest.warns(DeprecationWarning):
        api.StayDetection(d)


def test_stream(spark, data, tmp_path):
    spark.read.parquet(f"{data}/raw_pings.parquet").write.parquet(f"{tmp_path}/in")
    t = spark.read.parquet(f"{tmp_path}/in")
    q = ping_activity(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("act").agg(F.sum("n_pings")).first()[0] == t.where("caid is not null and ingested_at is not null").count()
