import numpy as np
import pandas as pd
import pytest

from tracksmith.functions.geo import chord, np_haversine, np_unit_vectors
from tracksmith.operators.sequences import number_runs
from tracksmith.operators.trips import _Dwell, _grow, _hull, detect_stops, spikes, stretches, trips_between
from pyspark.sql import functions as F

SCHEMA = "caid string, ping_id bigint, latitude double, longitude double, utc_us bigint"


def _walk(seed, n=400):
    """Dwells with noise, spikes and gaps along a line."""
    rng, t, lat, rows = np.random.default_rng(seed), 0, 40.0, []
    while len(rows) < n:
        for _ in range(rng.integers(3, 25)):
            t += int(rng.integers(20, 300))
            spike = rng.random() < 0.05
            rows.append((lat + rng.normal(0, 5e-5) + (0.01 if spike else 0), -70 + rng.normal(0, 5e-5), t * 1_000_000))
        lat += rng.uniform(0.002, 0.02)
        t += int(rng.choice([200, 800, 5000]))
    return pd.DataFrame(rows, columns=["latitude", "longitude", "utc_us"])


def _valid(lat, lon, us, got, metres=50.0, min_us=300_000_000, slack=2):
    assert us[got[-1]] - us[got[0]] >= min_us
    for i in got:
        assert (np_haversine(lat[i], lon[i], lat[got], lon[got]) <= metres + 1e-6).all()
    assert max(np.diff(got), default=1) <= slack + 1


@pytest.mark.parametrize("seed", range(6))
def test_stretches_are_valid_and_not_extendable(seed):
    p = _walk(seed)
    lat, lon, us = p["latitude"].to_numpy(), p["longitude"].to_numpy(), p["utc_us"].to_numpy()
    found = stretches(us, np_unit_vectors(lat, lon), chord(50.0), 300_000_000)
    assert found and all(a[-1] < b[0] for a, b in zip(found, found[1:]))
    for g in found:
        _valid(lat, lon, us, g)
        for nxt in range(g[-1] + 1, min(g[-1] + 4, len(us))):
            assert not (np_haversine(lat[nxt], lon[nxt], lat[g], lon[g]) <= 50.0).all()


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_batches_do_not_matter(size):
    p = _walk(3, 1500)
    p["caid"], p["ping_id"], p["session_us"] = "a", np.arange(len(p)), 0
    whole = pd.concat(list(_Dwell(50.0, 300.0, 2).run(iter([p]))))
    parts = pd.concat([x for x in _Dwell(50.0, 300.0, 2).run(iter([p.iloc[i : i + size] for i in range(0, len(p), size)])) if len(x)])
    assert whole["first_ping_id"].tolist() == parts["first_ping_id"].tolist()
    assert whole["last_ping_id"].tolist() == parts["last_ping_id"].tolist()
    assert np.allclose(whole["path_end_m"].astype(float), parts["path_end_m"].astype(float))


def test_rules(spark):
    s, here, far = 1_000_000, (40.0, -70.0), (41.0, -70.0)
    rows, pid = [], 0

    def add(caid, where, t):
        nonlocal pid
        pid += 1
        rows.append((caid, pid, *where, t * s))

    for t in (0, 200, 400):
        add("a", here, t)  # 1-3
    for t in (500, 600):
        add("a", far, t)  # 4-5: two elsewhere do not end it
    add("a", here, 700)  # 6
    add("a", here, 700)  # 7: same instant, larger id
    for t in (800, 900, 1000):
        add("a", far, t)  # 8-10: three do
    add("a", here, 1100)  # 11
    add("a", here, 5000)  # 12: silence of 3900 s
    add("a", here, 5250)  # 13: too short
    for t in (0, 299):
        add("b", here, t)
    add(None, here, 0)
    add("c", (None, 1.0), 0)
    add("c", (0.0, 0.0), 10)
    add("c", (float("nan"), 1.0), 20)
    add("c", (95.0, 1.0), 30)
    rows.append(("c", 99, 40.0, -70.0, None))
    df = spark.createDataFrame(rows, SCHEMA)
    got = detect_stops(df.withColumn("session_us", F.lit("clash")).withColumn("_run", F.lit(1)))
    assert [(r.caid, r.first_ping_id, r.last_ping_id, r.n_pings) for r in got.collect()] == [("a", 1, 6, 4)]
    twice = detect_stops(df.union(df))
    assert [(r.first_ping_id, r.last_ping_id) for r in twice.collect()] == [(1, 6)]
    assert detect_stops(df.limit(0)).count() == 0


def test_trips(spark):
    s, rows = 1_000_000, []
    for k, lat in enumerate((40.0, 40.01, 40.02)):
        for j, t in enumerate((0, 200, 400)):
            rows.append(("a", 10 * k + j, lat, -70.0, (k * 1000 + t + (90_000 if k == 2 else 0)) * s))
    t = trips_between(detect_stops(spark.createDataFrame(rows, SCHEMA))).orderBy("start_us").collect()
    assert [(r.from_ping_id, r.to_ping_id, r.duration_s, r.observed) for r in t] == [(2, 10, 600.0, True), (12, 20, 90_600.0, False)]
    assert all(abs(r.distance_m - 1112) < 2 for r in t)


def test_runs_over_bucket_borders(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"k": rng.choice(["x", "x", "x", "y"], 3000), "t": rng.integers(0, 50_000, 3000)})
    p["i"] = np.arange(len(p))
    q = p.sort_values(["k", "t", "i"])
    new = (q["k"] != q["k"].shift()) | (q["t"] - q["t"].shift() > 30)
    q["want"] = q["i"].where(new).ffill().astype(int)
    d = number_runs(spark.createDataFrame(p), ["k"], ["t", "i"], F.floor(F.col("t") / 500), lambda a, b: b["t"] - a["t"] > 30, "run")
    got = d.select("i", F.col("run.i").alias("r")).toPandas().set_index("i")["r"]
    assert (got.loc[q["i"]].to_numpy() == q["want"].to_numpy()).all()


def _plain_grow(i, xyz, r2, slack):
    got, away, passed = [i], [], []
    for j in range(i + 1, len(xyz)):
        if (((xyz[got] - xyz[j]) ** 2).sum(1) <= r2).all():
            got.append(j)
            passed += away
            away = []
        else:
            away.append(j)
            if len(away) > slack:
                break
    return got, passed


@pytest.mark.parametrize("seed", range(8))
def test_grow_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n = 900
    lat, lon = 40 + rng.normal(0, 1.2e-4, n) + np.cumsum(rng.normal(0, 2e-6, n)), 179.9999 + rng.normal(0, 1.2e-4, n)
    lat[rng.random(n) < 0.03] += 3e-4
    xyz, r2 = np_unit_vectors(lat, lon), chord(50.0) ** 2
    for i in range(0, n, 37):
        got, passed = _grow(i, xyz, r2, 2, window=16 if seed % 2 else 256)
        want, out = _plain_grow(i, xyz, r2, 2)
        assert got.tolist() == want and passed.tolist() == out
    some = rng.choice(n, 300, replace=False)
    hull = _hull(xyz, some)
    d = lambda a, b: ((xyz[a][:, None] - xyz[b][None]) ** 2).sum(2).max(1)
    assert np.allclose(d(np.arange(n), hull), d(np.arange(n), some), rtol=0, atol=1e-20)


def _still(n, every_s=1, share=0.02):
    rng = np.random.default_rng(1)
    off = rng.random(n) < share
    lat, lon = 40 + rng.uniform(0, 2.5e-4, n), -70 + rng.uniform(0, 3e-4, n)
    lat[off] += 3e-4
    return pd.DataFrame({"caid": "a", "ping_id": np.arange(n), "session_us": 0, "utc_us": np.arange(n) * every_s * 1_000_000, "latitude": lat, "longitude": lon})


def test_a_day_of_seconds():
    import time

    p = _still(86_400)
    began = time.perf_counter()
    got = pd.concat(list(_Dwell(50.0, 300.0, 2).run(p.iloc[i : i + 10_000] for i in range(0, len(p), 10_000))))
    assert time.perf_counter() - began < 30
    assert len(got) >= 1 and got["n_pings"].sum() > 80_000


def test_memory_is_bounded():
    p = _still(40_000, share=0.0)
    one = _Dwell(50.0, 300.0, 2, most=3000)
    out, most = [], 0
    for i in range(0, len(p), 1000):
        out.append(one.feed(p.iloc[i : i + 1000]))
        most = max(most, one.held)
    out.append(one.feed(None, final=True))
    got, want = pd.concat(out), pd.concat(list(_Dwell(50.0, 300.0, 2).run(iter([p]))))
    assert most <= 4000
    cols = ["first_ping_id", "last_ping_id", "n_pings"]
    assert got[cols].astype(int).values.tolist() == want[cols].astype(int).values.tolist() == [[0, 39_999, 40_000]]
    assert np.allclose(got[["latitude", "longitude", "path_end_m"]].astype(float), want[["latitude", "longitude", "path_end_m"]].astype(float), atol=1e-6)
    w = _walk(5, 3000).assign(caid="a", session_us=0)
    w["ping_id"] = np.arange(len(w))
    a, b = (pd.concat(list(_Dwell(50.0, 300.0, 2, most=m).run(w.iloc[i : i + 50] for i in range(0, len(w), 50)))) for m in (60, 10**6))
    assert a[["first_ping_id", "last_ping_id"]].values.tolist() == b[["first_ping_id", "last_ping_id"]].values.tolist()


def test_spikes_add_nothing_to_trips(spark):
    s, rows = 1_000_000, []
    for k, lat in enumerate((40.0, 40.01)):
        rows += [("a", 100 * k + j, lat, -70.0, (k * 3000 + t) * s) for j, t in enumerate((0, 200, 400))]
    rows += [("a", 10 + j, 40.0 + 0.001 * j, -70.0, (1000 + 100 * j) * s) for j in range(1, 10)]
    plain_ = trips_between(detect_stops(spark.createDataFrame(rows, SCHEMA))).first()
    noisy = rows + [("a", 50, 40.3, -70.0, 1450 * s), ("a", 51, 40.0, -70.4, 1650 * s), ("a", 52, 40.0, -70.4, 1660 * s), ("a", 53, 41.0, -70.0, 100 * s)]
    got = trips_between(detect_stops(spark.createDataFrame(noisy, SCHEMA))).first()
    assert abs(plain_.distance_m - 1112) < 2 and abs(got.distance_m - plain_.distance_m) < 1 and got.observed
    x = np_unit_vectors(np.array([40.0, 40.0, 40.3, 40.001, 40.002, 40.01]), np.full(6, -70.0))
    assert spikes(x, np.zeros(6), 50.0).tolist() == [False, False, True, False, False, False]


def test_trips_against_brute_force():
    for seed in range(4):
        p = _walk(seed, 800).assign(caid="a", session_us=0)
        p["ping_id"] = np.arange(len(p))
        stops = pd.concat(list(_Dwell(50.0, 300.0, 2).run(p.iloc[i : i + 97] for i in range(0, len(p), 97))))
        xyz = np_unit_vectors(p["latitude"], p["longitude"])
        kept = np.flatnonzero(~spikes(xyz, np.zeros(len(p)), 50.0))
        lat, lon = p["latitude"].to_numpy()[kept], p["longitude"].to_numpy()[kept]
        path = np.r_[0, np.cumsum(np_haversine(lat[:-1], lon[:-1], lat[1:], lon[1:]))]
        upto = lambda i: path[np.searchsorted(kept, i, "right") - 1]
        for first, last, a, z in stops[["first_ping_id", "last_ping_id", "path_start_m", "path_end_m"]].astype(float).values:
            assert abs(upto(first) - a) < 1e-3 and abs(upto(last) - z) < 1e-3
