import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracksmith.functions.geo import np_haversine
from tracksmith.operators.skew import aggregate_by_key, heavy_hitters
from tracksmith.operators.spatial import KdSplits, near_pairs, points_in_regions, sweep_regions


def test_heavy_hitters(spark):
    keys = ["hot"] * 400 + [f"k{i % 300}" for i in range(580)] + [None] * 20
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, heavy int")
    assert [(r.k, r.n) for r in heavy_hitters(df, "k", 0.02).collect()] == [("hot", 400)]
    assert heavy_hitters(df.limit(0), "k").count() == 0
    for share in (1e-4, 2e-5, 1e-6):
        assert heavy_hitters(df, "k", share).count() == 301
    got = aggregate_by_key(df, "k", {"n": F.count(F.lit(1)), "m": F.max("heavy")}, {"n": F.sum("n"), "m": F.max("m")}).toPandas()
    want = pd.DataFrame({"k": keys, "i": range(1000)}).groupby("k", dropna=False).agg(n=("i", "size"), m=("i", "max"))
    assert len(got) == len(want) == 302
    assert got.set_index("k")["n"].sum() == 1000 and set(got[got.heavy].k) == {"hot"}
    assert got[got.k.isna()].n.item() == 20


def _stops(n, seed):
    rng = np.random.default_rng(seed)
    lat, lon = rng.normal(10, 2e-3, n), (180 + rng.normal(0, 2e-3, n) + 180) % 360 - 180
    lat[: n // 4] = 10.0  # many rows on one spot, at the meridian and near a pole
    lon[: n // 4] = 180.0
    lat[-20:], lon[-20:] = 89.9999, rng.uniform(-180, 180, 20)
    return pd.DataFrame({"i": np.arange(n), "u": rng.integers(0, 9, n).astype(str), "a": lat, "b": lon})


def test_near_pairs(spark):
    p = _stops(400, 1)
    ok = np_haversine(p.a.to_numpy()[:, None], p.b.to_numpy()[:, None], p.a.to_numpy(), p.b.to_numpy()) <= 50
    want = {(i, j) for i, j in zip(*np.nonzero(ok)) if i < j and p.u[i] != p.u[j]}
    df = spark.createDataFrame(p)
    bad = spark.createDataFrame([(900, "z", None, 1.0), (901, None, float("nan"), 1.0), (None, "q", 10.0, 180.0)], "i bigint, u string, a double, b double")
    df = df.unionByName(bad).unionByName(df.limit(30)).withColumn("_leaf", F.lit(1)).withColumn("_own", F.lit("x"))
    for rows in (20_000, 40):
        got = near_pairs(df, "i", [("a", "b"), ("a", "b")], 50.0, "u", part_rows=rows)
        pairs = [(r.a, r.b) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert near_pairs(df.limit(0), "i", [("a", "b")], 50.0, "u").count() == 0


def test_regions(spark):
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-1, 5, 500), rng.uniform(-1, 5, 500)

    def inside(px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1]):
            if (ax <= px < bx or bx <= px < ax) and py >= ay + (by - ay) * (px - ax) / (bx - ax):
                odd = not odd
        return odd

    want = {i for i in range(500) if inside(x[i], y[i])}
    assert set(sweep_regions(x, y, [np.array(star)])[0].tolist()) == want
    pts = spark.createDataFrame([(i, float(b), float(a)) for i, (a, b) in enumerate(zip(x, y))] + [(999, None, 1.0)], "i int, lat double, lon double")
    reg = spark.createDataFrame([(7, [tuple(q) for q in star]), (8, None), (9, [(0.0, 0.0)])], "region_id int, ring array<struct<lng:double,lat:double>>")
    for corners, full in ((200_000, 9), (0, 9), (0, 10**6)):
        got = points_in_regions(pts, "i", "lat", "lon", reg, max_corners=corners, tile_points=full)
        assert {(r.i, r.region_id) for r in got.collect()} == {(i, 7) for i in want}
    assert points_in_regions(pts.limit(0), "i", "lat", "lon", reg).count() == 0
    assert points_in_regions(pts, "i", "lat", "lon", reg.limit(0)).count() == 0


def test_splits_at_any_number_of_rows(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(3000, 3))
    tree = KdSplits(xyz[:500], 64)
    row, leaf, own = tree.assign(xyz, 0.05)
    assert own.sum() == 3000 and np.bincount(row[own]).max() == 1 and tree.leaves == 64
    home = dict(zip(row[own], leaf[own]))
    there = set(zip(row.tolist(), leaf.tolist()))
    near = ((xyz[:300, None] - xyz[None]) ** 2).sum(2) <= 0.05**2
    assert all((j, home[i]) in there for i, j in zip(*np.nonzero(near)))
    p = _stops(400, 4)
    p.loc[:99, "a"] = rng.normal(10, 2e-3, 100)  # no spot
    got = near_pairs(spark.createDataFrame(p), "i", [("a", "b")], 50.0, "u", part_rows=10, max_parts=4).count()
    assert got == near_pairs(spark.createDataFrame(p), "i", [("a", "b")], 50.0, "u").count()
