import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.functions import cells, h3
from tracksmith.models import daily
from tracksmith.models.gravity import Gravity, check_resolution, pair_distances
from tracksmith.operators import areal, flows, timelines
from tracksmith.operators.sequences import fill_forward, running_total
from tracksmith.plans import mobility


def _points(n, seed, res):
    """Half of them near the twelve pentagons."""
    rng, (_, bases) = np.random.default_rng(seed), h3._tables()
    v = rng.normal(size=(n, 3))
    tips = bases.xyz[bases.pentagon]
    v[: n // 2] = tips[rng.integers(0, 12, n // 2)] + rng.normal(0, 0.3 / np.sqrt(7) ** res + 0.02, (n // 2, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, *h3._degrees(v)


@pytest.mark.parametrize("res", [0, 1, 2, 5, 8, 15])
def test_centres_and_corners(res):
    v, lat, lng = _points(1500, res, res)
    c = h3.latlng_to_cell(lat, lng, res)
    la, lo = h3.cell_to_latlng(c)
    assert h3.valid(c).all() and (h3.latlng_to_cell(la, lo, res) == c).all()
    w = h3._xyz(np.radians(la), np.radians(lo))
    reach = 0.25 / np.sqrt(7) ** res
    assert np.arccos(np.clip((v * w).sum(1), -1, 1)).max() < reach
    for cell, b in list(zip(c, h3.cell_to_boundary(c)))[::10]:
        assert len(b) in (5, 6)
        centre = h3._xyz(*np.radians(h3.cell_to_latlng([cell]))[:, 0])
        corners = h3._xyz(*np.radians(np.array(b)).T)
        d = np.arccos(np.clip(corners @ centre, -1, 1))
        assert d.max() < reach and d.min() > 0.2 * reach
        for share, there in ((0.9, True), (1.1, False)):  # just inside and outside every corner
            p = centre + share * (corners - centre)
            assert ((h3.latlng_to_cell(*h3._degrees(p / np.linalg.norm(p, axis=1, keepdims=True)), res) == cell) == there).all()


def test_published_cells():
    known = ((37.7752702151959, -122.418307270836, 9, "8928308280fffff"), (37.3615593, -122.0553238, 7, "87283472bffffff"), (40.689167, -74.044444, 10, "8a2a1072b59ffff"), (67.150926864, -168.390888581, 5, "850dab63fffffff"), (20, 123, 2, "824b9ffffffffff"))
    for lat, lng, res, want in known:
        assert f"{h3.latlng_to_cell([lat], [lng], res)[0]:x}" == want
    for cell, lat, lng in ((0x85283473FFFFFFF, 37.34579337536848, -121.97637597255124), (0x8928342E20FFFFF, 37.5012466151, -122.5003039349)):
        assert np.allclose(np.concatenate(h3.cell_to_latlng([cell])), (lat, lng), atol=1e-8)
    _, bases = h3._tables()
    assert np.flatnonzero(bases.pentagon).tolist() == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    assert h3.latlng_to_cell([np.nan, 95.0], [0.0, 0.0], 5).tolist() == [0, 0]
    assert np.isnan(h3.cell_to_latlng([5])[0]).all() and h3.cell_to_boundary([5]) == [None]
    assert h3.valid([0, 0x8029FFFFFFFFFFF, 0x80F5FFFFFFFFFFF, 0x8829A1D757FFFFF]).tolist() == [False, True, False, True]


def test_systems_do_not_mix(spark):
    df = spark.createDataFrame([(34.05, -118.25), (None, 1.0)], "lat double, lng double")
    for system, other in (("grid", "h3"), ("h3", "grid")):
        c = df.select(cells.latlng_to_cell(F.col("lat"), F.col("lng"), 8, system).alias("c"))
        at = lambda s: c.select(cells.cell_to_latlng(F.col("c"), s).alias("p"), cells.cell_to_boundary(F.col("c"), s).alias("b"), cells.first_vertex(F.col("c"), s).alias("v"), cells.parent(F.col("c"), 6).alias("q"), F.col("c")).collect()  # noqa: B023, E731
        a, none = sorted(at(system), key=lambda r: r.c is None)
        assert abs(a.p.lat - 34.05) < 0.01 and abs(a.p.lng + 118.25) < 0.01 and none.p.lat is None and none.c is None and none.q is None
        assert a.v.lat == a.b[0].lat and len(a.b) == (6 if system == "h3" else 4) and cells.system_of(c, "c") == system
        with pytest.raises(Exception, match="no cell of the built-in grid" if other == "grid" else "no H3 cell"):
            at(other)
    with pytest.raises(Exception, match="no cell"):
        spark.createDataFrame([(5,)], "c bigint").select(cells.parent(F.col("c"), 3)).collect()
    with pytest.raises(ValueError):
        cells.cell_to_latlng(F.col("c"), "s2")


def test_stays_with_h3_cells(spark):
    """Six users, 21 days, three stays a day, every place an H3 cell: nobody and nothing is lost."""
    rows = []
    cell = lambda la, lo: int(h3.latlng_to_cell([la], [lo], 8)[0])
    for u in range(6):
        home, work = cell(34.05 + 0.01 * u, -118.25), cell(34.1 + 0.01 * u, -118.35)
        for day in range(21):
            k = day % 20
            for hour, c, t in ((2, home, "home"), (9, work, "work"), (19, cell(34.0 + 0.01 * k, -118.1 - 0.01 * k), "other")):
                rows.append((f"u{u}", 1546300800 + day * 86400 + hour * 3600, c, t, f"{home:X}", f"{work:X}", day % 7 + 1))
    s = spark.createDataFrame(rows, "userid string, stay_start_timestamp bigint, h3_id_region bigint, type string, home_h3_index string, work_h3_index string, day_of_week int")
    a = daily.align(s, system="h3")
    got = a.select("caid", "h3_id_region", "type", "latitude", "longitude").collect()
    assert len(got) == 378 and {r.type for r in got} == {0, 1, 2} and all(33.9 < r.latitude < 34.3 and -118.4 < r.longitude < -118 for r in got)
    v = daily.align(s, "vertex0", "h3").first()
    assert v.latitude != daily.align(s, system="h3").where(F.col("timestamp") == v.timestamp).where(F.col("caid") == v.caid).first().latitude
    with pytest.raises(Exception, match="no cell of the built-in grid"):
        daily.align(s).collect()
    st = s.select(F.col("userid").alias("caid"), F.col("h3_id_region").alias("cell"), F.col("stay_start_timestamp").alias("local_time"))
    assert flows.stay_count(st, 7, system="h3").agg(F.sum("count")).first()[0] == 378
    od = flows.od_flow(st, 7, system="h3")
    assert od.agg(F.sum("flow")).first()[0] == 6 * 62 and od.where("distance is null or distance > 60").count() == 0
    assert flows.tessellation(st, system="h3").where("size(boundary) = 6").count() == st.select("cell").distinct().count()
    m = daily.TimeGeo(num_days=1, min_unique_locations=10, seed=4, system="h3").fit(s)
    assert m.stats()["num_users"] == 6


def test_h3_polygons(spark):
    ring = [(-118.5, 34.0), (-118.3, 34.0), (-118.3, 34.2), (-118.5, 34.2)]
    d = spark.createDataFrame([(1, ring), (2, None)], "region_id int, ring array<struct<lng:double,lat:double>>")
    got = {r.cell for r in areal.polygon_cells(d, 7, system="h3").collect()}
    rng = np.random.default_rng(0)
    c = np.unique(h3.latlng_to_cell(rng.uniform(33.95, 34.25, 60_000), rng.uniform(-118.55, -118.25, 60_000), 7))
    la, lo = h3.cell_to_latlng(c)
    assert got == set(c[(la >= 34.0) & (la < 34.2) & (lo >= -118.5) & (lo < -118.3)].tolist()) and len(got) > 50
    hole = spark.createDataFrame([(1, [(-118.45, 34.05), (-118.35, 34.05), (-118.35, 34.15), (-118.45, 34.15)])], "region_id int, ring array<struct<lng:double,lat:double>>")
    parts = areal.polygon_cells(d, 7, system="h3"), areal.polygon_cells(hole, 7, system="h3")
    left = areal.with_holes(d, *parts)
    assert left.count() == parts[0].count() - parts[1].count() and parts[1].count() > 5
    tracts = spark.createDataFrame([(1, [(-118.45, 34.05), (-118.35, 34.05), (-118.35, 34.15), (-118.45, 34.15)], 300.0)], "tract_id int, ring array<struct<lng:double,lat:double>>, population double")
    assert abs(areal.areal_population(parts[0].select("cell"), tracts, system="h3").agg(F.sum("population")).first()[0] - 300) < 0.5


def test_totals_in_ranges(spark):
    rng = np.random.default_rng(0)
    x = [(int(i), int(v), None if v % 3 else f"n{v}") for i, v in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    d = spark.createDataFrame(x, "i int, v int, n string").repartition(7)
    want, last, total = {}, None, 0
    for i, v, n in sorted(x):
        total, last = total + v, n if n is not None else last
        want[i] = (total, last)
    a = {r.i: r.t for r in running_total(d, ["i"], F.col("v"), "t").collect()}
    b = {r.i: r.t for r in fill_forward(d, ["i"], F.col("n"), "t").collect()}
    assert all((a[i], b[i]) == w for i, w in want.items())
    assert running_total(d.limit(0), ["i"], F.col("v"), "t").count() == 0


def test_timeline_names_and_comparisons(spark):
    t = spark.sql("select 'u' user, timestamp'2024-01-02 00:00:00' + make_interval(0,0,0,0,0,10*cast(id as int),0) datetime, case when id % 4 < 2 then 'h' else 'w' end location_type, id % 4 div 2 * 0.1D lon, 1D lat from range(144)")
    n = timelines.normalize_timeline(t)
    assert n.columns == ["user_id", "timeslot", "location_type", "longitude", "latitude"] and [r[0] for r in n.agg(F.min("timeslot")).collect() + n.agg(F.max("timeslot")).collect()] == [1, 144]
    with pytest.raises(ValueError):
        timelines.normalize_timeline(t.drop("lat"))
    assert set(timelines.combined_analysis(n)) == {"stay_duration", "daily_locations", "trip_distance", "departures"} and all(x.count() for x in timelines.combined_analysis(n).values())
    nodes = spark.range(5).selectExpr("id node", "id * 0.1D longitude", "1D latitude")
    with pytest.raises(ValueError):
        timelines.nearest_node(n, nodes, max_nodes=3)


def test_gravity_guards(spark):
    tiles = spark.createDataFrame([(i, 10.0 + i * 0.05, -70.0 + (i * 7) % 5 * 0.05, 1.0 + i % 4, 100.0) for i in range(40)], "tile bigint, latitude double, longitude double, relevance double, tot_outflow double")
    every = {(r.i, r.j): r.km for r in pair_distances(tiles).collect()}
    near = {(r.i, r.j): r.km for r in pair_distances(tiles, 20.0).collect()}
    assert near == {k: v for k, v in every.items() if v <= 20.0} and len(near) > 20
    a, b = (spark.createDataFrame([(int(h3.latlng_to_cell([34.0], [-118.0], r)[0]),)], f"{c} bigint") for r, c in ((7, "origin"), (8, "tile")))
    with pytest.raises(ValueError, match="resolution"):
        check_resolution(a, b)
    check_resolution(a, a.toDF("tile"))
    g = Gravity(gravity_type="global").generate(tiles, pair_distances(tiles), "flows_sample", seed=1)
    assert g.agg(F.sum("flow")).first()[0] == 4000


def test_rows_before_python_are_narrow(spark, data):
    """Rows that wait for Python lie on disk, so they must not hold a copy of a column for every mention of it."""
    nodes = [mobility.QUERIES["h3_round_trip"](spark, data)._jdf.queryExecution().optimizedPlan()]
    for p in nodes:
        nodes += [p.children().apply(i) for i in range(p.children().size())]
    assert sum(p.nodeName() == "ArrowEvalPython" for p in nodes) == 3
    assert max(p.output().size() for p in nodes) < 8
    df = spark.createDataFrame([(37.7752702151959, -122.418307270836), (None, 1.0), (1.0, float("nan")), (95.0, 0.0)], "lat double, lng double")
    c = df.coalesce(1).withColumn("c", cells.latlng_to_cell(F.col("lat"), F.col("lng"), 9, "h3"))
    got = c.select("c", cells.cell_to_latlng(F.col("c"), "h3").alias("at")).collect()
    assert [r.c for r in got] == [0x8928308280FFFFF, None, None, None]
    assert abs(got[0]["at"].lat - 37.77670) < 1e-3 and all(tuple(r["at"]) == (None, None) for r in got[1:])
