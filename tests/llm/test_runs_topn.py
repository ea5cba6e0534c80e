import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracksmith.functions.geo import np_haversine
from tracksmith.llm.runs import collapse_repeats
from tracksmith.llm.topn import top_n_per_group

STAYS = "caid string, unix_timestamp bigint, row_id bigint, longitude double, latitude double"


def _brute(p: pd.DataFrame) -> list:
    out, cur = [], None
    for k, t, i, lo, la in p.dropna().sort_values(["caid", "unix_timestamp", "row_id"])[["caid", "unix_timestamp", "row_id", "longitude", "latitude"]].itertuples(index=False):
        if cur and cur[0] == k and t - cur[4] <= 86_400 and np_haversine(cur[6], cur[5], la, lo) <= 50:
            cur[2], cur[4], cur[7] = i, t, cur[7] + 1
        else:
            cur = [k, i, i, t, t, lo, la, 1]
            out.append(cur)
    return sorted((c[0], c[1], c[2], c[4] - c[3], c[7]) for c in out)


def _got(df):
    return sorted((r.caid, r.first_row_id, r.last_row_id, r.duration_s, r.n_rows) for r in collapse_repeats(df).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_runs_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 3000
    p = pd.DataFrame({"caid": rng.choice(["hot", "hot", "b", "c"], n), "unix_timestamp": np.cumsum(rng.integers(0, 9000, n)) + rng.integers(0, 2, n) * 40_000, "row_id": rng.permutation(n)})
    place = np.repeat(rng.integers(0, 5, n // 6 + 1), 6)[:n]
    p["longitude"], p["latitude"] = -70 + place * 4e-4 + rng.normal(0, 1.5e-4, n), 40 + rng.normal(0, 1.5e-4, n)
    p.loc[rng.choice(n, 30), "unix_timestamp"] = 5
    df = spark.createDataFrame(p, STAYS)
    assert _got(df) == _brute(p)


def test_runs_edges(spark):
    rows = [("a", 0, 1, 1.0, 1.0), ("a", 10, 2, None, 1.0), ("a", 20, 3, 1.0, 1.0), ("a", 20, 4, 1.0, 1.0), ("a", 20 + 86_400, 5, 1.0, 1.0), ("a", 21 + 2 * 86_400, 6, 1.0, 1.0), (None, 0, 7, 1.0, 1.0), ("b", None, 8, 1.0, 1.0), ("b", 0, 9, float("nan"), 1.0), ("b", 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, STAYS).withColumn("_chain", F.lit(1)).withColumn("lon", F.lit("x")).withColumn("ts", F.lit(2))
    assert _got(df) == [("a", 1, 5, 86_420, 4), ("a", 6, 6, 0, 1)]
    assert _got(df.limit(0)) == []


ORDER = [("v", True), ("w", True), ("i", False)]


def _top(p: pd.DataFrame, n: int) -> set:
    q = p.dropna(subset=["g", "v", "w", "i"]).drop_duplicates().sort_values(["g", "v", "w", "i"], ascending=[True, False, False, True])
    return set(q.groupby("g").head(n)[["g", "i"]].itertuples(index=False, name=None))


@pytest.mark.parametrize("n,arity,hot", [(3, 64, 200_000), (7, 9, 100)])
def test_top_n(spark, n, arity, hot):
    rng = np.random.default_rng(n)
    p = pd.DataFrame({"g": rng.choice(["hot", "hot", "b", "c", "d"], 1500), "i": np.arange(1500) // 2 * 2, "v": rng.integers(0, 4, 1500), "w": rng.integers(-3, 3, 1500)})
    p = p.groupby(["g", "i"], as_index=False).first()
    p = pd.concat([p, p.sample(50, random_state=1), pd.DataFrame({"g": ["one"], "i": [5], "v": [1], "w": [1]})])
    df = spark.createDataFrame(p)
    bad = spark.createDataFrame([(None, 1, 9, 9), ("b", 9001, None, 9)], "g string, i bigint, v bigint, w bigint")
    got = top_n_per_group(df.unionByName(bad), "g", ORDER, n, arity=arity, hot_rows=hot)
    rows = [(r.g, r.i) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _top(p, n)
    assert got.columns == df.columns


def test_top_n_wide_ranges(spark):
    big = (1 << 63) - 1
    rows = [("a", k, v, w) for k, (v, w) in enumerate([(big, -big), (big, 0), (-big, big), (0, 0), (big, big), (-big - 1, 1)])]
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint, w bigint").withColumn("_salt", F.lit("x"))
    for n in (2,):
        got = {r.i for r in top_n_per_group(df.drop("_salt"), "g", ORDER, n, arity=4096).collect()}
        assert got == {i for _, i in _top(pd.DataFrame(rows, columns=["g", "i", "v", "w"]), n)}, n
    assert top_n_per_group(df.limit(0), "g", ORDER, 3).count() == 0


def test_top_n_kinds_and_ties(spark):
    rows = [("a", 1, 2.7), ("a", 2, 2.3), ("a", 3, 2.9), ("a", 4, -1.5), ("a", 5, -1.25), ("b", 1, float("nan")), ("b", 2, 9.0), ("b", 3, 0.0), ("b", 4, -0.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, i int, x double").withColumn("f", F.col("x").cast("float")).withColumn("m", F.when(~F.isnan("x"), F.col("x")).cast("decimal(9,2)"))
    best = lambda n, desc, c="x": sorted((r.g, r.i) for r in top_n_per_group(df, "g", [(c, desc)], n).collect())
    assert best(1, True) == best(1, True, "f") == [("a", 3), ("b", 1)]
    assert best(2, False) == [("a", 4), ("a", 5), ("b", 3), ("b", 4)]
    assert best(1, True, "m") == [("a", 3), ("b", 2)]
    assert best(0, True) == []
    ties = spark.range(500).selectExpr("'t' g", "1.5D x", "id", "cast(null as string) `_g`")
    first = {r.id for r in top_n_per_group(ties, "g", [("x", True)], 7).collect()}
    assert len(first) == 7 and first == {r.id for r in top_n_per_group(ties.repartition(7), "g", [("x", True)], 7, arity=300, hot_rows=50).collect()}
    dates = spark.sql("select 'g' g, date_add(date'2020-01-01', cast(id as int)) d, timestamp_micros(id) t, id % 2 = 0 e from range(9)")
    assert [str(r.d) for r in top_n_per_group(dates, "g", [("e", True), ("d", True)], 1).collect()] == ["2020-01-09"] == [str(r.d) for r in top_n_per_group(dates, "g", [("t", True)], 1).collect()]
    with pytest.raises(TypeError):
        top_n_per_group(dates.withColumn("s", F.lit("x")), "g", [("s", True)], 1)
