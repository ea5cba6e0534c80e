from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracksmith.functions.timestamps import normalize_timestamps

LOOKUP = [(1, " america/new_york ", "MM/dd/yyyy hh:mm:ss a"), (2, "Europe/Berlin", "dd/MM/yyyy HH:mm:ss"), (3, "+05:30", "UNIX"), (4, None, "yyyy-MM-dd HH:mm:ss"), (5, "Asia/Kolkata", None), (6, "Europe/Moscow", None)]


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    (1, "1331234563", 1331234563_000000, "ok"),
    (1, "1331234563123", 1331234563_123000, "ok"),
    (1, "1331234563123456", 1331234563_123456, "ok"),
    (1, "1331234563123456789", 1331234563_123456, "ok"),
    (1, "1331234563.5", 1331234563_500000, "ok"),
    (1, "1.331426086E9", 1331426086_000000, "ok"),
    (4, "2012-03-05T12:06:13+05:30", us(2012, 3, 5, 6, 36, 13), "ok"),
    (4, " 2012-03-11t00:41:37z ", us(2012, 3, 11, 0, 41, 37), "ok"),
    (4, "20120308T184544Z", us(2012, 3, 8, 18, 45, 44), "ok"),
    (4, "Mon, 05 Mar 2012 17:28:44 +0530", us(2012, 3, 5, 11, 58, 44), "ok"),
    (4, "2012-03-10T18:33:44-06:00[America/Mexico_City]", us(2012, 3, 11, 0, 33, 44), "ok"),
    (1, "20120701120000", us(2012, 7, 1, 16), "ok"),
    (1, "07/08/2012 01:00:00 PM", us(2012, 7, 8, 17), "ok"),
    (2, "07/08/2012 13:00:00", us(2012, 8, 7, 11), "ok"),
    (1, "07/25/2012 12:00:00 AM", us(2012, 7, 25, 4), "ok"),
    (3, "2012-07-01 05:30:00", us(2012, 7, 1), "ok"),
    (5, "05-Mar-2012 17:39:15 IST", us(2012, 3, 5, 12, 9, 15), "ok"),
    (1, "01-Nov-2015 01:30:00 EST", us(2015, 11, 1, 6, 30), "ok"),
    (1, "01-Nov-2015 01:30:00 EDT", us(2015, 11, 1, 5, 30), "ok"),
    (2, "2015-06-01 10:00:00 EST", None, "invalid"),
    (1, "2015-11-01 01:30:00", None, "ambiguous"),
    (1, "2015-03-08 02:30:00", None, "nonexistent"),
    (4, "2015-03-08 02:30:00", None, "no_zone"),
    (9, "2015-03-08 02:30:00", None, "no_zone"),
    (None, "2015-03-08 02:30:00Z", us(2015, 3, 8, 2, 30), "ok"),
    (5, "07/08/2012 13:00:00", None, "day_or_month"),
    (5, "07/07/2012 13:00:00", us(2012, 7, 7, 7, 30), "ok"),
    (1, "2021-02-30 10:15:00", None, "invalid"),
    (1, "31/04/2018 25:61:00", None, "invalid"),
    (1, "0000-00-00 00:00:00", None, "invalid"),
    (1, "2020-06-", None, "invalid"),
    (1, "N/A", None, "invalid"),
    (6, "2020-06-01 12:00:00 MSK", us(2020, 6, 1, 9), "ok"),
    (6, "2012-06-01 12:00:00 MSK", us(2012, 6, 1, 8), "ok"),
    (6, "2014-10-26 01:30:00 MSK", None, "invalid"),
    (6, "1850-06-01T12:00:00Z", us(1850, 6, 1, 12), "ok"),
    (6, "9999-12-31T00:00:00Z", us(9999, 12, 31), "ok"),
    (6, "-86400", -86_400_000_000, "ok"),
    (6, "-86400.5", -86_400_500_000, "ok"),
    (6, "-", None, "invalid"),
    (1, "9" * 5000, None, "invalid"),
    (1, "  ", None, "missing"),
    (1, None, None, "missing"),
]


def _lookup(spark):
    return spark.createDataFrame(LOOKUP, "dataset_id int, time_zone string, time_format string")


def test_forms(spark):
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _, _) in enumerate(CASES)], "i int, dataset_id int, utc_timestamp string")
    got = {r.i: (r.utc_us, r.ts_status) for r in normalize_timestamps(df, _lookup(spark)).collect()}
    assert len(got) == len(CASES)
    for i, (k, t, want, status) in enumerate(CASES):
        assert got[i] == (want, status), (k, (t or "")[:40])


def test_policies(spark):
    df = spark.createDataFrame([(1, "2015-11-01 01:30:00"), (1, "2015-03-08 02:30:00")], "dataset_id int, utc_timestamp string")
    got = lambda **kw: [r.utc_us for r in normalize_timestamps(df, _lookup(spark), **kw).collect()]
    assert got(ambiguous="earlier")[0] == us(2015, 11, 1, 5, 30)
    assert got(ambiguous="later")[0] == us(2015, 11, 1, 6, 30)
    assert got(nonexistent="shift")[1] == us(2015, 3, 8, 7, 30)
    with pytest.raises(ValueError):
        got(ambiguous="first")


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "1331234563", "x", "y", 5)], "dataset_id int, utc_timestamp string, time_zone string, `_zone` string, utc_us int")
    r = normalize_timestamps(df.drop("_zone"), _lookup(spark)).first()
    assert r.utc_us == 1331234563_000000 and r.time_zone == "x"
    assert normalize_timestamps(df.drop("_zone").limit(0), _lookup(spark)).count() == 0
    assert normalize_timestamps(df.drop("_zone"), _lookup(spark).limit(0)).first().ts_status == "ok"


def test_filter_is_not_rewritten_through_the_cascade(spark):
    df = spark.createDataFrame([(1, "1331234563")], "dataset_id int, utc_timestamp string")
    plan = normalize_timestamps(df, _lookup(spark)).where(F.col("ts_status") == "ok")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and len(plan) < 40_000
