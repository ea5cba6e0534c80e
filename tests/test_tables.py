import json

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import areal
from tracksmith.session import cut_lineage, release_tables, shared_folder, write_table
from tracksmith.sources import tables


def test_tables(spark, tmp_path):
    f = f"{tmp_path}/set"
    d = spark.range(100).select(F.col("id").cast("string").alias("caid"), "id")
    assert tables.list_tables(spark, f) == []
    tables.write(d.repartition(5), f, "A", block_mb=1)
    tables.write_config(spark, f, {"k": 1})
    assert tables.file_info(spark, f"{f}/A")["files"] >= 5 and tables.file_info(spark, f"{f}/A")["bytes"] > 0
    tables.consolidate(spark, f"{f}/A", f"{f}/B", 1)
    assert tables.list_tables(spark, f) == ["A", "B"] and len(tables.read(spark, f, "B").inputFiles()) == 1 and tables.read(spark, f, "B").count() == 100
    with pytest.raises(ValueError):
        tables.consolidate(spark, f"{f}/A", f"{f}/A/")
    few = tables.read_users(spark, f"{f}/A", spark.createDataFrame([("3",), ("5",), ("x",)], "caid string"))
    assert sorted(r.id for r in few.collect()) == [3, 5]
    tables.backup(spark, f"{f}/config.json", f"{f}/old.json")
    assert tables.exists(spark, f"{f}/old.json") and tables.read_config(spark, f) == {"k": 1}
    with pytest.raises(FileExistsError):
        tables.backup(spark, f"{f}/config.json", f"{f}/old.json")
    assert tables.remove(spark, f"{f}/B") and not tables.remove(spark, f"{f}/B") and tables.list_tables(spark, f) == ["A"]
    with pytest.raises(RuntimeError):
        tables.read_config(spark, f"{f}/none")


def test_written_tables_are_released(spark):
    t = write_table(spark.range(5))
    where = t.inputFiles()[0]
    assert t.count() == 5 and shared_folder(spark) in where and cut_lineage(spark.range(3)).count() == 3
    release_tables(spark)
    assert not tables.exists(spark, where)
    assert write_table(spark.range(2)).count() == 2


def test_geojson(spark):
    sq = lambda x, w: [[x, 0.0], [x + w, 0.0], [x + w, w], [x, w], [x, 0.0]]
    rows = [
        (1, json.dumps({"type": "Feature", "properties": {"population": 7}, "geometry": {"type": "Polygon", "coordinates": [sq(0, 4), sq(1, 1)]}})),
        (2, json.dumps({"type": "MultiPolygon", "coordinates": [[sq(10, 1)], [sq(20, 1), sq(20.2, 0.2)]]})), (3, json.dumps({"type": "Point", "coordinates": [1, 2]})), (4, "{"), (5, None),
    ]
    got = areal.read_geojson(spark.createDataFrame(rows, "region_id int, value string"), properties=("population",)).collect()
    assert [(r.region_id, r.part, r.hole, len(r.ring), r.population) for r in got] == [(1, 0, False, 4, 7.0), (1, 0, True, 4, 7.0), (2, 0, False, 4, None), (2, 1, False, 4, None), (2, 1, True, 4, None)]
