"""Parquet in and out, with the layout and the small JSON record of a data set's folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

STAY_POINTS, LABELLED, FILTERED = "StayPoints", "StayPointsWithHomeWork", "FilteredUserStayPoints"
HOME_WORK, FULL_OD = "HomeWorkODMatrix", "FullODMatrix"
METRICS = ("DailyVisitedLocations", "DepartureTimeDistribution", "StayDurationDistribution")


def read(spark: SparkSession, *parts: str) -> DataFrame:
    return spark.read.parquet("/".join(parts))


def write(df: DataFrame, *parts: str, block_mb: int | None = None) -> str:
    """Overwrite; ``block_mb`` bounds the row groups for readers with little memory."""
    path = "/".join(parts)
    w = df.write.mode("overwrite")
    if block_mb:
        w = w.option("parquet.block.size", str(block_mb << 20))
    w.parquet(path)
    return path


def read_users(spark: SparkSession, path: str, users: DataFrame, user: str = "caid") -> DataFrame:
    """Rows of the given users only (a semi-join, so the list may be of any size)."""
    return spark.read.parquet(path).join(users.select(user), user, "left_semi")


def _file(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return fs.exists(p)


def write_config(spark: SparkSession, folder: str, params: dict) -> None:
    """The last parameters used, as config.json in the folder, wherever that is."""
    p, fs = _file(spark, f"{folder}/config.json")
    out = fs.create(p, True)
    out.write(json.dumps(params, default=str).encode())
    out.close()


def read_config(spark: SparkSession, folder: str) -> dict:
    p, fs = _file(spark, f"{folder}/config.json")
    if not fs.exists(p):
        raise RuntimeError(f"no config.json in {folder}: run the stay detection first")
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/config.json").collect()))


def file_info(spark: SparkSession, path: str) -> dict[str, int]:
    """Files and bytes below a path."""
    p, fs = _file(spark, path)
    s = fs.getContentSummary(p)
    return {"files": s.getFileCount(), "bytes": s.getLength()}


def consolidate(spark: SparkSession, path: str, to: str, files: int = 1, block_mb: int | None = None) -> str:
    """A table's files written again as ``files`` larger ones under ``to``, which is not ``path``."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError("a table is not written over itself while it is read")
    return write(spark.read.parquet(path).coalesce(files), to, block_mb=block_mb)


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders of a data set that hold a complete table, in order; none for a folder that is not there."""
    p, fs = _file(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and any(x.getPath().getName() == "_SUCCESS" for x in fs.listStatus(s.getPath())))


def backup(spark: SparkSession, path: str, to: str) -> str:
    """A copy of a file or table, made by the file systems' own means; ``to`` must not exist."""
    p, fs = _file(spark, path)
    q, gs = _file(spark, to)
    if gs.exists(q):
        raise FileExistsError(to)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, gs, q, False, spark._jsc.hadoopConfiguration())
    return to


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or table; whether there was one."""
    p, fs = _file(spark, path)
    return fs.delete(p, True)
