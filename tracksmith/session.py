"""Session, settings and the two small services every operator uses: cutting
lineage in shared storage and deciding whether a side may be broadcast."""

from __future__ import annotations

import logging
import os
import tempfile
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("tracksmith")


@dataclass(frozen=True)
class Settings:
    """Engine settings. ``from_env`` reads TRACKSMITH_CORES, _MEMORY and _LOG_LEVEL."""

    cores: int = 8
    memory: str = "8g"
    log_level: str = "WARN"
    ignore_corrupt_files: bool = False

    @classmethod
    def from_env(cls) -> "Settings":
        return cls(
            cores=int(os.environ.get("TRACKSMITH_CORES", cls.cores)),
            memory=os.environ.get("TRACKSMITH_MEMORY", cls.memory),
            log_level=os.environ.get("TRACKSMITH_LOG_LEVEL", cls.log_level),
        )

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)


def build_session(settings: Settings | None = None, app_name: str = "tracksmith", **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and partitions sized to the cores; a running session is returned as it is."""
    s = settings or Settings.from_env()
    b = (
        SparkSession.builder.master(f"local[{s.cores}]")
        .appName(app_name)
        .config("spark.driver.memory", s.memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(2 * s.cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.ignoreCorruptFiles", str(s.ignore_corrupt_files).lower())
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel(s.log_level)
    return spark


def configure_logging(level: int | str = logging.INFO, path: str | None = None) -> logging.Logger:
    """Idempotent logging set-up: one stream handler and, when asked, one file handler."""
    log.setLevel(level)
    if not any(type(h) is logging.StreamHandler for h in log.handlers):
        log.addHandler(logging.StreamHandler())
    if path and not any(isinstance(h, logging.FileHandler) and h.baseFilename == os.path.abspath(path) for h in log.handlers):
        log.addHandler(logging.FileHandler(path))
    return log


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that set on the context. Only a local master may do without: it gets a folder of its own; on a cluster the executors could not read each other's files there, so that is an error."""
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    shared = sc.getConf().get("spark.checkpoint.dir") or (set_.get() if set_.isDefined() else None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        shared = tempfile.mkdtemp(prefix="tracksmith-checkpoint-")
    if set_.isEmpty():
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, see :func:`shared_folder`. Never a local checkpoint: the blocks must survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint when ``df`` is counted to hold at most ``max_rows`` rows; else ``df`` unchanged, so that it is shuffled."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package once per application, so that Arrow functions can import it on machines where it is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tracksmith_shipped", False):
        return spark
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tracksmith-"), "tracksmith.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(path)
    sc._tracksmith_shipped = True
    return spark


def _tables(spark: SparkSession):
    """(Hadoop path, file system) of this application's tables in the shared folder."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tracksmith-{sc.applicationId}")
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def write_table(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, as Parquet: compressed and column-wise, for tables that are read more than once.

    The tables of an application lie in one folder, which is deleted when its
    JVM ends, or before by :func:`release_tables`.
    """
    import uuid

    p, fs = _tables(df.sparkSession)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    path = f"{p.toString()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> None:
    """Delete what :func:`write_table` has written in this application. No result that still reads it may be used afterwards."""
    p, fs = _tables(spark)
    fs.delete(p, True)
