"""Objects for whole workflows over a folder of tables. Every step they run is one of the operators."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells
from .functions.geo import R_ROUND_M, haversine
from .operators import flows, grid, places, stops
from .sources import tables


def _epoch(t: str | datetime) -> int:
    t = datetime.fromisoformat(t) if isinstance(t, str) else t
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp())


@dataclass(frozen=True)
class MobilityDataset:
    """Where a data set lies and how its pings are to be read. Holds no data."""

    dataset_name: str
    raw_data_path: str
    column_mappings: dict = field(default_factory=dict)
    processed_data_path: str | None = None
    start_datetime: str = "2020-01-01 00:00:00"
    end_datetime: str = "2030-12-31 23:59:59"
    longitude: tuple[float, float] | None = None
    latitude: tuple[float, float] | None = None
    time_zone: str = "America/Mexico_City"
    time_format: str = "UNIX"
    cell_system: str = "h3"

    @property
    def folder(self) -> str:
        return self.processed_data_path or f"{self.dataset_name}_processed"

    def load_pings(self, spark: SparkSession) -> DataFrame:
        return stops.clean_pings(spark.read.parquet(self.raw_data_path), self.column_mappings, self.time_format, _epoch(self.start_datetime), _epoch(self.end_datetime), self.latitude, self.longitude)

    def load_stays(self, spark: SparkSession) -> DataFrame:
        s = tables.read(spark, self.folder, tables.LABELLED)
        return s.withColumn("cell", F.col("h3_id_region").cast("bigint"))

    def load_stay_count(self, spark: SparkSession, resolution: int) -> DataFrame:
        s = self.load_stays(spark)
        return flows.stay_count(s, resolution, system=cells.system_of(s, "cell"))

    def load_od_flow(self, spark: SparkSession, resolution: int) -> DataFrame:
        s = self.load_stays(spark)
        return flows.od_flow(s, resolution, system=cells.system_of(s, "cell"))

    def load_home_work_flow(self, spark: SparkSession, resolution: int) -> DataFrame:
        return tables.read(spark, self.folder, tables.HOME_WORK, f"Resolution{resolution}")

    def home_locations(self, spark: SparkSession, resolution: int) -> DataFrame:
        return flows.location_counts(self.load_stays(spark), "home_h3_index", resolution)

    def work_locations(self, spark: SparkSession, resolution: int) -> DataFrame:
        return flows.location_counts(self.load_stays(spark), "work_h3_index", resolution)

    @staticmethod
    def to_parent(df: DataFrame, resolution: int, column: str = "h3_index") -> DataFrame:
        return df.withColumn(f"h3_index_res{resolution}", cells.to_hex(cells.parent(cells.from_hex(F.col(column)), resolution)))

    @staticmethod
    def haversine_km(lat1, lon1, lat2, lon2):
        return haversine(lat1, lon1, lat2, lon2, R_ROUND_M / 1000)


@dataclass
class ClusterStayDetection:
    """Stops, density places, home and work; writes StayPoints and StayPointsWithHomeWork."""

    dataset: MobilityDataset

    def get_stays(
        self, spark: SparkSession, distance_threshold: float = 20.0, time_threshold: float = 3600.0, min_stop_duration: float = 300.0,
        dbscan_distance: float = 20.0, dbscan_min_points: int = 2, resolution: int = 8, find_home_and_work: bool = True, **home_work,
    ) -> DataFrame:
        d = self.dataset
        s = stops.find_stops(d.load_pings(spark), distance_threshold, time_threshold, min_stop_duration)
        local = places.add_local_time(places.cluster_stops(s, dbscan_distance, dbscan_min_points), d.time_zone).persist()
        try:
            if find_home_and_work:
                out = places.canonical_stays(places.classify_home_work(local, **home_work), resolution, d.cell_system)
                tables.write(out, d.folder, tables.LABELLED)
            else:
                none = local.withColumns({c: F.lit(None).cast("double") for c in ("home_latitude", "home_longitude", "work_latitude", "work_longitude")})
                out = places.canonical_stays(none.withColumn("type", F.lit(0)), resolution, d.cell_system)
            tables.write(places.stay_points(out), d.folder, tables.STAY_POINTS)
        finally:
            local.unpersist()
        return tables.read(spark, d.folder, tables.LABELLED if find_home_and_work else tables.STAY_POINTS)


@dataclass
class GridStayDetection:
    """Sequential-centroid stays on the cell grid, their flows and distributions. The data set needs a box."""

    dataset: MobilityDataset

    def get_stays(
        self, spark: SparkSession, delta_t: int = 300, spatial_threshold: float = 300.0, speed_threshold: float = 6.0, temporal_threshold: int = 300,
        hex_resolution: int = 8, regional_temporal_threshold: int = 3600, passing: bool = True, home_to_work: int = 8, work_to_home: int = 19,
        work_distance_limit: float = 500.0, work_freq_count_limit: int = 3, find_home_and_work: bool = True,
    ) -> DataFrame:
        d = self.dataset
        if d.latitude is None or d.longitude is None:
            raise ValueError("the data set needs latitude and longitude bounds")
        params = {k: v for k, v in locals().items() if k not in ("self", "spark", "d")}
        g = grid.grid_stays(d.load_pings(spark), delta_t, spatial_threshold, speed_threshold, temporal_threshold, hex_resolution, regional_temporal_threshold, passing, d.cell_system)
        local = places.add_local_time(g, d.time_zone).persist()
        hw = grid.grid_home_work(local, home_to_work, work_to_home, work_distance_limit, work_freq_count_limit, d.cell_system)
        s = local.join(hw, "caid", "left")
        hex_ = lambda c: F.upper(cells.to_hex(F.col(c)))
        kind = F.when(F.col("cell") == F.col("home_cell"), 1).when(F.col("cell") == F.col("work_cell"), 2).otherwise(0)
        out = s.select(
            "caid", F.col("stay_id").alias("h3_region_stay_id"), F.timestamp_seconds("start_timestamp").alias("stay_start_timestamp"), F.timestamp_seconds("end_timestamp").alias("stay_end_timestamp"),
            ((F.col("end_timestamp") - F.col("start_timestamp")) * 1_000_000).alias("stay_duration"), F.col("cell").cast("string").alias("h3_id_region"), "local_time", hex_("cell").alias("h3_index"),
            "day_of_week", "hour_of_day", hex_("home_cell").alias("home_h3_index"), kind.cast("int").alias("type"), hex_("work_cell").alias("work_h3_index"), F.lit(-1).alias("cluster_label"), "latitude", "longitude",
        )
        if find_home_and_work:
            tables.write(out, d.folder, tables.LABELLED)
        tables.write(places.stay_points(out), d.folder, tables.STAY_POINTS)
        tables.write_config(spark, d.folder, params | asdict(d))
        local.unpersist()
        return tables.read(spark, d.folder, tables.LABELLED if find_home_and_work else tables.STAY_POINTS)

    def _stays(self, spark: SparkSession) -> DataFrame:
        f = self.dataset.folder
        name = tables.LABELLED if tables.exists(spark, f"{f}/{tables.LABELLED}") else tables.STAY_POINTS
        return tables.read(spark, f, name).withColumn("cell", F.col("h3_id_region").cast("bigint"))

    def get_home_work_od_matrix(self, spark: SparkSession, resolution: int) -> DataFrame:
        if resolution > int(tables.read_config(spark, self.dataset.folder)["hex_resolution"]):
            raise ValueError("finer than the stays' own cells")
        s = self._stays(spark).groupBy("caid").agg(F.min(cells.from_hex(F.col("home_h3_index"))).alias("home_cell"), F.min(cells.from_hex(F.col("work_h3_index"))).alias("work_cell"))
        tables.write(flows.home_work_flow(s, resolution), self.dataset.folder, tables.HOME_WORK, f"Resolution{resolution}")
        return self.dataset.load_home_work_flow(spark, resolution)

    def get_od_matrix(self, spark: SparkSession, resolution: int) -> DataFrame:
        s = self._stays(spark)
        od = flows.od_flow(s, resolution, system=cells.system_of(s, "cell")).drop("distance")
        tables.write(od, self.dataset.folder, tables.FULL_OD, f"Resolution{resolution}")
        return tables.read(spark, self.dataset.folder, tables.FULL_OD, f"Resolution{resolution}")

    def summarize(self, spark: SparkSession) -> dict[str, DataFrame]:
        s = self._stays(spark)
        got = dict(zip(tables.METRICS, (flows.daily_locations_distribution(s), flows.departure_distribution(s, self.dataset.time_zone), flows.duration_distribution(s))))
        for name, df in got.items():
            tables.write(df, self.dataset.folder, "Metrics", name)
        return {n: tables.read(spark, self.dataset.folder, "Metrics", n) for n in got}


def StayDetection(*args, **kwargs) -> GridStayDetection:
    """Former name of :class:`GridStayDetection`."""
    warnings.warn("use GridStayDetection", DeprecationWarning, stacklevel=2)
    return GridStayDetection(*args, **kwargs)


@dataclass
class UserSelection:
    """Devices by number of stays and days of activity; writes FilteredUserStayPoints."""

    dataset: MobilityDataset

    def filter_users(self, spark: SparkSession, num_stay_points_range: tuple[int, int], time_span_days_range: tuple[int, int]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """The filtered stays, the activity grid and the two totals."""
        s = self.dataset.load_stays(spark).drop("cell")
        tables.write(flows.filter_users(s, num_stay_points_range, time_span_days_range), self.dataset.folder, tables.FILTERED)
        summary = flows.user_summary(s)
        totals = flows.user_totals(summary, num_stay_points_range, time_span_days_range).first().asDict()
        return tables.read(spark, self.dataset.folder, tables.FILTERED), flows.activity_grid(summary), totals
