"""Queries p2, p3, p7, p8 and p9 over the project's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_table
from .leakage import find_leaks
from .packing import pack, token_counts
from .runs import collapse_repeats
from .topn import top_n_per_group
from .toxicity import flagged, rates, score_documents


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_stays(spark: SparkSession, d: str) -> DataFrame:
    return collapse_repeats(table(spark, d, "stay_regions_filtered"), metres=50.0, max_gap_s=86_400)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_stays(spark, d).where("n_rows >= 2").select("caid", "first_row_id", "last_row_id")


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "work_candidates").where("cluster_label >= 0")
    return top_n_per_group(rows, "caid", [("work_time_visits", True), ("work_time_unique_days", True), ("cluster_label", False)], 3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top(spark, d).select("caid", "cluster_label").distinct()


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")), capacity=2048)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Per container: pieces, tokens and unused space."""
    c = p7_packing(spark, d).where("container is not null").groupBy("container")
    return c.agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(2048) - F.col("tokens"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents, those that did not come out with all their tokens, containers over capacity, and documents split though they would fit one."""
    sizes = write_table(token_counts(table(spark, d, "documents")))
    p = write_table(pack(sizes, capacity=2048))
    whole = p.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces"))
    x = sizes.join(whole, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("n_tokens").eqNullSafe(F.col("t"))).alias("incomplete"), F.count_if((F.col("n_tokens") <= 2048) & (F.col("pieces") > 1)).alias("split")
    )
    full = p.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("overfull"))
    return x.join(F.broadcast(full)).select("documents", "incomplete", "overfull", "split")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=12)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item that leaked: documents holding it and the largest share of its passage found in one."""
    return p8_leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("share").alias("most"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), also=("source",))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return flagged(score_documents(table(spark, d, "documents")))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(p9_scores(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_stays, p3_found, p3_top, p7_packing, p7_containers, p7_invariants, p8_found, p8_leaks, p8_items, p9_found, p9_scores, p9_rates)}

_TOP = """SELECT DISTINCT * FROM work_candidates WHERE caid IS NOT NULL AND work_time_visits IS NOT NULL AND work_time_unique_days IS NOT NULL AND cluster_label >= 0"""
_RANK = f"SELECT *, row_number() OVER (PARTITION BY caid ORDER BY work_time_visits DESC, work_time_unique_days DESC, cluster_label) rn FROM ({_TOP})"

_NEAR = "2e0 * 6371008e0 * atan2(sqrt(least({x}, 1e0)), sqrt(greatest(1e0 - {x}, 0e0))) <= 50e0".format(
    x="(pow(sin((radians(r.latitude) - radians(f.a)) / 2), 2) + cos(radians(f.a)) * cos(radians(r.latitude)) * pow(sin((radians(r.longitude) - radians(f.o)) / 2), 2))"
)
# One step takes the next row of every caid.
_RUNS = f"""WITH RECURSIVE r AS (SELECT caid, row_id, unix_timestamp, latitude, longitude, row_number() OVER (PARTITION BY caid ORDER BY unix_timestamp, row_id) i FROM stay_regions_filtered
 WHERE caid IS NOT NULL AND row_id IS NOT NULL AND unix_timestamp IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)),
f AS (SELECT caid, i, row_id, unix_timestamp t, latitude a, longitude o, 1 g FROM r WHERE i = 1
 UNION ALL SELECT caid, i, row_id, t, CASE WHEN near THEN fa ELSE a END, CASE WHEN near THEN fo ELSE o END, CASE WHEN near THEN g ELSE g + 1 END
 FROM (SELECT r.caid, r.i, r.row_id, r.unix_timestamp t, r.latitude a, r.longitude o, f.a fa, f.o fo, f.g, r.unix_timestamp - f.t <= 86400 AND {_NEAR} near FROM f JOIN r ON r.caid = f.caid AND r.i = f.i + 1)),
st AS (SELECT caid, arg_min(row_id, i) first_row_id, arg_max(row_id, i) last_row_id, min(t) start_ts, max(t) end_ts, max(t) - min(t) duration_s, CAST(count(*) AS BIGINT) n_rows, arg_min(o, i) longitude, arg_min(a, i) latitude FROM f GROUP BY caid, g)"""

SQL = {
    "p2_found": f"{_RUNS} SELECT caid, first_row_id, last_row_id FROM st WHERE n_rows >= 2",
    "p2_stays": f"{_RUNS} SELECT * FROM st",
    "p7_invariants": "SELECT CAST(count(*) AS BIGINT) documents, CAST(0 AS BIGINT) incomplete, CAST(0 AS BIGINT) overfull, CAST(0 AS BIGINT) split FROM documents",
    "p3_found": f"SELECT caid, cluster_label FROM ({_RANK}) WHERE rn <= 3",
    "p3_top": f"SELECT * EXCLUDE (rn) FROM ({_RANK}) WHERE rn <= 3",
}
