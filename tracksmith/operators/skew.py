"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The engine's limit on the counters of a frequent-items sketch, and the share from which a sketch of that size is sure to name every heavy key.
MOST_SLOTS, LEAST_SHARE = 1_000_000, 1e-5


def heavy_hitters(df: DataFrame, key: str, share: float = 0.02, slots: int | None = None) -> DataFrame:
    """(key, n): exactly the not-null keys holding at least ``share`` of all rows, nulls counted in the total.

    A mergeable frequent-items sketch of ``slots`` counters (default 64 per
    possible heavy key, so its error stays far below the share, and at most
    ``MOST_SLOTS``) names the candidates, of which there are at most 2 / share;
    their rows are then counted exactly behind a broadcast of that bounded
    list. Below ``LEAST_SHARE`` no sketch is sure enough: all keys are counted
    by an ordinary shuffle, combined before it. An empty table gives no keys.
    """
    some = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("_key"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    if share >= LEAST_SHARE:
        most = int(2 / share) + 1
        tracked = slots or min(MOST_SLOTS, 1 << (64 * most - 1).bit_length())
        got = some.agg(F.expr(f"approx_top_k(_key, {most}, {max(most, tracked)})").alias("_t"))
        names = got.select(F.explode_outer("_t").alias("_e")).select(F.col("_e.item").alias("_h")).where("_h is not null")
        some = some.join(F.broadcast(names), F.col("_key") == F.col("_h"), "left_semi")
    counts = some.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total)).where(F.col("n") >= F.lit(share) * F.col("_all")).select(F.col("_key").alias(key), "n")


def aggregate_by_key(df: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], share: float = 0.02, salts: int = 64, salt_on: str | None = None) -> DataFrame:
    """Per-key aggregates in which no task gets a heavy key whole.

    Heavy keys (see :func:`heavy_hitters`) are marked by a broadcast join of
    their bounded list, aggregated first by (key, salt) with ``partial`` and
    then by key with ``final``; the remaining keys go through an ordinary
    shuffle; both are united. ``final`` reads the names in ``partial``. Null
    keys form a group of their own. Returns key, the names of ``final`` and
    ``heavy``. An empty table gives no rows. ``share`` is at least
    ``LEAST_SHARE``, so that the list of heavy keys is bounded.
    """
    if share < LEAST_SHARE:
        raise ValueError(f"share: {share} < {LEAST_SHARE}")
    heavy = heavy_hitters(df, key, share).select(F.col(f"`{key}`").alias("_hk"))
    marked = df.join(F.broadcast(heavy), F.col(f"`{key}`") == F.col("_hk"), "left")
    parts = [c.alias(n) for n, c in partial.items()]
    ends = [c.alias(n) for n, c in final.items()]
    salt = F.pmod(F.xxhash64(salt_on) if salt_on else F.monotonically_increasing_id(), F.lit(salts))
    hot = marked.where(F.col("_hk").isNotNull()).groupBy(key, salt.alias("_salt")).agg(*parts).groupBy(key).agg(*ends)
    rest = marked.where(F.col("_hk").isNull()).groupBy(key).agg(*parts).groupBy(key).agg(*ends)
    return hot.withColumn("heavy", F.lit(True)).unionByName(rest.withColumn("heavy", F.lit(False)))
