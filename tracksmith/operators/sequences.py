"""Splitting ordered rows of a key into runs, without one task per key.

A plain ``lag`` window sends all rows of a key to one task. Here the key's time
axis is cut into buckets; windows run inside (key, bucket) and one summary row
per bucket carries the predecessor and the open run across bucket borders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_table


def number_runs(
    df: DataFrame,
    key: list[str],
    order: list[str],
    bucket: Column,
    changed: Callable[[Column, Column], Column],
    run: str = "_run",
) -> DataFrame:
    """Append ``run``: the (order columns) struct of the first row of each row's run.

    Rows of ``key`` are taken in the order of the not-null columns ``order``; a
    new run begins at a key's first row and wherever ``changed(previous,
    current)`` holds, both structs of all columns but the key. ``bucket`` must
    not decrease along ``order``. The sort and lag windows are confined to
    (key, bucket); only one row per bucket passes through a window per key.
    Rows with a null in ``key`` or ``order`` have no place in a sequence and are
    left out. An empty table stays empty.
    """
    rest = [c for c in df.columns if c not in key]
    # Both branches below take the whole struct, so that Catalyst plans one scan and one exchange for the two.
    for c in [*key, *order]:
        df = df.where(F.col(c).isNotNull())
    b = df.select(*key, bucket.alias("_bkt"), F.struct(*rest).alias("_cur")).where(F.col("_bkt").isNotNull())
    at = lambda s: F.struct(*[F.col(s)[c].alias(c) for c in order])
    w = W.partitionBy(*key, "_bkt").orderBy(*[F.col("_cur")[c] for c in order])
    d = b.withColumn("_prev", F.lag("_cur").over(w))
    d = d.withColumn("_new", F.when(F.col("_prev").isNotNull() & changed(F.col("_prev"), F.col("_cur")), at("_cur")))
    d = d.drop("_prev").withColumn("_open", F.last("_new", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = d.groupBy(*key, "_bkt").agg(F.min_by("_cur", at("_cur")).alias("_first"), F.max_by("_cur", at("_cur")).alias("_last"), F.max("_new").alias("_newest"))
    w2 = W.partitionBy(*key).orderBy("_bkt")
    s = ends.withColumn("_before", F.lag("_last").over(w2))
    s = s.withColumn("_own", F.when(F.col("_before").isNull() | changed(F.col("_before"), F.col("_first")), at("_first")))
    s = s.withColumn("_carried", F.last(F.coalesce("_newest", "_own"), ignorenulls=True).over(w2.rowsBetween(W.unboundedPreceding, -1)))
    s = s.select(*key, "_bkt", F.coalesce("_own", "_carried").alias("_at_start"))
    return d.join(s, [*key, "_bkt"]).select(*[F.col(c) if c in key else F.col("_cur")[c].alias(c) for c in df.columns], F.coalesce("_open", "_at_start").alias(run))


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in ranges of ``order``, numbered by ``_p``, written so that both passes see the same ranges."""
    return write_table(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Append ``name``, the sum of ``value`` over all rows up to each one in ``order`` (which should identify a row). Ranges are summed apart; one row a range is then added up in order."""
    d = _ranges(df.withColumn("_v", value), order)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    off = d.groupBy("_p").agg(F.sum("_v").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    here = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.join(F.broadcast(off), "_p").withColumn(name, F.sum("_v").over(here) + F.col("_off")).drop("_p", "_v", "_off")


def fill_forward(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Append ``name``, the last ``value`` that is not null up to each row in ``order``; ranges as in :func:`running_total`."""
    d = _ranges(df.withColumn("_v", value), order)
    at = F.struct(*order)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), at))
    off = d.groupBy("_p").agg(last.alias("_l")).select("_p", F.last("_l", ignorenulls=True).over(before).alias("_off"))
    here = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.join(F.broadcast(off), "_p").withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(here), "_off")).drop("_p", "_v", "_off")
