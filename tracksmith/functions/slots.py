"""Time slots, labels and other small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a slot, and slots of a day.
SLOT_S, DAY_SLOTS = 600, 144
# Words and letters for other, home and work stays.
TYPE_WORDS = {"other": 0, "o": 0, "home": 1, "h": 1, "work": 2, "w": 2}


def type_to_int(label: Column) -> Column:
    """0 other, 1 home, 2 work; blanks and case ignored, anything else and null 0."""
    words = F.create_map(*[x for k, v in TYPE_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(words[F.lower(F.trim(label))], F.lit(0)).cast("int")


def purpose_letter(kind: Column) -> Column:
    return F.when(kind == 1, "h").when(kind == 2, "w").otherwise("o")


def fractional_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def fixed_offset_local(seconds: Column, switch: int = 1_667_552_400, before_h: int = -4, after_h: int = -5) -> Column:
    """Local seconds by two fixed offsets, for results that must equal such a pipeline's; else use a time zone."""
    return seconds + F.when(seconds < switch, before_h * 3600).otherwise(after_h * 3600)


def slot_of_day(local_s: Column, slot_s: int = SLOT_S) -> Column:
    return F.floor((local_s % 86_400) / slot_s)


def day_number(local_s: Column) -> Column:
    """Day since 1970 modulo 7 (0 is a Thursday)."""
    return F.floor(local_s / 86_400) % 7


def slot_start(local_s: Column, slot_s: int = SLOT_S) -> Column:
    return F.floor(local_s / slot_s) * slot_s


def deterrence(km: Column, kind: str, argument: float) -> Column:
    if kind == "power_law":
        return F.pow(km, F.lit(argument))
    if kind == "exponential":
        return F.exp(F.lit(-argument) * km)
    raise ValueError(f"deterrence: {kind}")


def consecutive_ranges(df: DataFrame, key: str, slot: str) -> DataFrame:
    """(key, first_slot, last_slot) of each run of successive integers."""
    d = df.select(key, slot).distinct()
    d = d.withColumn("_g", F.col(slot) - F.row_number().over(W.partitionBy(key).orderBy(slot)))
    return d.groupBy(key, "_g").agg(F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot")).drop("_g")
