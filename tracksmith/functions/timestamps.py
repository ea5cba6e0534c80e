"""Mixed timestamp formats and time zones, normalised to UTC microseconds.

An ordered cascade of anchored patterns rewrites a reading into one canonical
field list; each field is then checked strictly and turned into an instant by
JVM expressions only. Wall-clock readings take the source's zone from a lookup
table and follow an explicit policy where that clock showed the time twice or
never.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage

_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r" ?(Z|[A-Z]{2,5}|[+-]\d{2}:?\d{2})?"
#: (name, test that every reading of the pattern passes, anchored pattern, rewriting into kind|y|m|d|h|mi|s|fraction|am/pm|zone|region).
#: The first whose test holds is tried; no reading passes the pattern of one and the test of an earlier one.
CASCADE = (
    ("iso", lambda u: F.substring(u, 5, 1) == "-", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME}{_ZONE}(?:\[([A-Z0-9_/+-]+)\])?$", "Y|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", lambda u: F.substring(u, 9, 1) == "T", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", "Y|$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("digits", lambda u: (F.length(u) == 14) & F.substring(u, 14, 1).between("0", "9") & (F.instr(u, " ") == 0), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "Y|$1|$2|$3|$4|$5|$6||||"),
    ("slashed", lambda u: F.instr(u, "/").between(2, 3), rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_TIME}(?: (AM|PM))?{_ZONE}$", "S|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    ("named", lambda u: F.instr(u, ":") > 0, rf"^(?:[A-Z]{{3}}, ?)?(\d{{1,2}})[- ]([A-Z]{{3}})[- ](\d{{4}}) {_TIME}(?: (AM|PM))?{_ZONE}$", "Y|$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
)
_COUNT = r"^-?\d+$"
_DECIMAL = r"^-?(\d{1,11}\.\d+|\d\.\d+E\+?\d{1,2})$"

_INFO = T.StructType(
    [
        T.StructField("zone", T.StringType()),
        T.StructField("abbr", T.MapType(T.StringType(), T.LongType())),
        T.StructField("dated", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("off", "since", "until")])))),
    ]
)


@lru_cache(maxsize=1024)
def _zone_info(name: str | None, since: int = 1970, until: int = 2038) -> tuple[str | None, dict[str, int], dict[str, list[tuple[int, int, int]]]]:
    """Canonical zone name of a spelling, the offset in seconds of each alphabetic abbreviation in use there, and for those that had several the (offset, first second, last second + 1) of each use."""
    import zoneinfo

    s = (name or "").strip()
    m = re.fullmatch(r"(?:UTC|GMT)?\s*([+-])(\d{1,2}):?(\d{2})?", s, re.I)
    if m:
        h, mi = int(m[2]), int(m[3] or 0)
        return (f"{m[1]}{h:02d}:{mi:02d}", {}, {}) if h <= 18 and mi < 60 else (None, {}, {})
    known = {z.lower(): z for z in zoneinfo.available_timezones()}
    z = known.get(s.lower().replace(" ", "_"))
    if z is None:
        return None, {}, {}
    tz = zoneinfo.ZoneInfo(z)

    def clock(t: int) -> tuple[str | None, int]:
        local = datetime.fromtimestamp(t, tz)
        return local.tzname(), int(local.utcoffset().total_seconds())

    first, end, week = int(datetime(since, 1, 1, tzinfo=timezone.utc).timestamp()), int(datetime(until, 1, 1, tzinfo=timezone.utc).timestamp()), 7 * 86_400
    uses, at, now = [], first, clock(first)
    for t in range(first, end, week):
        after = clock(t + week)
        if after != now:
            lo, hi = t, t + week
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if clock(mid) == now else (lo, mid)
            uses.append((*now, at, hi))
            at, now = hi, after
    uses.append((*now, at, 1 << 40))
    one, many = {}, {}
    for a in {u[0] for u in uses if u[0] and u[0].isalpha()}:
        mine = [u[1:] for u in uses if u[0] == a]
        if len({o for o, _, _ in mine}) == 1:
            one[a] = mine[0][0]
        else:
            many[a] = mine
    return z, one, many


@F.pandas_udf(_INFO)
def _zones(names: pd.Series) -> pd.DataFrame:
    got = [_zone_info(n if isinstance(n, str) else None) for n in names]
    return pd.DataFrame({"zone": [g[0] for g in got], "abbr": [g[1] for g in got], "dated": [{a: [dict(zip(("off", "since", "until"), u)) for u in us] for a, us in g[2].items()} for g in got]})


def source_clocks(lookup: DataFrame, key: str = "dataset_id", zone: str = "time_zone", time_format: str = "time_format") -> DataFrame:
    """(key, _zone, _abbr, _dated, _order) of each source: canonical zone, its abbreviations, those with several offsets, and D or M where its format leads with day or month."""
    f = F.trim(F.col(time_format))
    order = F.when(f.rlike("^'?d"), "D").when(f.rlike("^'?M"), "M")
    one = lookup.where(F.col(key).isNotNull()).dropDuplicates([key])
    return one.withColumn("_i", _zones(F.col(zone).cast("string"))).select(key, F.col("_i.zone").alias("_zone"), F.col("_i.abbr").alias("_abbr"), F.col("_i.dated").alias("_dated"), order.alias("_order"))


def _wall_micros(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column, us: Column) -> Column:
    """Micros of a strict calendar reading taken as if it were UTC; null when there is no such reading."""
    ok = m.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59) & y.between(1, 9999)
    day = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    days = F.when(ok, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long"))
    return ((days * 24 + h) * 60 + mi) * F.lit(60_000_000).cast("long") + s * F.lit(1_000_000).cast("long") + us


def _offset(us: Column, zone: Column) -> Column:
    """UTC offset in micros of ``zone`` at the instant ``us``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def normalize_timestamps(
    df: DataFrame,
    lookup: DataFrame,
    column: str = "utc_timestamp",
    key: str = "dataset_id",
    zone: str = "time_zone",
    time_format: str = "time_format",
    ambiguous: str = "unresolved",
    nonexistent: str = "unresolved",
    out: str = "utc_us",
    status: str = "ts_status",
    form: str = "ts_form",
) -> DataFrame:
    """Append ``out`` (bigint UTC micros), ``status`` and ``form`` to every row of ``df``.

    Bare numbers, which may be negative, count seconds, milli-, micro- or
    nanoseconds by their length, except fourteen-digit calendar readings. Years
    are 1 to 9999 of the Gregorian calendar. An offset, Z, UTC or GMT in the
    reading decides; else an abbreviation in use in the source's zone (of one
    that had several offsets since 1970, the offset in use then); else the
    source's zone (a bracketed region without offset must name that same zone). Day and month are exchanged only where both readings are
    possible and the source's format leads with one of them.

    ``ambiguous`` (a clock that showed the time twice): ``unresolved``,
    ``earlier`` or ``later``. ``nonexistent`` (a clock that skipped it):
    ``unresolved`` or ``shift`` (read with the offset before the gap).

    Status is one of ``ok``, ``missing`` (null or blank), ``invalid`` (no
    instant, impossible date), ``no_zone`` (wall clock, zone unknown),
    ``day_or_month``, ``ambiguous``, ``nonexistent``. Null key, key absent from
    the lookup or null zone: ``no_zone`` for wall-clock readings, others
    resolve. An empty table gives an empty table; columns of ``df`` are kept,
    and the result's columns replace columns of the same name.
    """
    if ambiguous not in ("unresolved", "earlier", "later"):
        raise ValueError(f"ambiguous: {ambiguous}")
    if nonexistent not in ("unresolved", "shift"):
        raise ValueError(f"nonexistent: {nonexistent}")
    keep = [c for c in df.columns if c not in (out, status, form)]
    clocks = broadcast_if_small(cut_lineage(source_clocks(lookup, key, zone, time_format).withColumnRenamed(key, "_k")))
    u = F.upper(F.regexp_replace(F.col(column).cast("string"), r"^[\s ]+|[\s ]+$", ""))
    c = u
    for _, test, pattern, to in reversed(CASCADE):
        c = F.when(test(u), F.regexp_replace(u, pattern, to)).otherwise(c)
    d = df.select(*[F.col(f"`{x}`") for x in keep]).withColumn("_u", u).withColumn("_c", c)
    d = d.join(clocks, F.col(f"`{key}`") == F.col("_k"), "left").drop("_k")
    d = d.withColumn("_f", F.when(F.col("_c").rlike(r"^[YS]\|"), F.split("_c", r"\|")))
    part = lambda i: F.get("_f", F.lit(i))
    num = lambda i: F.coalesce(part(i).try_cast("int"), F.when(part(i) == "", 0))
    a, b = num(2), num(3)
    swap = (a > 12) & (b <= 12) | (a <= 12) & (b <= 12) & (a != b) & (F.col("_order") == "D")
    unsure = (part(0) == "S") & (a <= 12) & (b <= 12) & (a != b) & F.col("_order").isNull()
    swap = F.coalesce((part(0) == "S") & swap, F.lit(False))
    month_no = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), part(2)).cast("int")
    month = F.when(part(2).rlike("^[A-Z]{3}$"), month_no).otherwise(F.when(swap, b).otherwise(a))
    hour = num(4)
    hour = F.when(part(8) == "", hour).when(hour.between(1, 12), hour % 12 + F.when(part(8) == "PM", 12).otherwise(0))
    micros = F.when(part(7) == "", 0).otherwise(F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("int"))
    d = d.withColumn("_wall", _wall_micros(num(1), month, F.when(swap, a).otherwise(b), hour, num(5), num(6), micros))
    z = part(9)
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    hhmm = F.translate(F.substring(z, 2, 5), ":", "")
    minutes = F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.substring(hhmm, 3, 2).try_cast("int")
    # An abbreviation that had several offsets there: the one in use at the instant it gives, if that is one only.
    fits = F.filter(F.element_at("_dated", z), lambda x: (F.col("_wall") >= (x["off"] + x["since"]) * 1_000_000) & (F.col("_wall") < (x["off"] + x["until"]) * 1_000_000))
    offs = F.array_distinct(F.transform(fits, lambda x: x["off"]))
    dated = F.when(F.size(offs) == 1, F.element_at(offs, 1))
    given = (
        F.when(z.isin("Z", "UTC", "GMT", "UT"), F.lit(0).cast("long"))
        .when(F.substring(z, 1, 1).isin("+", "-") & (minutes <= 18 * 60) & (minutes % 60 < 60), (sign * minutes).cast("long") * 60)
        .when(F.substring(z, 1, 1).between("A", "Z"), F.coalesce(F.element_at("_abbr", z), dated))
    )
    d = d.withColumn("_given", given * 1_000_000)
    bare = F.col("_f").isNotNull() & (z == "") & F.col("_wall").isNotNull()
    d = d.withColumn("_z", F.when(bare & ((part(10) == "") | (part(10) == F.upper("_zone"))), F.col("_zone")))
    day = F.lit(86_400_000_000).cast("long")
    d = d.withColumn("_o1", F.when(F.col("_z").isNotNull(), _offset(F.col("_wall") - day, F.col("_z")))).withColumn("_o2", F.when(F.col("_z").isNotNull(), _offset(F.col("_wall") + day, F.col("_z"))))
    d = d.withColumn("_u1", F.col("_wall") - F.col("_o1")).withColumn("_u2", F.col("_wall") - F.col("_o2"))
    moved = F.col("_o1") != F.col("_o2")
    d = d.withColumn("_v1", F.when(moved, _offset(F.col("_u1"), F.col("_z")) == F.col("_o1")).otherwise(F.col("_o1").isNotNull()))
    d = d.withColumn("_v2", F.when(moved, _offset(F.col("_u2"), F.col("_z")) == F.col("_o2")).otherwise(F.lit(False)))
    both, none = F.col("_v1") & F.col("_v2"), moved & ~F.col("_v1") & ~F.col("_v2")
    n = F.length("_u") - F.when(F.substring("_u", 1, 1) == "-", 1).otherwise(0)
    count = F.col("_u").rlike(_COUNT) & (n != 14) & (n <= 19)
    value = F.when(count, F.col("_u").try_cast("long"))
    counted = (
        F.when(n <= 11, value * 1_000_000)
        .when(n <= 13, value * 1_000)
        .when(n.isin(15, 16), value)
        .when(n.isin(18, 19), F.floor(value / F.lit(1000).cast("decimal(10,0)")).cast("long"))
    )
    decimal = F.when(F.col("_u").rlike(_DECIMAL), F.floor(F.col("_u").try_cast("decimal(30,9)") * 1_000_000).cast("long"))
    clock = (
        F.when(both, {"earlier": F.least("_u1", "_u2"), "later": F.greatest("_u1", "_u2")}.get(ambiguous, F.lit(None).cast("long")))
        .when(none, F.col("_u1") if nonexistent == "shift" else F.lit(None).cast("long"))
        .when(F.col("_v1"), F.col("_u1"))
        .when(F.col("_v2"), F.col("_u2"))
    )
    utc = F.when(F.col("_f").isNull(), F.coalesce(counted, decimal)).when(unsure, None).when(z != "", F.col("_wall") - F.col("_given")).otherwise(clock)
    d = d.withColumn(out, utc)
    state = (
        F.when(F.col("_u").isNull() | (F.col("_u") == ""), "missing")
        .when(F.col(out).isNotNull(), "ok")
        .when(F.col("_f").isNull() | F.col("_wall").isNull() | (z != ""), "invalid")
        .when(unsure, "day_or_month")
        .when(F.col("_z").isNull(), "no_zone")
        .when(both, "ambiguous")
        .when(none, "nonexistent")
        .otherwise("invalid")
    )
    bare_kind = F.when(F.col("_u").rlike(r"^\d{10}$"), "seconds").when(count, "count").when(decimal.isNotNull(), "decimal").otherwise("none")
    kind = F.when(F.col("_f").isNull(), bare_kind).when(z != "", "offset").otherwise("wall")
    # A generator, so that no filter on the result is rewritten in terms of the whole cascade.
    one = F.struct(F.col(out).alias(out), state.alias(status), kind.alias(form))
    return d.select(*[F.col(f"`{x}`") for x in keep], F.inline(F.array(one)))
