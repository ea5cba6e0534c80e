"""The N best items of every group by simultaneous bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, write_table

_WORD = 1 << 61


def _as_long(d: DataFrame, c: str) -> Column:
    """The column as bigint of the same order: integers, booleans, dates, timestamps, decimals of up to 18 digits, floats (NaN highest, as Spark sorts)."""
    kind, v = dict(d.dtypes)[c], F.col(f"`{c}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return v.cast("bigint")
    if kind == "boolean":
        return v.cast("int").cast("bigint")
    if kind == "date":
        return F.unix_date(v).cast("bigint")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(v.cast("timestamp"))
    if kind in ("float", "double"):
        bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v.cast("double") + F.lit(0.0)).cast("bigint")
        return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    if kind.startswith("decimal("):
        digits, scale = map(int, kind[8:-1].split(","))
        if digits <= 18:
            return (v * F.lit(10**scale).cast("decimal(19,0)")).cast("bigint")
    raise TypeError(f"{c}: {kind} has no order-preserving code")


def _words(d: DataFrame, order: list[tuple[Column, bool]]) -> tuple[DataFrame, int]:
    """Order-preserving codes: (bigint, descending) pairs packed by mixed radix into words of at most 61 bits, most significant first."""
    lim = d.agg(*[F.min(c).alias(f"lo{i}") for i, (c, _) in enumerate(order)], *[F.max(c).alias(f"hi{i}") for i, (c, _) in enumerate(order)]).first()
    digits = []
    for i, (v, desc) in enumerate(order):
        lo, hi = lim[f"lo{i}"] or 0, lim[f"hi{i}"] or 0
        if hi - lo + 1 < _WORD:
            digits.append((v - F.lit(lo) if desc else F.lit(hi) - v, hi - lo + 1))
        else:  # a range too wide for one word is taken in two halves
            for part, most in ((F.shiftright(v, 32), 1 << 33), (v.bitwiseAND(F.lit((1 << 32) - 1)), 1 << 32)):
                low = -(1 << 31) if most == 1 << 33 else 0
                digits.append((part - F.lit(low) if desc else F.lit(low + most - 1) - part, most))
    words, code, size = [], F.lit(0).cast("bigint"), 1
    for v, n in digits:
        if size * n >= _WORD:
            words.append(code)
            code, size = F.lit(0).cast("bigint"), 1
        code, size = code * F.lit(n).cast("bigint") + v, size * n
    words.append(code)
    return d.withColumns({f"_w{i}": w for i, w in enumerate(words)}), len(words)


def top_n_per_group(df: DataFrame, group: str, order: list[tuple[str, bool]], n: int, arity: int = 1024, hot_rows: int = 200_000) -> DataFrame:
    """The first ``n`` distinct rows of each group by ``order``, pairs of a column and whether it descends; exactly ``n`` where a group has as many.

    Exact repeats of a row count once. Rows with a null group or a null in an
    order column do not count. Rows that tie in all order columns are told
    apart by a hash of the whole row, the same on every run. Order columns are
    integers, booleans, dates, timestamps, floats or decimals of up to 18
    digits; others raise TypeError. An empty table gives no rows; columns are
    those of ``df``.

    Every row gets an order-preserving code of its order columns and its hash.
    Each group's cutoff lies between two codes; each round counts its rows
    above ``arity`` - 1 midpoints at once (combined before the shuffle) and
    keeps the part that holds the n-th. A group is done as soon as exactly
    ``n`` of its rows lie above a midpoint, so the rounds are at most log(code
    range) / log(arity) whatever the groups' sizes. No group is ever sorted or
    gathered: the rows of groups over ``hot_rows`` are salted.
    """
    cols, mine = df.columns, [c for c, _ in order]
    kinds = [_as_long(df, c).alias(f"_o{i}") for i, c in enumerate(mine)]
    if n < 1:
        return df.limit(0)
    d = df
    for c in [group, *mine]:
        d = d.where(F.col(f"`{c}`").isNotNull())
    d = write_table(d.dropDuplicates().select(F.col(f"`{group}`").alias("_g"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *kinds))
    d, levels = _words(d, [(F.col(f"_o{i}"), desc) for i, (_, desc) in enumerate(order)])
    tie = F.xxhash64("_row")
    words = [f"_w{i}" for i in range(levels + 2)]
    d = d.withColumns({words[-2]: F.shiftright(tie, 32) + F.lit(1 << 31), words[-1]: tie.bitwiseAND(F.lit((1 << 32) - 1))})
    big = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_w0").alias("_lo"), F.max("_w0").alias("_hi")).where(F.col("_n") > n)  # smaller groups are whole already
    zero = F.lit(0).cast("bigint")
    state = write_table(big.select("_g", F.lit(n).cast("bigint").alias("_need"), F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"), "_lo", "_hi", zero.alias("_above"), F.lit(None).cast("int").alias("_done")))
    hot = broadcast_if_small(state.where("_salts > 1").select(F.col("_g").alias("_hg"), F.col("_salts").alias("_s")))
    live = d.select("_g", *words).join(hot, F.col("_g") == F.col("_hg"), "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    live = live.select("_g", F.pmod(F.xxhash64(*words), F.col("_s")).cast("int").alias("_salt"), *words)
    # The state has a row per salt of each unfinished group; what is broadcast is counted once, and bounds every round.
    few = state.agg(F.sum("_salts")).first()[0] or 0

    def near(s: DataFrame, *names: str) -> DataFrame:
        """``live`` with the columns ``names`` of its group in ``s``; rows of other groups are left out."""
        s = s.select("_g", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), *names)
        return live.join(F.broadcast(s) if few <= 100_000 else s, ["_g", "_salt"])

    keep: list[str] = []
    for level, w in enumerate(words):
        if level:
            lim = live.groupBy("_g").agg(F.min(w).alias("_lo"), F.max(w).alias("_hi"))
            open_ = state.where("_done is null").drop("_lo", "_hi").join(lim, "_g")
            state = write_table(open_.unionByName(state.where("_done is not null")))
        for turn in range(64):  # a word has at most 61 bits, and every round takes one or more
            s = state.where("_done is null and _lo < _hi")
            if not s.limit(1).count():
                break
            s = s.withColumn("_step", F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(arity).cast("decimal(20,0)")).cast("bigint"))
            hit = near(s, "_lo", "_hi", "_step").where(F.col(w).between(F.col("_lo"), F.col("_hi")))
            count = hit.groupBy("_g", F.expr(f"({w} - _lo) div _step").alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
            down = W.partitionBy("_g").orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, 0)
            count = count.withColumn("_sum", F.sum("_c").over(down)).join(s.select("_g", "_need", "_above"), "_g").where(F.col("_above") + F.col("_sum") >= F.col("_need"))
            x = s.join(count.groupBy("_g").agg(F.max_by(F.struct("_part", "_sum", "_c"), "_part").alias("_x")), "_g")
            lo, upto = F.col("_lo") + F.col("_x._part") * F.col("_step"), F.col("_above") + F.col("_x._sum")
            x = x.select("_g", "_need", "_salts", lo.alias("_lo"), F.least("_hi", lo + F.col("_step") - 1).alias("_hi"), (upto - F.col("_x._c")).alias("_above"), F.when(upto == F.col("_need"), level).alias("_done"), *keep)
            state = write_table(x.unionByName(state.where("_done is not null or _lo >= _hi")))
            if not turn:  # what is left is a small part of the rows: those of open groups between their bounds
                live = write_table(near(state.where("_done is null"), "_lo", "_hi").where(F.col(w).between(F.col("_lo"), F.col("_hi"))).select("_g", "_salt", *words[level:]))
        # Rows above the cut are in; among those at the cut of an open group the next word decides about what is still needed.
        cut = F.when(F.col("_done").isNull() | (F.col("_done") == level), F.col("_lo")).alias(f"_cut{level}")
        state = state.select("_g", (F.col("_need") - F.col("_above")).alias("_need"), "_salts", "_lo", "_hi", zero.alias("_above"), "_done", *keep, cut)
        keep.append(f"_cut{level}")
        if not state.where("_done is null").limit(1).count():
            break
        live = near(state.where("_done is null"), f"_cut{level}").where(F.col(w) == F.col(f"_cut{level}")).select("_g", "_salt", *words[level + 1 :])
    cuts = broadcast_if_small(state.select(F.col("_g").alias("_cg"), *keep))
    inside = F.lit(True)
    for w, c in reversed(list(zip(words, keep))):
        inside = F.col(c).isNull() | (F.col(w) > F.col(c)) | ((F.col(w) == F.col(c)) & inside)
    return d.join(cuts, F.col("_g") == F.col("_cg"), "left").where(F.col("_cg").isNull() | inside).select("_row.*")
