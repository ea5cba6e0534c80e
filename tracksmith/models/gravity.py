"""Gravity model of flows between places."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geo import np_geodesic_km
from ..functions.slots import deterrence
from ..operators.spatial import near_pairs
from ..session import broadcast_if_small, cut_lineage


def pair_distances(tiles: DataFrame, max_km: float | None = None) -> DataFrame:
    """(i, j, km) of all ordered pairs of different places. ``tiles``: tile, latitude, longitude.

    A full origin-destination table is what the model is defined on; its size
    is the square of the tessellation, which must be chosen accordingly, or
    ``max_km`` be given. Each unordered pair is measured once.
    """
    @F.pandas_udf("double")
    def km(p: pd.Series, q: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(np_geodesic_km(p, q, r, s))

    a = tiles.select(F.col("tile").alias("i"), F.col("latitude").alias("_a"), F.col("longitude").alias("_b"))
    b = tiles.select(F.col("tile").alias("j"), F.col("latitude").alias("_c"), F.col("longitude").alias("_d"))
    if max_km is not None:
        # On the sphere first, by k-d splits; the ellipsoid's distances differ by less than one in a hundred.
        near = near_pairs(tiles, "tile", [("latitude", "longitude")], max_km * 1010.0, "tile").toDF("i", "j")
        half = near.join(a, "i").join(b, "j").select("i", "j", km("_a", "_b", "_c", "_d").alias("km")).where(F.col("km") <= max_km)
    else:
        half = a.join(b, F.col("i") < F.col("j")).select("i", "j", km("_a", "_b", "_c", "_d").alias("km"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "km"))


def check_resolution(flows: DataFrame, relevance: DataFrame) -> None:
    """Raises ValueError where the cells of ``flows`` (origin) and of ``relevance`` (tile), ids or their hexadecimal text, are of different resolutions."""
    def res(df: DataFrame, c: str) -> set:
        x = cells.from_hex(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("bigint")
        return {r[0] for r in df.select(cells.resolution(x).alias("r")).where("r is not null").limit(1).collect()}

    a, b = res(flows, "origin"), res(relevance, "tile")
    if a and b and a != b:
        raise ValueError(f"flows are of resolution {a.pop()}, relevances of {b.pop()}")


@dataclass(frozen=True)
class Gravity:
    """Parameters of the model; ``fit`` returns a new one.

    ``gravity_type`` is ``single`` (flows out of each place are given) or
    ``global``. ``compat`` keeps two traits of earlier implementations: column
    normalisation in the single type, so that the weight of a destination is its
    relevance to the power of ``origin_exp``, and a deterrence that ``fit``
    leaves as it was.
    """

    deterrence_func_type: str = "power_law"
    deterrence_func_arg: float = -2.0
    origin_exp: float = 1.0
    destination_exp: float = 1.0
    gravity_type: str = "single"
    compat: bool = False

    def __post_init__(self):
        if self.deterrence_func_type not in ("power_law", "exponential"):
            raise ValueError(f"deterrence function: {self.deterrence_func_type}")
        if self.gravity_type not in ("single", "global"):
            raise ValueError(f"gravity type: {self.gravity_type}")

    def scores(self, tiles: DataFrame, pairs: DataFrame) -> DataFrame:
        """(i, j, score, outflow): deterrence x relevances; what is not finite counts 0. ``tiles``: tile, relevance, tot_outflow."""
        t = tiles.select("tile", F.coalesce("relevance", F.lit(0.0)).alias("_m"), F.coalesce("tot_outflow", F.lit(0.0)).alias("_o"))
        d = pairs.join(t.select(F.col("tile").alias("i"), F.col("_m").alias("_mi"), F.col("_o").alias("outflow")), "i")
        d = d.join(t.select(F.col("tile").alias("j"), F.col("_m").alias("_mj")), "j")
        arg = self.deterrence_func_arg
        s = deterrence(F.col("km"), self.deterrence_func_type, arg) * F.pow("_mj", F.lit(self.destination_exp)) * F.pow("_mi", F.lit(self.origin_exp))
        s = F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(s)
        return d.select("i", "j", s.alias("score"), "outflow")

    def generate(self, tiles: DataFrame, pairs: DataFrame, out_format: str = "flows", seed: int = 0) -> DataFrame:
        """(origin, destination, probability | flow), entries above 0 only.

        ``probabilities``, ``flows`` (probability x outflow) or
        ``flows_sample`` (multinomial draw of each origin's outflow, or of all
        outflow over all pairs for the global type; seeded).
        """
        if out_format not in ("probabilities", "flows", "flows_sample"):
            raise ValueError(f"output format: {out_format}")
        d = self.scores(tiles, pairs)
        if self.gravity_type == "global":
            total = d.agg(F.sum("score").alias("_t"))
            out = tiles.agg(F.sum("tot_outflow").alias("_all"))
            d = d.join(F.broadcast(total)).join(F.broadcast(out)).withColumn("p", F.col("score") / F.nullif("_t", F.lit(0.0)))
        elif self.compat:
            back = d.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("score").alias("_s"))
            total = F.sum("_s").over(W.partitionBy("i"))
            d = d.drop("score").join(back, ["i", "j"]).withColumn("p", F.col("_s") / F.nullif(total, F.lit(0.0)))
        else:
            d = d.withColumn("p", F.col("score") / F.nullif(F.sum("score").over(W.partitionBy("i")), F.lit(0.0)))
        d = d.where("p > 0")
        if out_format == "probabilities":
            return d.select(F.col("i").alias("origin"), F.col("j").alias("destination"), F.col("p").alias("probability"))
        if out_format == "flows":
            return d.select(F.col("i").alias("origin"), F.col("j").alias("destination"), (F.col("p") * F.col("outflow")).alias("flow")).where("flow > 0")
        kind = dict(d.dtypes)["i"]
        if self.gravity_type == "global":
            # One multinomial over all pairs is one over the origins and, given theirs, one over each origin's destinations.
            rows = d.groupBy("i").agg(F.sum("p").alias("p"), F.first("_all").alias("all")).orderBy("i").toPandas()
            n = np.random.default_rng([seed, 1]).multinomial(int(rows["all"].iloc[0]), rows["p"] / rows["p"].sum()) if len(rows) else np.zeros(0, int)
            totals = d.sparkSession.createDataFrame(pd.DataFrame({"i": rows["i"], "_n": n}), f"i {kind}, _n bigint")
            d = d.join(broadcast_if_small(totals), "i")
        else:
            d = d.withColumn("_n", F.round("outflow").cast("bigint"))

        def draw(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("j", ignore_index=True)
            rng = np.random.default_rng([seed, zlib.crc32(str(pdf["i"].iloc[0]).encode())])
            p = pdf["p"].to_numpy()
            n = rng.multinomial(int(pdf["_n"].iloc[0]), p / p.sum())
            return pd.DataFrame({"origin": pdf["i"], "destination": pdf["j"], "flow": n.astype(float)})[n > 0]

        return d.select("i", "j", "p", "_n").groupBy("i").applyInPandas(draw, f"origin {kind}, destination {kind}, flow double")

    def training_set(self, flows: DataFrame, relevance: DataFrame, pairs: DataFrame) -> DataFrame:
        """(origin, destination, flow, ln_origin, ln_destination, cost): flows between different known places of positive relevance and distance."""
        if dict(flows.dtypes)["origin"] in ("bigint", "string") and dict(relevance.dtypes)["tile"] in ("bigint", "string"):
            check_resolution(flows, relevance)
        r = relevance.where("relevance > 0").select("tile", F.ln("relevance").alias("_l"))
        f = flows.where("origin <> destination").join(r.select(F.col("tile").alias("origin"), F.col("_l").alias("ln_origin")), "origin")
        f = f.join(r.select(F.col("tile").alias("destination"), F.col("_l").alias("ln_destination")), "destination")
        f = f.join(pairs.select(F.col("i").alias("origin"), F.col("j").alias("destination"), "km"), ["origin", "destination"]).where("km > 0")
        cost = -F.col("km") if self.deterrence_func_type == "exponential" else F.ln("km")
        return f.select("origin", "destination", "flow", "ln_origin", "ln_destination", cost.alias("cost"))

    def fit(self, training: DataFrame, iterations: int = 30) -> "Gravity":
        """Poisson regression with log link, by Newton steps on aggregates.

        Type ``single`` gives every origin an effect of its own, which is
        profiled out: given the slopes, it is the log ratio of the origin's
        flows to its fitted total, so no indicator columns are built.
        """
        x = ["ln_destination", "cost"] if self.gravity_type == "single" else ["ln_origin", "ln_destination", "cost"]
        k = len(x)
        beta = np.zeros(k)
        data = cut_lineage(training.select("origin", F.col("flow").cast("double").alias("y"), *x))  # read once per step
        for _ in range(iterations):
            eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, x)), F.lit(0.0))
            e = data.withColumn("_e", F.exp(eta))
            by = ["origin"] if self.gravity_type == "single" else []
            # Group totals of y, weights, weighted x and weighted products: enough for the profiled gradient and Hessian.
            aggs = [F.sum("y").alias("y"), F.sum("_e").alias("e")]
            aggs += [F.sum(F.col("y") * F.col(c)).alias(f"y{i}") for i, c in enumerate(x)]
            aggs += [F.sum(F.col("_e") * F.col(c)).alias(f"e{i}") for i, c in enumerate(x)]
            aggs += [F.sum(F.col("_e") * F.col(x[i]) * F.col(x[j])).alias(f"e{i}{j}") for i in range(k) for j in range(i, k)]
            g = e.groupBy(*by).agg(*aggs)
            mu = F.col("y") / F.col("e")
            total = [F.sum(F.col(f"y{i}") - mu * F.col(f"e{i}")) for i in range(k)]
            total += [F.sum(mu * F.col(f"e{i}{j}") - mu * F.col(f"e{i}") * F.col(f"e{j}") / F.col("e")) for i in range(k) for j in range(i, k)]
            row = g.where("e > 0").agg(*total).first()
            if row is None or row[0] is None:
                break
            grad = np.array(row[:k], float)
            hess, at = np.zeros((k, k)), k
            for i in range(k):
                for j in range(i, k):
                    hess[i, j] = hess[j, i] = row[at]
                    at += 1
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        # The exponential kind fits exp(-c d) through the column -d, the power law d^k through ln d: both give the argument itself.
        arg = self.deterrence_func_arg if self.compat else float(beta[-1])
        if self.gravity_type == "single":
            return replace(self, origin_exp=1.0, destination_exp=float(beta[0]), deterrence_func_arg=arg)
        return replace(self, origin_exp=float(beta[0]), destination_exp=float(beta[1]), deterrence_func_arg=arg)
