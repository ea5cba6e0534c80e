"""Exploration and preferential return: agents moving by an origin-destination matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRAJECTORY = "user bigint, datetime timestamp, location bigint"


def waiting_hours(rng: np.random.Generator, min_h: float, beta: float, tau_h: float) -> float:
    """A truncated power law, exponent 1 + ``beta`` and cut-off ``tau_h``, from ``min_h`` on: exponential proposals, thinned by the power."""
    while True:
        x = min_h - np.log1p(-rng.random()) * tau_h
        if rng.random() < (x / min_h) ** (-1.0 - beta):
            return x


@dataclass(frozen=True)
class EPR:
    """rho and gamma set how readily new places are explored; beta, tau and the shortest wait set how long agents stay."""

    rho: float = 0.6
    gamma: float = 0.21
    beta: float = 0.8
    tau_hours: float = 17.0
    min_wait_minutes: float = 20.0

    def generate(self, od: DataFrame, tiles: DataFrame, n_agents: int, start: str, end: str, starts: list[int] | None = None, seed: int = 0, max_entries: int = 5_000_000) -> DataFrame:
        """(user, datetime, location), each agent's first record at ``start``.

        ``od``: origin, destination, p (rows without entries are uniform);
        ``tiles``: cell. Agents are seeded one by one, so the result does not
        depend on partitioning. The matrix is needed at random by every agent
        and is sent to the tasks; more than ``max_entries`` entries, or cells, are
        refused, and a coarser tessellation is to be used.
        """
        for what, df in (("matrix entries", od), ("cells", tiles)):
            if df.limit(max_entries + 1).count() > max_entries:
                raise ValueError(f"more than {max_entries} {what}: use a coarser tessellation")
        cells = np.sort(tiles.select("cell").toPandas()["cell"].to_numpy())
        m = od.select("origin", "destination", "p").toPandas().sort_values(["origin", "destination"])
        o, dst = np.searchsorted(cells, m["origin"]), np.searchsorted(cells, m["destination"])
        ptr = np.searchsorted(o, np.arange(len(cells) + 1))
        side = od.sparkSession.sparkContext.broadcast((cells, ptr, dst, m["p"].to_numpy()))
        t0, t1 = pd.Timestamp(start).value / 3.6e12, pd.Timestamp(end).value / 3.6e12
        model = self
        first = np.searchsorted(cells, np.asarray(starts)) if starts else None

        def run(batches):
            cells, ptr, dst, p = side.value
            for pdf in batches:
                for agent in pdf["id"]:
                    rng = np.random.default_rng([seed, int(agent)])
                    here = int(first[agent % len(first)]) if first is not None else int(rng.integers(len(cells)))
                    visits, now, rows = {here: 1}, t0, [(t0, here)]
                    while True:
                        now += waiting_hours(rng, model.min_wait_minutes / 60.0, model.beta, model.tau_hours)
                        if now >= t1:
                            break
                        here = model._next(rng, here, visits, len(cells), dst[ptr[here] : ptr[here + 1]], p[ptr[here] : ptr[here + 1]])
                        visits[here] = visits.get(here, 0) + 1
                        rows.append((now, here))
                    yield pd.DataFrame({"user": agent, "datetime": pd.to_datetime([int(t * 3.6e9) for t, _ in rows], unit="us"), "location": cells[[x for _, x in rows]]})

        agents = od.sparkSession.range(n_agents).repartition(max(1, min(n_agents, od.sparkSession.sparkContext.defaultParallelism)))
        return agents.mapInPandas(run, TRAJECTORY)

    def _next(self, rng, here: int, visits: dict[int, int], n: int, dst: np.ndarray, p: np.ndarray) -> int:
        s = len(visits)
        if s == 1 or (rng.random() <= self.rho * s**-self.gamma and s < n):
            if len(dst) == 0:
                dst, p = np.delete(np.arange(n), here), np.full(n - 1, 1.0)
            new = ~np.isin(dst, list(visits))
            w = p * new
            if not w.any():
                unseen = np.setdiff1d(np.arange(n), list(visits))
                return int(rng.choice(unseen if len(unseen) else np.arange(n)))
            return int(rng.choice(dst, p=w / w.sum()))
        places = np.array(list(visits))
        k = np.array([visits[x] for x in places], float)
        return int(rng.choice(places, p=k / k.sum()))


def trajectory_flows(trajectories: DataFrame) -> DataFrame:
    """(origin, destination, flow) of successive records in different places."""
    w = W.partitionBy("user").orderBy("datetime", "location")
    d = trajectories.select(F.col("location").alias("origin"), F.lead("location").over(w).alias("destination"))
    return d.where("destination is not null and origin <> destination").groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("flow"))
