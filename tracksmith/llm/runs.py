"""Runs of near-identical consecutive events collapsed into one stay each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine, np_haversine
from ..operators.sequences import number_runs

_STAY = "first_row_id bigint, last_row_id bigint, start_ts bigint, end_ts bigint, duration_s bigint, n_rows bigint, longitude double, latitude double"


class _Anchored:
    """Streams rows sorted by (key, chain, time, row_id); closes a stay when a row lies too far from the stay's first row."""

    def __init__(self, metres: float):
        self.metres, self.open, self.at = metres, None, None

    def _close(self, out: list) -> None:
        if self.open is not None:
            k, r0, r1, t0, t1, n, lon, lat = self.open
            out.append((k, r0, r1, t0, t1, t1 - t0, n, lon, lat))
            self.open = None

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["_key", *[c.split()[0] for c in _STAY.split(", ")]]
        for pdf in batches:
            out: list = []
            key, row, ts, lon, lat, ct, cr = (pdf[c].to_numpy() for c in ("_key", "row_id", "ts", "lon", "lat", "_ct", "_cr"))
            n = len(pdf)
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (ct[1:] != ct[:-1]) | (cr[1:] != cr[:-1])][:n])
            for s, e in zip(new.tolist(), [*new[1:].tolist(), n]):
                chain = key[s], ct[s], cr[s]
                if chain != self.at:
                    self._close(out)
                    self.at = chain
                while s < e:
                    if self.open is None:
                        self.open = [key[s], row[s], row[s], ts[s], ts[s], 1, lon[s], lat[s]]
                        s += 1
                        continue
                    o = self.open
                    stop, ahead = s, 32
                    while stop < e:  # in doubling steps, so that a chain cut often is not measured again to its end each time
                        away = np.flatnonzero(np_haversine(o[7], o[6], lat[stop : min(e, stop + ahead)], lon[stop : min(e, stop + ahead)]) > self.metres)
                        if len(away):
                            stop += int(away[0])
                            break
                        stop, ahead = min(e, stop + ahead), 2 * ahead
                    if stop > s:
                        o[2], o[4], o[5] = row[stop - 1], ts[stop - 1], o[5] + stop - s
                    if stop < e:
                        self._close(out)
                    s = stop
            yield pd.DataFrame(out, columns=cols)
        out = []
        self._close(out)
        yield pd.DataFrame(out, columns=cols)


def collapse_repeats(
    df: DataFrame,
    key: str = "caid",
    time: str = "unix_timestamp",
    row_id: str = "row_id",
    lon: str = "longitude",
    lat: str = "latitude",
    metres: float = 50.0,
    max_gap_s: int = 86_400,
    bucket_s: int = 7 * 86_400,
) -> DataFrame:
    """One row per run: ``key``, first and last row id, start, end, duration in seconds, number of rows and the first row's position.

    Rows of a key are taken in the order of (time, row_id). A run holds
    consecutive rows that lie within ``metres`` of its first row and follow one
    another by at most ``max_gap_s``. Rows with a null (or NaN position) in any
    of the five columns take no part and interrupt nothing. Repeated rows are
    rows like any other; a single row is a run of one; an empty table gives no
    runs; other columns are ignored.

    A lag window compares each row with its predecessor, a cumulative pass
    numbers the chains of rows less than twice ``metres`` apart (a superset of
    the runs), and each chain is cut where the distance from the run's first row
    says so. Windows are confined to (key, ``bucket_s``), chains are spread over
    tasks and streamed, so no key passes through one task.
    """
    d = df.select(F.col(key).alias("_key"), F.col(row_id).cast("bigint").alias("row_id"), F.col(time).cast("bigint").alias("ts"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    d = d.where("_key is not null and row_id is not null and ts is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")

    def changed(p, c):
        return (c["ts"] - p["ts"] > max_gap_s) | (haversine(p["lat"], p["lon"], c["lat"], c["lon"]) > 2.0 * metres * (1 + 1e-9))

    d = number_runs(d, ["_key"], ["ts", "row_id"], F.floor(F.col("ts") / float(bucket_s)).cast("bigint"), changed, "_chain")
    d = d.select("_key", F.col("_chain.ts").alias("_ct"), F.col("_chain.row_id").alias("_cr"), "row_id", "ts", "lon", "lat")
    d = d.repartition("_key", "_ct", "_cr").sortWithinPartitions("_key", "_ct", "_cr", "ts", "row_id")

    def run(batches):
        yield from _Anchored(metres).run(batches)

    return d.mapInPandas(run, f"_key {dict(df.dtypes)[key]}, {_STAY}").withColumnRenamed("_key", key)
