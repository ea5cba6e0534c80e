"""Stops and trips from location pings.

Pings are discretised to hierarchical grid cells whose level follows the
latitude, so that a cell is never narrower than the stop's extent. Dwell is
run-length encoded with neighbour-cell hysteresis: a run goes on while a ping
lies in the cell, or a neighbouring cell, of one of its last three. Runs that
dwell long enough are refined to the longest stretches whose pings lie within
the extent of each other. Everything between two stops is a trip.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import R_MEAN_M, chord, haversine, np_unit_vectors, valid_position
from ..session import write_table
from .sequences import number_runs

_STOP = "caid string, session_us bigint, first_ping_id bigint, last_ping_id bigint, start_us bigint, end_us bigint, n_pings int, latitude double, longitude double, path_start_m double, path_end_m double, session_path_m double"


def grid_cells(lat: np.ndarray, lon: np.ndarray, extent_m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, row, column) in a quadtree over degrees: the finest level at which a cell is ``extent_m`` wide or more at that latitude and 1/64 degree beyond."""
    beyond = np.minimum(np.abs(lat) + 1 / 64, 89.9)
    width = 2 * np.pi * R_MEAN_M * np.cos(np.radians(beyond))
    level = np.clip(np.floor(np.log2(np.maximum(width / extent_m, 2.0))), 1, 30).astype(np.int64)
    n = (1 << level).astype(float)
    row = np.floor((lat + 90.0) / 360.0 * n).astype(np.int64)
    col = np.floor((lon + 180.0) / 360.0 * n).astype(np.int64) % (1 << level)
    return level, row, col


def _near(level, row, col, xyz, session, k: int, reach: float) -> np.ndarray:
    """Of each ping, whether the k-th before it, in the same session, lies in the same or a neighbouring cell."""
    out = np.zeros(len(level), bool)
    if len(level) <= k:
        return out
    same = session[k:] == session[:-k]
    dc = np.abs(col[k:] - col[:-k])
    dc = np.minimum(dc, (1 << level[k:]) - dc)
    cells = (np.abs(row[k:] - row[:-k]) <= 1) & (dc <= 1)
    mixed = level[k:] != level[:-k]
    if mixed.any():  # two levels meet: the cells have no common grid, so the distance itself decides
        cells = np.where(mixed, ((xyz[k:] - xyz[:-k]) ** 2).sum(1) <= reach * reach, cells)
    out[k:] = same & cells
    return out


def dwell_runs(level, row, col, xyz, session, reach: float, slack: int = 2) -> np.ndarray:
    """Run numbers: a run ends where no ping before the border is a cell neighbour of one after it at most ``slack`` + 1 places apart."""
    n = len(level)
    linked = np.zeros(n, bool)
    for k in range(1, slack + 2):
        near = _near(level, row, col, xyz, session, k, reach)
        for shift in range(k):
            linked[: n - shift] |= near[shift:]
    return np.cumsum(~linked)


def _hull(xyz: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the places ``at``, those on the convex hull in the tangent plane: whatever lies within reach of all of these lies within reach of all."""
    if len(at) <= 8:
        return at
    p = xyz[at]
    z = p[0] / np.linalg.norm(p[0])
    x = np.cross(z, (0.0, 0.0, 1.0) if abs(z[2]) < 0.9 else (1.0, 0.0, 0.0))
    x /= np.linalg.norm(x)
    u, v = p @ x, p @ np.cross(z, x)
    # Points inside the polygon of eight extremes cannot be corners; most fall here.
    ext = np.unique([f(c) for c in (u, v, u + v, u - v) for f in (np.argmin, np.argmax)])
    mid = u[ext].mean(), v[ext].mean()
    ext = ext[np.argsort(np.arctan2(v[ext] - mid[1], u[ext] - mid[0]))]
    if len(ext) >= 3:
        inner = np.ones(len(at), bool)
        for i, j in zip(ext, np.roll(ext, -1)):
            inner &= (u[j] - u[i]) * (v - v[i]) - (v[j] - v[i]) * (u - u[i]) > 0
        inner[ext] = False
        left = np.flatnonzero(~inner)
    else:
        left = np.arange(len(at))
    left = left[np.lexsort((v[left], u[left]))]
    out: list[int] = []
    for order in (left, left[::-1]):
        side: list[int] = []
        for k in order.tolist():
            while len(side) > 1 and (u[side[-1]] - u[side[-2]]) * (v[k] - v[side[-2]]) - (v[side[-1]] - v[side[-2]]) * (u[k] - u[side[-2]]) <= 0:
                side.pop()
            side.append(k)
        out += side[:-1]
    return at[np.array(sorted(set(out)), int)] if out else at[:1]


def _within(xyz: np.ndarray, a: np.ndarray, b: np.ndarray, r2: float) -> np.ndarray:
    """Which places ``a`` lie within reach of all places ``b``."""
    d = xyz[a][:, None, :] - xyz[b][None, :, :]
    return (np.einsum("ijk,ijk->ij", d, d) <= r2).all(1)


def _grow(i: int, xyz: np.ndarray, r2: float, slack: int, window: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places from i on that stay within reach of all taken before; more than ``slack`` successive others end it. Also those passed over inside.

    What is taken is remembered by its hull, and looked at one window at a
    time, so the work grows with the length and not with its square.
    """
    n, got, passed, away = len(xyz), [np.array([i])], [], []
    hull = got[0]
    lo = i + 1
    while lo < n and len(away) <= slack:
        look = np.arange(lo, min(n, lo + window))
        fit = _within(xyz, look, hull, r2)
        new = look[fit]
        both = _hull(xyz, np.r_[hull, new]) if len(new) else hull
        if len(new) and _within(xyz, both, both, r2).all():
            taken = fit  # the usual case: those that fit also lie within reach of each other
        else:
            taken = np.zeros(len(look), bool)
            for k in range(len(look)):
                if fit[k]:
                    taken[k] = True
                    fit &= _within(xyz, look, look[k : k + 1], r2)
                    fit[k] = True
            both = _hull(xyz, np.r_[hull, look[taken]])
        hits = np.flatnonzero(taken)
        before = np.r_[-1, hits] if not away else np.r_[-1 - len(away), hits]
        wide = np.flatnonzero(np.diff(before) - 1 > slack)
        if len(wide):  # it ends before the first such gap
            last = before[wide[0]]
            if last >= 0:
                got.append(look[hits[hits <= last]])
                passed += away + look[: last + 1][~taken[: last + 1]].tolist()
            return np.concatenate(got), np.array(passed, int)
        if len(hits):
            got.append(look[hits])
            passed += away + look[: hits[-1] + 1][~taken[: hits[-1] + 1]].tolist()
            away = look[hits[-1] + 1 :].tolist()
            hull = both
        else:
            away += look.tolist()
        lo = look[-1] + 1
    return np.concatenate(got), np.array(passed, int)


def _starts(got: np.ndarray, passed: np.ndarray, xyz: np.ndarray, r2: float) -> list[int]:
    """Behind the last taken ping that kept out each of the passed ones, ascending, with repeats."""
    at = []
    for q in passed:
        end = int(np.searchsorted(got, q))
        step = 64
        while end > 0:  # backwards in doubling steps: the last one is mostly near
            part = got[max(0, end - step) : end]
            d = xyz[part] - xyz[q]
            out = np.flatnonzero(np.einsum("ij,ij->i", d, d) > r2)
            if len(out):
                at.append(int(part[out[-1]]) + 1)
                break
            end -= step
            step *= 2
    return sorted(at)


def stretches(us: np.ndarray, xyz: np.ndarray, reach: float, min_us: int, slack: int = 2) -> list[np.ndarray]:
    """Longest stretches, in order and disjoint, of pings pairwise within chord ``reach`` lasting ``min_us`` or more."""
    return _stretches(us, xyz, reach, min_us, slack)[0]


def _stretches(us: np.ndarray, xyz: np.ndarray, reach: float, min_us: int, slack: int, final: bool = True) -> tuple[list[np.ndarray], int]:
    """The stretches, and the first ping of which it is not known yet whether one begins there; if not ``final``, more pings may follow."""
    n = len(us)
    if us[-1] - us[0] < min_us:
        return [], 0
    spread, r2 = xyz.max(0) - xyz.min(0), reach * reach
    if (spread * spread).sum() <= r2:
        return [np.arange(n)], n

    out, i = [], 0
    while i < n and us[-1] - us[i] >= min_us:
        got, passed = _grow(i, xyz, r2, slack)
        if us[got[-1]] - us[i] < min_us:
            if not final and n - 1 - got[-1] <= slack:
                break
            i += 1
            continue
        # A ping on the way in may have kept out pings of the stop itself: a start behind it is preferred if it holds more.
        tried = True
        while len(passed) and tried:
            tried = False
            starts = _starts(got, passed, xyz, r2)
            for later in dict.fromkeys(starts):
                lost = int(np.searchsorted(got, later))
                if lost >= len(passed) or later >= got[-1]:
                    break
                # It may win the passed pings that only earlier ones kept out, and what follows the end.
                if lost >= bisect_right(starts, later) + (n - 1 - got[-1]):
                    continue
                other, other_passed = _grow(later, xyz, r2, slack)
                if len(other) > len(got) and us[other[-1]] - us[later] >= min_us:
                    got, passed, tried = other, other_passed, True
                    break
        out.append(got)
        i = int(got[-1]) + 1
    return out, i


def _arc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2 * R_MEAN_M * np.arcsin(np.minimum(np.sqrt(((a - b) ** 2).sum(-1)) / 2, 1))


def spikes(xyz: np.ndarray, session: np.ndarray, extent_m: float) -> np.ndarray:
    """Which pings, one or two in a row, lie over twice ``extent_m`` from the pings before and after, while these two are near each other."""
    n, out = len(xyz), np.zeros(len(xyz), bool)
    for m in (1, 2):
        k = n - m - 1
        if k <= 0:
            continue
        before, after = xyz[:k], xyz[m + 1 :]
        off = np.min([f for j in range(1, m + 1) for f in (_arc(before, xyz[j : j + k]), _arc(xyz[j : j + k], after))], axis=0)
        hit = (session[:k] == session[m + 1 :]) & (off > 2 * extent_m) & (_arc(before, after) <= np.maximum(extent_m, off / 4))
        for j in range(1, m + 1):
            out[j : j + k] |= hit
    return out


class _Dwell:
    """Streams pings sorted by (caid, session, instant, ping_id).

    Holds the run that is still open. Of a run of more than ``most`` pings the
    settled stops are given out and, of a stop that is still going on, only the
    first ping, its hull and its last pings are kept, with the sums of the
    others; its start is then no longer reconsidered for the sake of those.
    """

    def __init__(self, extent_m: float, min_s: float, slack: int, most: int = 1_000_000):
        self.reach, self.min_us, self.slack, self.extent, self.most = chord(extent_m), int(min_s * 1e6), slack, extent_m, most
        self.around = max(slack, 2) + 1  # pings on either side that decide about a border or a spike
        self.open: list[tuple[np.ndarray, np.ndarray]] = []  # of the open run: (instant, ping, count), (path, x, y, z, sums of x, y, z)
        self.held, self.next_most, self.key = 0, most, None
        self.before = self.wait = None  # pings just before the first that is not settled, and those not settled
        self.path, self.last_kept = 0.0, None

    def _close(self, rows: list, final: bool = True) -> None:
        if not self.open:
            return
        whole, real = (np.concatenate(x, axis=1) for x in zip(*self.open))
        us = whole[0]
        found, upto = _stretches(us, real[1:4].T, self.reach, self.min_us, self.slack, final)
        going = found.pop() if not final and found and len(us) - 1 - found[-1][-1] <= self.slack else None
        for g in found:
            c, a, z = real[4:7, g].sum(1), g[0], g[-1]
            where = float(np.degrees(np.arctan2(c[2], np.hypot(c[0], c[1])))), float(np.degrees(np.arctan2(c[1], c[0])))
            rows.append((*self.key, whole[1, a], whole[1, z], us[a], us[z], whole[2, g].sum(), *where, real[0, a], real[0, z], np.nan))
        self.open, self.held, self.next_most = [], 0, self.most
        if final:
            return
        left = np.arange(upto, len(us))
        if going is not None:
            xyz = real[1:4].T
            stay = np.union1d(_hull(xyz, going), going[[0, -1]])
            gone = np.setdiff1d(going, stay)
            whole[2, going[0]] += whole[2, gone].sum()
            real[4:7, going[0]] += real[4:7, gone].sum(1)
            left = np.union1d(stay, np.arange(going[-1] + 1, len(us)))
        self.open, self.held = [(whole[:, left], real[:, left])], len(left)
        self.next_most = max(self.most, 2 * self.held)

    def _paths(self, xyz: np.ndarray, sess: np.ndarray, keys: list, start: int, end: int) -> np.ndarray:
        """Metres along the session's pings that are no spikes, up to each of the pings ``start`` to ``end``."""
        at = np.flatnonzero(~spikes(xyz, sess, self.extent)[:end])
        at = at[at >= start]
        if not len(at):
            return np.full(end - start, self.path)
        goes_on = self.last_kept is not None and self.last_kept[0] == keys[at[0]]
        step = np.r_[_arc(self.last_kept[1], xyz[at[0]]) if goes_on else 0.0, np.where(sess[at[1:]] == sess[at[:-1]], _arc(xyz[at[1:]], xyz[at[:-1]]), 0.0)]
        total = (self.path if goes_on else 0.0) + np.cumsum(step)
        begins = np.maximum.accumulate(np.where(np.r_[not goes_on, sess[at[1:]] != sess[at[:-1]]], np.arange(len(at)), -1))
        total = total - np.where(begins >= 0, total[np.maximum(begins, 0)], 0.0)
        last = np.searchsorted(at, np.arange(start, end), "right") - 1
        path = np.where(last >= 0, total[np.maximum(last, 0)], self.path)
        self.path, self.last_kept = float(total[-1]), (keys[at[-1]], xyz[at[-1]])
        return path

    def feed(self, pdf: pd.DataFrame | None, final: bool = False) -> pd.DataFrame:
        rows: list = []
        some = [x for x in (self.before, self.wait, pdf) if x is not None and len(x)]
        if not some:
            return self._frame(rows)
        d = pd.concat([x[["caid", "session_us", "utc_us", "ping_id", "latitude", "longitude"]] for x in some], ignore_index=True)
        start = 0 if self.before is None else len(self.before)
        caid, sus, us = d["caid"].to_numpy(), d["session_us"].to_numpy(), d["utc_us"].to_numpy()
        keep = np.ones(len(d), bool)
        keep[1:] = (caid[1:] != caid[:-1]) | (sus[1:] != sus[:-1]) | (us[1:] != us[:-1])  # of one instant, the smallest ping_id
        if not keep.all():
            d, caid, sus, us = d[keep], caid[keep], sus[keep], us[keep]
        n = len(d)
        end = n if final else max(start, n - self.around)
        sess = np.cumsum(np.r_[True, (caid[1:] != caid[:-1]) | (sus[1:] != sus[:-1])])
        lat, lon = d["latitude"].to_numpy(float), d["longitude"].to_numpy(float)
        xyz = np_unit_vectors(lat, lon)
        run = dwell_runs(*grid_cells(lat, lon, self.extent), xyz, sess, self.reach, self.slack)
        if end > start:
            path = self._paths(xyz, sess, list(zip(caid, sus)), start, end)
            whole = np.vstack([us[start:end], d["ping_id"].to_numpy()[start:end], np.ones(end - start, np.int64)])
            real = np.vstack([path, xyz[start:end].T, xyz[start:end].T])
            new = run[start:end] != np.r_[run[start - 1] if start else -1, run[start : end - 1]]
            cut = np.unique(np.r_[0, np.flatnonzero(new), end - start]).tolist()
            for s, e in zip(cut, cut[1:]):
                if new[s]:
                    self._close(rows)
                    self.key = caid[start + s], sus[start + s]
                self.open.append((whole[:, s:e], real[:, s:e]))
                self.held += e - s
                if self.held > self.next_most:
                    self._close(rows, final=False)
        if final:
            self._close(rows)
            self.before = self.wait = None
        else:
            self.before, self.wait = d.iloc[max(0, end - self.around) : end], d.iloc[end:]
        return self._frame(rows)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _STOP.split(", ")])

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield self.feed(pdf)
        yield self.feed(None, final=True)


def ping_sessions(pings: DataFrame, max_silence_s: float = 3600.0) -> DataFrame:
    """Usable pings with ``session_us``, the instant of the first ping since the last silence of more than ``max_silence_s``.

    ``pings`` has caid, ping_id, latitude, longitude and utc_us. Rows with a
    null among them, an impossible position or (0, 0) are left out.
    """
    d = pings.where(F.col("caid").isNotNull() & F.col("utc_us").isNotNull() & F.col("ping_id").isNotNull() & valid_position("latitude", "longitude"))
    d = write_table(d.select("caid", "ping_id", "latitude", "longitude", "utc_us"))  # parsed once, read by both branches of number_runs
    gap = int(max_silence_s * 1e6)
    day = F.floor(F.col("utc_us") / F.lit(86_400_000_000.0)).cast("int")
    d = number_runs(d, ["caid"], ["utc_us", "ping_id"], day, lambda p, c: c["utc_us"] - p["utc_us"] > F.lit(gap), "_run")
    return d.withColumn("session_us", F.col("_run.utc_us")).drop("_run")


def detect_stops(pings: DataFrame, extent_m: float = 50.0, min_s: float = 300.0, max_silence_s: float = 3600.0, slack: int = 2, most: int = 1_000_000) -> DataFrame:
    """One row per stop of each device.

    ``pings``: caid, ping_id (unique), latitude, longitude, utc_us. A stop is a
    longest stretch of a device's usable pings within ``extent_m`` of each
    other, lasting ``min_s``; ``slack`` successive instants elsewhere do not
    end it, a silence over ``max_silence_s`` does. Of several pings at one
    instant the smallest ping_id counts. Unusable rows (nulls, NaN, out of
    range, (0, 0)) take no part; repeated rows change nothing; an empty table
    gives no stops; further columns are ignored.

    A device's rows are spread over tasks by session, so a device with a third
    of all rows costs no task more than its longest unbroken session, which is
    read as a stream of Arrow batches in time in proportion to its length. Of
    one dwell run at most ``most`` pings are held: beyond, of the stop that is
    going on its hull and sums are kept, and its start stays.
    """
    d = ping_sessions(pings, max_silence_s)
    d = d.repartition("caid", "session_us").sortWithinPartitions("caid", "session_us", "utc_us", "ping_id")

    def run(batches):
        yield from _Dwell(extent_m, min_s, slack, most).run(batches)

    return d.mapInPandas(run, _STOP).drop("session_path_m")


def trips_between(stops: DataFrame) -> DataFrame:
    """One row per pair of successive stops of a device: the trip between them.

    ``observed`` trips lie within one session and their distance is the sum of
    great-circle distances along the pings that are no spikes; where a silence lies between the
    stops, the distance is that between the two places.
    """
    w = W.partitionBy("caid").orderBy("start_us", "first_ping_id")
    nxt = lambda c: F.lead(c).over(w)
    d = stops.select(
        "caid",
        F.col("last_ping_id").alias("from_ping_id"),
        nxt("first_ping_id").alias("to_ping_id"),
        F.col("end_us").alias("start_us"),
        nxt("start_us").alias("end_us"),
        (nxt("session_us") == F.col("session_us")).alias("observed"),
        (nxt("path_start_m") - F.col("path_end_m")).alias("_path"),
        haversine(F.col("latitude"), F.col("longitude"), nxt("latitude"), nxt("longitude")).alias("_direct"),
    ).where(F.col("to_ping_id").isNotNull())
    return d.select(
        "caid", "from_ping_id", "to_ping_id", "start_us", "end_us",
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"),
        F.when(F.col("observed"), F.greatest("_path", "_direct")).otherwise(F.col("_direct")).alias("distance_m"),
        "observed",
    )
