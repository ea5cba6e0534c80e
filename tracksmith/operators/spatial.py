"""Points near other points, and the region containing a point.

Positions become unit vectors, so that neither poles nor the 180th meridian
need care. Space is cut by k-d splits fitted on a bounded sample; every row is
sent to the part that owns it and, as a halo copy, to parts within the radius.
Inside a part a local k-d tree is queried by chord radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import R_MEAN_M, chord, np_unit_vectors
from ..session import broadcast_if_small, write_table


class KdSplits:
    """A k-d partition of the unit cube's space: inner nodes (axis, value), numbered leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []
        self.leaves, self._axis = 0, None
        self._build(sample, leaves)

    def _build(self, pts: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        axis = int(np.argmax(np.ptp(pts, axis=0))) if len(pts) > 1 else 0
        if leaves <= 1 or len(pts) < 2 or np.ptp(pts[:, axis]) == 0:
            self.nodes[at] = (-1, self.leaves, 0, 0)
            self.leaves += 1
            return at
        value = float(np.median(pts[:, axis]))
        low = pts[:, axis] < value
        if not low.any():
            value = float(np.nextafter(value, 2))
            low = pts[:, axis] < value
        left = self._build(pts[low], leaves // 2)
        right = self._build(pts[~low], leaves - leaves // 2)
        self.nodes[at] = (axis, value, left, right)
        return at

    def assign(self, xyz: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, owned): each row once in the leaf that owns it and once in each further leaf within ``reach``."""
        if self._axis is None:
            self._axis, self._value, self._left, self._right = (np.array(c) for c in zip(*self.nodes))
        axis_of, value_of, left_of, right_of = self._axis.astype(int), self._value, self._left, self._right
        idx, at, own, out = np.arange(len(xyz)), np.zeros(len(xyz), np.int64), np.ones(len(xyz), bool), []
        while len(idx):  # all rows go down one level at a time
            axis, value = axis_of[at], value_of[at]
            end = axis < 0
            if end.any():
                out.append((idx[end], value[end].astype(np.int64), own[end]))
                idx, at, own, axis, value = idx[~end], at[~end], own[~end], axis[~end], value[~end]
            x = xyz[idx, axis]
            lo, hi, low = x < value + reach, x >= value - reach, x < value
            idx, at, own = np.r_[idx[lo], idx[hi]], np.r_[left_of[at[lo]], right_of[at[hi]]], np.r_[own[lo] & low[lo], own[hi] & ~low[hi]]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(p) for p in zip(*out))


class KdTree:
    """A local k-d tree with buckets; ``pairs`` finds all pairs within a chord radius, bucket against bucket."""

    def __init__(self, xyz: np.ndarray, bucket: int = 32):
        self.xyz, self.order = xyz, np.arange(len(xyz))
        self.boxes, self.kids, self.span, stack = [], [], [], [(0, len(xyz), -1, 0)]
        while stack:
            s, e, parent, side = stack.pop()
            idx = self.order[s:e]
            at = len(self.boxes)
            lo, hi = xyz[idx].min(0), xyz[idx].max(0)
            self.boxes.append(np.r_[lo, hi])
            self.kids.append([-1, -1])
            self.span.append((s, e))
            if parent >= 0:
                self.kids[parent][side] = at
            if e - s > bucket:
                axis, mid = int(np.argmax(hi - lo)), (e - s) // 2
                self.order[s:e] = idx[np.argpartition(xyz[idx, axis], mid)]
                stack += [(s, s + mid, at, 0), (s + mid, e, at, 1)]
        self.boxes, self.kids, self.span = np.array(self.boxes), np.array(self.kids), np.array(self.span)

    def pairs(self, reach: float, label: np.ndarray, chunk: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) positions with chord at most ``reach`` and different labels, each unordered pair once."""
        leaf = np.flatnonzero(self.kids[:, 0] < 0)
        a, b = leaf, np.zeros(len(leaf), np.int64)
        found = []
        while len(a):
            gap = np.maximum(0, np.maximum(self.boxes[a, :3] - self.boxes[b, 3:], self.boxes[b, :3] - self.boxes[a, 3:]))
            ok = (gap * gap).sum(1) <= reach * reach * (1 + 1e-9)
            a, b = a[ok], b[ok]
            end = self.kids[b, 0] < 0
            found.append(np.column_stack([a[end], b[end]]))
            a, b = a[~end], b[~end]
            a, b = np.r_[a, a], np.r_[self.kids[b, 0], self.kids[b, 1]]
        both = np.concatenate(found)
        both = both[both[:, 0] <= both[:, 1]]
        lab = label[self.order]
        starts, ends = self.span[:, 0], self.span[:, 1]
        single = np.array([lab[s] if e > s and (lab[s:e] == lab[s]).all() else -1 for s, e in zip(starts[leaf], ends[leaf])])
        one = np.full(len(self.span), -1, np.int64)
        one[leaf] = single
        both = both[(one[both[:, 0]] < 0) | (one[both[:, 0]] != one[both[:, 1]])]  # buckets of one and the same label hold no pair
        width = int((ends[leaf] - starts[leaf]).max()) if len(leaf) else 1
        step, k = max(1, chunk // (width * width)), np.arange(width)
        for s in range(0, len(both), step):
            la, lb = both[s : s + step, 0], both[s : s + step, 1]
            ia, ib = starts[la][:, None] + k, starts[lb][:, None] + k
            va, vb = ia < ends[la][:, None], ib < ends[lb][:, None]
            ia, ib = self.order[np.where(va, ia, 0)], self.order[np.where(vb, ib, 0)]
            d = self.xyz[ia][:, :, None, :] - self.xyz[ib][:, None, :, :]
            hit = np.einsum("abcd,abcd->abc", d, d) <= reach * reach
            hit &= va[:, :, None] & vb[:, None, :] & (label[ia][:, :, None] != label[ib][:, None, :])
            p, q, r = np.nonzero(hit)
            i, j = ia[p, q], ib[p, r]
            twice = (la == lb)[p] & (i >= j)
            yield i[~twice], j[~twice]


def _sample(df: DataFrame, id: str, lat: str, lon: str, rows: int, n: int) -> np.ndarray:
    """Unit vectors of about ``rows`` of the ``n`` rows, at most twice as many."""
    keep = min(1.0, rows / max(n, 1))
    got = df.where(F.pmod(F.xxhash64(F.col(id)), F.lit(1_000_000_000)) < int(1e9 * keep) + 1).select(lat, lon).limit(2 * rows).toPandas()
    return np_unit_vectors(got[lat], got[lon]) if len(got) else np.zeros((0, 3))


def near_pairs(
    df: DataFrame,
    id: str,
    positions: list[tuple[str, str]],
    metres: float,
    different: str,
    part_rows: int = 20_000,
    sample_rows: int = 40_000,
    max_parts: int = 65_536,
) -> DataFrame:
    """(a, b), a < b: rows whose ``different`` values differ and whose every position pair is at most ``metres`` apart.

    ``positions`` lists (latitude, longitude) columns; the first is indexed, the
    others are checked on its hits. Null or NaN positions are near nothing; a
    null in ``different`` counts as a value equal to no other null. ``id`` is
    unique and not null (null ids are left out). Repeated rows under one id are
    one row. An empty table gives no pairs.

    The split tree is fitted on about ``sample_rows`` sampled rows, or 20 for
    each part where that is more (a bounded sample, as there are at most
    ``max_parts`` parts); every row is indexed. Parts hold about ``part_rows``
    rows, and more where there would be over ``max_parts`` of them (about
    150,000 at 10 billion rows): they grow, their rows are not copied. A part
    of over three times that, which the tree cannot split because many rows
    share a place, is cut into blocks that are compared block by block, so no
    task holds more than two blocks.
    """
    cols = [c for p in positions for c in p]
    ok = F.col(id).isNotNull()
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    at = [F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(cols)]
    d = df.where(ok).select(F.col(id), F.col(different).alias("_diff"), *at).dropDuplicates([id])
    reach = chord(metres)
    n = d.count()
    parts = int(min(max_parts, max(1, n // part_rows)))
    part_rows = max(part_rows, -(-n // parts) if parts == max_parts else 0)
    tree = KdSplits(_sample(d, id, "_p0", "_p1", max(sample_rows, 20 * parts), n), parts)
    kind = dict(d.dtypes)
    shape = f"_leaf bigint, _own boolean, `{id}` {kind[id]}, _label bigint, " + ", ".join(f"_p{i} double" for i in range(len(cols)))
    label = F.when(F.col("_diff").isNull(), F.xxhash64(F.lit("null"), F.col(id))).otherwise(F.xxhash64("_diff"))
    d = d.select(id, label.alias("_label"), *[f"_p{i}" for i in range(len(cols))])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, leaf, own = tree.assign(np_unit_vectors(pdf["_p0"], pdf["_p1"]), reach * (1 + 1e-9))
            yield pdf.iloc[row].assign(_leaf=leaf, _own=own)[["_leaf", "_own", *pdf.columns]]

    sent = write_table(d.mapInPandas(send, shape))  # counted and read again
    crowded = sent.groupBy("_leaf").count().where(F.col("count") > 3 * part_rows)  # at most max_parts rows
    blocks = crowded.select(F.col("_leaf").alias("_cl"), F.ceil(F.col("count") / part_rows).cast("int").alias("_n"))
    sent = sent.join(F.broadcast(blocks), F.col("_leaf") == F.col("_cl"), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    sent = sent.withColumn("_b", F.pmod(F.xxhash64(F.col(id)), F.col("_n")).cast("int"))
    sent = sent.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_lo", F.least("_b", "_o")).withColumn("_hi", F.greatest("_b", "_o")).drop("_cl", "_n", "_o")
    m = len(positions)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype=pdf[id].dtype), "b": pd.Series(dtype=pdf[id].dtype)})
        if len(pdf) < 2:
            return empty
        p = [np_unit_vectors(pdf[f"_p{2 * i}"], pdf[f"_p{2 * i + 1}"]) for i in range(m)]
        ids, lab, own, blk = pdf[id].to_numpy(), pdf["_label"].to_numpy(), pdf["_own"].to_numpy(), pdf["_b"].to_numpy()
        cross = pdf["_lo"].iloc[0] != pdf["_hi"].iloc[0]
        out = []
        for i, j in KdTree(p[0]).pairs(reach, lab):
            ok = np.ones(len(i), bool)
            for q in p[1:]:
                ok &= ((q[i] - q[j]) ** 2).sum(1) <= reach * reach
            if cross:
                ok &= blk[i] != blk[j]
            i, j = i[ok], j[ok]
            swap = ids[i] > ids[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            mine = own[a]  # a pair is reported where its smaller id is owned
            out.append((ids[a[mine]], ids[b[mine]]))
        if not out:
            return empty
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    return sent.groupBy("_leaf", "_lo", "_hi").applyInPandas(find, f"a {kind[id]}, b {kind[id]}")


def sweep_regions(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> list[np.ndarray]:
    """For each ring (k x 2 of x, y) the indices of the points inside: a sweep over x in which every edge toggles the points it passes below.

    Even-odd rule; an edge holds its lower x and not its higher, and a point on
    an edge lies above it, so adjoining regions share no point.
    """
    order = np.argsort(x, kind="stable")
    xs, ys, out = x[order], y[order], []
    for ring in rings:
        a, b = ring, np.roll(ring, -1, axis=0)
        low = np.where((a[:, 0] <= b[:, 0])[:, None], a, b)
        high = np.where((a[:, 0] <= b[:, 0])[:, None], b, a)
        start, stop = np.searchsorted(xs, low[:, 0], "left"), np.searchsorted(xs, high[:, 0], "left")
        s0, s1 = (int(start.min()), int(stop.max())) if len(ring) else (0, 0)
        odd = np.zeros(max(0, s1 - s0), bool)
        for (x0, y0), (x1, y1), s, e in zip(low, high, start, stop):
            if e > s:
                at = y0 + (y1 - y0) * ((xs[s:e] - x0) / (x1 - x0))
                odd[s - s0 : e - s0] ^= ys[s:e] >= at
        out.append(order[s0:s1][odd])
    return out


def points_in_regions(points: DataFrame, id: str, lat: str, lon: str, regions: DataFrame, region: str = "region_id", ring: str = "ring", tile_deg: float = 1.0, max_corners: int = 200_000, fine_tiles: int = 8, tile_points: int = 200_000) -> DataFrame:
    """(``id``, ``region``) for every point inside a region.

    ``ring`` is an array of structs (lng, lat), not closed, not crossing the
    180th meridian (split it there). A region holds its western and southern
    edges and not the others. Null or NaN positions lie in no region; null or
    short rings hold no point; overlapping regions each give a row; repeated
    points give repeated rows; empty tables give no rows. Both sides meet in
    tiles of ``tile_deg``; the points of a tile stream through the sweep in
    Arrow batches. Regions are sent to the tasks if they have at most
    ``max_corners`` corners, counted once per tile; else both meet in tiles of
    an eighth (``fine_tiles``) of that width, and the points of a tile with more than
    ``tile_points`` are spread over several tasks.
    """
    r = regions.where(F.size(ring) >= 3).select(F.col(region).alias("_r"), F.col(ring).alias("_ring"))
    edge = lambda f, c: F.floor(f(F.transform("_ring", lambda p: p[c])) / tile_deg).cast("int")
    r = r.withColumn("_ty", F.explode(F.sequence(edge(F.array_min, "lat"), edge(F.array_max, "lat"))))
    r = r.withColumn("_tx", F.explode(F.sequence(edge(F.array_min, "lng"), edge(F.array_max, "lng"))))
    kinds = dict(points.dtypes)[id], dict(regions.dtypes)[region]
    shape = f"`{id}` {kinds[0]}, `{region}` {kinds[1]}"
    p = points.select(F.col(id), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).where("_lat is not null and _lon is not null and not isnan(_lat) and not isnan(_lon)")
    corners = r.agg(F.sum(F.size("_ring"))).first()[0] or 0

    def inside(pdf: pd.DataFrame, rings: list) -> Iterator[pd.DataFrame]:
        x, y, ids = pdf["_lon"].to_numpy(), pdf["_lat"].to_numpy(), pdf[id].to_numpy()
        for (name, _), got in zip(rings, sweep_regions(x, y, [xy for _, xy in rings])):
            if len(got):
                yield pd.DataFrame({id: ids[got], region: name})

    if corners <= max_corners:  # counted: the regions go to the tasks once, and only points travel
        at: dict[tuple, list] = {}
        for row in r.collect():
            at.setdefault((row["_ty"], row["_tx"]), []).append((row["_r"], np.array([(q["lng"], q["lat"]) for q in row["_ring"]], float)))
        side = points.sparkSession.sparkContext.broadcast(at)

        def sweep_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tiles = side.value
            for pdf in batches:
                ty, tx = np.floor(pdf["_lat"] / tile_deg).astype(int), np.floor(pdf["_lon"] / tile_deg).astype(int)
                for tile, g in pdf.groupby([ty, tx], sort=False):
                    if tile in tiles:
                        yield from inside(g, tiles[tile])

        return p.mapInPandas(sweep_all, shape)
    # Many regions: finer tiles, and the points of a full tile in several tasks, each of which gets the tile's rings once.
    fine = tile_deg / fine_tiles
    edge = lambda f, c: F.floor(f(F.transform("_ring", lambda p: p[c])) / fine).cast("int")
    r = regions.where(F.size(ring) >= 3).select(F.col(region).alias("_r"), F.col(ring).alias("_ring"))
    r = r.withColumn("_ty", F.explode(F.sequence(edge(F.array_min, "lat"), edge(F.array_max, "lat"))))
    r = r.withColumn("_tx", F.explode(F.sequence(edge(F.array_min, "lng"), edge(F.array_max, "lng"))))
    p = p.withColumn("_ty", F.floor(F.col("_lat") / fine).cast("int")).withColumn("_tx", F.floor(F.col("_lon") / fine).cast("int"))
    full = broadcast_if_small(p.groupBy("_ty", "_tx").agg(F.ceil(F.count(F.lit(1)) / tile_points).cast("int").alias("_n")).where("_n > 1"))
    key = ["_ty", "_tx", "_s"]
    p = p.join(full, ["_ty", "_tx"], "left").withColumn("_s", F.pmod(F.xxhash64(id, "_lat", "_lon"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    r = r.join(full, ["_ty", "_tx"], "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")

    def sweep(pts: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
        got = list(inside(pts, [(n, np.array([(q["lng"], q["lat"]) for q in xy], float)) for n, xy in zip(rings["_r"], rings["_ring"])])) if len(pts) else []
        return pd.concat(got, ignore_index=True) if got else pd.DataFrame({id: pts[id].iloc[:0], region: rings["_r"].iloc[:0]})

    return p.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(sweep, shape)
