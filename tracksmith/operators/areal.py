"""Polygons covered by cells, and population interpolated by area."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells, h3
from .spatial import sweep_regions

# Axis and flattening of GRS 80; standard parallels, origin of the California Albers projection.
_A, _F = 6_378_137.0, 1 / 298.257222101
ALBERS = (34.0, 40.5, 0.0, -120.0)


def albers(lng, lat, p1: float = ALBERS[0], p2: float = ALBERS[1], lat0: float = ALBERS[2], lng0: float = ALBERS[3]) -> np.ndarray:
    """Equal-area conic projection of the ellipsoid (Snyder 1987), metres, without false origin."""
    e2 = _F * (2 - _F)
    e = np.sqrt(e2)

    def q(p):
        s = np.sin(p)
        return (1 - e2) * (s / (1 - e2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(p):
        return np.cos(p) / np.sqrt(1 - e2 * np.sin(p) ** 2)

    a, b, c = np.radians([p1, p2, lat0])
    n = (m(a) ** 2 - m(b) ** 2) / (q(b) - q(a)) if a != b else np.sin(a)
    k = m(a) ** 2 + n * q(a)
    rho = lambda p: _A * np.sqrt(np.maximum(k - n * q(p), 0)) / n
    th = n * np.radians(np.asarray(lng, float) - lng0)
    r = rho(np.radians(np.asarray(lat, float)))
    return np.column_stack([r * np.sin(th), rho(c) - r * np.cos(th)])


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def clip(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one given counter-clockwise (Sutherland-Hodgman)."""
    out = [tuple(p) for p in ring]
    for (ax, ay), (bx, by) in zip(convex, np.roll(convex, -1, axis=0)):
        if not out:
            break
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        new = []
        for i, (p, s) in enumerate(zip(out, side)):
            q, t = out[i - 1], side[i - 1]
            if (s >= 0) != (t >= 0):
                u = t / (t - s)
                new.append((q[0] + u * (p[0] - q[0]), q[1] + u * (p[1] - q[1])))
            if s >= 0:
                new.append(p)
        out = new
    return np.array(out, float).reshape(-1, 2)


_CORNERS = "array<struct<lng:double,lat:double>>"


def polygon_cells(polygons: DataFrame, res: int, id: str = "region_id", ring: str = "ring", system: str = "grid") -> DataFrame:
    """(id, cell): cells whose centre lies in the polygon (even-odd; one row of ``polygons`` per ring).

    A polygon's bounding box is enumerated row of cells by row of cells, in
    Arrow batches, never as one array.
    """
    kind = dict(polygons.dtypes)[id]
    if system == "h3":
        return _polygon_h3(polygons, res, id, ring, kind)
    n = 1 << (res + 6)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, r in zip(pdf[id], pdf[ring]):
                if r is None or len(r) < 3:
                    continue
                xy = np.array([(p["lng"], p["lat"]) for p in r], float)
                x0, x1 = (np.floor((xy[:, 0].min() + 180) / 360 * n), np.floor((xy[:, 0].max() + 180) / 360 * n))
                y0, y1 = (np.floor((xy[:, 1].min() + 90) / 180 * n), np.floor((xy[:, 1].max() + 90) / 180 * n))
                gx = np.arange(int(x0), int(min(x1, n - 1)) + 1)
                lng = (gx + 0.5) / n * 360 - 180
                for gy in range(int(y0), int(min(y1, n - 1)) + 1):
                    inside = sweep_regions(lng, np.full(len(gx), (gy + 0.5) / n * 180 - 90), [xy])[0]
                    if len(inside):
                        yield pd.DataFrame({id: i, "_x": gx[np.sort(inside)], "_y": gy})

    d = polygons.select(id, F.col(ring).cast(_CORNERS).alias(ring)).mapInPandas(rows, f"`{id}` {kind}, _x bigint, _y bigint")
    base = F.lit((cells.GRID_MODE << 59) | (res << 52)).cast("bigint")
    return d.select(id, F.shiftleft("_y", res + 6).bitwiseOR(F.col("_x")).bitwiseOR(base).alias("cell")).distinct()


def _polygon_h3(polygons: DataFrame, res: int, id: str, ring: str, kind: str) -> DataFrame:
    """The bounding box is sounded row by row, closer than a cell is wide; of the cells met, those whose centre lies inside are kept."""
    step = np.degrees(0.3 * h3.least_width(res))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, r in zip(pdf[id], pdf[ring]):
                if r is None or len(r) < 3:
                    continue
                xy = np.array([(p["lng"], p["lat"]) for p in r], float)
                (x0, y0), (x1, y1) = xy.min(0), xy.max(0)
                for lat in np.arange(y0, y1 + step, step):
                    wide = step / max(np.cos(np.radians(min(abs(lat) + step, 89.0))), 0.01)
                    lng = np.arange(x0, x1 + wide, wide)
                    met = np.unique(h3.latlng_to_cell(np.full(len(lng), min(lat, 90.0)), (lng + 180) % 360 - 180, res))
                    la, lo = h3.cell_to_latlng(met)
                    inside = sweep_regions(lo, la, [xy])[0]
                    if len(inside):
                        yield pd.DataFrame({id: i, "cell": met[inside]})

    return polygons.select(id, F.col(ring).cast(_CORNERS).alias(ring)).mapInPandas(rows, f"`{id}` {kind}, cell bigint").distinct()


def read_geojson(lines: DataFrame, id: str = "region_id", text: str = "value", properties: tuple[str, ...] = ()) -> DataFrame:
    """(id, part, hole, ring, and numeric ``properties``): one row per ring of the polygons and multipolygons in ``text``, which holds a GeoJSON feature or geometry a row, under the row's ``id``.

    Rings are closed in the text and open here. Null, other geometries and what
    is no JSON give no rows; a missing property is null. Tables of several
    counties are united before.
    """
    kind = dict(lines.dtypes)[id]
    shape = f"`{id}` {kind}, part int, hole boolean, ring {_CORNERS}" + "".join(f", `{p}` double" for p in properties)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf[id], pdf[text]):
                try:
                    g = json.loads(t) if t else {}
                    more = g.get("properties") or {}
                    g = g.get("geometry") or g
                    parts = {"Polygon": lambda c: [c], "MultiPolygon": list}.get(g.get("type"), lambda c: [])(g.get("coordinates"))
                    extra = [float(more[p]) if isinstance(more.get(p), (int, float)) else None for p in properties]
                    for n, part in enumerate(parts):
                        for k, ring in enumerate(part):
                            ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
                            out.append((i, n, k > 0, [{"lng": float(p[0]), "lat": float(p[1])} for p in ring], *extra))
                except (ValueError, TypeError, AttributeError, IndexError):
                    continue
            yield pd.DataFrame(out, columns=[id, "part", "hole", "ring", *properties])

    return lines.select(id, text).mapInPandas(rows, shape)


def with_holes(regions: DataFrame, outer: DataFrame, holes: DataFrame, id: str = "region_id") -> DataFrame:
    """(id, cell) of regions of several parts and with holes: the cells of the ``outer`` rings less those of the ``holes`` of the same region (both as :func:`polygon_cells` gives them). ``regions``: id."""
    some = outer.join(regions.select(id), id, "left_semi").distinct()
    return some.join(holes.select(id, "cell"), [id, "cell"], "left_anti")


def areal_population(cells_: DataFrame, tracts: DataFrame, tile_deg: float = 0.5, system: str = "grid") -> DataFrame:
    """(cell, population): each tract's population shared by the area of its parts in the cells; cells that meet no tract are left out.

    ``cells_``: cell; ``tracts``: tract_id, ring, population. Both meet in tiles
    by bounding box; the exact parts are cut and measured in an equal-area
    projection. A cell that meets a tract in several tiles counts once.
    """
    def tiles(d: DataFrame, r: str) -> DataFrame:
        lo = lambda f, c: F.floor(f(F.transform(r, lambda p: p[c])) / tile_deg).cast("int")
        d = d.withColumn("_ty", F.explode(F.sequence(lo(F.array_min, "lat"), lo(F.array_max, "lat"))))
        return d.withColumn("_tx", F.explode(F.sequence(lo(F.array_min, "lng"), lo(F.array_max, "lng"))))

    c = tiles(cells_.where("cell is not null").select("cell").distinct().withColumn("_b", cells.cell_to_boundary(F.col("cell"), system)), "_b")
    t = tiles(tracts.where("ring is not null and size(ring) >= 3").select("tract_id", F.col("ring").cast(_CORNERS).alias("ring"), F.col("population").cast("double").alias("population")), "ring")
    d = c.join(t, ["_ty", "_tx"]).dropDuplicates(["cell", "tract_id"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cell, b, r, pop in zip(pdf["cell"], pdf["_b"], pdf["ring"], pdf["population"]):
                hexa, whole = (albers([p["lng"] for p in x], [p["lat"] for p in x]) for x in (b, r))
                total = area(whole)
                part = area(clip(whole, hexa)) if total else 0.0
                if part > 0:
                    out.append((cell, pop * part / total if pop == pop else 0.0))
            yield pd.DataFrame(out, columns=["cell", "population"])

    d = d.select("cell", "_b", "ring", "population").mapInPandas(cut, "cell bigint, population double")
    return d.groupBy("cell").agg(F.sum("population").alias("population"))
