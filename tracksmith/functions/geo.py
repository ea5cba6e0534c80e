"""Distances and coordinates as Column expressions, with NumPy twins for Arrow code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in metres: mean radius used by stop detection, and the rounded one used by OD and plot distances.
R_MEAN_M = 6_371_008.0
R_ROUND_M = 6_371_000.0


def haversine(lat1, lon1, lat2, lon2, radius: float = R_MEAN_M) -> Column:
    """Great-circle distance in the unit of ``radius``; null when an input is null."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dl = F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(F.least(a, F.lit(1.0))), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def haversine_asin(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    """The arcsine form, kilometres by default."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dl = F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def np_haversine(lat1, lon1, lat2, lon2, radius: float = R_MEAN_M):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2.0 * radius * np.arctan2(np.sqrt(np.minimum(a, 1.0)), np.sqrt(np.maximum(1.0 - a, 0.0)))


def np_unit_vectors(lat, lon) -> np.ndarray:
    """n x 3 unit vectors; the chord of an arc d on radius R is 2 sin(d / 2R)."""
    p, q = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    return np.column_stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])


def chord(metres: float, radius: float = R_MEAN_M) -> float:
    return 2.0 * np.sin(metres / (2.0 * radius))


def valid_position(lat, lon) -> Column:
    """Present, finite, in range and not the (0, 0) of a device without a fix."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    la, lo = c(lat), c(lon)
    ok = ~F.isnan(la) & ~F.isnan(lo) & la.between(-90.0, 90.0) & lo.between(-180.0, 180.0) & ~((la == 0.0) & (lo == 0.0))
    return F.coalesce(ok, F.lit(False))


def np_geodesic_km(lat1, lon1, lat2, lon2, iterations: int = 60) -> np.ndarray:
    """Vincenty's inverse formula on WGS-84 (vectorised); pairs that do not converge fall back to the sphere."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b = (1 - f) * a
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2, ell = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = ell.copy()
    with np.errstate(all="ignore"):
        for _ in range(iterations):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sig = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            c2 = 1 - sa**2
            cm = np.where(c2 == 0, 0.0, cs - 2 * su1 * su2 / c2)
            cc = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            new = ell + (1 - cc) * f * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(done | np.isnan(lam)):
                break
        usq = c2 * (a * a - b * b) / (b * b)
        aa = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
        bb = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
        ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm**2 - 1) - bb / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        km = b * aa * (sig - ds) / 1000
    sphere = np_haversine(np.degrees(lat1), np.degrees(lon1), np.degrees(lat2), np.degrees(lon2)) / 1000
    return np.where(done & np.isfinite(km), km, np.where(ss == 0, 0.0, sphere))
