"""Cell ids of two systems: H3, and a built-in latitude/longitude quadtree.

Both share the id layout of a mode nibble (bits 59-62), a resolution nibble
(bits 52-55) and the position below, but bear different modes, so that ids of
the two systems can be told apart. Functions of positions take ``system``,
``grid`` (column expressions, never leaving the JVM) or ``h3`` (see ``h3``, in
Arrow batches); an id of the other system raises an error. Bit operations
(resolution, parent, texts) tell the systems apart by themselves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import h3

H3_MODE = 1
GRID_MODE = 9
#: The quadtree at resolution r has 2 ** (r + 6) cells around the equator.
_EXTRA = 6


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(_long(15)).cast("int")


def mode(cell: Column) -> Column:
    return F.shiftright(cell, 59).bitwiseAND(_long(15)).cast("int")


def to_hex(cell: Column) -> Column:
    """Lower-case hexadecimal text of an id."""
    return F.lower(F.hex(cell))


def from_hex(text: Column) -> Column:
    """Id of a hexadecimal text; null where it is not one."""
    return F.when(text.rlike("^[0-7]?[0-9a-fA-F]{1,15}$"), F.conv(text, 16, 10).try_cast("bigint"))


def h3_parent(cell: Column, res: int) -> Column:
    """Parent at ``res`` of an H3 id: the resolution replaced and the finer digits set. Null for a coarser cell or another mode."""
    fine = (1 << (3 * (15 - res))) - 1
    got = cell.bitwiseAND(_long(~(15 << 52))).bitwiseOR(_long((res << 52) | fine))
    return F.when((mode(cell) == H3_MODE) & (resolution(cell) >= res), got)


def _base(res: int) -> Column:
    return _long((GRID_MODE << 59) | (res << 52))


def _grid_cell(lat: Column, lon: Column, res: int) -> Column:
    n = 1 << (res + _EXTRA)
    x = F.least(F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(n))).cast("bigint"), _long(n - 1))
    y = F.least(F.floor((lat + F.lit(90.0)) / F.lit(180.0) * F.lit(float(n))).cast("bigint"), _long(n - 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.shiftleft(y, res + _EXTRA).bitwiseOR(x).bitwiseOR(_base(res)))


def _parts(cell: Column) -> tuple[Column, Column, Column]:
    cell = F.when(cell.isNull() | (mode(cell) == GRID_MODE), cell).otherwise(F.raise_error(F.concat(F.lit("no cell of the built-in grid: "), cell.cast("string"))).cast("bigint"))
    n = F.pow(F.lit(2.0), resolution(cell) + _EXTRA).cast("bigint")
    pos = cell.bitwiseAND(_long((1 << 52) - 1))
    x = F.pmod(pos, n)
    return x, ((pos - x) / n).cast("bigint"), n


def _grid_parent(cell: Column, res: int) -> Column:
    x, y, _ = _parts(F.when(mode(cell) == GRID_MODE, cell))
    up = F.pow(F.lit(2.0), resolution(cell) - res)
    got = F.shiftleft(F.floor(y / up).cast("bigint"), res + _EXTRA).bitwiseOR(F.floor(x / up).cast("bigint")).bitwiseOR(_base(res))
    return F.when(resolution(cell) >= res, got)


def parent(cell: Column, res: int) -> Column:
    """Parent at ``res`` in the cell's own system; null for a coarser cell and for null, an error for what is no cell of either."""
    none = F.raise_error(F.concat(F.lit("no cell: "), cell.cast("string"))).cast("bigint")
    return F.when(mode(cell) == GRID_MODE, _grid_parent(cell, res)).when(mode(cell) == H3_MODE, h3_parent(cell, res)).when(cell.isNotNull(), none)


def _corner(cell: Column, dx: float, dy: float) -> tuple[Column, Column]:
    x, y, n = _parts(cell)
    return (y + F.lit(dy)) / n * F.lit(180.0) - F.lit(90.0), (x + F.lit(dx)) / n * F.lit(360.0) - F.lit(180.0)


def _is_h3(system: str) -> bool:
    if system not in ("grid", "h3"):
        raise ValueError(f"cell system: {system}")
    return system == "h3"


def _h3_ids(cell: pd.Series):
    """Ids of a batch; 0 stands for null. What is no H3 cell raises an error."""
    ids = cell.to_numpy("int64")
    bad = (ids != 0) & ~h3.valid(ids)
    if bad.any():
        raise ValueError(f"no H3 cell: {ids[bad][0]:x}")
    return ids


def latlng_to_cell(lat: Column, lon: Column, res: int, system: str = "grid") -> Column:
    """Cell of a position at resolution 0..15; null where the position is."""
    if not _is_h3(system):
        return _grid_cell(lat, lon, res)

    @F.pandas_udf("bigint")
    def ids(a: pd.Series, b: pd.Series) -> pd.Series:
        got = h3.latlng_to_cell(a, b, res)
        return pd.Series(pd.arrays.IntegerArray(got, got == 0))

    return ids(lat.cast("double"), lon.cast("double"))


def cell_to_latlng(cell: Column, system: str = "grid") -> Column:
    """Centre of a cell as struct(lat, lng)."""
    if _is_h3(system):

        @F.pandas_udf("lat double, lng double")
        def centre(c: pd.Series) -> pd.DataFrame:
            lat, lng = h3.cell_to_latlng(_h3_ids(c))
            return pd.DataFrame({"lat": lat, "lng": lng})

        return centre(F.coalesce(cell, _long(0)))
    lat, lng = _corner(cell, 0.5, 0.5)
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def cell_to_boundary(cell: Column, system: str = "grid") -> Column:
    """Corners of a cell, counter-clockwise (on the grid from the south-west), as array of struct(lng, lat)."""
    if _is_h3(system):

        @F.pandas_udf("array<struct<lng:double,lat:double>>")
        def corners(c: pd.Series) -> pd.Series:
            return pd.Series([[{"lng": lng, "lat": lat} for lat, lng in b] if b else None for b in h3.cell_to_boundary(_h3_ids(c))])

        return corners(F.coalesce(cell, _long(0)))
    at = []
    for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)):
        lat, lng = _corner(cell, float(dx), float(dy))
        at.append(F.struct(lng.alias("lng"), lat.alias("lat")))
    return F.array(*at)


def first_vertex(cell: Column, system: str = "grid") -> Column:
    """The first corner as struct(lat, lng): what some pipelines use for a cell's position."""
    if _is_h3(system):
        at = F.get(cell_to_boundary(cell, system), F.lit(0))
        return F.struct(at["lat"].alias("lat"), at["lng"].alias("lng"))
    lat, lng = _corner(cell, 0.0, 0.0)
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def system_of(df: DataFrame, cell: str) -> str:
    """The system of the first id in the column (bigint or hexadecimal text), ``grid`` where there is none. Meant for tables that are written: it reads as far as that id."""
    x = from_hex(F.col(cell)) if dict(df.dtypes)[cell] == "string" else F.col(cell)
    got = df.select(mode(x).alias("m")).where("m is not null").limit(1).collect()
    return "h3" if got and got[0][0] == H3_MODE else "grid"
