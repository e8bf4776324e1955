"""Degrees to cell indices and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import GLOBAL, PACIFIC, Box, Grid, Subset, half_step


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gy_of(lat, grid: Grid = GLOBAL) -> Column:
    return F.rint((_col(lat) - F.lit(grid.lat0)) / F.lit(grid.resolution)).cast("int")


def gx_of(lon, grid: Grid = GLOBAL) -> Column:
    turn = F.pmod(_col(lon) - F.lit(grid.lon0), F.lit(360.0))
    return F.rint(turn / F.lit(grid.resolution)).cast("int") % grid.nlon


def lat_of(gy, grid: Grid = GLOBAL) -> Column:
    return F.lit(grid.lat0) + _col(gy) * F.lit(grid.resolution)


def lon_of(gx, grid: Grid = GLOBAL) -> Column:
    return F.lit(grid.lon0) + _col(gx) * F.lit(grid.resolution)


def area_weight(gy, grid: Grid = GLOBAL) -> Column:
    """Relative area of a cell: the cosine of its latitude."""
    return F.cos(F.radians(lat_of(gy, grid)))


# Area weights in whole units of 2^-46, cut in two so that sums over a day's cells stay within longs.
UNIT_BITS = 23


def weight_units(weight) -> tuple[Column, Column]:
    """(high, low): the weight is (high * 2^23 + low) / 2^46."""
    units = F.round(_col(weight) * F.lit(float(1 << 2 * UNIT_BITS))).cast("long")
    return F.shiftright(units, UNIT_BITS), units.bitwiseAND(F.lit((1 << UNIT_BITS) - 1).cast("long"))


TILE = 32  # rows and columns of a block of cells
TILES_IN_ROW = 1024


def block_at(cell: tuple[int, int]) -> int:
    return cell[0] // TILE * TILES_IN_ROW + cell[1] // TILE


def block_of(gy="gy", gx="gx") -> Column:
    """The square block a cell lies in: one number, by which stored tables are dealt into buckets."""
    return F.expr(f"{gy} div {TILE} * {TILES_IN_ROW} + {gx} div {TILE}").cast("int")


def signed_lon(lon) -> Column:
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0


def inside(lat, lon, subset: Subset = PACIFIC) -> Column:
    """The column form of domain.in_subset."""
    margin = half_step(subset)
    east = F.pmod(_col(lon) - F.lit(subset.lon[0]), F.lit(360.0))
    return _col(lat).between(subset.lat[0] - margin, subset.lat[1] + margin) & (east <= subset.lon[1] - subset.lon[0] + margin)


def in_box(box: Box, gy="gy", gx="gx") -> Column:
    return _col(gy).between(box.gy0, box.gy1) & _col(gx).between(box.gx0, box.gx1)
