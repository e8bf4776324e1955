"""Per-cell series: the value of a variable by day, week or month.

`sst` and `anom` average the days of a bucket, the heatwave class takes their
maximum. Integer counts are summed and scaled once, so the result does not
depend on the order in which partitions are merged.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import GLOBAL, PACIFIC, Grid, Subset, require_inside, variable
from ..functions.calendar import bucket_start, climatology_of, date_range, mmdd, months_between
from ..functions.grid import block_at, lat_of, lon_of
from ..schema import Archive

CELL = ["gy", "gx"]
SCALE = {name: variable(name).scale for name in ("sst", "anom", "mhw")}


def with_derived(daily: DataFrame, grid: Grid = GLOBAL) -> DataFrame:
    """Stored counts plus the computed columns `sst` (or `clim`), `lat`, `lon`."""
    for raw, name in (("sst_raw", "sst"), ("clim_raw", "clim")):
        if raw in daily.columns:
            daily = daily.withColumn(name, F.col(raw) * F.lit(0.01))
    return daily.withColumn("lat", lat_of("gy", grid)).withColumn("lon", lon_of("gx", grid))


def cell_keys(*tables: DataFrame) -> list[str]:
    """What names a cell in all these tables. Stored ones carry its block, by which they are bucketed: joins and
    groupings that name it too find their rows in place."""
    return ["block", *CELL] if all("block" in t.columns for t in tables) else CELL


def at_cell(table: DataFrame, cell: tuple[int, int] | None) -> DataFrame:
    """Indices as literals, so that the scan can skip row groups, and buckets where the table has blocks."""
    if cell is None:
        return table
    table = table.filter((F.col("gy") == cell[0]) & (F.col("gx") == cell[1]))
    return table.filter(F.col("block") == block_at(cell)) if "block" in table.columns else table


def _climatology(clim: DataFrame, keys: list[str], cell: tuple[int, int] | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    months = months_between(start, end) if start and end and start <= end else None
    side = at_cell(climatology_of(clim, months), cell).select(*keys, "mmdd", "clim_raw")
    # one cell: at most 366 rows by the table's key
    return side if cell is None else F.broadcast(side)


def daily_values(
    archive: Archive,
    name: str,
    *,
    cell: tuple[int, int] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    normal: bool = True,
) -> DataFrame:
    """([block,] gy, gx, date, raw[, clim_raw]): one row per cell and day, in counts.

    `sst` comes with its normal where that is asked for, NULL on days without a
    climatology; `anom` drops these days. `mhw` is stored sparsely, and the days absent from it are 0 wherever
    the daily table shows ocean.
    """
    variable(name)
    days = date_range(at_cell(archive.sst, cell), start, end)
    if name == "mhw":
        keys = cell_keys(archive.sst, archive.mhw)
        hits = date_range(at_cell(archive.mhw, cell), start, end).select(*keys, "date", "cat")
        return (
            days.select(*keys, "date")
            .join(hits, [*keys, "date"], "left")
            .select(*keys, "date", F.coalesce(F.col("cat").cast("long"), F.lit(0).cast("long")).alias("raw"))
        )
    keys = cell_keys(archive.sst) if name == "sst" and not normal else cell_keys(archive.sst, archive.clim)
    days = days.select(*keys, "date", mmdd("date").alias("mmdd"), F.col("sst_raw").cast("long").alias("raw"))
    if name == "sst" and not normal:
        return days.drop("mmdd")
    how = "left" if name == "sst" else "inner"
    joined = days.join(_climatology(archive.clim, keys, cell, start, end), [*keys, "mmdd"], how)
    if name == "sst":
        return joined.select(*keys, "date", "raw", F.col("clim_raw").cast("long").alias("clim_raw"))
    return joined.select(*keys, "date", (F.col("raw") - F.col("clim_raw")).alias("raw"))


def scaled_mean(raw, scale: float) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.sum(raw).cast("double") / F.count(raw) * F.lit(scale)


def cell_series(
    archive: Archive,
    name: str,
    period: str = "daily",
    *,
    cell: tuple[int, int] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """(gy, gx, bucket, value, n_days[, clim]) for one cell, or for every cell.

    With `sst`, `clim` is the bucket's normal. It is NULL as soon as one of the
    bucket's days has none, so that value and normal always cover the same days.
    """
    days = daily_values(archive, name, cell=cell, start=start, end=end)
    groups = days.groupBy(*cell_keys(days), bucket_start("date", period).alias("bucket"))
    n_days = F.count(F.lit(1)).alias("n_days")
    if name == "mhw":
        return groups.agg(F.max("raw").cast("double").alias("value"), n_days).drop("block")
    value = scaled_mean("raw", SCALE[name]).alias("value")
    if name == "anom":
        return groups.agg(value, n_days).drop("block")
    complete = F.count("clim_raw") == F.count(F.lit(1))
    return groups.agg(value, n_days, F.when(complete, scaled_mean("clim_raw", SCALE["sst"])).alias("clim")).drop("block")


def point_series(
    archive: Archive,
    lat: float,
    lon: float,
    name: str = "sst",
    period: str = "daily",
    start: dt.date | None = None,
    end: dt.date | None = None,
    *,
    grid: Grid = GLOBAL,
    subset: Subset = PACIFIC,
) -> DataFrame:
    """Series of the cell nearest to a point. Raises outside the loaded subset."""
    require_inside(lat, lon, subset)
    return cell_series(archive, name, period, cell=(grid.row(lat), grid.col(lon)), start=start, end=end)
