"""What the service answers, as DataFrames rounded to the published precision.

Operators return unrounded numbers; rounding happens here, once. Series rows
carry what the value is (`variable`, `quantity`, `units`) beside the numbers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain as dm
from ..domain import GLOBAL, Grid, Region, require_inside, variable
from ..functions.grid import lat_of, lon_of
from ..functions.wording import extent_word
from ..operators import events, ranking, regions, rollup, series, state
from ..operators.series import SCALE, daily_values
from ..schema import Archive

AREA_PLACES = 3


def _labelled(df: DataFrame, name: str, *, region: bool) -> DataFrame:
    quantity = dm.series_quantity(name, region=region)
    return df.withColumns({
        "variable": F.lit(name),
        "quantity": F.lit(quantity).cast("string"),
        "units": F.lit(dm.series_units(name, region=region)),
    })


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names if n in df.columns})


def point_timeseries(
    archive: Archive, lat: float, lon: float, name: str = "sst", period: str = "daily",
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Series of the nearest cell, with the cell and its centre on every row."""
    out = series.point_series(archive, lat, lon, name, period, start, end)
    out = _rounded(out, variable(name).precision, "value", "clim")
    out = out.withColumn("lat", lat_of("gy")).withColumn("lon", lon_of("gx"))
    if name == "sst":
        out = out.withColumn("clim_baseline", F.lit(variable("anom").baseline.period))
    return _labelled(out, name, region=False)


def point_events(
    archive: Archive, lat: float, lon: float, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Runs at a cell in one row: the one in progress, the longest, and totals."""
    require_inside(lat, lon)
    cell = (GLOBAL.row(lat), GLOBAL.col(lon))
    cut = lambda df: series.date_range(series.at_cell(df, cell), start, end)
    return events.run_summary(events.event_runs(cut(archive.mhw)), cut(archive.sst))


def box_timeseries(
    archive: Archive, lat: tuple[float, float], lon: tuple[float, float], name: str = "sst", period: str = "daily",
    start: dt.date | None = None, end: dt.date | None = None, *, grid: Grid = GLOBAL,
) -> DataFrame:
    """Area series of any box, aggregated from the cells."""
    out = rollup.box_series(archive, grid.box(lat, lon), name, period, start, end, grid=grid)
    return _labelled(_rounded(out, AREA_PLACES, "value"), name, region=True)


def region_timeseries(
    region_daily: DataFrame, region_clim: DataFrame, key: str, name: str = "sst", period: str = "daily",
    start: dt.date | None = None, end: dt.date | None = None, *, known: dict[str, Region] | None = None,
) -> DataFrame:
    """Area series of a named region, read from the rollups."""
    region = _named(key, known)
    out = rollup.region_series(region_daily, region_clim, name, period, start, end, region=key)
    out = out.withColumns({"label": F.lit(region.label), "partial": F.lit(region.partial)})
    return _labelled(_rounded(out, AREA_PLACES, "value"), name, region=True)


def _named(key: str, known: dict[str, Region] | None) -> Region:
    known = dm.REGIONS if known is None else known
    if key not in known:
        raise KeyError(f"unknown region {key!r}; expected one of {sorted(known)}")
    return known[key]


def region_geometry(spark: SparkSession, key: str, known: dict[str, Region] | None = None) -> DataFrame:
    """(region, ring, points) of a polygon region; a box has no outline to give."""
    region = _named(key, known)
    if not region.masked:
        raise ValueError(f"region {key!r} is a box; its bounds say everything")
    return regions.rings_of(spark, [region])


def _ranking(df: DataFrame, name: str, *, region: bool) -> DataFrame:
    base = variable(name).baseline
    departs_from = base.period if base is not None and base.statistic == "mean" else None
    out = _rounded(df, AREA_PLACES, "mean", "sd").withColumn("clim_baseline", F.lit(departs_from).cast("string"))
    return _labelled(out, name, region=region)


def point_ranking(
    archive: Archive, lat: float, lon: float, name: str = "anom", top: int = 10, *, edges: DataFrame
) -> DataFrame:
    """Years at the nearest cell ranked within each month, and as a whole.

    `edges` are the archive's first and last day: `Store.edges` has them off the
    status table, without a scan.

    Classes are averaged here, unlike in a series: ranked by their maximum, most
    years would tie.
    """
    require_inside(lat, lon)
    days = daily_values(archive, name, cell=(GLOBAL.row(lat), GLOBAL.col(lon)), normal=False)
    days = days.select("date", F.col("raw").alias("value"))
    return _ranking(ranking.ranked_periods(days, edges, scale=SCALE[name], top=top), name, region=False)


def region_ranking(
    archive: Archive, region_daily: DataFrame, region_clim: DataFrame, key: str, name: str = "anom", top: int = 10,
    *, known: dict[str, Region] | None = None, edges: DataFrame,
) -> DataFrame:
    """The same over a region's daily area means. The archive's edges, and so the
    partial flags, are those of the daily table here as well."""
    _named(key, known)
    only = lambda df: df.filter(F.col("region") == key)
    days = rollup.region_values(only(region_daily), only(region_clim), name)
    return _ranking(ranking.ranked_periods(days, edges, ["region"], top=top), name, region=True)


def index_report(region_daily: DataFrame, region_clim: DataFrame, region: str = dm.INDEX_REGION) -> DataFrame:
    """Phase of the index region. Not an official index: one fixed baseline."""
    only = lambda df: df.filter(F.col("region") == region)
    out = state.index_state(only(region_daily), only(region_clim))
    return _rounded(out, 2, "index", "latest_value").withColumns({
        "threshold": F.lit(state.INDEX_THRESHOLD), "baseline": F.lit(variable("anom").baseline.period),
        "official": F.lit(False),
    })


def extent_report(region_daily: DataFrame, region: str = dm.BASIN_REGION) -> DataFrame:
    """Latest heatwave extent of the basin against the time of the year."""
    out = state.extent_state(region_daily.filter(F.col("region") == region))
    return _rounded(out, 1, "extent", "normal", "ratio").withColumns({
        "wording": extent_word("ratio"), "baseline": F.lit(variable("anom").baseline.period),
        "window_days": F.lit(state.NORMAL_WINDOW_DAYS),
    })


def named_value(current: DataFrame, spark: SparkSession) -> DataFrame:
    """Add the class name of a whole heatwave value: 0 has one, a mean has none."""
    labels = dm.classes_table(spark).filter("variable = 'mhw'").select(
        F.col("value").cast("double").alias("value"), "label"
    )
    named = current.join(F.broadcast(labels), "value", "left")  # five rows
    return named.withColumn("label", F.when(F.col("value") == 0, "no heatwave").otherwise(F.col("label")))

