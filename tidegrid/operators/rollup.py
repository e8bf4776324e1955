"""Area means over boxes and regions, weighted by the cosine of the latitude.

Weights are whole units of 2^-46, so that weighted sums are sums of whole
numbers: exact, the same for every partitioning, and additive. What a batch adds
to a region's day is therefore a small row of parts (schema.REGION_PARTS), and
means are taken off the parts at the end.

An area anomaly never joins days with the climatology cell by cell: over the
same cells with the same weights mean(sst - clim) = mean(sst) - mean(clim). The
daily side therefore keeps a second mean restricted to cells with a climatology.

The heatwave table is sparse. Instead of joining it to the daily table, both are
read as one stream of facts and aggregated together: the daily rows supply the
denominator, the sparse rows the numerator, and a day without events is a 0.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import GLOBAL, Box, Grid, series_quantity, variable
from ..functions.calendar import bucket_start, date_range, mmdd
from ..functions.grid import UNIT_BITS, area_weight, in_box, weight_units
from ..schema import REGION_PARTS, Archive
from .regions import RegionRows, assign_regions, for_all_regions

COUNT = 0.01  # degrees per stored count
PERCENT = 100.0


def _facts(archive: Archive, start=None, end=None) -> DataFrame:
    days = date_range(archive.sst, start, end).select(
        "date", "gy", "gx", F.col("sst_raw").cast("long").alias("sst_raw"),
        F.col("has_clim").cast("boolean").alias("has_clim"), F.lit(None).cast("int").alias("cat"),
    )
    if archive.mhw is None:
        return days
    hits = date_range(archive.mhw, start, end).select(
        "date", "gy", "gx", F.lit(None).cast("long").alias("sst_raw"),
        F.lit(None).cast("boolean").alias("has_clim"), F.col("cat").cast("int").alias("cat"),
    )
    return days.unionByName(hits)


PARTS = [f.split()[0] for f in REGION_PARTS.split(", ")][3:]


def _sums(name: str, value: Column, when: Column) -> list[Column]:
    """Exact weighted sums `name`_hi and `name`_lo of a whole number; null where there is none."""
    return [F.sum(F.when(when, value * F.col(w))).alias(f"{name}_{w[-2:]}") for w in ("w_hi", "w_lo")]


def _total(name: str) -> Column:
    """A weighted sum in units of 2^-46, as a double."""
    return F.col(f"{name}_hi").cast("double") * F.lit(float(1 << UNIT_BITS)) + F.col(f"{name}_lo").cast("double")


def _ratio(name: str, area: str) -> Column:
    return F.try_divide(_total(name), _total(area))


def in_units(df: DataFrame, weight="weight") -> DataFrame:
    hi, lo = weight_units(weight)
    return df.withColumns({"w_hi": hi, "w_lo": lo})


def _assigned(facts: DataFrame, dim: RegionRows) -> DataFrame:
    return assign_regions(facts, replace(dim, frame=in_units(dim.frame)))


def region_daily(
    archive: Archive, dim: RegionRows, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """All regions, all days, in one scan and one shuffle.

    No row where a day has no ocean cell in the region. `mean_sst_clim` is NULL
    where none of them has a climatology.
    """
    one, day, warm = F.lit(1).cast("long"), F.col("sst_raw").isNotNull(), F.col("cat").isNotNull()
    clim = day & F.col("has_clim")
    sums = _assigned(_facts(archive, start, end), dim).groupBy("region", "date").agg(
        *_sums("total", F.col("sst_raw"), day), *_sums("area", one, day), F.count_if(day).alias("n_cells"),
        *_sums("clim_total", F.col("sst_raw"), clim), *_sums("clim_area", one, clim), F.count_if(clim).alias("n_cells_clim"),
        *_sums("cat_total", F.col("cat").cast("long"), warm), *_sums("cat_area", one, warm), F.count_if(warm).alias("n_cells_mhw"),
    )
    return for_all_regions(_means(sums).filter("n_cells > 0"), dim)


def _means(sums: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return sums.select(
        "region", "date",
        (_ratio("total", "area") * COUNT).alias("mean_sst"), "n_cells",
        (_ratio("clim_total", "clim_area") * COUNT).alias("mean_sst_clim"), "n_cells_clim",
        F.when(F.col("n_cells") > 0, F.coalesce(_ratio("cat_total", "area"), zero)).alias("mean_mhw"),
        F.when(F.col("n_cells") > 0, F.coalesce(_ratio("cat_area", "area"), zero)).alias("mhw_area_frac"), "n_cells_mhw",
    )


def region_parts(cells: DataFrame, product: str, dim: RegionRows) -> DataFrame:
    """What these cells of a product add to each region's day (schema.REGION_PARTS), whatever part of the day they are."""
    if product == "sst":
        facts = cells.select("date", "gy", "gx", F.col("sst_raw").cast("long").alias("value"), F.col("has_clim").cast("boolean").alias("clim"))
    else:
        facts = cells.select("date", "gy", "gx", F.col("cat").cast("long").alias("value"), F.lit(False).alias("clim"))
    one, every, clim = F.lit(1).cast("long"), F.lit(True), F.col("clim")
    sums = _assigned(facts, dim).groupBy("region", "date").agg(
        *_sums("total", F.col("value"), every), *_sums("area", one, every), F.count(F.lit(1)).alias("n_cells"),
        *_sums("clim_total", F.col("value"), clim), *_sums("clim_area", one, clim), F.count_if(clim).alias("n_cells_clim"),
    )
    zero = F.lit(0).cast("long")
    parts = sums.select("region", "date", F.lit(product).alias("product"), *[F.coalesce(c, zero).alias(c) for c in PARTS])
    return for_all_regions(parts, dim)


def whole_days(parts: DataFrame, regions: list[str], dates: DataFrame, product: str) -> DataFrame:
    """Parts with a row, of zeros if need be, for each of the regions and dates: a day without cells is known to be one."""
    grid = dates.select("date").distinct().select(F.explode(F.array(*[F.lit(r) for r in regions])).alias("region"), "date")
    zero = F.lit(0).cast("long")
    return grid.join(parts.drop("product"), ["region", "date"], "left").select("region", "date", F.lit(product).alias("product"), *[F.coalesce(c, zero).alias(c) for c in PARTS])


def added(*parts: DataFrame) -> DataFrame:
    """The sum of parts, as of batches that each hold some of a day's cells."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("region", "date", "product").agg(*[F.sum(c).alias(c) for c in PARTS])


def rollup_of(parts: DataFrame, *, keep_empty: bool = False) -> DataFrame:
    """`region_daily` off the parts of both products; with `keep_empty` also rows without cells."""
    sst, mhw = F.col("product") == "sst", F.col("product") == "mhw"
    pick = lambda which, column, name: F.sum(F.when(which, F.col(column))).alias(name)
    zero = F.lit(0).cast("long")
    sums = parts.groupBy("region", "date").agg(
        *[pick(sst, c, c) for c in PARTS],
        *[pick(mhw, f"{c}_{h}", f"cat_{c}_{h}") for c in ("total", "area") for h in ("hi", "lo")], pick(mhw, "n_cells", "n_cells_mhw"),
    )
    counts = {c: F.coalesce(c, zero) for c in ("n_cells", "n_cells_clim", "n_cells_mhw")}
    out = _means(sums.withColumns(counts))
    return out if keep_empty else out.filter("n_cells > 0")


def refresh(archive: Archive, dim: RegionRows, changed: DataFrame) -> DataFrame:
    """`region_daily` for the changed dates only, off the facts of both products.

    The span of the dates (one row, fetched here) prunes partitions; within it a
    semi join keeps just the dates, which are at most the archive's days.
    """
    dates = changed.select("date").distinct()
    start, end = dates.agg(F.min("date"), F.max("date")).first()
    if start is None:
        return region_daily(archive, dim).filter(F.lit(False))
    only = lambda df: None if df is None else date_range(df, start, end).join(F.broadcast(dates), "date", "left_semi")
    return region_daily(Archive(only(archive.sst), archive.clim, only(archive.mhw)), dim)


def region_clim(clim: DataFrame, dim: RegionRows) -> DataFrame:
    """(region, mmdd, mean_clim, n_cells)."""
    sums = (
        _assigned(clim.select("mmdd", "gy", "gx", F.col("clim_raw").cast("long").alias("value")), dim)
        .groupBy("region", "mmdd")
        .agg(*_box_sums(), F.count(F.lit(1)).alias("n_cells"))
        .select("region", "mmdd", (_ratio("total", "area") * COUNT).alias("mean_clim"), "n_cells")
    )
    return for_all_regions(sums, dim)


def _box_sums() -> list[Column]:
    every = F.lit(True)
    return [*_sums("total", F.col("value"), every), *_sums("area", F.lit(1).cast("long"), every)]


# ------------------------------------------------------------------ any one box


def box_sst(
    archive: Archive, box: Box, start=None, end=None, *, with_clim_only: bool = False, grid: Grid = GLOBAL
) -> DataFrame:
    """(date, value, n_cells): the daily area mean of a box."""
    cells = date_range(archive.sst.filter(in_box(box)), start, end)
    if with_clim_only:
        cells = cells.filter(F.col("has_clim").cast("boolean"))
    cells = in_units(cells.select("date", "gy", F.col("sst_raw").cast("long").alias("value")), area_weight("gy", grid))
    sums = cells.groupBy("date").agg(*_box_sums(), F.count(F.lit(1)).alias("n_cells"))
    return sums.select("date", (_ratio("total", "area") * COUNT).alias("value"), "n_cells")


def box_clim(clim: DataFrame, box: Box, *, grid: Grid = GLOBAL) -> DataFrame:
    cells = in_units(clim.filter(in_box(box)).select("mmdd", "gy", F.col("clim_raw").cast("long").alias("value")), area_weight("gy", grid))
    sums = cells.groupBy("mmdd").agg(*_box_sums(), F.count(F.lit(1)).alias("n_cells"))
    return sums.select("mmdd", (_ratio("total", "area") * COUNT).alias("mean_clim"), "n_cells")


def box_anom(archive: Archive, box: Box, start=None, end=None, *, grid: Grid = GLOBAL) -> DataFrame:
    """Daily box anomaly. Days whose calendar day has no climatology drop out."""
    days = box_sst(archive, box, start, end, with_clim_only=True, grid=grid).withColumn("mmdd", mmdd("date"))
    # at most 366 rows, one per calendar day
    normals = F.broadcast(box_clim(archive.clim, box, grid=grid).select("mmdd", "mean_clim"))
    return days.join(normals, "mmdd").select("date", (F.col("value") - F.col("mean_clim")).alias("value"), "n_cells")


def box_extent(archive: Archive, box: Box, start=None, end=None, *, grid: Grid = GLOBAL) -> DataFrame:
    """Daily share of the box's ocean in a heatwave, in percent; 0 without events."""
    one, day, warm = F.lit(1).cast("long"), F.col("sst_raw").isNotNull(), F.col("cat").isNotNull()
    return (
        in_units(_facts(archive, start, end).filter(in_box(box)), area_weight("gy", grid))
        .groupBy("date")
        .agg(*_sums("hit", one, warm), *_sums("area", one, day), F.count_if(day).alias("n_cells"))
        .filter("n_cells > 0")
        .select("date", (PERCENT * F.coalesce(_ratio("hit", "area"), F.lit(0.0))).alias("value"), "n_cells")
    )


def box_series(
    archive: Archive, box: Box, name: str, period: str = "daily", start=None, end=None, *, grid: Grid = GLOBAL
) -> DataFrame:
    variable(name)
    daily = {"sst": box_sst, "anom": box_anom, "mhw": box_extent}[name](archive, box, start, end, grid=grid)
    return fold_buckets(daily, period)


# ------------------------------------------------------------- named regions


def fold_buckets(daily: DataFrame, period: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of the daily values per bucket; `n_cells` is the last day's."""
    return (
        daily.filter(F.col("value").isNotNull())
        .groupBy(*(keys or []), bucket_start("date", period).alias("bucket"))
        .agg(
            F.avg("value").alias("value"),
            F.count(F.lit(1)).alias("n_days"),
            F.max_by("n_cells", "date").alias("n_cells"),
        )
    )


def region_values(rollup: DataFrame, normals: DataFrame | None, name: str, start=None, end=None) -> DataFrame:
    """(region, date, value, n_cells) off the stored rollups.

    `sst` uses the mean over all cells, `anom` the one over cells with a
    climatology, and `mhw` reports the extent in percent.
    """
    variable(name)
    rows = date_range(rollup, start, end)
    if name == "sst":
        out = rows.select("region", "date", F.col("mean_sst").alias("value"), "n_cells")
    elif name == "mhw":
        out = rows.select("region", "date", (F.col("mhw_area_frac") * PERCENT).alias("value"), "n_cells")
    else:
        side = normals.select("region", "mmdd", "mean_clim")
        out = (
            rows.withColumn("mmdd", mmdd("date"))
            .join(side, ["region", "mmdd"])
            .select(
                "region", "date", (F.col("mean_sst_clim") - F.col("mean_clim")).alias("value"),
                F.col("n_cells_clim").alias("n_cells"),
            )
        )
    return out.filter(F.col("value").isNotNull())


def region_series(
    rollup: DataFrame, normals: DataFrame | None, name: str, period: str = "daily", start=None, end=None,
    *, region: str | None = None,
) -> DataFrame:
    """Bucketed series of one region, or of all of them."""
    if region is not None:
        rollup = rollup.filter(F.col("region") == region)
        normals = normals.filter(F.col("region") == region) if normals is not None else None
    folded = fold_buckets(region_values(rollup, normals, name, start, end), period, ["region"])
    return folded.withColumn("quantity", F.lit(series_quantity(name, region=True)).cast("string"))
