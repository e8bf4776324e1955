"""Source day files, after decoding: one row per grid row, `(date, row, values)`.

Source columns run -180..180 and the archive's 0..360, so each row is rolled by
half the grid. Daily files are south-up; climatology files are north-up and must
be flipped. Both corrections are made here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import GLOBAL, MASK_LAND, PACIFIC, VARIABLES, Box, Grid, Subset
from ..functions.packing import is_class

# File names of the two daily archives and of the climatology.
FILE_PATTERNS = {
    "sst": r"^coraltemp_v3\.1_(\d{8})\.nc$",
    "mhw": r"^noaa-crw_mhw_v1\.0\.1_category_(\d{8})\.nc$",
}
CLIM_PATTERN = r"^ct5km_v3\.1_clim-sst-mean-daily-window-01day-01grid-source.*_day(\d{4})\.nc$"


def subset_box(subset: Subset = PACIFIC, grid: Grid = GLOBAL) -> Box:
    box = grid.box(subset.lat, subset.lon)
    if (box.rows, box.cols) != (subset.nlat, subset.nlon):
        raise ValueError(f"{subset.name} covers {box.rows} x {box.cols} cells, not {subset.nlat} x {subset.nlon}")
    return box


# ------------------------------------------------------------------- listings


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of a folder's files. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def landed_files(listing: DataFrame) -> DataFrame:
    """(filename, size, modified, date) of decoded files; `date` is null where the name has no `_yyyymmdd` before a dot."""
    name = F.element_at(F.split("path", "/"), -1)
    stamp = F.nullif(F.regexp_extract("filename", r"_(\d{8})\.", 1), F.lit(""))
    files = listing.select(name.alias("filename"), "size", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"))
    files = files.filter(F.col("filename").endswith(".parquet"))
    return files.withColumn("date", F.try_to_timestamp(stamp, F.lit("yyyyMMdd")).cast("date"))


def archive_listing(paths: DataFrame, product: str) -> DataFrame:
    """(filename, date) of the recognised day files. Unfinished downloads and
    names that carry no real date are left out."""
    name = F.regexp_extract(F.col("path"), r"[^/]+$", 0)
    stamp = F.regexp_extract("filename", FILE_PATTERNS[product], 1)
    date = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd")).cast("date")
    return paths.select(name.alias("filename")).withColumn("date", date).filter(F.col("date").isNotNull())


def clim_listing(paths: DataFrame) -> DataFrame:
    """(filename, mmdd) of climatology files; with several, the last name wins."""
    name = F.regexp_extract(F.col("path"), r"[^/]+$", 0)
    found = paths.select(name.alias("filename")).withColumn(
        "mmdd", F.nullif(F.regexp_extract("filename", CLIM_PATTERN, 1), F.lit("")).cast("int")
    )
    return found.filter(F.col("mmdd").isNotNull()).groupBy("mmdd").agg(F.max("filename").alias("filename"))


def select_files(
    files: DataFrame, date=None, start=None, end=None, *, newest_first: bool = False, limit: int | None = None
) -> DataFrame:
    if date is not None:
        files = files.filter(F.col("date") == F.lit(date))
    if start is not None:
        files = files.filter(F.col("date") >= F.lit(start))
    if end is not None:
        files = files.filter(F.col("date") <= F.lit(end))
    files = files.orderBy(F.col("date").desc() if newest_first else F.col("date"))
    return files if limit is None else files.limit(limit)


# ---------------------------------------------------------------------- reading


def shape_problems(rows: DataFrame, grid: Grid = GLOBAL, key: str = "date") -> DataFrame:
    """(key, problem) for every file that is not a full grid: each row once, each of full width."""
    full = F.coalesce(F.size("values") == grid.nlon, F.lit(False))
    lines = rows.groupBy(key, "row").agg(F.count(F.lit(1)).alias("times"), F.count_if(~full).alias("odd"))
    inside = F.coalesce(F.col("row").between(0, grid.nlat - 1), F.lit(False))
    facts = lines.groupBy(key).agg(
        F.count_if(inside & (F.col("times") == 1)).alias("good"), F.sum("times").alias("n"), F.sum("odd").alias("odd"))
    text = F.format_string(f"expected a {grid.nlat} x {grid.nlon} grid, got %d rows, %d of another width, %d in place", "n", "odd", "good")
    sound = (F.col("n") == grid.nlat) & (F.col("good") == grid.nlat) & (F.col("odd") == 0)
    return facts.filter(~sound).select(key, text.alias("problem"))


def grid_to_cells(
    rows: DataFrame, box: Box, *, flip_lat: bool = False, keep=None, grid: Grid = GLOBAL, key: str = "date",
    name: str = "raw",
) -> DataFrame:
    """(key, gy, gx, <name>): the box's cells on the global index, long form.

    No shuffle. Rows outside the box are dropped before their values are looked
    at, and each array is rolled and cut to the box before it is exploded.
    `keep` is a predicate on the value column, such as "not the fill value".
    """
    half = grid.nlon // 2
    gy = (F.lit(grid.nlat - 1) - F.col("row")) if flip_lat else F.col("row")
    values = F.col("values")
    rolled = F.concat(F.slice(values, grid.nlon - half + 1, half), F.slice(values, 1, grid.nlon - half))
    cells = (
        rows.withColumn("gy", gy.cast("int"))
        .filter(F.col("gy").between(box.gy0, box.gy1))
        .select(key, "gy", F.posexplode(F.slice(rolled, box.gx0 + 1, box.cols)).alias("pos", name))
        .select(key, "gy", (F.col("pos") + box.gx0).alias("gx"), name)
    )
    return cells if keep is None else cells.filter(keep(F.col(name)))


def not_fill(variable: str = "sst"):
    fill = VARIABLES[variable].fill
    return lambda value: value != fill


def sst_cells(rows: DataFrame, box: Box, grid: Grid = GLOBAL) -> DataFrame:
    return grid_to_cells(rows, box, keep=not_fill("sst"), grid=grid, name="sst_raw")


def clim_cells(rows: DataFrame, box: Box, grid: Grid = GLOBAL) -> DataFrame:
    """Climatology files are north-up: flipped here."""
    return grid_to_cells(
        rows, box, flip_lat=True, keep=not_fill("sst"), grid=grid, key="mmdd", name="clim_raw"
    ).select("mmdd", "gy", "gx", "clim_raw")


def class_cells(rows: DataFrame, box: Box, grid: Grid = GLOBAL) -> DataFrame:
    return grid_to_cells(rows, box, keep=is_class, grid=grid, name="cat")


# ------------------------------------------------------------------ land repair


def carries_land(mask_rows: DataFrame) -> DataFrame:
    """(date, has_land) from the category file's own mask."""
    return mask_rows.groupBy("date").agg(
        F.bool_or(F.exists("values", lambda m: m == MASK_LAND)).alias("has_land")
    )


def repair_land(cells: DataFrame, land: DataFrame, ocean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep only ocean on the days whose category mask marks no land at all.

    `land` says which days those are, `ocean` has the cells with a temperature.
    Returns the usable cells of all days, and (date, problem) for days without
    land whose ocean is not known: of these no cell is returned.
    """
    flags = F.broadcast(land)  # one row per day
    marked = cells.join(flags, "date")
    good = marked.filter("has_land").drop("has_land")
    bad = marked.filter(~F.col("has_land")).drop("has_land")
    repaired = bad.join(ocean.select("date", "gy", "gx"), ["date", "gy", "gx"], "left_semi").select(*good.columns)
    bare = land.filter(~F.col("has_land")).select("date")
    stuck = bare.join(ocean.select("date").distinct(), "date", "left_anti")
    problem = F.lit("its mask marks no land, and no temperatures of that day say where the ocean is")
    return good.unionByName(repaired), stuck.select("date", problem.alias("problem"))
