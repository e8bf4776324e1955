"""Map pictures as tables: a packed code and an opacity for every picture cell.

A picture is reduced from its bucket's days, regridded, packed to codes, and
filled under the land. It stays a table; drawing is somebody else's job. All
buckets of one variable and period are made in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import GLOBAL, PACIFIC, VARIABLES, Box, Grid, Subset, variable
from ..functions.calendar import PERIODS, bucket_end, climatology_of, date_range, months_between
from ..functions.grid import in_box
from ..operators import raster as ra
from ..operators.ingest import affected_buckets
from ..schema import Archive
from ..sources.gridfiles import subset_box
from ..sources.store import Store

FRAME = ["bucket"]
FILES = 4  # of a picture at most


def _placed(cells: DataFrame, box: Box) -> DataFrame:
    """Cells of the box, counted from its south-western corner."""
    return (
        cells.filter(in_box(box))
        .withColumns({"y": F.col("gy") - box.gy0, "x": F.col("gx") - box.gx0})
    )


def codes(
    field: DataFrame, name: str, width: int = ra.DEFAULT_WIDTH, subset: Subset = PACIFIC
) -> DataFrame:
    """(bucket, y, x, code) of the picture's ocean cells.

    `field` is (bucket, y, x, value, no_clim). Classes are sampled and measured
    values blended; ocean without a climatology gets the sentinel.
    """
    var = variable(name)
    spark = field.sparkSession
    rows, cols = ra.row_sources(spark, width, subset), ra.col_sources(spark, width, subset)
    shape = (subset.nlat, subset.nlon)
    values = field.filter(F.col("value").isNotNull()).select(*FRAME, "y", "x", "value")
    regrid = ra.regrid_nearest if var.categorical else ra.regrid_bilinear
    picture = regrid(values, FRAME, rows, cols, shape)
    if var.packing.sentinel is None:
        return ra.encode_field(picture, FRAME, var.packing)
    bare = ra.regrid_mask(field.filter("no_clim").select(*FRAME, "y", "x"), FRAME, rows, cols, shape)
    return ra.encode_field(picture, FRAME, var.packing, bare)


def pictures(
    archive: Archive, name: str, period: str, buckets: DataFrame | None = None, width: int = ra.DEFAULT_WIDTH, *,
    loaded: DataFrame | None = None, subset: Subset = PACIFIC, grid: Grid = GLOBAL,
) -> DataFrame:
    """(variable, period, bucket, y, x, code, opaque, <bytes>) of whole pictures.

    `buckets` (variable, period, bucket), as from `pending_buckets`, restricts
    what is made; their number is that of the archive's buckets at most.
    """
    var = variable(name)
    wanted = None
    if buckets is not None:
        wanted = buckets.filter((F.col("variable") == name) & (F.col("period") == period)).select("bucket").distinct()
        # the span, one row, prunes partitions; the semi join below keeps the buckets
        first, last = wanted.agg(F.min("bucket"), F.max(bucket_end("bucket", period))).first()
        cut = lambda df: None if df is None else date_range(df, first, last)
        clim = climatology_of(archive.clim, months_between(first, last)) if archive.clim is not None and first else archive.clim
        archive = Archive(cut(archive.sst), clim, cut(archive.mhw))
    cells = ra.bucket_field(archive, name, period, loaded)
    if wanted is not None:
        cells = cells.join(F.broadcast(wanted), "bucket", "left_semi")
    ocean = codes(_placed(cells, subset_box(subset, grid)), name, width, subset)
    full = ra.neighbour_fill(ocean, FRAME, ra.picture_height(width, subset), width)
    # land is cut by its opacity; its codes only keep blending harmless
    out = full.select(
        F.lit(name).alias("variable"), F.lit(period).alias("period"), "bucket", "y", "x", "code",
        F.col("known").alias("opaque"),
    )
    return ra.channel_bytes(out, var.packing)


def draw(
    store: Store, todo: DataFrame, names: tuple[str, ...] = tuple(VARIABLES), periods: tuple[str, ...] = PERIODS,
    width: int = ra.DEFAULT_WIDTH, *, subset: Subset = PACIFIC, grid: Grid = GLOBAL,
) -> int:
    """Write the pictures of `todo` (variable, period, bucket), also over older ones; returns how many.

    Each is noted in the store's picture list, which tells what exists without
    reading pictures. Nothing is scanned for a variable and period not asked for.
    """
    drawn = 0
    for name in names:
        for period in periods:
            mine = todo.filter((F.col("variable") == name) & (F.col("period") == period)).distinct()
            count = mine.count()
            if not count:
                continue
            loaded = store.loaded_days("mhw" if name == "mhw" else "sst")
            out = pictures(store.archive(), name, period, mine, width, loaded=loaded, subset=subset, grid=grid)
            out = out.repartition("bucket", F.pmod(F.xxhash64("y"), F.lit(FILES)))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "variable", "period", "bucket").parquet(store.path("pictures"))
            store.append("picture_list", mine)
            drawn += count
    return drawn


def redraw(store: Store, outcomes: DataFrame, width: int = ra.DEFAULT_WIDTH, **where) -> int:
    """Draw every bucket that an ingested date of (date, outcome) contributes to, open ones included."""
    changed = outcomes.filter("outcome = 'ingested'").select("date")
    return draw(store, affected_buckets(changed), width=width, **where)
