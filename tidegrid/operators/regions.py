"""Regions as row intervals.

Every region, box or polygon, is stored as (region, gy, gx0, gx1, weight): the
columns it covers on one latitude row, and that row's area weight. Daily rows
find their regions through an equi-join on `gy` with a range test on `gx`, so
all regions are rolled up in one scan and the cosine is taken once per row of
the dimension instead of once per cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..domain import GLOBAL, Box, Grid, Region
from ..functions.grid import area_weight, lat_of, lon_of
from ..session import checkpoint

# About 60 bytes a row: 60 MB on each executor at most.
BROADCAST_ROWS = 1_000_000
# Width of the column blocks that the join falls back to beyond that size.
BLOCK = 64


@dataclass(frozen=True)
class RegionRows:
    """The dimension. With `members` (region, like), `frame` holds each set of rows once, under the name `like`
    of one region, and what is summed for it counts for all regions like it, `names` in all (see `for_all_regions`)."""

    frame: DataFrame
    rows: int
    hull: Box | None = None
    members: DataFrame | None = None
    names: int = 0

    @property
    def broadcastable(self) -> bool:
        return self.rows <= BROADCAST_ROWS


# ---------------------------------------------------------------------- polygons


def ring_edges(rings: DataFrame) -> DataFrame:
    """(region, ring, x1, y1, x2, y2) from (region, ring, points array<struct<lon,lat>>).

    The ring is closed if the source leaves it open.
    """
    after = F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, 1))
    pairs = rings.select("region", "ring", F.explode(F.arrays_zip(F.col("points").alias("a"), after.alias("b"))).alias("e"))
    return pairs.select(
        "region", "ring",
        F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"),
        F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"),
    ).filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def rings_of(spark: SparkSession, regions: list[Region]) -> DataFrame:
    rows = [
        (r.key, i, [(float(x), float(y)) for x, y in ring]) for r in regions if r.masked for i, ring in enumerate(r.rings)
    ]
    return spark.createDataFrame(rows, "region string, ring int, points array<struct<lon:double,lat:double>>")


def rings_from_geojson(spark: SparkSession, path: str, region: str) -> DataFrame:
    """Outer rings of a GeoJSON feature (Polygon or MultiPolygon)."""
    feature = spark.read.schema("geometry struct<type:string,coordinates:string>").json(path, multiLine=True)
    nested = "array<array<array<array<double>>>>"
    coords = F.col("geometry.coordinates")
    polys = F.when(
        F.col("geometry.type") == "MultiPolygon", F.from_json(coords, nested)
    ).otherwise(F.array(F.from_json(coords, "array<array<array<double>>>")))
    points = F.transform(F.col("poly")[0], lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return (
        feature.select(F.posexplode(polys).alias("ring", "poly"))
        .select(F.lit(region).alias("region"), "ring", points.alias("points"))
        .filter(F.size("points") >= 4)
    )


def _first_at_or_after(x: Column, grid: Grid) -> Column:
    """Smallest index whose centre is not left of x, settled with the same
    centre formula as everywhere else rather than by trusting the division."""
    guess = F.ceil((x - F.lit(grid.lon0)) / F.lit(grid.resolution)).cast("int")
    return (
        F.when(lon_of(guess - 1, grid) >= x, guess - 1).when(lon_of(guess, grid) >= x, guess).otherwise(guess + 1)
    )


def polygon_intervals(edges: DataFrame, grid: Grid = GLOBAL) -> DataFrame:
    """(region, gy, gx0, gx1): columns whose cell centre lies inside a ring.

    Scan lines instead of testing cells against edges. Each edge is cut with the
    latitude rows it spans; along a row, the sorted crossings of one ring pair
    up into its inside (even-odd). Rows and columns use half-open tests, so a
    centre exactly on an edge belongs to one side only. Rings of one region are
    united. The work is (edges x rows spanned), whatever the polygon's area.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    to_row = lambda y: (y - F.lit(grid.lat0)) / F.lit(grid.resolution)
    first = F.greatest(F.floor(to_row(low)).cast("int") - 1, F.lit(0))
    last = F.least(F.ceil(to_row(high)).cast("int") + 1, F.lit(grid.nlat - 1))
    lat = lat_of("gy", grid)
    crossings = (
        edges.filter((F.col("y1") != F.col("y2")) & (first <= last))
        .select("*", F.explode(F.sequence(first, last)).alias("gy"))
        .filter((F.least("y1", "y2") <= lat) & (lat < F.greatest("y1", "y2")))
        .select(
            "region", "ring", "gy",
            (F.col("x1") + (lat - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"),
        )
    )
    along = W.partitionBy("region", "ring", "gy").orderBy("x")
    inside = (
        crossings.select("region", "gy", "x", F.row_number().over(along).alias("k"), F.lead("x").over(along).alias("x_out"))
        .filter((F.col("k") % 2 == 1) & F.col("x_out").isNotNull())
        .select(
            "region", "gy",
            F.greatest(_first_at_or_after(F.col("x"), grid), F.lit(0)).alias("gx0"),
            F.least(_first_at_or_after(F.col("x_out"), grid) - 1, F.lit(grid.nlon - 1)).alias("gx1"),
        )
        .filter(F.col("gx0") <= F.col("gx1"))
    )
    return merge_intervals(inside)


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Unite overlapping or touching intervals on each (region, gy)."""
    row = W.partitionBy("region", "gy").orderBy("gx0", "gx1")
    reach = F.max("gx1").over(row.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("gx0") > reach + 1), 1).otherwise(0)
    return (
        intervals.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(row.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("region", "gy", "island")
        .agg(F.min("gx0").alias("gx0"), F.max("gx1").alias("gx1"))
        .drop("island")
    )


def interval_cells(intervals: DataFrame) -> DataFrame:
    """region_cells: one row per covered cell."""
    return intervals.select("region", "gy", F.explode(F.sequence("gx0", "gx1")).alias("gx"))


def cell_intervals(cells: DataFrame) -> DataFrame:
    """Back from region_cells to intervals."""
    row = W.partitionBy("region", "gy").orderBy("gx")
    return (
        cells.select("region", "gy", "gx").distinct()
        .withColumn("island", F.col("gx") - F.row_number().over(row))
        .groupBy("region", "gy", "island")
        .agg(F.min("gx").alias("gx0"), F.max("gx").alias("gx1"))
        .drop("island")
    )


# ---------------------------------------------------------------- the dimension


def box_rows(spark: SparkSession, boxes: dict[str, Box], grid: Grid = GLOBAL) -> RegionRows:
    """The dimension for boxes; its size is known from the configuration."""
    listed = spark.createDataFrame(
        [(k, b.gy0, b.gy1, b.gx0, b.gx1) for k, b in boxes.items()],
        "region string, gy0 int, gy1 int, gx0 int, gx1 int",
    )
    frame = listed.select("region", F.explode(F.sequence("gy0", "gy1")).alias("gy"), "gx0", "gx1")
    hull = Box(
        min(b.gy0 for b in boxes.values()), max(b.gy1 for b in boxes.values()),
        min(b.gx0 for b in boxes.values()), max(b.gx1 for b in boxes.values()),
    )
    return RegionRows(frame.withColumn("weight", area_weight("gy", grid)), sum(b.rows for b in boxes.values()), hull)


def interval_rows(intervals: DataFrame, grid: Grid = GLOBAL) -> RegionRows:
    """The dimension for polygon regions. Regions of the same rows share them, so
    that rollups do their work once however many there are. Its size is counted,
    since it grows with the number and detail of the different polygons.

    Grouped by the rows themselves, not by a hash of them. A row of the stored
    table holds the rows of a polygon and the names of the regions like it.
    """
    spans = F.array_sort(F.collect_set(F.struct("gy", "gx0", "gx1"))).alias("spans")
    shapes = checkpoint(
        intervals.groupBy("region").agg(spans).groupBy("spans").agg(F.collect_list("region").alias("regions"))
    )
    like = F.array_min("regions")
    frame = shapes.select(like.alias("region"), F.explode("spans").alias("s")).select("region", "s.*")
    frame = frame.withColumn("weight", area_weight("gy", grid))
    facts = frame.agg(
        F.count(F.lit(1)), F.min("gy"), F.max("gy"), F.min("gx0"), F.max("gx1")
    ).first()
    members = shapes.select(F.explode("regions").alias("region"), like.alias("like"))
    names = shapes.agg(F.sum(F.size("regions"))).first()[0] or 0
    return RegionRows(frame, facts[0], Box(*facts[1:]) if facts[0] else None, members, names)


def _members(dim: RegionRows) -> DataFrame:
    if dim.members is not None:
        return dim.members
    return dim.frame.select("region", F.col("region").alias("like")).distinct()


def combine(*dims: RegionRows) -> RegionRows:
    frame, members = dims[0].frame, None
    for d in dims[1:]:
        frame = frame.unionByName(d.frame)
    if any(d.members is not None for d in dims):
        members = _members(dims[0])
        for d in dims[1:]:
            members = members.unionByName(_members(d))
    hulls = [d.hull for d in dims if d.hull]
    hull = Box(
        min(h.gy0 for h in hulls), max(h.gy1 for h in hulls), min(h.gx0 for h in hulls), max(h.gx1 for h in hulls)
    ) if hulls else None
    names = sum(d.rows if d.members is None else d.names for d in dims)
    return RegionRows(frame, sum(d.rows for d in dims), hull, members, names)


def for_all_regions(sums: DataFrame, dim: RegionRows) -> DataFrame:
    """Rows (region, ...) found for the frame's regions, for all regions like them."""
    if dim.members is None:
        return sums
    found = sums.withColumnRenamed("region", "like")
    members = F.broadcast(dim.members) if dim.names <= BROADCAST_ROWS else dim.members
    return found.join(members, "like").select(*sums.columns)


def assign_regions(facts: DataFrame, dim: RegionRows) -> DataFrame:
    """Each fact row once per region that covers its cell, with the row weight.

    The hull filter reaches the scan. Within the size bound the dimension is
    broadcast; beyond it both sides are shuffled on (gy, block of columns),
    which has enough distinct keys to spread and is split further by AQE.
    """
    if dim.hull is not None:
        h = dim.hull
        facts = facts.filter(F.col("gy").between(h.gy0, h.gy1) & F.col("gx").between(h.gx0, h.gx1))
    side = dim.frame.withColumnRenamed("gy", "d_gy")
    covered = (F.col("gx") >= F.col("gx0")) & (F.col("gx") <= F.col("gx1"))
    if dim.broadcastable:
        joined = facts.join(F.broadcast(side), (F.col("gy") == F.col("d_gy")) & covered)
        return joined.drop("d_gy", "gx0", "gx1")
    blocks = F.sequence(F.floor(F.col("gx0") / BLOCK).cast("int"), F.floor(F.col("gx1") / BLOCK).cast("int"))
    side = side.withColumn("d_block", F.explode(blocks))
    facts = facts.withColumn("block", F.floor(F.col("gx") / BLOCK).cast("int"))
    joined = facts.join(side, (F.col("gy") == F.col("d_gy")) & (F.col("block") == F.col("d_block")) & covered)
    return joined.drop("d_gy", "gx0", "gx1", "block", "d_block")
