"""Field operators on cells in long form: reduce, regrid, fill.

A field is (frame..., y, x, value) with one row per cell that has a value. The
frame columns say which picture it is, usually variable, period and bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import PACIFIC, Packing, Subset, half_step, variable
from ..functions.calendar import bucket_start, mmdd
from ..functions.packing import code_bytes, quantise
from ..schema import Archive
from .series import SCALE, cell_keys, scaled_mean

# --------------------------------------------------------------------- per cell


def anomaly_field(archive: Archive) -> DataFrame:
    """(date, gy, gx, raw, no_clim): anomaly in counts for all cells and days.

    NULL with `no_clim` where the ocean has no climatology; land has no row.
    """
    return _anomalies(archive).select("date", "gy", "gx", "raw", F.col("raw").isNull().alias("no_clim"))


def _anomalies(archive: Archive) -> DataFrame:
    keys = cell_keys(archive.sst, archive.clim)
    side = archive.clim.select(*keys, "mmdd", "clim_raw")
    joined = archive.sst.withColumn("mmdd", mmdd("date")).join(side, [*keys, "mmdd"], "left")
    return joined.select("date", *keys, (F.col("sst_raw").cast("long") - F.col("clim_raw").cast("long")).alias("raw"))


def bucket_field(archive: Archive, name: str, period: str, loaded: DataFrame | None = None) -> DataFrame:
    """(bucket, gy, gx, value, no_clim, n_days) for every bucket at once.

    Mean over the days a cell was present, or the maximum for classes. A cell
    has `no_clim` only if none of its days had an anomaly. `n_days` says on how
    many days of the archive the bucket rests; where the loaded dates are known
    (from the status table), passing them saves a second look at the facts.
    """
    variable(name)
    if name == "anom":
        days = _anomalies(archive)
    elif name == "sst":
        days = archive.sst.select("date", *cell_keys(archive.sst), F.col("sst_raw").cast("long").alias("raw"))
    else:
        days = archive.mhw.select("date", *cell_keys(archive.mhw), F.col("cat").cast("long").alias("raw"))
    bucket = bucket_start("date", period).alias("bucket")
    value = F.max("raw").cast("double") if name == "mhw" else scaled_mean("raw", SCALE[name])
    no_clim = F.count("raw") == 0 if name == "anom" else F.lit(False)
    cells = days.groupBy(bucket, *cell_keys(days)).agg(
        F.when(F.count("raw") > 0, value).alias("value"), no_clim.alias("no_clim")
    ).drop("block")
    # distinct dates first, so that the count works on days instead of cells
    source = loaded if loaded is not None else archive.mhw if name == "mhw" else archive.sst
    present = source.select("date").distinct().groupBy(bucket).agg(F.count(F.lit(1)).alias("n_days"))
    # one row per bucket: never more than the archive has days
    return cells.join(F.broadcast(present), "bucket")


# ----------------------------------------------------------------------- regrid

# Where the projection is cut, and the default picture width.
MERCATOR_LIMIT = 85.0511287798066
DEFAULT_WIDTH = 2048


def _mercator(lat: float) -> float:
    """Height of a latitude on the Mercator axis."""
    return math.asinh(math.tan(math.radians(min(max(lat, -MERCATOR_LIMIT), MERCATOR_LIMIT))))


def picture_axis(width: int, subset: Subset = PACIFIC) -> tuple[float, float, int]:
    """Mercator heights of a picture's upper and lower edge, and the rows that give square picture cells between them."""
    margin = half_step(subset)
    upper, lower = (_mercator(edge) for edge in (subset.lat[1] + margin, subset.lat[0] - margin))
    breadth = math.radians(subset.lon[1] - subset.lon[0] + 2 * margin)
    return upper, lower, max(1, round(width * (upper - lower) / breadth))


def picture_height(width: int, subset: Subset = PACIFIC) -> int:
    return picture_axis(width, subset)[2]


def row_sources(spark: SparkSession, width: int, subset: Subset = PACIFIC) -> DataFrame:
    """(out, src): fractional source row of each picture row, north to south, on
    an axis that is even in Mercator height. Source row 0 is the southern edge.

    The latitude of a height h is the angle whose sine is tanh(h).
    """
    upper, lower, height = picture_axis(width, subset)
    south, north = subset.lat
    per_row = (subset.nlat - 1) / (north - south) if subset.nlat > 1 else 1.0
    down = (2 * F.col("id") + 1) / F.lit(2.0 * height)
    latitude = F.degrees(F.asin(F.tanh(F.lit(upper) - down * F.lit(upper - lower))))
    return spark.range(height).select(F.col("id").cast("int").alias("out"), ((latitude - south) * per_row).alias("src"))


def col_sources(spark: SparkSession, width: int, subset: Subset = PACIFIC) -> DataFrame | None:
    """(out, src) for the columns, or None where the width stays as it is."""
    if width == subset.nlon:
        return None
    src = (F.col("id") + 0.5) / F.lit(float(width)) * F.lit(float(subset.nlon)) - 0.5
    return spark.range(width).select(F.col("id").cast("int").alias("out"), src.alias("src"))


def _clip(index, size: int):
    return F.least(F.greatest(index.cast("int"), F.lit(0)), F.lit(size - 1))


def _taps(sources: DataFrame, size: int) -> DataFrame:
    """(src, out, side, w): which source line feeds which output line. Side 0 is
    the lower neighbour and w the upper one's share. Twice the picture's lines."""
    low = _clip(F.floor("src"), size)
    both = sources.select("out", low.alias("low"), (F.col("src") - low).alias("w"))
    ends = F.array(
        F.struct(F.col("low").alias("src"), F.lit(0).alias("side")),
        F.struct(_clip(F.col("low") + 1, size).alias("src"), F.lit(1).alias("side")),
    )
    return both.select("out", "w", F.inline(ends))


def _nearest_taps(sources: DataFrame, size: int) -> DataFrame:
    return sources.select("out", _clip(F.rint("src"), size).alias("src"))


def _blend_axis(
    field: DataFrame, taps: DataFrame, axis: str, keys: list[str], owner: list[str] | None = None
) -> DataFrame:
    """Blend along one axis; where one neighbour is missing the other stands in."""
    hits = field.join(F.broadcast(taps), F.col(axis) == F.col("src")).drop(axis, "src")
    hits = hits.withColumnRenamed("out", axis)
    if owner:
        hits = hits.repartition(*owner)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    return (
        hits.groupBy(*keys)
        .agg(side(0).alias("a"), side(1).alias("b"), F.first("w").alias("w"))
        .select(*keys, F.coalesce(a * (1 - w) + b * w, a, b).alias("value"))
    )


def regrid_bilinear(
    field: DataFrame, frame: list[str], rows: DataFrame, cols: DataFrame | None, shape: tuple[int, int]
) -> DataFrame:
    """Bilinear resampling of (frame..., y, x, value) onto other rows and columns.

    Two passes, rows then columns. The tables of taps have two rows per output
    line and are broadcast. Each output cell has only two inputs per pass, so
    there is nothing to combine early: the cells are sent once to the owner of
    their output row, and both groupings work within that partitioning.
    """
    tall = _blend_axis(field, _taps(rows, shape[0]), "y", [*frame, "y", "x"], owner=[*frame, "y"])
    return tall if cols is None else _blend_axis(tall, _taps(cols, shape[1]), "x", [*frame, "y", "x"])


def regrid_nearest(
    field: DataFrame, frame: list[str], rows: DataFrame, cols: DataFrame | None, shape: tuple[int, int]
) -> DataFrame:
    """Nearest resampling, for classes. Two broadcast joins and no shuffle."""
    for axis, sources, size in (("y", rows, shape[0]), ("x", cols, shape[1])):
        if sources is None:
            continue
        taps = F.broadcast(_nearest_taps(sources, size))
        field = field.join(taps, F.col(axis) == F.col("src")).drop(axis, "src").withColumnRenamed("out", axis)
    return field.select(*frame, "y", "x", "value")


def regrid_mask(
    mask: DataFrame, frame: list[str], rows: DataFrame, cols: DataFrame | None, shape: tuple[int, int]
) -> DataFrame:
    """(frame..., y, x) whose bilinear share of marked cells exceeds one half.

    Cells not in `mask` count as 0, so the share is a sum of tap weights, and
    both axes multiply into one pass.
    """
    weight = F.when(F.col("side") == 0, 1 - F.col("w")).otherwise(F.col("w"))
    share = lambda sources, size, name: (
        _taps(sources, size).groupBy("src", "out").agg(F.sum(weight).alias(name))
    )
    ys = F.broadcast(share(rows, shape[0], "wy"))
    hits = mask.join(ys, F.col("y") == F.col("src")).drop("y", "src").withColumnRenamed("out", "y")
    if cols is None:
        hits = hits.withColumn("wx", F.lit(1.0))
    else:
        xs = F.broadcast(share(cols, shape[1], "wx"))
        hits = hits.join(xs, F.col("x") == F.col("src")).drop("x", "src").withColumnRenamed("out", "x")
    return (
        hits.groupBy(*frame, "y", "x").agg(F.sum(F.col("wy") * F.col("wx")).alias("share"))
        .filter("share > 0.5").select(*frame, "y", "x")
    )


# ------------------------------------------------------------------------- codes


def encode_field(
    field: DataFrame, frame: list[str], packing: Packing, no_value: DataFrame | None = None
) -> DataFrame:
    """(frame..., y, x, code): packed codes; marked cells get the sentinel."""
    keys = [*frame, "y", "x"]
    if no_value is None or packing.sentinel is None:
        return field.select(*keys, quantise("value", packing).alias("code"))
    both = field.unionByName(no_value.select(*keys, F.lit(None).cast("double").alias("value")).withColumn("m", F.lit(True)), True)
    one = both.groupBy(*keys).agg(F.max("value").alias("value"), F.coalesce(F.bool_or("m"), F.lit(False)).alias("m"))
    return one.select(*keys, quantise("value", packing, "m").alias("code"))


def channel_bytes(codes: DataFrame, packing: Packing) -> DataFrame:
    names = ["high", "low"][-packing.channels:] if packing.channels > 1 else ["low"]
    return codes.select("*", *[b.alias(n) for b, n in zip(code_bytes("code", packing), names)])


# -------------------------------------------------------------------------- fill

# Fixed value: how many times known codes grow into their surroundings.
PASSES = 8
TILE = 64


def neighbour_fill(
    codes: DataFrame, frame: list[str], height: int, width: int, *, passes: int = PASSES, tile: int = TILE
) -> DataFrame:
    """(frame..., y, x, code, known) for every cell of each frame, gaps filled.

    A gap takes its value from known cells at most `passes` steps away, across
    the picture's edges; farther gaps take the frame's median code. So each
    picture is cut into tiles that carry a margin of `passes` cells, and a tile
    is filled on its own: one shuffle, groups of bounded size, the same result
    as on the whole picture.
    """
    tiles_y, tiles_x = -(-height // tile), -(-width // tile)

    def spread(column: str, size: int, tiles: int, prefix: str) -> list:
        # all positions, edge-wrapped copies included, at which a tile's margin sees the cell
        wraps = -(-passes // size)
        copies = F.transform(
            F.sequence(F.lit(-wraps), F.lit(wraps)), lambda k: F.col(column) + k * size
        )
        first = lambda p: F.greatest(F.floor((p - passes) / tile).cast("int"), F.lit(0))
        last = lambda p: F.least(F.floor((p + passes) / tile).cast("int"), F.lit(tiles - 1))
        placed = F.flatten(F.transform(copies, lambda p: F.when(
            first(p) <= last(p),
            F.transform(F.sequence(first(p), F.greatest(first(p), last(p))), lambda t: F.struct(t.alias("t"), p.alias("p"))),
        ).otherwise(F.array().cast("array<struct<t:int,p:int>>"))))
        return F.explode(F.filter(
            placed,
            lambda s: (s["p"] >= s["t"] * tile - passes)
            & (s["p"] < F.least((s["t"] + 1) * tile, F.lit(size)) + passes),
        )).alias(prefix)

    known = codes.filter(F.col("code").isNotNull()).select(*frame, F.col("y").cast("int"), F.col("x").cast("int"), F.col("code").cast("int"))
    placed = known.select(*frame, spread("y", height, tiles_y, "sy"), "x", "code")
    placed = placed.select(*frame, "sy", spread("x", width, tiles_x, "sx"), "code")
    placed = placed.select(
        *frame, F.col("sy.t").alias("ty"), F.col("sx.t").alias("tx"),
        F.col("sy.p").alias("y"), F.col("sx.p").alias("x"), "code", F.lit(None).cast("int").alias("median"),
    )
    # one marker per tile carries the median and makes sure that empty tiles exist
    medians = known.groupBy(*frame).agg(F.floor(F.expr("percentile(code, 0.5)")).cast("int").alias("median"))
    markers = medians.select(
        *frame, F.explode(F.sequence(F.lit(0), F.lit(tiles_y - 1))).alias("ty"), "median"
    ).select(
        *frame, "ty", F.explode(F.sequence(F.lit(0), F.lit(tiles_x - 1))).alias("tx"),
        F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("code"),
        "median",
    )

    def grow(code: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pass, unknown cells beside known ones get the floored mean of those.

        The sums over the four sides are products with the two axes' neighbour
        matrices, for the codes and for the number of known cells alike.
        """
        beside = [np.eye(n, k=1) + np.eye(n, k=-1) for n in code.shape]
        around = lambda cells: beside[0] @ cells + cells @ beside[1]
        for _ in range(passes):
            count = around(known.astype(float))
            reached = ~known & (count > 0)
            if not reached.any():
                break
            mean = around(np.where(known, code, 0).astype(float))[reached] // count[reached]
            code[reached] = mean.astype(code.dtype)
            known = known | reached
        return code, known

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        marker = pdf["median"].notna()
        head = pdf[marker].iloc[0]
        y0, x0 = int(head["ty"]) * tile, int(head["tx"]) * tile
        rows, cols = min(tile, height - y0), min(tile, width - x0)
        body = pdf[~marker]
        code = np.zeros((rows + 2 * passes, cols + 2 * passes), dtype=np.int64)
        seen = np.zeros(code.shape, dtype=bool)
        at = (body["y"].to_numpy(dtype=np.int64) - y0 + passes, body["x"].to_numpy(dtype=np.int64) - x0 + passes)
        code[at] = body["code"].to_numpy(dtype=np.int64)
        seen[at] = True
        inner = (slice(passes, passes + rows), slice(passes, passes + cols))
        known_before = seen[inner]
        code, seen = grow(code, seen)
        out = np.where(seen, code, int(head["median"]))[inner]
        yy, xx = np.indices(out.shape)
        keys = {c: [head[c]] * out.size for c in frame}
        cells = {"y": yy.ravel() + y0, "x": xx.ravel() + x0, "code": out.ravel(), "known": known_before.ravel()}
        return pd.DataFrame({**keys, **cells})

    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in frame] + ["y int", "x int", "code int", "known boolean"])
    return placed.unionByName(markers).groupBy(*frame, "ty", "tx").applyInPandas(fill, schema)

