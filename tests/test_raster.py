"""Field operators against small numpy models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.domain import Packing, Subset, code_limits
from tidegrid.operators import raster as ra
from tidegrid.schema import Archive


def to_frame(spark, field):
    rows = [(1, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(field) if np.isfinite(v)]
    return spark.createDataFrame(rows, "f int, y int, x int, value double")


def to_array(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def sources(df):
    return np.array([r.src for r in df.orderBy("out").collect()])


def bilinear(field, src, axis):
    n = field.shape[axis]
    low = np.clip(np.floor(src).astype(int), 0, n - 1)
    a, b = np.take(field, low, axis), np.take(field, np.clip(low + 1, 0, n - 1), axis)
    w = (src - low).reshape((-1, 1) if axis == 0 else (1, -1))
    mixed = a * (1 - w) + b * w
    return np.where(np.isnan(mixed), np.where(np.isnan(a), b, a), mixed)


SMALL = Subset("s", lat=(-50.0, 50.0), lon=(10.0, 60.0), nlat=6, nlon=6)


@pytest.mark.parametrize("width", [9, 6])
def test_bilinear_and_nearest(spark, width):
    field = np.add.outer(np.arange(6) * 10.0, np.arange(6) * 1.0)
    field[:, 2] = np.nan
    field[4, 4] = np.nan
    rows, cols = ra.row_sources(spark, width, SMALL), ra.col_sources(spark, width, SMALL)
    height = ra.picture_height(width, SMALL)
    src_y = sources(rows)
    assert len(src_y) == height and (np.diff(src_y) < 0).all()  # north first
    want = bilinear(field, src_y, 0)
    if cols is not None:
        want = bilinear(want, sources(cols), 1)
    got = to_array(ra.regrid_bilinear(to_frame(spark, field), ["f"], rows, cols, (6, 6)), want.shape)
    np.testing.assert_allclose(got, want)

    pick = field[np.clip(np.rint(src_y).astype(int), 0, 5)]
    if cols is not None:
        pick = pick[:, np.clip(np.rint(sources(cols)).astype(int), 0, 5)]
    got = to_array(ra.regrid_nearest(to_frame(spark, field), ["f"], rows, cols, (6, 6)), pick.shape)
    np.testing.assert_array_equal(got, pick)

    mask = np.zeros((6, 6))
    mask[:3, 3:] = 1
    share = bilinear(mask, src_y, 0)
    if cols is not None:
        share = bilinear(share, sources(cols), 1)
    marked = spark.createDataFrame([(1, int(y), int(x)) for y, x in np.argwhere(mask == 1)], "f int, y int, x int")
    got = {(r.y, r.x) for r in ra.regrid_mask(marked, ["f"], rows, cols, (6, 6)).collect()}
    assert got == {tuple(map(int, p)) for p in np.argwhere(share > 0.5)}


def fill_model(codes, known, passes):
    codes = np.where(known, codes, int(np.median(codes[known]))).astype(int)
    for _ in range(passes):
        total, count = np.zeros(codes.shape, int), np.zeros(codes.shape, int)
        for step, axis in ((1, 0), (-1, 0), (1, 1), (-1, 1)):
            total += np.roll(np.where(known, codes, 0), step, axis)
            count += np.roll(known.astype(int), step, axis)
        fresh = ~known & (count > 0)
        codes = np.where(fresh, total // np.maximum(count, 1), codes)
        known = known | fresh
    return codes


@pytest.mark.parametrize("shape,tile,passes,share", [
    ((13, 17), 5, 3, 0.05), ((13, 17), 64, 8, 0.02), ((3, 4), 4, 8, 0.1), ((20, 20), 8, 8, 0.01), ((7, 7), 3, 2, 1.0),
])
def test_fill_is_the_same_for_any_tiling(spark, shape, tile, passes, share):
    rng = np.random.default_rng(shape[0] + tile)
    codes, known = rng.integers(0, 60000, shape), rng.random(shape) < share
    known[0, 0] = True
    rows = [(7, int(y), int(x), int(codes[y, x])) for y, x in np.argwhere(known)]
    out = ra.neighbour_fill(spark.createDataFrame(rows, "f int, y int, x int, code int"), ["f"], *shape, passes=passes, tile=tile)
    assert out.count() == shape[0] * shape[1]
    np.testing.assert_array_equal(to_array(out, shape, "code"), fill_model(codes, known, passes))


def test_encode(spark):
    packing = Packing(0.1, -12.8, sentinel=0)
    f = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 99.0), (1, 0, 2, 2.0)], "f int, y int, x int, value double")
    m = spark.createDataFrame([(1, 0, 2), (1, 0, 3)], "f int, y int, x int")
    got = {r.x: r.code for r in ra.encode_field(f, ["f"], packing, m).collect()}
    assert got == {0: 138, 1: 255, 2: 0, 3: 0}
    assert {r.x for r in ra.encode_field(f, ["f"], Packing(0.01, -5.0, 2)).collect()} == {0, 1, 2}


def test_bucket_field(spark, frame, day):
    sst = frame("date date, gy int, gx int, sst_raw int, has_clim boolean", [
        ("2024-01-01", 1, 1, 100, True), ("2024-01-02", 1, 1, 300, False), ("2024-01-02", 1, 2, 50, False), ("2024-01-04", 1, 1, 800, True)])
    clim = frame("mmdd int, gy int, gx int, clim_raw int", [(101, 1, 1, 0), (104, 1, 1, 0)])
    mhw = frame("date date, gy int, gx int, cat int", [("2024-01-01", 1, 1, 1), ("2024-01-03", 1, 1, 4)])
    arc = Archive(sst, clim, mhw)
    out = {(r.gy, r.gx): tuple(r)[3:] for r in ra.bucket_field(arc, "anom", "weekly").collect()}
    assert out == {(1, 1): (4.5, False, 3), (1, 2): (None, True, 3)}  # one day without normal does not hide the others
    out = {(r.gy, r.gx): tuple(r)[3:] for r in ra.bucket_field(arc, "sst", "weekly").collect()}
    assert out == {(1, 1): (4.0, False, 3), (1, 2): (0.5, False, 3)}
    assert tuple(ra.bucket_field(arc, "mhw", "weekly").first())[3:] == (4.0, False, 2)
    assert ra.anomaly_field(arc).filter(F.col("no_clim") & F.col("raw").isNull()).count() == 2


def test_pictures_match_a_numpy_model(spark, day):
    """Reduce, regrid, mask, pack and fill, all in one."""
    from tidegrid.domain import VARIABLES, Grid
    from tidegrid.plans import pictures as pc

    grid = Grid(resolution=20.0, lat0=-50.0, lon0=10.0, nlat=6, nlon=18)
    subset = Subset("s", lat=(-50.0, 50.0), lon=(30.0, 130.0), nlat=6, nlon=6)
    rng = np.random.default_rng(9)
    days = [day("2024-01-01"), day("2024-01-03")]
    sst, clim, mhw = [], [], []
    for d in days:
        for y, x in np.ndindex(6, 18):
            if (y + x) % 5 == 0:
                continue
            sst.append((d, y, x, int(rng.integers(0, 3000)), True))
            if (y, x) != (2, 3):
                clim.append((d.month * 100 + d.day, y, x, int(rng.integers(1000, 2000))))
            if rng.random() < 0.4:
                mhw.append((d, y, x, int(rng.integers(1, 6))))
    arc = Archive(
        spark.createDataFrame(sst, "date date, gy int, gx int, sst_raw int, has_clim boolean"),
        spark.createDataFrame(clim, "mmdd int, gy int, gx int, clim_raw int"),
        spark.createDataFrame(mhw, "date date, gy int, gx int, cat int"),
    )
    width = 11
    src_y = sources(ra.row_sources(spark, width, subset))
    src_x = sources(ra.col_sources(spark, width, subset))

    def model(name):
        total, count = np.zeros((6, 6)), np.zeros((6, 6))
        seen = np.zeros((6, 6), bool)
        normal = {(m, y, x): c for m, y, x, c in clim}
        if name == "mhw":
            field = np.full((6, 6), np.nan)
            for _, y, x, c in mhw:
                if 1 <= x <= 6:
                    field[y, x - 1] = np.fmax(field[y, x - 1], c)
            bare = None
        else:
            for d, y, x, raw, _ in sst:
                if 1 <= x <= 6:
                    seen[y, x - 1] = True
                    base = 0 if name == "sst" else normal.get((d.month * 100 + d.day, y, x))
                    if base is not None:
                        total[y, x - 1] += raw - base
                        count[y, x - 1] += 1
            field = np.where(count > 0, total / np.maximum(count, 1) * 0.01, np.nan)
            bare = (seen & (count == 0)) if name == "anom" else None
        p = VARIABLES[name].packing
        if name == "mhw":
            pic = field[np.clip(np.rint(src_y).astype(int), 0, 5)][:, np.clip(np.rint(src_x).astype(int), 0, 5)]
        else:
            pic = bilinear(bilinear(field, src_y, 0), src_x, 1)
        mask = np.zeros(pic.shape, bool) if bare is None else bilinear(bilinear(bare.astype(float), src_y, 0), src_x, 1) > 0.5
        known = np.isfinite(pic) | mask
        code = np.clip(np.rint((np.nan_to_num(pic) - p.offset) / p.scale), *code_limits(p)).astype(int)
        code = np.where(mask, 0, code)
        return fill_model(code, known, 8), known

    for name in ("sst", "anom", "mhw"):
        want, known = model(name)
        out = pc.pictures(arc, name, "weekly", width=width, subset=subset, grid=grid)
        assert out.first().bucket == days[0]
        np.testing.assert_array_equal(to_array(out, want.shape, "code"), want)
        np.testing.assert_array_equal(to_array(out, want.shape, "opaque").astype(bool), known)
    made = spark.createDataFrame([("sst", "weekly", day("2023-12-25"))], "variable string, period string, bucket date")
    assert pc.pictures(arc, "sst", "weekly", made, width, subset=subset, grid=grid).count() == 0
