"""Regions, weighted rollups and the index state."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.domain import GLOBAL, Box, Grid, Region
from tidegrid.operators import regions as rg
from tidegrid.operators import rollup as ru
from tidegrid.operators import state as sa
from tidegrid.schema import Archive

SST = "date date, gy int, gx int, sst_raw int, has_clim boolean"
CLIM = "mmdd int, gy int, gx int, clim_raw int"
MHW = "date date, gy int, gx int, cat int"
TINY = Grid(resolution=1.0, lat0=0.5, lon0=0.5, nlat=40, nlon=60)


def weight(gy):
    return math.cos(math.radians(GLOBAL.lat0 + gy * GLOBAL.resolution))


def inside(px, py, rings):
    """Even-odd per ring, any ring."""
    hit = False
    for ring in rings:
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        hit = hit or odd
    return hit


def cells_of(spark, rings, grid=TINY):
    region = Region("r", "r", rings=tuple(tuple(r) for r in rings))
    edges = rg.ring_edges(rg.rings_of(spark, [region]))
    return rg.polygon_intervals(edges, grid)


def brute(rings, grid=TINY):
    return {
        (y, x) for y in range(grid.nlat) for x in range(grid.nlon)
        if inside(grid.lon0 + x * grid.resolution, grid.lat0 + y * grid.resolution, rings)
    }


SHAPES = {
    "rectangle": [[(10.0, 5.0), (20.0, 5.0), (20.0, 9.0), (10.0, 9.0)]],
    "edge_on_centres": [[(10.5, 5.5), (20.5, 5.5), (20.5, 9.5), (10.5, 9.5)]],
    "two_squares": [[(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)], [(8.0, 1.0), (11.0, 1.0), (11.0, 4.0), (8.0, 4.0)]],
    "overlapping": [[(1.0, 1.0), (6.0, 1.0), (6.0, 6.0), (1.0, 6.0)], [(4.0, 3.0), (9.0, 3.0), (9.0, 9.0), (4.0, 9.0)]],
    "concave": [[(5.0, 2.0), (30.0, 2.0), (30.0, 30.0), (20.0, 10.0), (15.0, 28.0), (12.0, 8.0)]],
    "bow_tie": [[(2.0, 2.0), (22.0, 22.0), (22.0, 2.0), (2.0, 22.0)]],
    "outside_the_grid": [[(50.0, -5.0), (75.0, -5.0), (75.0, 50.0), (50.0, 50.0)]],
}


@pytest.mark.parametrize("name", SHAPES)
def test_polygon_matches_brute_force(spark, name):
    intervals = cells_of(spark, SHAPES[name])
    cells = [(r.gy, r.gx) for r in rg.interval_cells(intervals).collect()]
    assert len(cells) == len(set(cells)) and set(cells) == brute(SHAPES[name])
    back = rg.cell_intervals(rg.interval_cells(intervals))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, intervals.select(*back.columns).collect()))


def test_random_polygons(spark):
    random.seed(2)
    for _ in range(3):
        ring = [(random.uniform(0, 60), random.uniform(0, 40)) for _ in range(9)]
        got = {(r.gy, r.gx) for r in rg.interval_cells(cells_of(spark, [ring])).collect()}
        assert got == brute([ring])


def test_rectangle_polygon_is_its_box(spark):
    got = {(r.gy, r.gx) for r in rg.interval_cells(cells_of(spark, SHAPES["rectangle"])).collect()}
    assert got == {(y, x) for y in range(5, 9) for x in range(10, 20)}


def test_geojson(spark, tmp_path):
    outer = [[10, 5], [20, 5], [20, 9], [10, 9], [10, 5]]
    hole = [[12, 6], [13, 6], [13, 7], [12, 6]]
    for kind, coords in (("Polygon", [outer, hole]), ("MultiPolygon", [[outer, hole], [[[0, 0], [1, 1], [0, 0]]]])):
        path = tmp_path / f"{kind}.geojson"
        path.write_text(json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": coords}}, indent=1))
        rings = rg.rings_from_geojson(spark, str(path), "zone")
        assert rings.count() == 1  # holes and unusable rings are left out
        got = rg.interval_cells(rg.polygon_intervals(rg.ring_edges(rings), TINY))
        assert got.count() == 40


BOXES = {"all": Box(1500, 2600, 0, 99), "high": Box(2500, 2600, 0, 9), "one": Box(1800, 1800, 3, 3), "empty": Box(1, 2, 1, 2)}


@pytest.fixture(scope="module")
def data():
    random.seed(4)
    rows_ = [1500, 1800, 2500, 2600]
    days = [dt.date(2024, 2, 28) + dt.timedelta(days=i) for i in range(4)]
    sst, mhw = [], []
    for d in days:
        for y in rows_:
            for x in range(8):
                if random.random() < 0.7 or (y, x) == (1800, 3):
                    sst.append((d, y, x, random.randrange(-200, 3200), random.random() < 0.6))
                    if random.random() < 0.3 and d != days[2]:
                        mhw.append((d, y, x, random.randrange(1, 6)))
    mhw.append((dt.date(2024, 5, 1), 1800, 3, 5))  # published before its temperatures
    clim = [(m, y, x, random.randrange(0, 3000)) for m in (228, 229, 301, 302) for y in rows_ for x in range(8)]
    return sst, mhw, clim


@pytest.fixture
def archive(spark, data):
    sst, mhw, clim = data
    return Archive(spark.createDataFrame(sst, SST), spark.createDataFrame(clim, CLIM), spark.createDataFrame(mhw, MHW))


def expected(data, box):
    sst, mhw, _ = data
    within = lambda y, x: box.gy0 <= y <= box.gy1 and box.gx0 <= x <= box.gx1
    out = {}
    for day in {r[0] for r in sst}:
        cells = [r for r in sst if r[0] == day and within(r[1], r[2])]
        if not cells:
            continue
        warm = [r for r in mhw if r[0] == day and within(r[1], r[2])]
        area = sum(weight(r[1]) for r in cells)
        known = [r for r in cells if r[4]]
        out[day] = (
            sum(r[3] * 0.01 * weight(r[1]) for r in cells) / area, len(cells),
            sum(r[3] * 0.01 * weight(r[1]) for r in known) / sum(weight(r[1]) for r in known) if known else None,
            len(known), sum(r[3] * weight(r[1]) for r in warm) / area, sum(weight(r[1]) for r in warm) / area, len(warm),
        )
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_rollup_of_all_regions(spark, archive, data, broadcast, monkeypatch):
    dim = rg.box_rows(spark, BOXES)
    if not broadcast:
        monkeypatch.setattr(rg, "BROADCAST_ROWS", 0)
    got = {(r.region, r.date): tuple(r)[2:] for r in ru.region_daily(archive, dim).collect()}
    want = {(k, d): v for k, b in BOXES.items() for d, v in expected(data, b).items()}
    assert set(got) == set(want)
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=1e-12, nan_ok=False), key


def test_box_extent_equals_rollup(spark, archive):
    box = BOXES["all"]
    dim = rg.box_rows(spark, {"all": box})
    a = {r.date: r.mhw_area_frac * 100 for r in ru.region_daily(archive, dim).collect()}
    b = {r.date: r.value for r in ru.box_extent(archive, box).collect()}
    assert a == pytest.approx(b) and all(0 <= v <= 100 for v in b.values())
    assert b[dt.date(2024, 3, 1)] == 0.0  # a calm day is a day


def test_means_commute_on_equal_cells(spark, data):
    """Box anomaly from two means equals the mean of the cells' anomalies."""
    sst, _, clim = data
    normal = {(m, y, x): c for m, y, x, c in clim}
    days = [(dt.date(2024, 3, 1), y, x, 1000 + 7 * y % 90 + x, True) for _, y, x, _ in clim[:32]]
    arc = Archive(spark.createDataFrame(days, SST), spark.createDataFrame(clim, CLIM))
    got = ru.box_anom(arc, BOXES["all"]).first().value
    area = sum(weight(r[1]) for r in days)
    assert got == pytest.approx(sum((r[3] - normal[301, r[1], r[2]]) * 0.01 * weight(r[1]) for r in days) / area)


def test_days_without_a_normal_drop_out(spark, archive):
    arc = Archive(archive.sst, archive.clim.filter("mmdd <> 229"), archive.mhw)
    assert dt.date(2024, 2, 29) not in {r.date for r in ru.box_anom(arc, BOXES["all"]).collect()}


def test_constant_field_has_that_mean(spark, archive):
    flat = Archive(archive.sst.withColumn("sst_raw", F.lit(1234)), archive.clim, archive.mhw)
    for r in ru.region_daily(flat, rg.box_rows(spark, BOXES)).collect():
        assert r.mean_sst == pytest.approx(12.34)


def test_buckets_keep_the_last_days_cells(frame, day):
    daily = frame("date date, value double, n_cells bigint",
                  [("2024-01-01", 1.0, 5), ("2024-01-03", 3.0, 9), ("2024-01-02", None, 7), ("2024-01-08", 4.0, 1)])
    out = {r.bucket: tuple(r)[1:] for r in ru.fold_buckets(daily, "weekly").collect()}
    assert out == {day("2024-01-01"): (2.0, 2, 9), day("2024-01-08"): (4.0, 1, 1)}


def test_refresh_touches_only_its_dates(spark, archive, frame):
    dim = rg.box_rows(spark, BOXES)
    days = frame("date date", [("2024-02-29",), ("2024-02-29",)])
    out = ru.refresh(archive, dim, days).collect()
    assert {str(r.date) for r in out} == {"2024-02-29"}
    full = {r.region: r for r in ru.region_daily(archive, dim).filter("date = date'2024-02-29'").collect()}
    assert {r.region: r.n_cells for r in out} == {k: r.n_cells for k, r in full.items()}
    assert ru.refresh(archive, dim, days.filter("false")).count() == 0


# ----------------------------------------------------------------------- state


def months(spark, values, start=(2020, 1), region="r", last_days=None):
    out, (y, m) = [], start
    for i, v in enumerate(values):
        first = dt.date(y, m, 1)
        n = ((first + dt.timedelta(days=32)).replace(day=1) - first).days
        if i == len(values) - 1 and last_days:
            n = last_days
        if v is not None:
            out.append((region, first, float(v), n))
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return spark.createDataFrame(out, "region string, month date, anom double, n_days bigint")


def test_episode(spark):
    m = months(spark, [0, 0, 0.3, 0.9, 1.2, 1.5, 1.5, 1.5, 1.2, 1.2, 9.0], last_days=3)
    seasons = sa.running_index(m)
    got = {str(r.middle): r["index"] for r in seasons.collect()}
    assert len(got) == 8 and "2020-10-01" not in got  # the open month is left out
    r = sa.episode_run(seasons).first()
    assert (r.phase, r.seasons, r.episode) == ("el_nino", 6, True)
    assert (str(r.season_end), r.season, r.strength) == ("2020-09-01", "ASO 2020", "moderate")
    latest = sa.latest_month(m).first()
    assert latest.partial and latest["rank"] == 1 and latest.of == 1


def test_sign_flip_ends_a_run(spark):
    r = sa.episode_run(sa.running_index(months(spark, [2, 2, 2, 2, -2, -2, -2, -2]))).first()
    assert (r.phase, r.seasons, r.episode, r.strength) == ("la_nina", 3, False, "very strong")
    r = sa.episode_run(sa.running_index(months(spark, [2, 2, 2, 0, 0, 0]))).first()
    assert (r.phase, r.seasons, r.strength) == ("neutral", 0, None)


def test_no_season_across_a_missing_month(spark):
    assert sa.running_index(months(spark, [1, 1, None, 1, 1])).count() == 0
    assert sa.running_index(months(spark, [1, 1, 1, None, 1, 1, 1])).count() == 2


def test_same_month_rank_shares_ties(spark):
    m = months(spark, [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2])
    jan = {str(r.month): (r["rank"], r.of) for r in sa.same_month_rank(m).collect() if r.month.month == 1}
    assert jan == {"2020-01-01": (3, 3), "2021-01-01": (1, 3), "2022-01-01": (1, 3)}


def test_months_of_equal_days_in_another_order_share_a_rank(frame):
    days = {2001: (0.1, 0.2, 0.3), 2002: (0.3, 0.2, 0.1)}  # as doubles, 0.6000000000000001 and 0.6 in all
    rows = [("r", f"{y}-05-{d + 1:02}", v, 1) for y, vs in days.items() for d, v in enumerate(vs)]
    roll = frame("region string, date date, mean_sst_clim double, n_cells_clim bigint", rows).coalesce(1)
    normals = frame("region string, mmdd int, mean_clim double", [("r", 501 + d, 0.0) for d in range(3)]).coalesce(1)
    out = sa.same_month_rank(sa.monthly_index(roll, normals)).collect()
    assert [(r["rank"], r.of, r.n_days) for r in out] == [(1, 2, 3), (1, 2, 3)]


def test_normal_wraps_the_year(frame):
    days = [("1996-12-28", 0.2), ("1997-01-05", 0.4), ("1997-07-01", 0.9), ("1997-01-10", 0.8), ("2021-01-02", 0.6)]
    roll = frame("region string, date date, mhw_area_frac double, n_cells bigint", [("r", d, v, 1) for d, v in days])
    r = sa.extent_state(roll).first()
    assert (r.extent, r["rank"], r.of) == (60.0, 3, 5) and r.normal == pytest.approx(30.0) and r.ratio == pytest.approx(2.0)
    assert sa.extent_state(roll, (1900, 1901)).first().normal is None


def test_rollups_are_the_same_for_every_partitioning(spark):
    random.seed(3)
    cells = [(dt.date(2024, 1, 1 + k % 3), 900 + random.randrange(700), 2400 + random.randrange(900), random.randrange(-200, 3200), k % 5 > 0) for k in range(4000)]
    sst = spark.createDataFrame(sorted({c[:3]: c for c in cells}.values()), "date date, gy int, gx int, sst_raw int, has_clim boolean")
    mhw = sst.filter("sst_raw % 4 = 1").selectExpr("date", "gy", "gx", "cast(1 + sst_raw % 5 as int) as cat").filter("cat > 0")
    dim = rg.box_rows(spark, {"a": Box(900, 1300, 2400, 3000), "b": Box(1000, 1599, 2500, 3299), "none": Box(0, 3, 0, 3)})
    found = set()
    for n in (1, 8, 211):
        arc = Archive(sst.repartition(n), None, mhw.repartition(n))
        parts = [ru.region_parts(t, p, dim) for p, t in (("sst", arc.sst), ("mhw", arc.mhw))]
        halves = [ru.region_parts(t.filter(c), p, dim) for p, t in (("sst", arc.sst), ("mhw", arc.mhw)) for c in ("gx % 2 = 0", "gx % 2 = 1")]
        for df in (ru.region_daily(arc, dim), ru.rollup_of(ru.added(*parts)), ru.rollup_of(ru.added(*halves))):
            found.add(tuple(sorted(map(tuple, df.collect()))))
        found.add(tuple(sorted(map(tuple, ru.refresh(arc, dim, sst.select("date")).collect()))))
    assert len(found) == 1 and len(found.pop()) == 6
    box = {tuple(sorted(map(tuple, ru.box_sst(Archive(sst.repartition(n)), Box(900, 1300, 2400, 3000)).collect()))) for n in (1, 8, 211)}
    assert len(box) == 1


def test_days_without_cells_have_rows_of_zeros(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "date date")
    sst = spark.createDataFrame([(dt.date(2024, 1, 1), 1, 1, 100, True)], "date date, gy int, gx int, sst_raw int, has_clim boolean")
    dim = rg.box_rows(spark, {"a": Box(0, 3, 0, 3), "b": Box(5, 6, 5, 6)})
    parts = ru.whole_days(ru.region_parts(sst, "sst", dim), ["a", "b"], days, "sst")
    assert {(r.region, r.date.day): r.n_cells for r in parts.collect()} == {("a", 1): 1, ("a", 2): 0, ("b", 1): 0, ("b", 2): 0}
    out = {(r.region, r.date.day): (r.mean_sst, r.mean_mhw, r.n_cells, r.n_cells_mhw) for r in ru.rollup_of(parts, keep_empty=True).collect()}
    assert out["a", 1] == (1.0, 0.0, 1, 0) and out["b", 2] == (None, None, 0, 0) and len(out) == 4
    assert ru.rollup_of(parts).count() == 1


def test_regions_of_the_same_rows_are_summed_once_and_reported_each(spark):
    random.seed(5)
    cells = {(dt.date(2024, 1, 1 + k % 3), random.randrange(40), random.randrange(40)): k for k in range(900)}
    sst = spark.createDataFrame([(*c, k % 300, k % 4 > 0) for c, k in cells.items()], "date date, gy int, gx int, sst_raw int, has_clim boolean")
    mhw = sst.filter("sst_raw % 4 = 1").selectExpr("date", "gy", "gx", "cast(1 + sst_raw % 5 as int) as cat")
    clim = sst.filter("has_clim and date = date'2024-01-01'").selectExpr("101 as mmdd", "gy", "gx", "sst_raw as clim_raw")
    arc = Archive(sst, clim, mhw)
    one = [(gy, 3 + gy % 5, 20 - gy % 3) for gy in range(5, 25)]
    other = [*one, (30, 0, 1)]
    rows = [(name, *r) for name, shape in (("b", one), ("a", one), ("c", other), ("d", one)) for r in shape]
    listed = spark.createDataFrame(rows, "region string, gy int, gx0 int, gx1 int")
    dim = rg.interval_rows(listed)
    assert dim.rows == len(one) + len(other)
    plain = rg.RegionRows(listed.withColumn("weight", rg.area_weight("gy")), len(rows), Box(0, 39, 0, 39))
    boxes = rg.box_rows(spark, {"box": Box(5, 8, 3, 20)})
    both, apart = rg.combine(boxes, dim), rg.combine(boxes, plain)
    for rollup in (lambda d: ru.region_daily(arc, d), lambda d: ru.region_clim(clim, d), lambda d: ru.region_parts(sst, "sst", d), lambda d: ru.region_parts(mhw, "mhw", d)):
        got = sorted(map(tuple, rollup(both).collect()), key=str)
        assert got == sorted(map(tuple, rollup(apart).collect()), key=str) and {r[0] for r in got} == {"a", "b", "c", "d", "box"}
    assert rg.interval_rows(listed.filter("false")).rows == 0
