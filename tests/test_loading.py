"""Day files, planning, the store, the daily run and its stream form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.domain import Box, Grid, Region, outlined
from tidegrid.operators import ingest as ig
from tidegrid.operators.rollup import region_daily
from tidegrid.plans import daily as pl
from tidegrid.sources import export as ex
from tidegrid.sources import gridfiles as gf
from tidegrid.sources.store import Store
from tidegrid.streaming import daily as stream

G = Grid(resolution=45.0, lat0=-67.5, lon0=22.5, nlat=4, nlon=8)
BOX = Box(1, 2, 2, 6)
ALL = Box(0, 3, 0, 7)
ROWS = "date date, row int, values array<smallint>"
T0 = dt.datetime(2024, 3, 1, 12)


def grid_rows(spark, day, value=lambda r, c: 10 * r + c, mask=None):
    rows = [(day, r, [value(r, c) for c in range(8)]) for r in range(4)]
    if mask is None:
        return spark.createDataFrame(rows, ROWS)
    rows = [(*t, [mask(t[1], c) for c in range(8)]) for t in rows]
    return spark.createDataFrame(rows, f"{ROWS}, mask array<tinyint>")


def cells(df, name):
    return {(r.gy, r.gx): r[name] for r in df.collect()}


def test_roll_subset_and_fill(spark, day):
    rows = grid_rows(spark, day("2024-01-01"), lambda r, c: -32768 if (r, c) == (1, 0) else 10 * r + c)
    got = cells(gf.sst_cells(rows, BOX, G), "sst_raw")
    want = {(r, (c + 4) % 8): 10 * r + c for r in (1, 2) for c in range(8) if 2 <= (c + 4) % 8 <= 6 and (r, c) != (1, 0)}
    assert got == want


def test_flip_for_climatology(spark, day):
    rows = grid_rows(spark, day("2024-01-01")).select(F.lit(101).alias("mmdd"), "row", "values")
    got = cells(gf.clim_cells(rows, BOX, G), "clim_raw")
    assert got[1, 4] == 20 and got[2, 4] == 10


def test_odd_width_rolls_like_numpy(spark, day):
    import numpy as np

    g = Grid(1.0, 0.0, 0.0, nlat=1, nlon=7)
    rows = spark.createDataFrame([(day("2024-01-01"), 0, list(range(7)))], ROWS)
    got = cells(gf.grid_to_cells(rows, Box(0, 0, 0, 6), grid=g), "raw")
    assert [got[0, i] for i in range(7)] == np.roll(np.arange(7), 7 // 2).tolist()


def test_shape_problems(spark, day):
    good = grid_rows(spark, day("2024-01-01"))
    short = grid_rows(spark, day("2024-01-02")).filter("row < 3")
    narrow = grid_rows(spark, day("2024-01-03")).withColumn("values", F.slice("values", 1, F.when(F.col("row") == 1, 7).otherwise(8)))
    twice = grid_rows(spark, day("2024-01-04")).withColumn("row", F.when(F.col("row") == 2, 1).otherwise(F.col("row")))
    out = gf.shape_problems(good.unionByName(short).unionByName(narrow).unionByName(twice), G)
    assert {str(r.date) for r in out.collect()} == {"2024-01-02", "2024-01-03", "2024-01-04"}
    ends = grid_rows(spark, day("2024-01-05")).withColumn("row", F.when(F.col("row") < 2, 0).otherwise(3))
    blank = grid_rows(spark, day("2024-01-06")).withColumn("values", F.when(F.col("row") != 2, F.col("values")))
    assert gf.shape_problems(ends.unionByName(blank).unionByName(good), G).count() == 2
    with pytest.raises(ValueError):
        gf.subset_box(gf.Subset("x", (0.0, 1.0), (0.0, 1.0), 7, 7))
    assert gf.subset_box() == Box(600, 3099, 2000, 5799)


def test_listing(spark, day, tmp_path):
    names = ["coraltemp_v3.1_20240101.nc", "coraltemp_v3.1_20241301.nc", "coraltemp_v3.1_20240102.nc.part",
             "noaa-crw_mhw_v1.0.1_category_20240103.nc", "coraltemp_v3.1_20240230.nc", "other.nc"]
    for n in names:
        (tmp_path / n).write_text("x")
    listing = gf.folder_listing(spark, str(tmp_path))
    assert [tuple(r) for r in gf.archive_listing(listing, "sst").collect()] == [(names[0], day("2024-01-01"))]
    assert [r.date for r in gf.archive_listing(listing, "mhw").collect()] == [day("2024-01-03")]
    clim = "ct5km_v3.1_clim-sst-mean-daily-window-01day-01grid-source{}_day0229.nc"
    paths = spark.createDataFrame([(clim.format("19912020"),), (clim.format("20012030"),)], "path string")

    assert gf.clim_listing(paths).first().filename.endswith("source20012030_day0229.nc")


def test_land_repair(spark, day):
    leap, fine, lone = day("2024-02-29"), day("2024-02-28"), day("2020-02-29")
    codes = {d: grid_rows(spark, d, lambda r, c: 5) for d in (leap, fine, lone)}
    masks = [grid_rows(spark, leap, lambda r, c: 0), grid_rows(spark, fine, lambda r, c: 2 if c == 0 else 0), grid_rows(spark, lone, lambda r, c: 0)]
    both = codes[leap].unionByName(codes[fine]).unionByName(codes[lone])
    land = gf.carries_land(masks[0].unionByName(masks[1]).unionByName(masks[2]))
    ocean = gf.sst_cells(grid_rows(spark, leap, lambda r, c: 1 if c < 3 else -32768), ALL, G)
    out, stuck = gf.repair_land(gf.class_cells(both, ALL, G), land, ocean)
    counts = {r.date: r["count"] for r in out.groupBy("date").count().collect()}
    assert counts == {leap: 12, fine: 32}
    assert [r.date for r in stuck.collect()] == [lone]


STATUS = "product string, date date, status string, remote_size bigint, remote_modified string"


def test_plan_and_revisions(frame, day):
    ok, bad = "success_ingest", "failed_ingest"
    status = frame(STATUS, [("sst", "2024-01-01", ok, 10, "a"), ("sst", "2024-01-02", ok, 10, "a"),
                            ("sst", "2024-01-03", ok, 10, "a"), ("sst", "2024-01-04", ok, 0, ""),
                            ("sst", "2024-01-05", bad, 10, "a"), ("sst", "2024-01-07", "ingesting", 0, None),
                            ("sst", "2024-01-08", ok, 10, None)])
    remote = frame("product string, date date, filename string, size bigint, modified string",
                   [("sst", f"2024-01-0{d}", "f", s, m) for d, s, m in (
                       (1, 10, "a"), (2, 11, "a"), (3, 10, "b"), (4, 99, "z"), (5, 10, "a"), (6, 10, "a"), (7, 10, "a"), (8, 10, "q"))])
    plan = {r.date.day: r.action for r in ig.ingest_plan(remote, status).collect()}
    assert plan == {1: "skip", 2: "replace", 3: "replace", 4: "skip", 5: "load", 6: "load", 7: "replace", 8: "skip"}
    bare = {r.date.day: r.action for r in ig.ingest_plan(remote.drop("size", "modified"), status).collect()}
    assert bare[2] == "skip" and bare[5] == "load"
    forced = {r.date.day: r.action for r in ig.ingest_plan(remote, status, force=True).collect()}
    assert forced[1] == "replace" and forced[6] == "load" and "skip" not in forced.values()
    current = {r.date.day: r.current for r in ig.revised_dates(status, remote).collect()}
    assert [d for d, c in current.items() if c] and not current[2] and not current[6] and current[4]


def targets(df):
    return {str(r.date)[5:]: r.reason for r in df.collect()}


def test_run_targets(frame, day):
    ok = "success_ingest"
    status = lambda *rows: frame("product string, date date, status string", list(rows))
    y = day("2024-01-10")
    none = status(("sst", "2024-01-03", ok))
    assert targets(ig.run_targets(none, y, recheck_days=2)) == {"01-10": "catch_up", "01-09": "recheck", "01-08": "recheck"}
    both = status(("sst", "2024-01-08", ok), ("mhw", "2024-01-06", ok), ("mhw", "2024-01-09", "failed_ingest"))
    assert targets(ig.run_targets(both, y)) == {f"01-{d:02d}": "catch_up" for d in (7, 8, 9, 10)}
    assert targets(ig.run_targets(both, y, max_days=0)) == targets(ig.run_targets(both, y))
    assert targets(ig.run_targets(both, y, max_days=2, recheck_days=5)) == {
        "01-07": "catch_up", "01-08": "catch_up", "01-05": "recheck", "01-06": "recheck"}
    done = status(("sst", "2024-01-10", ok), ("mhw", "2024-01-10", ok))
    assert targets(ig.run_targets(done, y, recheck_days=1)) == {"01-10": "catch_up", "01-09": "recheck"}


def test_buckets_of_dates(frame, day):
    out = ig.affected_buckets(frame("date date", [("2024-02-29",)])).collect()
    assert len(out) == 9
    assert {(r.period, str(r.bucket)) for r in out} == {("daily", "2024-02-29"), ("weekly", "2024-02-26"), ("monthly", "2024-02-01")}
    span = frame("lo date, hi date", [("2024-01-03", "2024-02-04")])
    closed = {(r.period, str(r.bucket)) for r in ig.closed_buckets(span).collect()}
    assert {b for p, b in closed if p == "weekly"} == {"2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"}
    assert {b for p, b in closed if p == "monthly"} == {"2024-01-01"}
    assert len([1 for p, _ in closed if p == "daily"]) == 33
    made = frame("variable string, period string, bucket date", [("sst", "monthly", "2024-01-01")])
    left = ig.pending_buckets(ig.closed_buckets(span), made)
    assert left.count() == 39 * 3 - 1 and ig.pending_buckets(ig.closed_buckets(span), made, force=True).count() == 39 * 3
    assert ig.pending_buckets(ig.closed_buckets(span), made, limit=5).count() == 5
    files = frame("product string, date date", [("sst", d) for d in ("2024-01-28", "2024-01-29", "2024-02-01")])
    assert [str(r.date) for r in ig.retention_list(files, day("2024-02-02")).collect()] == ["2024-01-28"]


def test_leap_plan_and_outcomes(frame):
    status = frame("product string, date date, status string",
                   [("mhw", "2019-05-01", "success_ingest"), ("mhw", "2024-02-29", "success_ingest"), ("sst", "2030-01-01", "success_ingest")])
    out = ig.leap_repair_plan(status).collect()
    assert {str(r.leap_day) for r in out} == {"2020-02-29", "2024-02-29"}
    days = {str(r.date) for r in out if str(r.leap_day) == "2024-02-29"}
    assert min(days) == "2024-02-01" and max(days) == "2024-03-03" and len(days) == 32
    res = frame("date date, outcome string", [("2024-01-01", "skipped"), ("2024-01-01", "failed"), ("2024-01-02", "ingested"),
                                              ("2024-01-02", "unpublished"), ("2024-01-03", "unpublished")])
    assert {str(r.date)[-1]: r.outcome for r in ig.date_outcome(res).collect()} == {"1": "failed", "2": "ingested", "3": "unpublished"}


def test_layout_counts(spark, frame):
    old = frame("date date, v int", [("2020-01-01", 1), ("2020-01-02", 1), ("2021-01-01", 1)])
    assert ig.layout_mismatch(old, old).count() == 0
    moved = frame("date date, v int", [("2020-01-01", 1), ("2021-01-01", 1), ("2021-01-01", 1)])
    assert sorted(tuple(r) for r in ig.layout_mismatch(old, moved).collect()) == [(2020, 2, 1, False), (2021, 1, 2, False)]
    with pytest.raises(ValueError):
        Store.verify_copy(old, moved, "t")


# ------------------------------------------------------------------ store and run

REGIONS = {
    "half": Region("half", "Half", (-70.0, 0.0), (0.0, 359.0)),
    "tri": outlined("tri", "Triangle", (((0.0, -90.0), (359.9, -90.0), (180.0, 90.0), (0.0, -90.0)),)),
}


def files_of(spark, product, days, **extra):
    cols = {"filename": "f", **extra}
    return spark.createDataFrame([(product, d, *cols.values()) for d in days], "product string, date date, " + ", ".join(
        f"{k} {'bigint' if k == 'size' else 'string'}" for k in cols))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "archive"), buckets=2)
    clim = spark.createDataFrame(
        [(m, r, [100 + c for c in range(8)]) for m in (228, 229, 301) for r in range(4)], "mmdd int, row int, values array<smallint>")
    pl.load_climatology(s, clim, ALL, grid=G)
    pl.load_climatology(s, clim, ALL, grid=G)  # all present: adds nothing
    pl.build_region_cells(s, REGIONS, G)
    pl.build_region_clim(s, T0, REGIONS, G)
    return s


def load(store, product, rows, days, at, **kw):
    files = files_of(store.spark, product, days, **kw.pop("files", {}))
    return {str(r.date): r.outcome for r in pl.process_days(
        store, {product: (rows, files)}, at, ALL, regions=REGIONS, grid=G, **kw).collect()}


def rolled(store):
    return {(r.region, str(r.date)): r for r in store.latest("region_daily").collect()}


def test_store_layout_and_climatology(store):
    assert store.read("sst_clim").count() == 3 * 32
    assert store.latest("region_clim").groupBy("region").count().count() == 2
    assert store.read("sst_daily").count() == 0 and store.read("sst_daily").columns[-1] == "part"
    cells = store.read("region_cells")
    assert {r.region for r in cells.select("region").distinct().collect()} == {"tri"}


def test_late_category_corrects_the_zero(spark, store, day):
    d = day("2024-02-28")
    assert load(store, "sst", grid_rows(spark, d), [d], T0) == {"2024-02-28": "ingested"}
    assert rolled(store)["half", "2024-02-28"].mhw_area_frac == 0
    later = T0 + dt.timedelta(hours=2)
    mhw = grid_rows(spark, d, lambda r, c: 3 if c < 4 else 0, mask=lambda r, c: 2 if c == 7 else 0)
    load(store, "mhw", mhw, [d], later)
    assert rolled(store)["half", "2024-02-28"].mhw_area_frac == pytest.approx(0.5)
    before = (store.read("mhw_daily").count(), {k: tuple(r)[:9] for k, r in rolled(store).items()})
    load(store, "mhw", mhw, [d], later + dt.timedelta(hours=1), force=True)  # replay
    assert (store.read("mhw_daily").count(), {k: tuple(r)[:9] for k, r in rolled(store).items()}) == before
    store.compact("region_daily")
    assert store.read("region_daily").count() == 2 and len(rolled(store)) == 2
    store.drop_regions("region_daily", ["tri"])
    assert set(rolled(store)) == {("half", "2024-02-28")}


def test_bad_day_does_not_stop_the_others(spark, store, day):
    good, bad, leap = day("2024-02-28"), day("2024-03-01"), day("2024-02-29")
    rows = grid_rows(spark, good).unionByName(grid_rows(spark, bad).filter("row > 0"))
    assert load(store, "sst", rows, [good, bad], T0) == {"2024-02-28": "ingested", "2024-03-01": "failed"}
    st = {str(r.date): r for r in store.status().collect()}
    assert st["2024-02-28"].status == "success_ingest" and st["2024-02-28"].n_rows == 32
    assert st["2024-03-01"].status == "failed_ingest" and "4 x 8" in st["2024-03-01"].message
    # a leap day without land, and no temperatures to repair it from
    out = load(store, "mhw", grid_rows(spark, leap, lambda r, c: 5, mask=lambda r, c: 0), [leap], T0)
    assert out == {"2024-02-29": "failed"} and store.read("mhw_daily").count() == 0


def test_skip_replace_and_parts(spark, store, day):
    d1, d2 = day("2024-02-28"), day("2019-02-28")
    both = grid_rows(spark, d1).unionByName(grid_rows(spark, d2))
    load(store, "sst", both, [d1, d2], T0, files={"size": 5, "modified": "a"})
    assert {r.part for r in store.read("sst_daily").select("part").distinct().collect()} == {2024, 2010}
    assert load(store, "sst", both, [d1, d2], T0 + dt.timedelta(1), files={"size": 5, "modified": "a"}) == {
        "2024-02-28": "skipped", "2019-02-28": "skipped"}
    revised = grid_rows(spark, d1, lambda r, c: 7 if c else -32768)
    assert load(store, "sst", revised, [d1], T0 + dt.timedelta(2), files={"size": 6, "modified": "b"}) == {"2024-02-28": "ingested"}
    counts = {str(r.date): r["count"] for r in store.read("sst_daily").groupBy("date").count().collect()}
    assert counts == {"2024-02-28": 28, "2019-02-28": 32}
    store.recluster("sst", [2024, 2010])
    assert store.read("sst_daily").count() == 60
    # replacing with nothing empties the day, and its partition
    store.replace_days("sst", store.read("sst_daily").filter("false"), [d1])
    assert {str(r.date) for r in store.read("sst_daily").collect()} == {"2019-02-28"}
    store.reset(["sst"])
    assert store.read("sst_daily").count() == 0 and store.status().count() == 0


def test_failed_write_is_recorded_and_retried(spark, store, day, monkeypatch):
    d = day("2024-02-28")
    real = Store.append_days
    monkeypatch.setattr(Store, "append_days", lambda *a: (_ for _ in ()).throw(OSError("disk gone")))
    assert load(store, "sst", grid_rows(spark, d), [d], T0) == {"2024-02-28": "failed"}
    assert "disk gone" in store.status().first().message
    monkeypatch.setattr(Store, "append_days", real)
    assert load(store, "sst", grid_rows(spark, d), [d], T0 + dt.timedelta(1)) == {"2024-02-28": "ingested"}
    assert store.read("sst_daily").count() == 32


def test_broken_off_run_is_replaced(spark, store, day):
    d = day("2024-02-28")
    rows = grid_rows(spark, d)
    store.append_days("sst", ig.flag_climatology(gf.sst_cells(rows, ALL, G), store.read("sst_clim")))
    mine = files_of(spark, "sst", [d]).withColumn("action", F.lit("load"))
    none = spark.createDataFrame([], "product string, date date, n_rows bigint")
    ok = spark.createDataFrame([], "product string, date date, problem string")
    store.append("ingest_status", ig.status_rows(mine, none, ok, T0).withColumn("status", F.lit("ingesting")))
    assert load(store, "sst", rows, [d], T0 + dt.timedelta(1)) == {"2024-02-28": "ingested"}
    assert store.read("sst_daily").count() == 32


def test_run(spark, store, day):
    d1, d2, d3 = day("2024-02-28"), day("2024-02-29"), day("2024-03-01")
    load(store, "sst", grid_rows(spark, d1), [d1], T0)
    load(store, "mhw", grid_rows(spark, d1, lambda r, c: 1, mask=lambda r, c: 2), [d1], T0)
    rows = {"sst": grid_rows(spark, d2).unionByName(grid_rows(spark, d1)), "mhw": grid_rows(spark, d2, lambda r, c: 2, mask=lambda r, c: 0)}
    listings = {"sst": files_of(spark, "sst", [d1, d2]), "mhw": files_of(spark, "mhw", [d2])}
    out = pl.run(store, listings, rows, d3, T0 + dt.timedelta(1), ALL, recheck_days=3, regions=REGIONS, grid=G)
    assert {str(r.date): r.outcome for r in out.collect()}["2024-02-29"] == "ingested"
    assert {str(r.date): r.outcome for r in out.collect()}["2024-03-01"] == "unpublished"
    assert [str(v) for v in store.edges().first()] == ["2024-02-28", "2024-02-29"]
    cover = ig.coverage(store.status(), store.read("sst_clim")).first()
    assert (cover.rows, cover.days, cover.mhw_days, cover.mhw_complete, cover.clim_complete) == (64, 2, 2, True, False)
    assert {r.variable: r.ready for r in ig.readiness(ig.coverage(store.status(), store.read("sst_clim"))).collect()} == {
        "sst": True, "anom": False, "mhw": True}
    assert ig.orientation_check(store.read("sst_daily"), store.read("sst_clim")).agg(F.max("orphans")).first()[0] == 0


def test_layout_rewrite(spark, store, day, tmp_path, monkeypatch):
    flat = str(tmp_path / "flat")
    d = [day("2024-02-28"), day("1999-01-01")]
    rows = grid_rows(spark, d[0]).unionByName(grid_rows(spark, d[1]))
    ig.flag_climatology(gf.sst_cells(rows, ALL, G), store.read("sst_clim")).write.parquet(flat)
    store.rewrite_layout("sst_daily", flat)
    assert store.read("sst_daily").count() == 64 and store.read("sst_daily").filter("part = 1990").count() == 32
    monkeypatch.setattr(Store, "_write_bucketed", lambda self, t, r, p: r.limit(10).write.parquet(p))
    with pytest.raises(ValueError):
        store.rewrite_layout("sst_daily", flat)
    assert store.read("sst_daily").count() == 64


def test_stream_gives_the_same_as_the_batch(spark, store, day, tmp_path):
    landing, d = tmp_path / "landing", [day("2024-02-28"), day("2024-03-01")]
    for x in d:
        grid_rows(spark, x).coalesce(1).write.mode("append").parquet(str(landing / "sst"))
        grid_rows(spark, x, lambda r, c: 4 if r else 0, mask=lambda r, c: 2 if r == 0 else 0).coalesce(1).write.mode("append").parquet(str(landing / "mhw"))
    clock = iter(T0 + dt.timedelta(hours=i) for i in range(20))
    for product in ("sst", "mhw"):
        q = stream.start(store, str(landing), product, ALL, str(tmp_path / f"cp_{product}"), regions=REGIONS, grid=G,
                         clock=lambda: next(clock), files_per_batch=1)
        q.awaitTermination(120)
        assert q.exception() is None
    assert store.read("sst_daily").count() == 64 and store.read("mhw_daily").count() == 48
    streamed = {k: tuple(r)[2:9] for k, r in rolled(store).items()}
    dim = pl.region_dimension(store, REGIONS, G)
    direct = {(r.region, str(r.date)): tuple(r)[2:] for r in region_daily(store.archive(), dim).collect()}
    assert set(streamed) == set(direct)
    for k in direct:
        assert streamed[k] == pytest.approx(direct[k])


def test_region_cells_are_replaced(spark, store):
    assert store.read("region_cells").count() > 0
    box_now = {"tri": Region("tri", "t", (0.0, 1.0), (0.0, 1.0))}
    pl.build_region_cells(store, box_now, G)
    assert store.read("region_cells").count() == 0


# ---------------------------------------------------------------------- exports


def test_series_csv(spark, frame, tmp_path):
    s = frame("bucket date, value double", [("2024-05-13", None), ("2024-05-06", -0.125), ("2024-05-20", 3.0)])
    rows = ex.series_rows(s, "anom", "weekly")
    out = str(tmp_path / "csv")
    ex.write_csv(rows, out, ["start_date"], single=True)
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes().decode() == (
        "start_date,end_date,anom_degC\r\n2024-05-06,2024-05-12,-0.13\r\n2024-05-13,2024-05-19,\r\n2024-05-20,2024-05-26,3.00\r\n")
    assert ex.value_column("mhw", region=True) == "mhw_extent_pct" and ex.value_column("mhw", region=False) == "mhw"
    assert ex.value_column("sst", region=True, mean=True) == "mean_sst_degC"


def test_ranking_csv(spark, tmp_path, frame):
    rk = frame("month int, year int, mean double, sd double, n bigint, rank int, partial boolean",
               [(1, 2020, 1.5, None, 3, 1, True), (0, 2020, 0.5, 0.25, 9, 1, False)])
    month, year = ex.ranking_rows(rk, "anom"), ex.ranking_rows(rk, "anom", "year")
    assert month.columns == ["month", "month_name", "year", "rank", "mean_anom_degC", "sd", "days", "partial"]
    assert tuple(month.first()) == (1, "January", 2020, 1, "1.50", None, 3, "true")
    assert tuple(year.first()) == (2020, 1, "0.50", "0.25", 9, "false")
    with pytest.raises(ValueError):
        ex.ranking_rows(rk, "anom", "week")
    ex.write_csv(month, str(tmp_path / "r"), ["month", "rank"])


def test_leap_days_are_loaded_again(spark, store, day):
    leap = day("2024-02-29")
    load(store, "sst", grid_rows(spark, leap, lambda r, c: 1 if c < 4 else -32768), [leap], T0)
    load(store, "mhw", grid_rows(spark, leap, lambda r, c: 5, mask=lambda r, c: 2), [leap], T0)  # an older, wrong load
    assert store.read("mhw_daily").count() == 32
    rows = grid_rows(spark, leap, lambda r, c: 5, mask=lambda r, c: 0)
    out = pl.repair_leap_days(store, rows, files_of(spark, "mhw", [leap]), T0 + dt.timedelta(1), ALL, regions=REGIONS, grid=G)
    assert [r.outcome for r in out.collect()] == ["ingested"]
    assert store.read("mhw_daily").count() == 16 and rolled(store)["half", "2024-02-29"].mhw_area_frac == pytest.approx(1.0)


def test_landed_files_carry_their_facts(spark, store, day, tmp_path):
    grid_rows(spark, day("2024-02-28")).coalesce(1).write.parquet(str(tmp_path / "sst"))
    rows, files = pl.landed(store, str(tmp_path), "sst")
    f = files.first()
    assert rows.count() == 4 and f.filename.endswith(".parquet") and f["size"] > 0 and f["modified"].startswith("20")


def test_command_line(spark, store, day, tmp_path, capsys):
    from tidegrid.__main__ import main, parser

    landing = tmp_path / "landing"
    for p, extra in (("sst", {}), ("mhw", {"mask": lambda r, c: 2})):
        grid_rows(spark, day("2024-02-28"), **extra).coalesce(1).write.parquet(str(landing / p))
    grid_rows(spark, day("2024-02-28")).select(F.lit(228).alias("mmdd"), "row", "values").write.parquet(str(landing / "clim"))
    root = ["--root", store.root, "--landing", str(landing)]
    assert main([*root, "status"]) == 0
    assert main([*root, "scan"]) == 0
    assert main([*root, "verify-clim"]) == 1
    text = capsys.readouterr().out
    assert "0101  missing" in text and "0228  expected a 3600 x 7200 grid" in text
    assert main([*root, "init"]) == 1  # partial climatology
    # a 4 x 8 file is not the global grid: recorded as failed, and the command says so
    assert main([*root, "backfill", "--product", "sst"]) == 1
    assert store.status().first().status == "failed_ingest"
    assert parser().parse_args([*root, "run", "--max-days", "2"]).recheck_days == 3


# ------------------------------------------------------------------------ guards


def clim_files(spark, value=lambda m, r, c: 100 + c, mmdds=(228, 229, 301)):
    return spark.createDataFrame(
        [(m, r, [value(m, r, c) for c in range(8)]) for m in mmdds for r in range(4)], "mmdd int, row int, values array<smallint>")


def test_bad_climatologies_are_refused(spark, store, day, monkeypatch):
    before = sorted(map(tuple, store.read("sst_clim").collect()))
    doubled = clim_files(spark).withColumn("row", F.when(F.col("row") < 2, 0).otherwise(3))
    with pytest.raises(ValueError, match="0228"):
        pl.load_climatology(store, doubled, ALL, force=True, grid=G)
    d = day("2024-02-28")
    load(store, "sst", grid_rows(spark, d, lambda r, c: 5 if r < 2 else -32768), [d], T0)
    north = clim_files(spark, lambda m, r, c: 100 if r < 2 else -32768)  # north-up: the other half of the rows
    with pytest.raises(ValueError, match="2024-02-28"):
        pl.load_climatology(store, north, ALL, force=True, grid=G)
    fewer = clim_files(spark, lambda m, r, c: 100 if r == 3 else -32768)
    with pytest.raises(ValueError, match="anew"):
        pl.load_climatology(store, fewer, ALL, force=True, grid=G)
    assert sorted(map(tuple, store.read("sst_clim").collect())) == before


def test_a_broken_climatology_load_leaves_the_old_one(spark, store, monkeypatch):
    before = sorted(map(tuple, store.read("sst_clim").collect()))
    monkeypatch.setattr(Store, "_swap", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        pl.load_climatology(store, clim_files(spark, lambda m, r, c: 7), ALL, force=True, grid=G)
    assert sorted(map(tuple, store.read("sst_clim").collect())) == before


def test_reset_forgets_the_status_first(spark, store, day, monkeypatch):
    d = day("2024-02-28")
    load(store, "sst", grid_rows(spark, d), [d], T0)
    monkeypatch.setattr(Store, "_delete", lambda self, path: (_ for _ in ()).throw(OSError("lost")) if path.endswith("sst_daily") else None)
    with pytest.raises(OSError):
        store.reset(["sst"])
    assert store.loaded_days("sst").count() == 0  # the day will be loaded again


def test_nothing_to_process(store):
    assert pl.process_days(store, {}, T0, ALL, regions=REGIONS, grid=G).count() == 0


def test_a_date_that_loses_its_cells(spark, store, day):
    d = day("2024-02-28")
    load(store, "sst", grid_rows(spark, d), [d], T0)
    assert ("half", "2024-02-28") in rolled(store)
    load(store, "sst", grid_rows(spark, d, lambda r, c: -32768), [d], T0 + dt.timedelta(hours=1), force=True)
    assert rolled(store) == {}
    load(store, "sst", grid_rows(spark, d), [d], T0 + dt.timedelta(hours=2), force=True)
    assert rolled(store)["half", "2024-02-28"].n_cells > 0


def test_one_row_lost_and_one_doubled_in_a_year(frame):
    old = frame("date date, v int", [("2020-01-01", 1), ("2020-01-02", 2)])
    new = frame("date date, v int", [("2020-01-01", 1), ("2020-01-01", 1)])
    assert [tuple(r) for r in ig.layout_mismatch(old, new).collect()] == [(2020, 2, 2, False)]


def test_a_revised_day_changes_its_pictures(spark, store, day):
    from tidegrid.domain import Subset
    from tidegrid.plans import pictures

    small = Subset("s", (-67.5, 67.5), (22.5, 337.5), 4, 8)
    d = day("2024-02-28")
    shown = lambda: {(r.variable, r.period): r.c for r in spark.read.parquet(store.path("pictures")).groupBy("variable", "period").agg(F.sum("code").alias("c")).collect()}
    where = {"width": 8, "subset": small, "grid": G}

    def run(value, at):
        files = files_of(spark, "sst", [d])
        out = pl.process_days(store, {"sst": (grid_rows(spark, d, value), files)}, at, ALL, regions=REGIONS, grid=G, force=True)
        return pictures.redraw(store, spark.createDataFrame(out.collect(), out.schema), **where)

    assert run(lambda r, c: 500, T0) == 9
    before = shown()
    assert run(lambda r, c: 900, T0 + dt.timedelta(hours=1)) == 9
    after = shown()
    assert all(after["sst", p] != before["sst", p] for p in ("daily", "weekly", "monthly"))
    assert store.read("picture_list").distinct().count() == 9
    none = spark.createDataFrame([], "date date, outcome string")
    assert pictures.redraw(store, none, **where) == 0


# --------------------------------------------------------- files, parts and breaks


def some_cells(spark, days, value=1):
    rows = [(d, y, x, value, True) for d in days for y in (1, 40) for x in range(0, 100, 9)]
    return spark.createDataFrame(rows, "date date, gy int, gx int, sst_raw int, has_clim boolean")


def test_batches_end_with_the_files_of_one(spark, tmp_path, day):
    many, one = Store(spark, f"{tmp_path}/many", buckets=2), Store(spark, f"{tmp_path}/one", buckets=2)
    days = [day("2024-01-01") + dt.timedelta(k) for k in range(6)]
    one.append_days("sst", some_cells(spark, days))
    many.append_days("sst", some_cells(spark, [day("2019-05-05")]))
    for d in days:
        many.append_days("sst", some_cells(spark, [d]))
    assert many.files("sst_daily", 2024) == 6 * one.files("sst_daily", 2024)
    other = many._names(many.path("sst_daily/part=2010"))
    assert many.merge_files("sst", days[:1]) == [2024]
    assert many.files("sst_daily", 2024) == one.files("sst_daily", 2024)
    assert many._names(many.path("sst_daily/part=2010")) == other  # not touched
    assert many.merge_files("sst", days) == []
    now = many.read("sst_daily").filter("part = 2024")
    assert now.exceptAll(one.read("sst_daily")).isEmpty() and now.count() == one.read("sst_daily").count()


@pytest.mark.parametrize("broken_at", range(1, 5))
@pytest.mark.parametrize("empty", [False, True])
def test_a_broken_replacement_leaves_old_or_new_rows(spark, tmp_path, day, monkeypatch, broken_at, empty):
    store, d = Store(spark, str(tmp_path), buckets=2), day("2024-01-01")
    store.append_days("sst", some_cells(spark, [d], 1))
    moves, real, gone = [], Store._rename, Store._delete

    def count(act):
        def run(self, *args):
            moves.append(args)
            if len(moves) == broken_at:
                raise OSError("lost")
            return act(self, *args)
        return run

    monkeypatch.setattr(Store, "_rename", count(real))
    monkeypatch.setattr(Store, "_delete", count(gone))
    fresh = some_cells(spark, [d], 2)
    try:
        store.replace_days("sst", fresh.filter("false") if empty else fresh, [d])
    except OSError:
        pass
    monkeypatch.setattr(Store, "_rename", real)
    monkeypatch.setattr(Store, "_delete", gone)
    values = {r.sst_raw for r in Store(spark, str(tmp_path)).read("sst_daily").collect()}
    assert values in ({1}, set() if empty else {2})
    store.replace_days("sst", fresh, [d])
    assert {r.sst_raw for r in store.read("sst_daily").collect()} == {2} and store.read("sst_daily").count() == 24
    assert store._names(f"{store.root}/_swap/sst_daily") == []


def test_a_late_product_reads_only_itself(spark, store, day, monkeypatch):
    d = day("2024-02-28")
    load(store, "sst", grid_rows(spark, d), [d], T0)
    read, real = [], Store.days
    monkeypatch.setattr(Store, "days", lambda self, p, dates: read.append((p, tuple(dates))) or real(self, p, dates))
    load(store, "mhw", grid_rows(spark, d, lambda r, c: 2, mask=lambda r, c: 2), [d], T0 + dt.timedelta(hours=1))
    assert read == [("mhw", (d,))]
    assert rolled(store)["half", "2024-02-28"].mhw_area_frac > 0


def test_a_backfilled_day_gets_its_parts_with_the_other_product(spark, store, day):
    d = day("2024-02-28")
    pl.ingest_product(store, "sst", grid_rows(spark, d), files_of(spark, "sst", [d]), T0, ALL, grid=G).collect()
    assert store.read("region_parts").count() == 0
    load(store, "mhw", grid_rows(spark, d, lambda r, c: 2, mask=lambda r, c: 2), [d], T0 + dt.timedelta(hours=1))
    got = rolled(store)["half", "2024-02-28"]
    want = {r.region: r for r in region_daily(store.archive(), pl.region_dimension(store, REGIONS, G)).collect()}["half"]
    assert (got.mean_sst, got.mean_mhw, got.n_cells, got.n_cells_mhw) == (want.mean_sst, want.mean_mhw, want.n_cells, want.n_cells_mhw)


def test_names_date_landed_files(spark, tmp_path):
    rows = [(f"file:/x/{n}", 5, dt.datetime(2024, 3, 1, 4, 5)) for n in ("a_20240228.nc.parquet", "part-0001.parquet", "b_20240231.parquet", "c_20240229.txt")]
    got = gf.landed_files(spark.createDataFrame(rows, "path string, size long, modified timestamp")).collect()
    assert {r.filename: str(r.date) for r in got} == {"a_20240228.nc.parquet": "2024-02-28", "part-0001.parquet": "None", "b_20240231.parquet": "None"}


def test_runs_are_kept_up_to_date_by_batches(spark, tmp_path):
    """Random batches and revisions; after each, the stored runs are those of all events."""
    import random

    from tidegrid.operators.events import event_runs

    rng, store, model = random.Random(5), Store(spark, str(tmp_path), buckets=2), {}
    first = dt.date(2023, 12, 1)
    waiting = [first + dt.timedelta(k) for k in range(60)]  # crosses a year's end, and so a partition's
    rng.shuffle(waiting)
    for step in range(9):
        dates = [waiting.pop() for _ in range(8)] if step % 3 < 2 and len(waiting) >= 8 else rng.sample(sorted({d for d, _, _ in model}), 6)
        model = {k: v for k, v in model.items() if k[0] not in dates}
        rows = [(d, y, x, rng.randint(1, 5)) for d in dates for y, x in ((1, 1), (1, 2), (70, 3), (70, 90)) if rng.random() < 0.7]
        model |= {r[:3]: r[3] for r in rows}
        store.replace_days("mhw", spark.createDataFrame(rows, "date date, gy int, gx int, cat int"), dates)
        store.update_runs(dates)
        if step in (2, 5, 8):
            got = {tuple(r) for r in store.read("mhw_runs").select("gy", "gx", "start", "end", "days", "peak").collect()}
            want = set()
            for y, x in {k[1:] for k in model}:
                days = sorted(d for d, *cell in model if cell == [y, x])
                begin = [d for d in days if d - dt.timedelta(1) not in days]
                for b in begin:
                    n = next(n for n in range(1, 99) if b + dt.timedelta(n) not in days)
                    want.add((y, x, b, b + dt.timedelta(n - 1), n, max(model[b + dt.timedelta(k), y, x] for k in range(n))))
            assert got == want and store.read("mhw_runs").count() == len(want)
    assert {tuple(r) for r in event_runs(store.read("mhw_daily")).collect()} == got
    assert {r.part for r in store.read("mhw_runs").select("part").distinct().collect()} == {2020, 2024}
    store.update_runs([])


def test_a_replayed_batch_changes_nothing(spark, store, day, monkeypatch):
    d, clock, drawn = day("2024-02-28"), iter(T0 + dt.timedelta(hours=i) for i in range(20)), []
    monkeypatch.setattr(stream, "redraw", lambda s, done, width, **where: drawn.append(({r.date for r in done.filter("outcome = 'ingested'").collect()}, width)))
    load = stream.loader(store, "sst", ALL, "s", regions=REGIONS, grid=G, clock=lambda: next(clock), width=8)
    batch = lambda v: grid_rows(spark, d, lambda r, c: v).selectExpr("*", "'f' as filename", "cast(1 as long) as size", "'m' as modified")
    state = lambda: ({r.sst_raw for r in store.read("sst_daily").collect()}, store.read("region_daily").count(), len(drawn), store.read("stream_ledger").count())
    real = Store.append
    monkeypatch.setattr(Store, "append", lambda self, t, rows: (_ for _ in ()).throw(OSError("lost")) if t == "stream_ledger" else real(self, t, rows))
    with pytest.raises(OSError):
        load(batch(5), 0)  # broken off before it was noted
    monkeypatch.setattr(Store, "append", real)
    load(batch(5), 0)
    first = state()
    assert first[0] == {5} and first[3] == 1 and drawn == [({d}, 8)] * 2
    load(batch(6), 0)
    assert state() == first
    load(batch(7), 1)
    assert state()[0] == {7} and state()[3] == 2


def test_an_outline_is_brought_in_and_rolled_up(spark, store, day, tmp_path):
    import json

    square = [[[0.0, -80.0], [200.0, -80.0], [200.0, 80.0], [0.0, 80.0], [0.0, -80.0]]]
    (tmp_path / "o.json").write_text(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}}))
    with pytest.raises(ValueError):
        pl.store_outline(store, str(tmp_path / "o.json"), "nino34", G)
    pl.store_outline(store, str(tmp_path / "o.json"), "mine", G)
    assert {r.region for r in store.read("region_cells").select("region").distinct().collect()} == {"tri", "mine"}
    assert pl.region_names(store)[-2:] == ["mine", "tri"] and pl.region_names(store, REGIONS) == list(REGIONS)
    d = day("2024-02-28")
    store.append_days("sst", ig.flag_climatology(gf.sst_cells(grid_rows(spark, d), ALL, G), store.read("sst_clim")))
    only = {"mine": outlined("mine", "Mine", (((0.0, -80.0), (200.0, -80.0), (200.0, 80.0), (0.0, 80.0)),))}
    pl.build_region_daily(store, T0, only, grid=G)
    assert rolled(store)["mine", "2024-02-28"].n_cells == store.read("region_cells").filter("region = 'mine'").count() > 0
