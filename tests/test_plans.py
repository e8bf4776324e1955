"""What the physical plans must and must not contain."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.domain import Box
from tidegrid.operators import events as ev
from tidegrid.operators import raster as ra
from tidegrid.operators import regions as rg
from tidegrid.operators import rollup as ru
from tidegrid.operators import series as se
from tidegrid.plans import reports as rp
from tidegrid.sources.store import Store


def plan(df):
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.maxMetadataStringLength")
    conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set("spark.sql.maxMetadataStringLength", before)


def exchanges(df):
    text = plan(df)
    return text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning") + text.count("Exchange SinglePartition")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("archive")))
    random.seed(1)
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=40 * i) for i in range(60)]
    cells = [(y, x) for y in range(1700, 1720) for x in range(4000, 4010)]
    sst = [(d, y, x, random.randrange(0, 3000), True) for d in days for y, x in cells]
    s.append_days("sst", spark.createDataFrame(sst, "date date, gy int, gx int, sst_raw int, has_clim boolean"))
    s.append_days("mhw", spark.createDataFrame([(r[0], r[1], r[2], 2) for r in sst[::7]], "date date, gy int, gx int, cat int"))
    clim = {(d.month * 100 + d.day, y, x, 1000) for d in days for y, x in cells}
    s.append_climatology(spark.createDataFrame(sorted(clim), "mmdd int, gy int, gx int, clim_raw int"))
    return s


def test_point_query_reads_one_cell(store):
    lat, lon = -89.975 + 1705 * 0.05, 0.025 + 4003 * 0.05
    df = se.point_series(store.archive(), lat, lon, "anom", "monthly", dt.date(2021, 5, 1), dt.date(2024, 2, 1))
    text = plan(df)
    for name in ("EqualTo(gy,1705)", "EqualTo(gx,4003)", "GreaterThanOrEqual(date,2021-05-01)"):
        assert name in text, name
    assert "PartitionFilters: [isnotnull(part" in text and "part#" in text
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text
    assert exchanges(df) == 0  # its bucket holds the whole cell
    assert df.count() > 0


def test_only_touched_partitions_are_listed(store):
    parts = lambda df: {f.split("part=")[1].split("/")[0] for f in df.inputFiles()}
    from tidegrid.functions.calendar import date_range

    assert parts(store.read("sst_daily")) == {"2010", "2020", "2024", "2025"}
    cut = date_range(store.read("sst_daily"), dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    assert "PartitionFilters: []" not in plan(cut) and {r.part for r in cut.select("part").distinct().collect()} == {2024}


def test_rollup_is_one_scan_each_and_one_shuffle(spark, store):
    dim = rg.box_rows(spark, {"a": Box(1700, 1710, 4000, 4009), "b": Box(1705, 1719, 4003, 4005)})
    df = ru.region_daily(store.archive(), dim)
    text = plan(df)
    assert exchanges(df) == 1 and text.count("FileScan parquet") == 2
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    assert "GreaterThanOrEqual(gy,1700)" in text
    assert df.count() > 0


def test_runs_share_one_shuffle(store):
    assert exchanges(ev.event_runs(store.read("mhw_daily").drop("block"))) == 1


def test_regrid_shuffles_once_or_never(spark):
    f = spark.range(50).select((F.col("id") % 2).alias("f"), (F.col("id") % 5).cast("int").alias("y"), (F.col("id") / 5).cast("int").alias("x"), F.lit(1.0).alias("value"))
    from tidegrid.domain import Subset

    s = Subset("s", (-40.0, 40.0), (0.0, 90.0), 5, 10)
    axes = (ra.row_sources(spark, 16, s), ra.col_sources(spark, 16, s), (5, 10))
    assert exchanges(ra.regrid_bilinear(f, ["f"], *axes)) == 1
    assert exchanges(ra.regrid_nearest(f, ["f"], *axes)) == 0


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_all_cell_work_finds_stored_rows_in_place(spark, store, no_broadcast):
    arc = store.archive()
    days = store.read("sst_daily").count()
    for name in ("anom", "sst", "mhw"):
        df = se.cell_series(arc, name, "monthly")
        assert exchanges(df) == 0 and "Python" not in plan(df), name
        assert df.agg(F.sum("n_days")).first()[0] == days and "block" not in df.columns
        loaded = spark.createDataFrame([(dt.date(2019, 1, 1),)], "date date")
        field = ra.bucket_field(arc, name, "monthly", loaded)
        own = exchanges(loaded.distinct().groupBy(F.trunc("date", "month")).count())
        assert exchanges(field) == own and field.count() > 0, name
    assert exchanges(ra.anomaly_field(arc)) == 0
    assert exchanges(ev.event_runs(arc.mhw)) == 0


def test_rows_in_place_are_the_same_rows(spark, store):
    from tidegrid.schema import Archive

    arc = store.archive()
    plain = Archive(*[df.drop("block", "part", "month") for df in (arc.sst, arc.clim, arc.mhw)])
    for name in ("anom", "sst", "mhw"):
        mine, other = (se.cell_series(a, name, "weekly") for a in (arc, plain))
        assert mine.columns == other.columns and mine.exceptAll(other).isEmpty() and other.exceptAll(mine).isEmpty()


def test_point_query_opens_one_bucket(store):
    df = se.cell_series(store.archive(), "anom", "monthly", cell=(1705, 4003))
    assert "SelectedBucketsCount: 1 out of 16" in plan(df)


def test_a_days_load_reads_one_month_of_the_climatology(spark, store, no_broadcast):
    from tidegrid.operators.ingest import flag_climatology

    clim = store.read("sst_clim")
    assert {r.month for r in clim.select("month").distinct().collect()} == {r[0] for r in clim.select(F.expr("mmdd div 100")).distinct().collect()}
    some = store.days("sst", [dt.date(2019, 2, 10)]).select("date", "gy", "gx", "sst_raw")
    df = flag_climatology(some, clim, [210])
    text = plan(df)
    assert "PartitionFilters: [isnotnull(month" in text and "(month#" in text and "= 2)" in text
    assert df.count() == 200 and df.filter("has_clim").count() == 200
    assert exchanges(df) <= 1  # the climatology stays in its buckets
    cut = se.daily_values(store.archive(), "anom", start=dt.date(2019, 12, 20), end=dt.date(2020, 1, 5))
    assert "month#" in plan(cut) and "IN (1,12)" in plan(cut)
    assert "PartitionFilters: [isnotnull(part" in plan(store.days("sst", [dt.date(2024, 2, 3)]))


def test_polygon_needs_no_cross_join(spark):
    edges = spark.createDataFrame([("r", 0, 1.0, 1.0, 5.0, 9.0), ("r", 0, 5.0, 9.0, 9.0, 1.0), ("r", 0, 9.0, 1.0, 1.0, 1.0)],
                                  "region string, ring int, x1 double, y1 double, x2 double, y2 double")
    text = plan(rg.polygon_intervals(edges))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_reports(spark, store):
    lat, lon = -89.975 + 1705 * 0.05, 0.025 + 4003 * 0.05
    arc = store.archive()
    one = rp.point_timeseries(arc, lat, lon, "sst", "monthly").first()
    assert one.units == "degC" and one.clim_baseline == "1991-2020" and one.clim == 10.0
    assert rp.point_events(arc, lat, lon).count() == 1
    box = rp.box_timeseries(arc, (lat, lat + 0.3), (lon, lon + 0.2), "mhw")
    assert box.first().quantity == "mhw_extent" and box.first().units == "%"
    dim = rg.box_rows(spark, {"nino34": Box(1699, 1899, 3799, 4800)})
    daily, clim = ru.region_daily(arc, dim), ru.region_clim(arc.clim, dim)
    r = rp.region_timeseries(daily, clim, "nino34", "anom", "monthly").first()
    assert r.label == "Nino 3.4" and r.partial is False
    with pytest.raises(KeyError):
        rp.region_timeseries(daily, clim, "atlantis")
    with pytest.raises(ValueError):
        rp.region_geometry(spark, "nino34")
    from tidegrid.operators.ranking import archive_edges

    edges = archive_edges(arc.sst)
    rank = rp.region_ranking(arc, daily, clim, "nino34", edges=edges)
    assert rank.first().clim_baseline == "1991-2020" and rank.filter("month = 0").count() == 7
    assert rp.point_ranking(arc, lat, lon, "mhw", edges=edges).first().clim_baseline is None
    assert rp.index_report(daily, clim).columns[-1] == "official"
    assert rp.extent_report(daily, "nino34").first().window_days == 7
