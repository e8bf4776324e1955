"""Calendar, grid, packing and wording against plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import domain as dm
from tidegrid.functions import calendar as cal
from tidegrid.functions import grid as gr
from tidegrid.functions import packing as pk
from tidegrid.functions import wording as wd

DAYS = ["2023-12-31", "2024-01-01", "2024-02-29", "2024-05-06", "2024-05-12", "1999-12-31", "2023-01-01"]

# corners worked out by hand from the bounds
GOLDEN = {
    "pacific": (600, 3099, 2000, 5799), "nino34": (1699, 1899, 3799, 4800), "nino3": (1699, 1899, 4200, 5400),
    "nino4": (1699, 1899, 3199, 4200), "nino12": (1599, 1799, 5400, 5600), "ne_pacific": (2599, 2999, 3999, 4700),
    "gulf_of_alaska": (2799, 2999, 4100, 4500), "bering_sea": (2899, 3099, 3599, 3999),
    "pdo_north_pacific": (2199, 3099, 3599, 5000),
}


def test_region_boxes():
    for key, want in GOLDEN.items():
        box = dm.REGIONS[key].box()
        assert (box.gy0, box.gy1, box.gx0, box.gx1) == want, key


def test_cell_of_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    lats = [*rng.uniform(-89.9, 89.9, 60), -5.0, 5.0, 60.0, 0.0]
    lons = [*rng.uniform(-180, 360, 60), -170.0, 190.0, 359.999, 0.0]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lats, lons)], "lat double, lon double")
    for r in df.select("lat", "lon", gr.gy_of("lat").alias("y"), gr.gx_of("lon").alias("x")).collect():
        assert r.y == int(np.rint((r.lat + 89.975) / 0.05)) == dm.GLOBAL.row(r.lat)
        assert r.x == int(np.rint(np.mod(r.lon - 0.025, 360.0) / 0.05)) % 7200 == dm.GLOBAL.col(r.lon)


def test_both_longitude_conventions_and_the_domain(spark):
    assert dm.GLOBAL.col(-170.0) == dm.GLOBAL.col(190.0)
    assert dm.in_subset(0, -170, dm.PACIFIC) and dm.in_subset(0, 190, dm.PACIFIC)
    assert dm.in_subset(64.99, 289.99, dm.PACIFIC) and not dm.in_subset(65.1, 200, dm.PACIFIC)
    df = spark.createDataFrame([(0.0, -170.0), (0.0, 20.0), (64.99, -70.0), (70.0, 200.0)], "lat double, lon double")
    assert [r[0] for r in df.select(gr.inside("lat", "lon")).collect()] == [
        dm.in_subset(*p, dm.PACIFIC) for p in [(0, -170), (0, 20), (64.99, -70), (70, 200)]
    ]
    with pytest.raises(dm.OutsideDomain):
        dm.require_inside(0.0, 20.0)


def test_buckets(spark, frame):
    df = frame("d date", [(d,) for d in DAYS])
    for period in cal.PERIODS:
        for r in df.select("d", cal.bucket_start("d", period).alias("a"), cal.bucket_end("d", period).alias("b")).collect():
            if period == "daily":
                want = (r.d, r.d)
            elif period == "weekly":
                monday = r.d - dt.timedelta(days=r.d.weekday())
                want = (monday, monday + dt.timedelta(days=6))
            else:
                first = r.d.replace(day=1)
                want = (first, (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1))
            assert (r.a, r.b) == want
    with pytest.raises(ValueError):
        cal.bucket_start("d", "hourly")


def test_shift_step_and_labels(spark, frame, day):
    df = frame("d date", [("2024-05-08",)])
    r = df.select(
        cal.shift_buckets("d", "weekly", -1).alias("w"), cal.shift_buckets("d", "monthly", -3).alias("m"),
        cal.next_bucket("d", "weekly", day("2024-05-19")).alias("n"),
        cal.next_bucket("d", "weekly", day("2024-05-12")).alias("none"),
        cal.step_within("d", "monthly", 12, day("1990-01-01"), day("2024-06-30")).alias("c"),
        cal.bucket_label("d", "weekly").alias("lw"), cal.bucket_label("d", "monthly").alias("lm"),
        cal.bucket_label("d", "daily").alias("ld"),
        cal.first_bucket_in_month(F.lit(2024), F.lit(5), "weekly").alias("f"),
        cal.first_bucket_in_month(F.lit(2024), F.lit(7), "weekly").alias("g"),
        cal.days_in_month("d").alias("dm"), cal.days_in_year("d").alias("dy"),
    ).first()
    assert (r.w, r.m, r.n, r.none) == (day("2024-04-29"), day("2024-02-01"), day("2024-05-13"), None)
    assert r.c == day("2024-06-30")
    assert (r.lw, r.lm, r.ld) == ("6 May – 12 May", "May 2024", "8 May 2024")
    assert (r.f, r.g) == (day("2024-05-06"), day("2024-07-01"))
    assert (r.dm, r.dy) == (31, 366)


def test_partition_key_and_range(spark, frame, day):
    df = frame("date date", [(d,) for d in DAYS]).withColumn("part", cal.part_key("date"))
    for r in df.collect():
        assert r.part == cal.part_of(r.date)
    assert {r.part for r in df.collect()} == {2020, 2024, 1990}
    cut = cal.date_range(df, day("2023-06-01"), day("2024-02-29"))
    assert sorted(str(r.date) for r in cut.collect()) == ["2023-12-31", "2024-01-01", "2024-02-29"]
    assert cal.mmdd_calendar(spark).distinct().count() == 366


def test_packing(spark):
    sst, anom = dm.VARIABLES["sst"].packing, dm.VARIABLES["anom"].packing
    assert dm.packed_range(sst) == (-5.0, -5.0 + 0.01 * 65535) and dm.code_limits(anom) == (1, 255)
    df = spark.createDataFrame([(1.235, False), (99.0, False), (-99.0, False), (None, True), (None, False)], "v double, m boolean")
    rows = df.select(pk.quantise("v", sst).alias("s"), pk.quantise("v", anom, "m").alias("a")).collect()
    assert [r.a for r in rows] == [140, 255, 1, 0, None]  # clamped, sentinel, unknown
    assert rows[0].s == round((1.235 + 5.0) / 0.01) and rows[2].s == 0
    high, low = pk.code_bytes(F.lit(0x1234), sst)
    assert tuple(spark.range(1).select(high, low).first()) == (0x12, 0x34)
    d = spark.createDataFrame([(0,), (140,)], "c int").select(pk.decode("c", anom)).collect()
    assert d[0][0] is None and d[1][0] == pytest.approx(1.2)


def test_class_codes_of_both_encodings(spark):
    codes = [-127, -1, 0, 1, 2, 3, 4, 5, 251]
    df = spark.createDataFrame([(c,) for c in codes], "c int")
    assert [r[0] for r in df.select(pk.class_or_null("c")).collect()] == [None, None, None, 1, 2, 3, 4, 5, None]
    assert df.select(pk.physical("c", dm.VARIABLES["sst"])).first()[0] == pytest.approx(-1.27)
    fill = spark.createDataFrame([(-32768,)], "c int").select(pk.physical("c", dm.VARIABLES["sst"]))
    assert fill.first()[0] is None


def test_words(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(wd.strength(F.lit(v))) for v in (2.0, -1.6, 1.0, 0.2)] == ["very strong", "strong", "moderate", "weak"]
    assert [get(wd.phase(F.lit(v))) for v in (0.5, -0.5, 0.49)] == ["el_nino", "la_nina", "neutral"]
    assert get(wd.season(F.lit(dt.date(2024, 1, 1)))) == "DJF 2024"
    assert get(wd.season(F.lit(dt.date(2024, 12, 1)))) == "NDJ 2024"
    assert [get(wd.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112, 103)] == [
        "1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th", "103rd"]
    assert [get(wd.gap_word(F.lit(a), F.lit(b))) for a, b in ((1.0, 1.04), (2.0, 1.0), (1.0, 2.0))] == ["at", "above", "below"]
    assert [get(wd.extent_word(F.lit(v))) for v in (1.15, 0.85, 1.0)] == ["above", "below", "about normal"]
    assert get(wd.extent_word(F.lit(None).cast("double"))) == "rank"
    assert [get(wd.slug(F.lit(t))) for t in ("NE Pacific (the Blob)", "--", "BC EEZ")] == ["ne-pacific-the-blob", "export", "bc-eez"]
    assert get(wd.cell_slug(F.lit(48.0), F.lit(232.0))) == "48-00n_128-00w"
    assert get(wd.cell_slug(F.lit(-5.025), F.lit(150.5))) == "5-03s_150-50e"
    note = get(wd.partial_note(F.lit(8), F.lit(2026), F.lit(24)))
    assert note.startswith("* August 2026 is incomplete — ranked on 24 of 31 days")
    assert "* 2024 is incomplete — ranked on 24 of 366 days" in get(wd.partial_note(F.lit(0), F.lit(2024), F.lit(24)))


def test_dimension_checks(spark):
    good = dm.VARIABLES["sst"]
    from dataclasses import replace

    ring = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))
    bad_variables = [
        replace(good, presets=(("x", -10.0, 5.0),)), replace(good, presets=(("x", 5.0, 5.0),)),
        replace(good, baseline=dm.Baseline("x", "median", 1, "", "here")), replace(good, baseline=dm.Baseline("x", "mean", 2, "", "here")),
        replace(good, baseline=dm.Baseline("x", "mean", 1, "", "there")),
    ]
    bad_regions = [dm.Region("r", "r", (5, 6), (5, 6), rings=(ring,)), dm.Region("r", "r"), dm.Region("r", "r", (0, 1), (0, 1), rings=()), dm.outlined("r", "r", (ring[:3],))]
    assert all(len(dm.faults([v])) == 1 for v in bad_variables) and all(dm.faults(regions=[r]) for r in bad_regions)
    with pytest.raises(ValueError):
        dm.require_sound(bad_variables)
    r = dm.outlined("r", "r", (ring,))
    assert not dm.faults([good], [r])
    assert r.masked and (r.lat, r.lon) == ((0.0, 1.0), (0.0, 1.0))
    assert dm.variables_table(spark).count() == 3 and dm.classes_table(spark).count() == 5
    assert dm.presets_table(spark).count() == 6 and dm.regions_table(spark).count() == 9
    assert dm.series_units("mhw", region=True) == "%" and dm.series_units("mhw", region=False) == "category"
    with pytest.raises(ValueError):
        dm.variable("salinity")
    assert math.isclose(dm.half_step(dm.PACIFIC), 0.025, rel_tol=1e-9)
