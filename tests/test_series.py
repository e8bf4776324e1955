"""Cell series, event runs and series statistics on small hand-made frames."""

import datetime as dt
import random

import pytest

from tidegrid.operators import events as ev
from tidegrid.operators import ranking as rk
from tidegrid.operators import series as se
from tidegrid.operators import stats as st
from tidegrid.schema import Archive

SST = "date date, gy int, gx int, sst_raw int, has_clim boolean"
CLIM = "mmdd int, gy int, gx int, clim_raw int"
MHW = "date date, gy int, gx int, cat int"


@pytest.fixture
def archive(frame):
    week = [f"2024-01-0{d}" for d in range(1, 8)]  # Monday to Sunday
    sst = [(d, 1, 1, 1000 + 10 * i, i != 3) for i, d in enumerate(week)]
    sst += [("2024-01-08", 1, 1, 2000, True), ("2024-01-08", 1, 2, 500, False)]
    clim = [(101 + i, 1, 1, 900) for i in range(8) if i != 3]
    mhw = [("2024-01-02", 1, 1, 2), ("2024-01-03", 1, 1, 4), ("2024-01-09", 1, 1, 5)]  # the 9th has no SST
    return Archive(frame(SST, sst), frame(CLIM, clim), frame(MHW, mhw))


def get(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_normal_is_null_for_a_bucket_with_a_gap(archive, day):
    out = get(se.cell_series(archive, "sst", "weekly", cell=(1, 1)), "bucket", "value", "n_days", "clim")
    assert out[0][0] == day("2024-01-01") and out[0][2:] == (7, None)
    assert out[0][1] == pytest.approx(10.3)
    assert out[1][2:] == (1, 9.0)


def test_anomaly_drops_days_without_normal(archive):
    out = get(se.cell_series(archive, "anom", "weekly", cell=(1, 1)), "value", "n_days")
    assert out[0][1] == 6 or out[1][1] == 6
    daily = get(se.cell_series(archive, "anom", cell=(1, 1)), "bucket", "value")
    assert len(daily) == 7 and daily[0][1] == pytest.approx(1.0)


def test_sparse_zeros_and_maximum(archive, day):
    daily = dict(get(se.cell_series(archive, "mhw", cell=(1, 1)), "bucket", "value"))
    assert daily[day("2024-01-01")] == 0 and daily[day("2024-01-03")] == 4
    assert day("2024-01-09") not in daily  # events without SST are not ocean yet
    weekly = get(se.cell_series(archive, "mhw", "weekly", cell=(1, 1)), "bucket", "value", "n_days")
    assert weekly == [(day("2024-01-01"), 4.0, 7), (day("2024-01-08"), 0.0, 1)]


def test_range_and_unknown_names(archive, day):
    one = se.cell_series(archive, "sst", cell=(1, 1), start=day("2024-01-02"), end=day("2024-01-04"))
    assert one.count() == 3
    with pytest.raises(ValueError):
        se.cell_series(archive, "salt")


RUNS = ["2023-12-30", "2023-12-31", "2024-01-01", "2024-01-03", "2024-01-05", "2024-01-06", "2024-01-07"]


def test_runs_break_at_gaps_and_span_years(frame, day):
    mhw = frame(MHW, [(d, 1, 1, 1 + i % 3) for i, d in enumerate(RUNS)])
    runs = get(ev.event_runs(mhw), "start", "end", "days", "peak")
    assert runs == [
        (day("2023-12-30"), day("2024-01-01"), 3, 3), (day("2024-01-03"), day("2024-01-03"), 1, 1),
        (day("2024-01-05"), day("2024-01-07"), 3, 3),
    ]
    for last, current in (("2024-01-07", 3), ("2024-01-08", None)):
        sst = frame(SST, [(last, 1, 1, 0, True), (last, 9, 9, 0, True)])
        out = {(r.gy, r.gx): r for r in ev.run_summary(ev.event_runs(mhw), sst).collect()}
        assert out[1, 1].current_days == current
        assert (out[1, 1].longest_start, out[1, 1].longest_days) == (day("2023-12-30"), 3)  # earliest of equals
        assert (out[1, 1].days, out[1, 1].events, out[1, 1].through) == (7, 3, day(last))
        assert (out[9, 9].days, out[9, 9].events, out[9, 9].current_start) == (0, 0, None)


def test_run_days_add_up(frame):
    random.seed(5)
    days = sorted(random.sample(range(400), 150))
    mhw = frame(MHW, [(str(dt.date(2020, 1, 1) + dt.timedelta(days=d)), c, 7, 1) for d in days for c in (1, 2)])
    assert ev.event_runs(mhw).agg({"days": "sum"}).first()[0] == 300


SERIES = "k string, bucket date, value double"


def test_extremes_take_the_first_of_equals(frame, day):
    s = frame(SERIES, [("a", "2020-01-01", 3.0), ("a", "2020-01-02", 1.0), ("a", "2020-01-03", 3.0),
                       ("a", "2020-01-04", 1.0), ("a", "2020-01-05", None), ("b", "2020-01-01", 7.0)])
    out = {r.k: r for r in st.extremes(s, ["k"]).collect()}
    a = out["a"]
    assert (a.n, a.mean, a.max_bucket, a.min_bucket) == (4, 2.0, day("2020-01-01"), day("2020-01-02"))
    ranks = {r.k: r for r in st.value_rank(s, ["k"], day("2020-01-03")).collect()}
    assert set(ranks) == {"a"} and (ranks["a"]["rank"], ranks["a"]["of"]) == (1, 4)


def test_trend(frame):
    s = frame(SERIES, [("one", "2020-01-01", 3.0), ("same", "2020-01-01", 3.0), ("same", "2020-01-01", 4.0),
                       ("up", "2020-01-01", 1.0), ("up", "2020-01-11", 2.0), ("up", "2020-01-31", 4.0)])
    out = {r.k: r.trend_per_decade for r in st.trend_per_decade(s, ["k"]).collect()}
    assert out["one"] is None and out["same"] is None and out["up"] == pytest.approx(365.25)


def test_recent_window_ends_with_the_series(frame):
    s = frame(SERIES, [("a", "2019-01-01", 100.0), ("a", "2019-01-02", 1.0), ("a", "2020-01-01", 0.0)])
    r = st.recent(s, ["k"]).first()
    assert (r.recent_mean, r.active_hits, r.active_of) == (0.5, 1, 2)


def test_summary_with_and_without_keys(frame, day):
    s = frame(SERIES, [("a", "2020-01-01", 1.0), ("a", "2020-02-01", 2.5)])
    keyed = st.summarise(s, ["k"], day("2020-01-01")).first()
    bare = st.summarise(s.drop("k"), [], day("2020-01-01")).first()
    for r in (keyed, bare):
        assert (r["rank"], r.current_value, r.max_value, r.n) == (2, 1.0, 2.5, 2)
        assert r.active_hits is None and r.recent_vs_mean == pytest.approx(0.0)
    assert st.summarise(s.drop("k"), [], day("1999-01-01")).first()["rank"] is None
    classes = st.summarise(s, ["k"], day("2020-01-01"), categorical=True).first()
    assert classes.min_value is None and classes.trend_per_decade is None and classes.active_of == 2
    assert not st.whole_classes(s, ["k"]).first().whole_classes


def test_nearest_bucket_matches_brute_force(spark, frame):
    random.seed(11)
    base = dt.date(2001, 1, 1)
    marks = {k: sorted({base + dt.timedelta(days=random.randrange(4000)) for _ in range(n)}) for k, n in (("a", 25), ("b", 2))}
    s = frame("k string, bucket date", [(k, str(d)) for k, ds in marks.items() for d in ds])
    asked = [(k, dt.datetime(2000, 1, 1) + dt.timedelta(hours=random.randrange(24 * 5000))) for k in marks for _ in range(150)]
    asked += [("a", dt.datetime.combine(marks["a"][0], dt.time()))] * 3
    probes = spark.createDataFrame(asked, "k string, x timestamp_ntz")
    out = st.nearest_bucket(s, probes, ["k"]).collect()
    assert len(out) == len(asked)
    for r in out:
        gap = lambda d: abs(dt.datetime.combine(d, dt.time()) - r.x)
        assert r.bucket == min(marks[r.k], key=lambda d: (gap(d), d))


def test_nearest_bucket_middle_goes_left(spark, frame, day):
    s = frame("bucket date", [("2020-01-01",), ("2020-01-03",)])
    p = spark.createDataFrame([(day("2020-01-02"),)], "x date")
    assert st.nearest_bucket(s, p, []).first().bucket == day("2020-01-01")


def test_ranking(frame, day):
    vals = [("2020-01-30", 1), ("2020-01-31", 3), ("2021-01-05", 2), ("2021-01-06", 2), ("2022-01-01", 9), ("2022-03-01", 1)]
    s = frame("date date, value int", vals)
    edges = rk.archive_edges(s)
    out = {(r.month, r.year): r for r in rk.ranked_periods(s, edges, scale=0.5, top=1).collect()}
    jan = {y: out[1, y]["rank"] for y in (2020, 2021, 2022)}
    assert jan == {2022: 1, 2020: 2, 2021: 3}  # equal means are ordered by year
    assert out[1, 2022].sd is None and out[1, 2020]["mean"] == 1.0
    assert out[0, 2022]["mean"] == 2.5  # mean of days, not of months
    assert {k for k, r in out.items() if r.partial} == {(1, 2020), (3, 2022), (0, 2020), (0, 2022)}
    assert {k for k, r in out.items() if r.is_top} == {(1, 2022), (3, 2022), (0, 2022)}
    notes = rk.partial_notes(rk.ranked_periods(s, edges)).collect()
    assert len(notes) == 4
    span = rk.ranking_span(edges).first()
    assert (span.span_start, span.span_end, span.through) == (day("2020-01-01"), day("2022-03-31"), day("2022-03-01"))


def test_empty_series_gives_empty_ranking(frame):
    s = frame("date date, value int", [])
    assert rk.ranked_periods(s, rk.archive_edges(s)).count() == 0


def test_equal_days_in_another_order_are_a_tie_and_rank_by_year(frame):
    days = {2001: (0.1, 0.2, 0.3), 2002: (0.3, 0.2, 0.1)}  # as doubles, 0.6000000000000001 and 0.6 in all
    rows = [(f"{y}-05-{d + 1:02}", v) for y, vs in sorted(days.items(), reverse=True) for d, v in enumerate(vs)]
    for order in (rows, rows[::-1], sorted(rows)):
        s = frame("date date, value double", order).coalesce(1)
        out = rk.ranked_periods(s, rk.archive_edges(s)).collect()
        assert {(r.month, r.year): r["rank"] for r in out} == {(m, y): 1 + (y == 2002) for m in (0, 5) for y in days}
        assert len({r.mean for r in out}) == 1


def test_values_without_decimals_are_still_averaged(frame):
    s = frame("date date, value double", [("2001-05-01", float("inf")), ("2001-05-02", 1.0), ("2002-05-01", 1e20), ("2002-05-02", None)])
    out = {(r.month, r.year): (r.mean, r.n) for r in rk.ranked_periods(s, rk.archive_edges(s)).collect()}
    assert out == {(m, 2001): (float("inf"), 2) for m in (0, 5)} | {(m, 2002): (1e20, 1) for m in (0, 5)}


def test_runs_near_many_dates_are_looked_up_not_compared_with_each(frame):
    random.seed(11)
    first = dt.date(2020, 1, 1)
    spans = sorted({(random.randrange(400), random.randrange(1, 9)) for _ in range(150)})
    rows = [(1, k, first + dt.timedelta(a), first + dt.timedelta(a + n - 1)) for k, (a, n) in enumerate(spans)]
    runs = frame("gy int, gx int, start date, end date", rows)
    for count in (1, 12, 60):
        dates = [first + dt.timedelta(d) for d in sorted(random.sample(range(-2, 410), count))]
        found = runs.filter(ev.near(dates))
        one = dt.timedelta(1)
        assert {r.gx for r in found.collect()} == {k for _, k, a, b in rows if any(a - one <= d <= b + one for d in dates)}
    assert "INSET" in found._jdf.queryExecution().optimizedPlan().toString()
