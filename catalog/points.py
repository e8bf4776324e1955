"""Series of cells: joins with the climatology and the sparse event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.calendar import date_range, part_key
from tidegrid.operators import events as ev
from tidegrid.operators import series as se
from tidegrid.operators import stats as st

from .fixtures import CELL, POINT, day, with_views
from .registry import query

AT = "gy = 1900 and gx = 3600"
MONTH = "cast(date_trunc('month', date) as date)"
WEEK = "cast(date_trunc('week', date) as date)"


def mean(raw: str, scale: str = "0.01") -> str:
    return f"cast(sum({raw}) as double)/count(*)*{scale}"


NORMAL = """case when count(k.clim_raw) = count(*)
    then cast(sum(k.clim_raw) as double)/count(k.clim_raw)*0.01 end"""
WITH_NORMAL = """fx_sst d left join fx_clim k on k.gy = d.gy and k.gx = d.gx
    and k.mmdd = month(d.date)*100 + day(d.date)"""


@query("point_anom", with_views(
    f"select date as bucket, raw*cast(0.01 as double) as value, cast(1 as bigint) as n_days from fx_anom where {AT}", "fx_anom"))
def point_anom(fx):
    return se.point_series(fx.archive, *POINT, "anom").select("bucket", "value", "n_days")


@query("point_sst_normal", with_views(f"""
    select cast(date_trunc('week', d.date) as date) as bucket, {mean('d.sst_raw')} as value,
           count(*) as n_days, {NORMAL} as clim
    from {WITH_NORMAL} where d.{AT.replace('gx', 'd.gx')} group by 1""", "fx_sst", "fx_clim"))
def point_sst_normal(fx):
    return se.point_series(fx.archive, *POINT, "sst", "weekly").select("bucket", "value", "n_days", "clim")


@query("point_mhw", with_views(
    f"select date as bucket, cast(raw as double) as value, cast(1 as bigint) as n_days from fx_class where {AT}",
    "fx_class"))
def point_mhw(fx):
    return se.point_series(fx.archive, *POINT, "mhw").select("bucket", "value", "n_days")


@query("point_series_sst", with_views(f"""
    select cast(date_trunc('month', d.date) as date) as bucket, {mean('d.sst_raw')} as value,
           count(*) as n_days, {NORMAL} as clim
    from {WITH_NORMAL} where d.gy = 1900 and d.gx = 3600 group by 1""", "fx_sst", "fx_clim"))
def point_series_sst(fx):
    return se.point_series(fx.archive, *POINT, "sst", "monthly").select("bucket", "value", "n_days", "clim")


@query("point_series_anom", with_views(
    f"select {MONTH} as bucket, {mean('raw')} as value, count(*) as n_days from fx_anom where {AT} group by 1",
    "fx_anom"))
def point_series_anom(fx):
    return se.point_series(fx.archive, *POINT, "anom", "monthly").select("bucket", "value", "n_days")


@query("point_series_mhw", with_views(
    f"select {WEEK} as bucket, cast(max(raw) as double) as value, count(*) as n_days"
    f" from fx_class where {AT} group by 1", "fx_class"))
def point_series_mhw(fx):
    return se.point_series(fx.archive, *POINT, "mhw", "weekly").select("bucket", "value", "n_days")


@query("cell_series_sst", with_views(f"""
    select d.gy, d.gx, cast(date_trunc('month', d.date) as date) as bucket, {mean('d.sst_raw')} as value,
           count(*) as n_days, {NORMAL} as clim
    from {WITH_NORMAL} group by 1, 2, 3""", "fx_sst", "fx_clim", grid="wide"))
def cell_series_sst(fx):
    return se.cell_series(fx.on("wide").archive, "sst", "monthly")


@query("cell_series_anom", with_views(
    f"select gy, gx, {MONTH} as bucket, {mean('raw')} as value, count(*) as n_days from fx_anom group by 1, 2, 3",
    "fx_anom", grid="wide"))
def cell_series_anom(fx):
    return se.cell_series(fx.on("wide").archive, "anom", "monthly")


@query("cell_series_mhw", with_views(
    f"select gy, gx, {WEEK} as bucket, cast(max(raw) as double) as value, count(*) as n_days"
    f" from fx_class group by 1, 2, 3", "fx_class", grid="wide"))
def cell_series_mhw(fx):
    return se.cell_series(fx.on("wide").archive, "mhw", "weekly")


@query("daily_derived", with_views("""
    select date, gy, gx, sst_raw, has_clim, sst_raw*cast(0.01 as double) as sst,
           cast(-89.975 as double) + gy*cast(0.05 as double) as lat, cast(0.025 as double) + gx*cast(0.05 as double) as lon
    from fx_sst""", "fx_sst", grid="wide"))
def daily_derived(fx):
    return se.with_derived(fx.on("wide").sst)


@query("date_range", with_views(
    "select date, gy, gx, sst_raw from fx_sst where date between date '1996-02-29' and date '1999-12-31'",
    "fx_sst", grid="wide"))
def date_range_(fx):
    stored = fx.on("wide").sst.withColumn("part", part_key("date"))
    return date_range(stored, day("1996-02-29"), day("1999-12-31")).select("date", "gy", "gx", "sst_raw")


# ------------------------------------------------------------------------ runs

RUNS = """
    select gy, gx, min(date) as start, max(date) as "end", count(*) as days, max(cat) as peak from (
      select *, date_add(date, -cast(row_number() over (partition by gy, gx order by date) as int)) as island
      from fx_mhw) group by gy, gx, island"""


@query("mhw_events", with_views(RUNS, "fx_mhw"))
def mhw_events(fx):
    return ev.event_runs(fx.mhw)


@query("mhw_events_wide", with_views(RUNS, "fx_mhw", grid="wide"))
def mhw_events_wide(fx):
    return ev.event_runs(fx.on("wide").mhw)


# Classes as they end up: on some days they are revised, and the lowest ones vanish.
_REVISED = """fx_revised as (
    select date, gy, gx, case when day(date) % 9 = 0 then least(cat + 1, 5) else cat end as cat from fx_mhw
    where not (day(date) % 9 = 0 and cat = 1))"""


@query("event_runs_in_batches", with_views(RUNS.replace("fx_mhw", "fx_revised"), "fx_mhw", grid="wide", extra=_REVISED))
def event_runs_in_batches(fx):
    """Runs kept up to date: most days first, then those of some months, then revisions of loaded days."""
    mhw = fx.on("wide").mhw
    late, revised = F.month("date").isin(5, 11), F.day("date") % 9 == 0
    final = mhw.filter(~(revised & (F.col("cat") == 1))).withColumn("cat", F.when(revised, F.least(F.col("cat") + 1, F.lit(5))).otherwise(F.col("cat")))
    runs = ev.event_runs(mhw.filter(~late), classes=True)
    for events, chosen in ((mhw, late), (final, revised)):
        dates = sorted(r.date for r in mhw.filter(chosen).select("date").distinct().collect())  # days, not cells
        stay, new = ev.renewed_runs(runs, events, dates)
        runs = stay.select(*new.columns).unionByName(new)
    return runs.drop("classes")


def _summary_sql(where: str) -> str:
    pick = ", ".join(
        f"{side}.{f} as {side}_{f}" for side in ("current", "longest") for f in ("start", "\"end\"", "days", "peak")
    ).replace('current_"end"', "current_end").replace('longest_"end"', "longest_end")
    return f"""
        select t.gy, t.gx, {pick},
               cast(coalesce(a.days, 0) as bigint) as days, cast(coalesce(a.events, 0) as bigint) as events, t.through
        from (select gy, gx, max(date) as through from fx_sst group by 1, 2) t
        left join (select gy, gx, sum(days) as days, count(*) as events from runs group by 1, 2) a using (gy, gx)
        left join (select * exclude (rn) from (select *, row_number() over (
                     partition by gy, gx order by days desc, start) as rn from runs) where rn = 1) longest
          on longest.gy = t.gy and longest.gx = t.gx
        left join runs current on current.gy = t.gy and current.gx = t.gx and current."end" = t.through
        {where}"""


@query("mhw_events_point", with_views(
    _summary_sql("where t.gy = 1900 and t.gx = 3600"), "fx_mhw", "fx_sst", extra=f"runs as ({RUNS})"))
def mhw_events_point(fx):
    runs = ev.event_runs(se.at_cell(fx.mhw, CELL))
    return ev.run_summary(runs, se.at_cell(fx.sst, CELL))


@query("mhw_run_summary", with_views(
    _summary_sql(""), "fx_mhw", "fx_sst", grid="wide", extra=f"runs as ({RUNS})"))
def mhw_run_summary(fx):
    wide = fx.on("wide")
    return ev.run_summary(ev.event_runs(wide.mhw), wide.sst)


# ------------------------------------------------------- statistics of a series

# every cell's monthly anomaly series, one row per cell and month
CELL_MONTHS = f"s as (select gy, gx, {MONTH} as bucket, {mean('raw')} as value from fx_anom group by 1, 2, 3)"
KEYS = ["gy", "gx"]


def _months(fx):
    return se.cell_series(fx.archive, "anom", "monthly")


@query("series_stats", with_views("""
    select s.gy, s.gx, count(*) as n, round(avg(value), 6) as mean, max(bucket) as last_bucket,
           arg_max(bucket, (value, -epoch(cast(bucket as timestamp)))) as max_bucket, max(value) as max_value,
           arg_min(bucket, (value, epoch(cast(bucket as timestamp)))) as min_bucket, min(value) as min_value
    from s group by 1, 2""", "fx_anom", extra=CELL_MONTHS))
def series_stats(fx):
    return st.extremes(_months(fx), KEYS).withColumn("mean", F.round("mean", 6))


@query("trend_per_decade", with_views("""
    select gy, gx, round(case when min(bucket) < max(bucket) then
        regr_slope(value, cast(date_diff('day', date '1970-01-01', bucket) as double))*3652.5 end, 6)
        as trend_per_decade
    from s group by 1, 2""", "fx_anom", extra=CELL_MONTHS))
def trend_per_decade(fx):
    return st.trend_per_decade(_months(fx), KEYS).withColumn("trend_per_decade", F.round("trend_per_decade", 6))


@query("recent_mean", with_views("""
    select gy, gx, round(avg(value), 6) as recent_mean
    from s join (select gy, gx, max(bucket) as b from s group by 1, 2) using (gy, gx)
    where bucket > date_add(b, -365) group by 1, 2""", "fx_anom", extra=CELL_MONTHS))
def recent_mean(fx):
    return st.recent(_months(fx), KEYS).select(*KEYS, F.round("recent_mean", 6).alias("recent_mean"))


@query("active_recent", with_views(f"""
    select gy, gx, count(*) filter (where value >= 1) as active_hits, count(*) as active_of
    from s join (select gy, gx, max(bucket) as b from s group by 1, 2) using (gy, gx)
    where bucket > date_add(b, -365) group by 1, 2""", "fx_class", grid="wide",
    extra=f"s as (select gy, gx, {WEEK} as bucket, max(raw) as value from fx_class group by 1, 2, 3)"))
def active_recent(fx):
    weeks = se.cell_series(fx.on("wide").archive, "mhw", "weekly")
    return st.recent(weeks, KEYS).select(*KEYS, "active_hits", "active_of")


@query("value_rank", with_views("""
    select c.gy, c.gx, c.bucket as current_bucket, c.value as current_value,
           1 + count(*) filter (where s.value > c.value) as rank, count(*) as "of"
    from s join (select * from s where bucket = date '1998-05-01') c on c.gy = s.gy and c.gx = s.gx
    group by 1, 2, 3, 4""", "fx_anom", extra=CELL_MONTHS))
def value_rank(fx):
    return st.value_rank(_months(fx), KEYS, day("1998-05-01"))


@query("series_summary", with_views("""
    select gy, gx, n, round(mean, 6) as mean, max_bucket, max_value, min_bucket, min_value, round(trend, 6) as trend_per_decade,
           round(recent, 6) as recent_mean, cast(null as bigint) as active_hits, cast(null as bigint) as active_of,
           current_bucket, current_value, case when current_value is not null then over + 1 end as rank, round(recent - mean, 6) as recent_vs_mean, last_bucket
    from (
      select s.gy, s.gx, count(*) as n, avg(value) as mean, max(bucket) as last_bucket,
             arg_max(bucket, (value, -epoch(cast(bucket as timestamp)))) as max_bucket, max(value) as max_value,
             arg_min(bucket, (value, epoch(cast(bucket as timestamp)))) as min_bucket, min(value) as min_value,
             case when min(bucket) < max(bucket) then regr_slope(value, cast(date_diff('day', date '1970-01-01', bucket) as double))*3652.5 end as trend,
             avg(value) filter (where bucket > date_add(b, -365)) as recent,
             any_value(c.bucket_) as current_bucket, any_value(c.value_) as current_value, count(*) filter (where value > c.value_) as over
      from s join (select gy, gx, max(bucket) as b from s group by 1, 2) l using (gy, gx)
      left join (select gy, gx, bucket as bucket_, value as value_ from s where bucket = date '1998-05-01') c using (gy, gx)
      group by 1, 2)""", "fx_anom", extra=CELL_MONTHS))
def series_summary(fx):
    out = st.summarise(_months(fx), KEYS, day("1998-05-01"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "trend_per_decade", "recent_mean", "recent_vs_mean")})



@query("whole_classes", with_views("""
    select gy, gx, bool_and(value = floor(value)) as whole_classes from s group by 1, 2""",
    "fx_anom", extra=CELL_MONTHS))
def whole_classes(fx):
    return st.whole_classes(_months(fx), KEYS)


# probes: every event's instant moved into the series' years, at every cell
@query("nearest_bucket", with_views(f"""
    select x, arg_min(bucket, (abs(epoch_us(x) - epoch_us(cast(bucket as timestamp))), bucket)) as bucket
    from (select event_id, ts - interval 24 year as x from events), s group by event_id, x""", "fx_anom",
    extra=f"s as (select distinct {MONTH} as bucket from fx_anom where {AT})"))
def nearest_bucket(fx):
    one = se.point_series(fx.archive, *POINT, "anom", "monthly").select("bucket")
    probes = fx.table("events").select(F.expr("ts - interval 24 year").alias("x"))
    return st.nearest_bucket(one, probes, [])

