"""Rankings of months and years, and the index state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import ranking as rk
from tidegrid.operators import rollup as ru
from tidegrid.operators import series as se
from tidegrid.operators import state as sa

from .areas import rounded
from .fixtures import BASE_YEARS, CELL, with_views
from .registry import query

EDGES = "e as (select min(date) as a, max(date) as b from fx_sst)"
PARTIAL = """
    case when month = 0 then (year = year(a) and dayofyear(a) > 1)
                          or (year = year(b) and (month(b) < 12 or day(b) < 31))
         else (year = year(a) and month = month(a) and day(a) > 1)
           or (year = year(b) and month = month(b) and b < last_day(b)) end"""


def _ranking_sql(source: str, keys: str = "", scale: str = "1", total: str = "sum(value)") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
        select {k}cast(month as int) as month, cast(year as int) as year, round(mean, 6) as mean,
               round(sd, 6) as sd, n,
               cast(row_number() over (partition by {k}month order by mean desc, year) as int) as rank,
               {PARTIAL} as partial,
               row_number() over (partition by {k}month order by mean desc, year) <= 10 as is_top
        from (select {k}case when grouping(month) = 1 then 0 else month end as month, year,
                     cast({total} as double)/count(*)*{scale} as mean, stddev_samp(value)*{scale} as sd, count(*) as n
              from (select {k}month(date) as month, year(date) as year, value from {source})
              group by grouping sets (({k}month, year), ({k}year))), e"""


def _rounded(df):
    return rounded(df, "mean", "sd")


@query("ranked_periods", with_views(
    _ranking_sql("(select gy, gx, date, raw as value from fx_anom)", "gy, gx", "0.01"), "fx_anom", extra=EDGES))
def ranked_periods(fx):
    days = se.daily_values(fx.archive, "anom").withColumnRenamed("raw", "value")
    return _rounded(rk.ranked_periods(days, rk.archive_edges(fx.sst), ["gy", "gx"], scale=0.01))


@query("monthly_ranking_point", with_views(
    _ranking_sql("(select date, raw as value from fx_anom where gy = 1900 and gx = 3600)", scale="0.01"),
    "fx_anom", extra=EDGES))
def monthly_ranking_point(fx):
    days = se.daily_values(fx.archive, "anom", cell=CELL).select("date", F.col("raw").alias("value"))
    return _rounded(rk.ranked_periods(days, rk.archive_edges(fx.sst), scale=0.01))


@query("monthly_ranking_point_mhw", with_views(
    _ranking_sql("(select date, raw as value from fx_class where gy = 1900 and gx = 3600)"),
    "fx_class", extra=EDGES))
def monthly_ranking_point_mhw(fx):
    days = se.daily_values(fx.archive, "mhw", cell=CELL).select("date", F.col("raw").alias("value"))
    return _rounded(rk.ranked_periods(days, rk.archive_edges(fx.sst), scale=1.0))


@query("monthly_ranking_region", with_views(
    _ranking_sql("(select region, date, value from fx_region_anom)", "region"), "fx_region_anom", extra=EDGES))
def monthly_ranking_region(fx):
    days = ru.region_values(fx.rollup, fx.normals, "anom")
    return _rounded(rk.ranked_periods(days, rk.archive_edges(fx.sst), ["region"]))


@query("partial_notes", with_views("""
    select month, year, printf('* %s is incomplete — ranked on %d of %d days, so its place will move.',
        case when month = 0 then cast(year as varchar)
             else strftime(make_date(year, month, 1), '%B %Y') end, n,
        case when month = 0 then dayofyear(make_date(year, 12, 31))
             else day(last_day(make_date(year, month, 1))) end) as note
    from (select * from (""" + _ranking_sql(
    "(select date, raw as value from fx_anom where gy = 1900 and gx = 3600)", scale="0.01") + """) where partial)
    """, "fx_anom", extra=EDGES).replace("make_date(year, month, 1)", "make_date(year, greatest(month, 1), 1)"))
def partial_notes(fx):
    days = se.daily_values(fx.archive, "anom", cell=CELL).select("date", F.col("raw").alias("value"))
    return rk.partial_notes(rk.ranked_periods(days, rk.archive_edges(fx.sst), scale=0.01))


@query("ranking_span", with_views("""
    select cast(date_trunc('month', a) as date) as span_start, last_day(b) as span_end, b as through from e""",
    "fx_sst", extra=EDGES))
def ranking_span(fx):
    return rk.ranking_span(rk.archive_edges(fx.sst))


# ----------------------------------------------------------------------- state


@query("monthly_index", with_views(
    "select region, month, round(anom, 6) as anom, n_days from fx_monthly", "fx_monthly"))
def monthly_index(fx):
    return rounded(sa.monthly_index(fx.rollup, fx.normals), "anom")


SEASONS = """
    full_months as (select region, month, anom from fx_monthly m
      where not (n_days < day(last_day(month)) and month = (select max(month) from fx_monthly x where x.region = m.region))),
    seasons as (select b.region, b.month as middle, (a.anom + b.anom + c.anom)/3 as idx
      from full_months b
      join full_months a on a.region = b.region and a.month = cast(b.month - interval 1 month as date)
      join full_months c on c.region = b.region and c.month = cast(b.month + interval 1 month as date))"""


@query("running_index", with_views(
    'select region, middle, round(idx, 6) as "index" from seasons', "fx_monthly", extra=SEASONS))
def running_index(fx):
    return rounded(sa.running_index(sa.monthly_index(fx.rollup, fx.normals)), "index")


EPISODE = """
    latest as (select region, max(middle) as season_end, arg_max(idx, middle) as idx,
                      case when arg_max(idx, middle) >= 0.5 then 1 when arg_max(idx, middle) <= -0.5 then -1
                           else 0 end as sign
               from seasons group by region),
    runs as (select l.region, l.season_end, l.idx, l.sign,
                    case when l.sign = 0 then 0 else count(*) filter (where s.middle > coalesce(
                      (select max(x.middle) from seasons x where x.region = l.region and x.idx*l.sign < 0.5),
                      date '0001-01-01')) end as n
             from latest l join seasons s on s.region = l.region group by l.region, l.season_end, l.idx, l.sign)"""


@query("episode_run", with_views("""
    select region,
           concat(list_element(['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'],
                               month(season_end)), ' ', year(season_end)) as season,
           season_end, round(idx, 6) as "index",
           case sign when 1 then 'el_nino' when -1 then 'la_nina' else 'neutral' end as phase,
           case when sign = 0 then null when abs(idx) >= 2 then 'very strong' when abs(idx) >= 1.5 then 'strong'
                when abs(idx) >= 1 then 'moderate' else 'weak' end as strength,
           cast(n as bigint) as seasons, n >= 5 as episode
    from runs""", "fx_monthly", extra=f"{SEASONS}, {EPISODE}"))
def episode_run(fx):
    return rounded(sa.episode_run(sa.running_index(sa.monthly_index(fx.rollup, fx.normals))), "index")


@query("same_month_rank", with_views("""
    select region, month, round(anom, 6) as anom, n_days, n_days < day(last_day(month)) as partial,
           cast(rank() over (partition by region, month(month) order by anom desc) as int) as rank,
           count(*) over (partition by region, month(month)) as "of"
    from fx_monthly""", "fx_monthly"))
def same_month_rank(fx):
    return rounded(sa.same_month_rank(sa.monthly_index(fx.rollup, fx.normals)), "anom")


@query("index_state", with_views("""
    select r.region, concat(list_element(['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'],
                               month(r.season_end)), ' ', year(r.season_end)) as season,
           r.season_end, round(r.idx, 6) as "index",
           case r.sign when 1 then 'el_nino' when -1 then 'la_nina' else 'neutral' end as phase,
           case when r.sign = 0 then null when abs(r.idx) >= 2 then 'very strong' when abs(r.idx) >= 1.5 then 'strong'
                when abs(r.idx) >= 1 then 'moderate' else 'weak' end as strength,
           cast(r.n as bigint) as seasons, r.n >= 5 as episode, m.month as latest_month,
           round(m.anom, 6) as latest_value, m.n_days as latest_days, m.n_days < day(last_day(m.month)) as latest_partial,
           (select cast(1 + count(*) as int) from fx_monthly x where x.region = m.region and month(x.month) = month(m.month)
              and x.anom > m.anom) as latest_rank,
           (select count(*) from fx_monthly x where x.region = m.region and month(x.month) = month(m.month)) as latest_of
    from runs r join fx_monthly m on m.region = r.region
     and m.month = (select max(month) from fx_monthly x where x.region = r.region)""",
    "fx_monthly", extra=f"{SEASONS}, {EPISODE}"))
def index_state(fx):
    return rounded(sa.index_state(fx.rollup, fx.normals), "index", "latest_value")


@query("doy_normal", with_views(f"""
    select region, date, round(extent, 6) as extent, round(normal, 6) as normal, rank, "of",
           round(extent/normal, 6) as ratio
    from (select s.region, l.date, l.extent,
                 avg(s.extent) filter (where year(s.date) between {BASE_YEARS[0]} and {BASE_YEARS[1]} and
                   least(abs(dayofyear(s.date) - dayofyear(l.date)),
                         366 - abs(dayofyear(s.date) - dayofyear(l.date))) <= 7) as normal,
                 1 + count(*) filter (where s.extent > l.extent) as rank, count(*) as "of"
          from x s join (select region, max(date) as date, arg_max(extent, date) as extent from x group by region) l
            on l.region = s.region
          group by s.region, l.date, l.extent)""", "fx_region_daily",
    extra="x as (select region, date, round(mhw_area_frac*100, 9) as extent from fx_region_daily)"))
def doy_normal(fx):
    # nine places, so that equal extents are equal however they were summed
    rollup = fx.rollup.withColumn("mhw_area_frac", F.round("mhw_area_frac", 11))
    return rounded(sa.extent_state(rollup, BASE_YEARS), "extent", "normal", "ratio")
