"""Column functions over every row of a table, and the exports built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid import domain as dm
from tidegrid.functions import calendar as cal
from tidegrid.functions import grid as gr
from tidegrid.functions import packing as pk
from tidegrid.functions import wording as wd
from tidegrid.operators import ranking as rk
from tidegrid.operators import regions as rg
from tidegrid.operators import rollup as ru
from tidegrid.operators import series as se
from tidegrid.plans import reports as rp
from tidegrid.sources import export as ex

from .fixtures import CELL, POINT, day, with_views
from .points import MONTH, mean
from .ranks import EDGES, _ranking_sql
from .registry import query

# degrees drawn from the orders: latitudes -60..65, longitudes in both conventions
PLACES_SQL = """places as (select distinct -62 + cast((o_custkey*131 + o_orderkey*17) % 13000 as double)/cast(100 as double) as lat,
    -180 + cast((o_orderkey*271) % 54000 as double)/cast(100 as double) as lon from orders)"""


def _places(fx):
    return fx.table("orders").select(
        F.expr("-62 + cast((o_custkey*131 + o_orderkey*17) % 13000 as double)/cast(100 as double)").alias("lat"),
        F.expr("-180 + cast((o_orderkey*271) % 54000 as double)/cast(100 as double)").alias("lon"),
    ).distinct()


@query("cell_of", f"""
    with {PLACES_SQL}
    select lat, lon, cast(round_even((lat - -89.975::double)/0.05::double, 0) as int) as gy,
           cast(round_even(((lon - 0.025::double) % 360::double + case when lon < 0.025 then 360 else 0 end)/0.05::double, 0) as int)
             % 7200 as gx from places""")
def cell_of(fx):
    return _places(fx).select("lat", "lon", gr.gy_of("lat").alias("gy"), gr.gx_of("lon").alias("gx"))


@query("centre_of", with_views("""
    select distinct gy, gx, -89.975::double + gy*0.05::double as lat, 0.025::double + gx*0.05::double as lon,
           round(cos(radians(-89.975::double + gy*0.05::double)), 9) as weight from fx_cells""", "fx_cells", grid="wide"))
def centre_of(fx):
    return fx.on("wide").cells.select("gy", "gx").distinct().select(
        "gy", "gx", gr.lat_of("gy").alias("lat"), gr.lon_of("gx").alias("lon"),
        F.round(gr.area_weight("gy"), 9).alias("weight"),
    )


_HALF = dm.half_step(dm.PACIFIC)


@query("inside_domain", f"""
    with {PLACES_SQL}
    select lat, lon, lat between {-59.975 - _HALF!r} and {64.975 + _HALF!r}
        and ((lon - 100.025::double) % 360 + 360) % 360 + 100.025::double between {100.025 - _HALF!r} and {289.975 + _HALF!r}
        as inside from places""")
def inside_domain(fx):
    return _places(fx).select("lat", "lon", gr.inside("lat", "lon").alias("inside"))


@query("region_members", with_views("""
    select distinct region, gy, gx from fx_cells join fx_regions on gy between gy0 and gy1 and gx between gx0 and gx1""",
    "fx_cells", "fx_regions", grid="wide"))
def region_members(fx):
    wide = fx.on("wide")
    return rg.assign_regions(wide.cells.select("gy", "gx").distinct(), wide.dim).select("region", "gy", "gx")


def _bucket(expr: str, d: str = "date") -> tuple[str, str]:
    return {
        "daily": (d, d),
        "weekly": (f"cast(date_trunc('week', {d}) as date)", f"date_add(cast(date_trunc('week', {d}) as date), 6)"),
        "monthly": (f"cast(date_trunc('month', {d}) as date)", f"last_day({d})"),
    }[expr]


@query("bucket_calendar", with_views(f"""
    select date, cast(month(date)*100 + day(date) as int) as mmdd,
           {_bucket('weekly')[0]} as week, {_bucket('weekly')[1]} as week_end,
           {_bucket('monthly')[0]} as month, {_bucket('monthly')[1]} as month_end,
           date_add({_bucket('weekly')[0]}, -21) as three_weeks_back,
           cast({_bucket('monthly')[0]} + interval 5 month as date) as five_months_on,
           case when date_add({_bucket('weekly')[0]}, 7) <= cast(date_trunc('week', date '1999-06-30') as date)
                then date_add({_bucket('weekly')[0]}, 7) end as next_week,
           least(greatest(cast({_bucket('monthly')[0]} + interval 12 month as date), date '1995-02-01'), date '2001-08-01') as year_on,
           cast(day(last_day(date)) as int) as days_in_month,
           cast(dayofyear(make_date(year(date), 12, 31)) as int) as days_in_year,
           case when cast(date_trunc('week', date_trunc('month', date)) as date) < cast(date_trunc('month', date) as date)
                then date_add(cast(date_trunc('week', date_trunc('month', date)) as date), 7)
                else cast(date_trunc('week', date_trunc('month', date)) as date) end as first_monday,
           strftime(date, '%-d %b %Y') as day_label, strftime(date, '%B %Y') as month_label,
           concat(strftime({_bucket('weekly')[0]}, '%-d %b'), ' – ', strftime({_bucket('weekly')[1]}, '%-d %b')) as week_label
    from fx_dates""", "fx_dates"))
def bucket_calendar(fx):
    d = F.col("date")
    return fx.dates.select(
        "date", cal.mmdd(d).alias("mmdd"),
        cal.bucket_start(d, "weekly").alias("week"), cal.bucket_end(d, "weekly").alias("week_end"),
        cal.bucket_start(d, "monthly").alias("month"), cal.bucket_end(d, "monthly").alias("month_end"),
        cal.shift_buckets(d, "weekly", -3).alias("three_weeks_back"),
        cal.shift_buckets(d, "monthly", 5).alias("five_months_on"),
        cal.next_bucket(d, "weekly", day("1999-06-30")).alias("next_week"),
        cal.step_within(d, "monthly", 12, day("1995-02-01"), day("2001-08-01")).alias("year_on"),
        cal.days_in_month(d).alias("days_in_month"), cal.days_in_year(d).alias("days_in_year"),
        cal.first_bucket_in_month(F.year(d), F.month(d), "weekly").alias("first_monday"),
        cal.bucket_label(d, "daily").alias("day_label"), cal.bucket_label(d, "monthly").alias("month_label"),
        cal.bucket_label(d, "weekly").alias("week_label"),
    )


@query("physical_values", """
    select l_orderkey, l_linenumber, raw, case when raw <> -200 then raw*0.01::double end as value,
           case when code between 1 and 5 then code end as class from (
      select l_orderkey, l_linenumber, cast(l_quantity as int)*60 - 260 as raw,
             cast(round(l_discount*100) as int) - 5 as code from lineitem)""")
def physical_values(fx):
    from dataclasses import replace

    # the fill value of this made-up encoding is -200 counts
    packed = replace(dm.VARIABLES["sst"], fill=-200)
    lines = fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("cast(l_quantity as int)*60 - 260").alias("raw"),
        F.expr("cast(round(l_discount*100) as int) - 5").alias("code"),
    )
    return lines.select("l_orderkey", "l_linenumber", "raw", pk.physical("raw", packed).alias("value"),
                        pk.class_or_null("code").alias("class"))


@query("index_words", with_views("""
    select region, month,
           case when anom >= 0.5 then 'el_nino' when anom <= -0.5 then 'la_nina' else 'neutral' end as phase,
           case when abs(anom) >= 2 then 'very strong' when abs(anom) >= 1.5 then 'strong' when abs(anom) >= 1 then 'moderate'
                else 'weak' end as strength,
           concat(list_element(['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'], month(month)), ' ', year(month)) as season,
           case when abs(anom - 0.25) < 0.05 then 'at' when anom > 0.25 then 'above' else 'below' end as gap,
           case when anom >= 1.15 then 'above' when anom <= 0.85 then 'below' else 'about normal' end as extent
    from fx_monthly""", "fx_monthly"))
def index_words(fx):
    from tidegrid.operators.state import monthly_index

    return monthly_index(fx.rollup, fx.normals).select(
        "region", "month", wd.phase("anom").alias("phase"), wd.strength("anom").alias("strength"),
        wd.season("month").alias("season"), wd.gap_word("anom", F.lit(0.25)).alias("gap"),
        wd.extent_word("anom").alias("extent"),
    )


@query("slugs", """
    select p_partkey, case when trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') = '' then 'export'
           else trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') end as slug,
           concat(cast(p_partkey as varchar), case when p_partkey % 100 between 11 and 13 then 'th'
             when p_partkey % 10 = 1 then 'st' when p_partkey % 10 = 2 then 'nd' when p_partkey % 10 = 3 then 'rd' else 'th' end) as place
    from part""")
def slugs(fx):
    return fx.table("part").select("p_partkey", wd.slug("p_name").alias("slug"), wd.ordinal("p_partkey").alias("place"))


@query("cell_slugs", f"""
    with {PLACES_SQL}, s as (select lat, lon, ((lon + 180) % 360 + 360) % 360 - 180 as e from places)
    select lat, lon, replace(concat(printf('%.2f', abs(lat)), case when lat < 0 then 's' else 'n' end, '_',
                                    printf('%.2f', abs(e)), case when e < 0 then 'w' else 'e' end), '.', '-') as slug from s""")
def cell_slugs(fx):
    return _places(fx).select("lat", "lon", wd.cell_slug("lat", "lon").alias("slug"))


@query("class_names", with_views("""
    select gy, gx, date, cast(raw as double) as value,
           list_element(['no heatwave', 'Moderate', 'Strong', 'Severe', 'Extreme', 'Beyond extreme'], raw + 1) as label
    from fx_class""", "fx_class", grid="wide"))
def class_names(fx):
    days = se.daily_values(fx.on("wide").archive, "mhw").select("gy", "gx", "date", F.col("raw").cast("double").alias("value"))
    return rp.named_value(days, fx.spark).select("gy", "gx", "date", "value", "label")


# ---------------------------------------------------------------------- exports


@query("series_export", with_views(f"""
    select bucket as start_date, last_day(bucket) as end_date, printf('%.6f', value) as "anom_degC"
    from (select {MONTH} as bucket, {mean('raw')} as value from fx_anom where gy = 1900 and gx = 3600 group by 1)""", "fx_anom"))
def series_export(fx):
    return ex.series_rows(se.point_series(fx.archive, *POINT, "anom", "monthly"), "anom", "monthly", precision=6)


@query("region_export", with_views("""
    select region, date as start_date, date as end_date, printf('%.3f', round(mhw_area_frac*100, 3)) as mhw_extent_pct
    from fx_region_daily""", "fx_region_daily"))
def region_export(fx):
    daily = ru.region_series(fx.rollup, None, "mhw").withColumn("value", F.round("value", 3))
    return ex.series_rows(daily, "mhw", "daily", region=True, precision=3, keys=("region",))


@query("ranking_export", with_views("""
    select month, strftime(make_date(2000, greatest(month, 1), 1), '%B') as month_name, year, rank,
           printf('%.6f', mean) as "mean_anom_degC", printf('%.6f', sd) as sd, n as days,
           cast(partial as varchar) as partial
    from (""" + _ranking_sql("(select date, raw as value from fx_anom where gy = 1900 and gx = 3600)", scale="0.01")
    + ") where month > 0", "fx_anom", extra=EDGES))
def ranking_export(fx):
    days = se.daily_values(fx.archive, "anom", cell=CELL).select("date", F.col("raw").alias("value"))
    ranking = rk.ranked_periods(days, rk.archive_edges(fx.sst), scale=0.01)
    ranking = ranking.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})
    return ex.ranking_rows(ranking, "anom", precision=6)


# ---------------------------------------------------------------------- reports


@query("point_report", with_views(f"""
    select gy, gx, bucket, round(value, 2) as value, n_days, 'anom' as variable, 'degC' as units,
           -89.975::double + gy*0.05::double as lat, 0.025::double + gx*0.05::double as lon
    from (select gy, gx, date as bucket, raw*0.01::double as value, cast(1 as bigint) as n_days
          from fx_anom where gy = 1900 and gx = 3600)""", "fx_anom"))
def point_report(fx):
    out = rp.point_timeseries(fx.archive, *POINT, "anom")
    return out.select("gy", "gx", "bucket", "value", "n_days", "variable", "units", "lat", "lon")


@query("extent_report", with_views("""
    select region, date, round(extent, 1) as extent, round(normal, 1) as normal, rank, "of", round(extent/nullif(normal, 0), 1) as ratio,
           case when round(extent/nullif(normal, 0), 1) is null then 'rank'
                when round(extent/nullif(normal, 0), 1) >= 1.15 then 'above' when round(extent/nullif(normal, 0), 1) <= 0.85 then 'below' else 'about normal' end as wording,
           '1991-2020' as baseline, 7 as window_days
    from (select s.region, l.date, l.extent,
                 avg(s.extent) filter (where year(s.date) between 1991 and 2020 and
                   least(abs(dayofyear(s.date) - dayofyear(l.date)), 366 - abs(dayofyear(s.date) - dayofyear(l.date))) <= 7) as normal,
                 1 + count(*) filter (where s.extent > l.extent) as rank, count(*) as "of"
          from x s join (select region, max(date) as date, arg_max(extent, date) as extent from x group by region) l on l.region = s.region
          group by s.region, l.date, l.extent)""", "fx_region_daily",
    extra="x as (select region, date, round(mhw_area_frac*100, 9) as extent from fx_region_daily where region = 'pacific')"))
def extent_report(fx):
    return rp.extent_report(fx.rollup.withColumn("mhw_area_frac", F.round("mhw_area_frac", 11)))


@query("ranking_export_annual", with_views("""
    select year, rank, printf('%.6f', mean) as "mean_anom_degC", printf('%.6f', sd) as sd, n as days, cast(partial as varchar) as partial
    from (""" + _ranking_sql("(select date, raw as value from fx_anom where gy = 1900 and gx = 3600)", scale="0.01")
    + ") where month = 0", "fx_anom", extra=EDGES))
def ranking_export_annual(fx):
    days = se.daily_values(fx.archive, "anom", cell=CELL).select("date", F.col("raw").alias("value"))
    ranking = rk.ranked_periods(days, rk.archive_edges(fx.sst), scale=0.01)
    ranking = ranking.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})
    return ex.ranking_rows(ranking, "anom", precision=6, basis="year")
