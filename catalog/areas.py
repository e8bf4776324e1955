"""Boxes, named regions and polygons: weighted means, extents, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import regions as rg
from tidegrid.operators import rollup as ru

from .fixtures import BOXES, with_views
from .points import MONTH
from .registry import query

W = "cos(radians(-89.975 + gy*0.05))"
SOUTH = "gy between 800 and 1500 and gx between 2300 and 4300"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


MEANS = ("mean_sst", "mean_sst_clim", "mean_mhw", "mhw_area_frac")
ROUNDED_MEANS = ", ".join(f"round({m}, 6) as {m}" for m in MEANS)
REGION_DAILY_SQL = f"select region, date, {ROUNDED_MEANS}, n_cells, n_cells_clim, n_cells_mhw from fx_region_daily"


@query("box_sst", with_views(f"""
    select date, round(sum(sst_raw*0.01*{W})/sum({W}), 6) as value, count(*) as n_cells
    from fx_sst where {SOUTH} group by date""", "fx_sst", grid="wide"))
def box_sst(fx):
    return rounded(ru.box_sst(fx.on("wide").archive, BOXES["south"]), "value")


@query("box_clim", with_views(f"""
    select mmdd, round(sum(clim_raw*0.01*{W})/sum({W}), 6) as mean_clim, count(*) as n_cells
    from fx_clim where {SOUTH} group by mmdd""", "fx_clim", grid="wide"))
def box_clim(fx):
    return rounded(ru.box_clim(fx.on("wide").clim, BOXES["south"]), "mean_clim")


@query("box_anom", with_views(f"""
    select d.date, round(d.v - c.v, 6) as value, n_cells
    from (select date, sum(sst_raw*0.01*{W})/sum({W}) as v, count(*) as n_cells
          from fx_sst where {SOUTH} and has_clim group by date) d
    join (select mmdd, sum(clim_raw*0.01*{W})/sum({W}) as v from fx_clim where {SOUTH} group by mmdd) c
      on c.mmdd = month(d.date)*100 + day(d.date)""", "fx_sst", "fx_clim"))
def box_anom(fx):
    return rounded(ru.box_anom(fx.archive, BOXES["south"]), "value")


@query("box_mhw_extent", with_views(f"""
    select s.date, round(100*coalesce(m.a, 0)/s.a, 6) as value, s.n_cells
    from (select date, sum({W}) as a, count(*) as n_cells from fx_sst where {SOUTH} group by date) s
    left join (select date, sum({W}) as a from fx_mhw where {SOUTH} group by date) m on m.date = s.date""",
    "fx_sst", "fx_mhw", grid="wide"))
def box_mhw_extent(fx):
    return rounded(ru.box_extent(fx.on("wide").archive, BOXES["south"]), "value")


@query("box_series", with_views(f"""
    select {MONTH} as bucket, round(avg(value), 6) as value, count(*) as n_days,
           arg_max(n_cells, date) as n_cells
    from (select date, sum(sst_raw*0.01*{W})/sum({W}) as value, count(*) as n_cells
          from fx_sst where {SOUTH} group by date) group by 1""", "fx_sst", grid="wide"))
def box_series(fx):
    return rounded(ru.box_series(fx.on("wide").archive, BOXES["south"], "sst", "monthly"), "value")


@query("region_daily", with_views(REGION_DAILY_SQL, "fx_region_daily"))
def region_daily(fx):
    return rounded(fx.rollup, *MEANS)


@query("region_daily_wide", with_views(REGION_DAILY_SQL, "fx_region_daily", grid="wide"))
def region_daily_wide(fx):
    return rounded(fx.on("wide").rollup, *MEANS)


@query("region_clim", with_views(
    "select region, mmdd, round(mean_clim, 6) as mean_clim, n_cells from fx_region_clim", "fx_region_clim",
    grid="wide"))
def region_clim(fx):
    return rounded(fx.on("wide").normals, "mean_clim")


@query("region_anom", with_views(
    "select region, date, round(value, 6) as value, n_cells from fx_region_anom", "fx_region_anom", grid="wide"))
def region_anom(fx):
    wide = fx.on("wide")
    return rounded(ru.region_values(wide.rollup, wide.normals, "anom"), "value")


def _series_sql(daily: str, bucket: str, quantity: str = "null") -> str:
    return f"""
        select region, {bucket} as bucket, round(avg(value), 6) as value, count(*) as n_days,
               arg_max(n_cells, date) as n_cells, cast({quantity} as varchar) as quantity
        from {daily} group by 1, 2"""


@query("region_series", with_views(
    _series_sql("(select region, date, mean_sst as value, n_cells from fx_region_daily where region = 'south')",
                "cast(date_trunc('week', date) as date)"), "fx_region_daily"))
def region_series(fx):
    return rounded(ru.region_series(fx.rollup, None, "sst", "weekly", region="south"), "value")


@query("region_series_sst", with_views(
    _series_sql("(select region, date, mean_sst as value, n_cells from fx_region_daily)", MONTH),
    "fx_region_daily", grid="wide"))
def region_series_sst(fx):
    return rounded(ru.region_series(fx.on("wide").rollup, None, "sst", "monthly"), "value")


@query("region_series_anom", with_views(_series_sql("fx_region_anom", MONTH), "fx_region_anom", grid="wide"))
def region_series_anom(fx):
    wide = fx.on("wide")
    return rounded(ru.region_series(wide.rollup, wide.normals, "anom", "monthly"), "value")


@query("region_series_mhw", with_views(
    _series_sql("(select region, date, mhw_area_frac*100 as value, n_cells from fx_region_daily)", MONTH,
                "'mhw_extent'"), "fx_region_daily", grid="wide"))
def region_series_mhw(fx):
    return rounded(ru.region_series(fx.on("wide").rollup, None, "mhw", "monthly"), "value")


# -------------------------------------------------------------------- polygons

# brute force: every cell of a polygon's bounding box against every edge
INSIDE = """
    hull as (select region, floor((min(y1) + 89.975)/0.05) as a, ceil((max(y1) + 89.975)/0.05) as b,
                    floor((min(x1) - 0.025)/0.05) as c, ceil((max(x1) - 0.025)/0.05) as d
             from fx_edges group by region),
    grid as (select region, gy, unnest(generate_series(cast(c as bigint), cast(d as bigint))) as gx from (
               select *, unnest(generate_series(cast(a as bigint), cast(b as bigint))) as gy from hull)),
    inside as (
      select region, cast(gy as int) as gy, cast(gx as int) as gx from (
        select g.region, gy, gx, cast(-89.975 as double) + gy*cast(0.05 as double) as py,
               cast(0.025 as double) + gx*cast(0.05 as double) as px, x1, y1, x2, y2
        from grid g join fx_edges e on e.region = g.region)
      group by 1, 2, 3
      having sum(case when (y1 > py) <> (y2 > py) and px < x1 + (py - y1)*(x2 - x1)/(y2 - y1)
                      then 1 else 0 end) % 2 = 1)"""


@query("polygon_cells", with_views("select region, gy, gx from inside", "fx_edges", extra=INSIDE))
def polygon_cells(fx):
    return rg.interval_cells(rg.polygon_intervals(fx.edges))


@query("polygon_intervals", with_views("""
    select region, gy, min(gx) as gx0, max(gx) as gx1 from (
      select *, gx - row_number() over (partition by region, gy order by gx) as island from inside)
    group by region, gy, island""", "fx_edges", extra=INSIDE))
def polygon_intervals(fx):
    return rg.cell_intervals(rg.interval_cells(rg.polygon_intervals(fx.edges)))


@query("masked_region_daily", with_views(f"""
    select s.region, s.date, round(s.v, 6) as mean_sst, s.n_cells, round(coalesce(m.a, 0)/s.a, 6) as mhw_area_frac,
           coalesce(m.n, 0) as n_cells_mhw
    from (select region, date, sum(sst_raw*0.01*{W})/sum({W}) as v, sum({W}) as a, count(*) as n_cells
          from fx_sst join inside using (gy, gx) group by 1, 2) s
    left join (select region, date, sum({W}) as a, count(*) as n
               from fx_mhw join inside using (gy, gx) group by 1, 2) m
      on m.region = s.region and m.date = s.date""", "fx_sst", "fx_mhw", "fx_edges", grid="wide", extra=INSIDE))
def masked_region_daily(fx):
    wide = fx.on("wide")
    dim = rg.interval_rows(rg.polygon_intervals(wide.edges))
    out = ru.region_daily(wide.archive, dim)
    return rounded(
        out.select("region", "date", "mean_sst", "n_cells", "mhw_area_frac", "n_cells_mhw"),
        "mean_sst", "mhw_area_frac",
    )
