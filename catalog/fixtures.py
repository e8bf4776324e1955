"""Archive tables derived from the given parquet tables.

`compact` has 20 cells with long, gappy series, `wide` spreads the same rows
over 50,000 cells. Region polygons come from the suppliers, so their number
grows with the data as well.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.domain import Box
from tidegrid.functions.calendar import mmdd
from tidegrid.operators import regions as rg
from tidegrid.operators import rollup as ru
from tidegrid.operators.ingest import flag_climatology
from tidegrid.schema import Archive

# name -> (gy expression, gx expression), valid in both dialects
GRIDS = {
    "compact": ("900 + 500*({a} % 4)", "2400 + 600*({b} % 5)"),
    "wide": ("900 + 15*({a} % 100)", "2400 + 5*({b} % 500)"),
}
BOXES = {
    "pacific": Box(600, 3099, 2000, 5799),
    "south": Box(800, 1500, 2300, 4300),
    "north": Box(1800, 2500, 2300, 4900),
    "east": Box(900, 2400, 4200, 4900),
}
CELL = (1900, 3600)
# centre of CELL in degrees
POINT = (-89.975 + 1900 * 0.05, 0.025 + 3600 * 0.05)
# corner offsets of the supplier triangles, degrees
CORNERS = ((-1.03, -0.77), (1.11, -0.49), (0.17, 0.93))
BASE_YEARS = (1996, 2000)


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str, grid: str = "compact"):
        self.spark, self.sf_dir, self.grid = spark, sf_dir, grid

    def on(self, grid: str) -> Fixture:
        return self if grid == self.grid else Fixture(self.spark, self.sf_dir, grid)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _cell(self, a: str, b: str):
        gy, gx = GRIDS[self.grid]
        return (
            F.expr(f"cast({gy.format(a=a, b=b)} as int)").alias("gy"),
            F.expr(f"cast({gx.format(a=a, b=b)} as int)").alias("gx"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(
                F.col("l_shipdate").cast("date").alias("date"),
                *self._cell("l_suppkey", "l_partkey"),
                F.expr("cast(l_quantity as int)*60 - 200").alias("s"),
                F.expr("cast(round(l_discount*100) as int) - 5").alias("m"),
            )
            .groupBy("date", "gy", "gx")
            .agg(F.max("s").alias("sst_raw"), F.max("m").alias("mhw_code"))
        )

    @cached_property
    def clim(self) -> DataFrame:
        if self.grid == "compact":
            source = self.table("orders").select(
                mmdd(F.col("o_orderdate").cast("date")).alias("mmdd"),
                *self._cell("o_custkey", "o_custkey"),
                F.expr("cast(floor(o_totalprice/200) as int)").alias("c"),
            )
        else:
            # lines that were not returned: most, but not all, of the daily keys
            source = self.table("lineitem").filter("l_returnflag <> 'R'").select(
                mmdd(F.col("l_shipdate").cast("date")).alias("mmdd"),
                *self._cell("l_suppkey", "l_partkey"),
                F.expr("cast(floor(l_extendedprice/20) as int)").alias("c"),
            )
        return (
            source.groupBy("mmdd", "gy", "gx")
            .agg(F.max("c").alias("clim_raw"))
        )

    @cached_property
    def sst(self) -> DataFrame:
        return flag_climatology(self.cells.select("date", "gy", "gx", "sst_raw"), self.clim)

    @cached_property
    def mhw(self) -> DataFrame:
        return self.cells.filter(F.col("mhw_code").between(1, 5)).select(
            "date", "gy", "gx", F.col("mhw_code").alias("cat")
        )

    @cached_property
    def archive(self) -> Archive:
        return Archive(self.sst, self.clim, self.mhw)

    @cached_property
    def dim(self) -> rg.RegionRows:
        return rg.box_rows(self.spark, BOXES)

    @cached_property
    def rollup(self) -> DataFrame:
        return ru.region_daily(self.archive, self.dim)

    @cached_property
    def normals(self) -> DataFrame:
        return ru.region_clim(self.clim, self.dim)

    @cached_property
    def edges(self) -> DataFrame:
        """A triangle per supplier, as ring edges."""
        s = self.table("supplier").select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("region"),
            F.expr("cast(105 + (s_suppkey*37) % 175 as double)").alias("cx"),
            F.expr("cast(-50 + (s_suppkey*29) % 105 as double)").alias("cy"),
        )
        points = F.array(*[
            F.struct((F.col("cx") + dx).alias("lon"), (F.col("cy") + dy).alias("lat")) for dx, dy in CORNERS
        ])
        return rg.ring_edges(s.select("region", F.lit(0).alias("ring"), points.alias("points")))

    @cached_property
    def versions(self) -> DataFrame:
        """Status rows in many versions, from the event stream."""
        return self.table("events").select(
            F.expr("case when user_id % 2 = 0 then 'sst' else 'mhw' end").alias("product"),
            F.col("ts").cast("date").alias("date"),
            F.expr(
                "case when event_type in ('purchase','view','click') then 'success_ingest'"
                " when event_type = 'error' then 'failed_ingest' else 'pending_download' end"
            ).alias("status"),
            F.expr("cast(floor(value*100) as bigint)").alias("n_rows"),
            F.col("user_id").cast("bigint").alias("remote_size"),
            F.col("ts").alias("updated_at"),
            F.col("event_id").cast("bigint").alias("event_id"),
        )

    @cached_property
    def dates(self) -> DataFrame:
        return self.cells.select("date").distinct()


# ------------------------------------------------------------------------- SQL

_W = "cos(radians(-89.975 + gy*0.05))"


def _views(grid: str) -> dict[str, tuple[tuple[str, ...], str]]:
    gy, gx = GRIDS[grid]
    boxes = ", ".join(f"('{k}',{b.gy0},{b.gy1},{b.gx0},{b.gx1})" for k, b in BOXES.items())
    corners = [(f"cx + ({dx})", f"cy + ({dy})") for dx, dy in CORNERS]
    ring = " union all ".join(
        f"select region, 0 as ring, {corners[i][0]} as x1, {corners[i][1]} as y1,"
        f" {corners[(i + 1) % 3][0]} as x2, {corners[(i + 1) % 3][1]} as y2 from fx_centres"
        for i in range(3)
    )
    return {
        "fx_cells": ((), f"""
            select cast(l_shipdate as date) as date,
                   cast({gy.format(a='l_suppkey', b='l_partkey')} as int) as gy,
                   cast({gx.format(a='l_suppkey', b='l_partkey')} as int) as gx,
                   max(cast(l_quantity as int)*60 - 200) as sst_raw,
                   max(cast(round(l_discount*100) as int) - 5) as mhw_code
            from lineitem group by 1, 2, 3"""),
        "fx_clim": ((), f"""
            select cast(month(l_shipdate)*100 + day(l_shipdate) as int) as mmdd,
                   cast({gy.format(a='l_suppkey', b='l_partkey')} as int) as gy,
                   cast({gx.format(a='l_suppkey', b='l_partkey')} as int) as gx,
                   max(cast(floor(l_extendedprice/20) as int)) as clim_raw
            from lineitem where l_returnflag <> 'R' group by 1, 2, 3""" if grid == "wide" else f"""
            select cast(month(o_orderdate)*100 + day(o_orderdate) as int) as mmdd,
                   cast({gy.format(a='o_custkey', b='o_custkey')} as int) as gy,
                   cast({gx.format(a='o_custkey', b='o_custkey')} as int) as gx,
                   max(cast(floor(o_totalprice/200) as int)) as clim_raw
            from orders group by 1, 2, 3"""),
        "fx_sst": (("fx_cells", "fx_clim"), """
            select c.date, c.gy, c.gx, c.sst_raw, k.clim_raw is not null as has_clim
            from fx_cells c left join fx_clim k
              on k.gy = c.gy and k.gx = c.gx and k.mmdd = month(c.date)*100 + day(c.date)"""),
        "fx_mhw": (("fx_cells",), """
            select date, gy, gx, mhw_code as cat from fx_cells where mhw_code between 1 and 5"""),
        "fx_regions": ((), f"select * from (values {boxes}) as t(region, gy0, gy1, gx0, gx1)"),
        "fx_anom": (("fx_sst", "fx_clim"), """
            select d.date, d.gy, d.gx, d.sst_raw - k.clim_raw as raw
            from fx_sst d join fx_clim k
              on k.gy = d.gy and k.gx = d.gx and k.mmdd = month(d.date)*100 + day(d.date)"""),
        "fx_class": (("fx_sst", "fx_mhw"), """
            select d.date, d.gy, d.gx, coalesce(m.cat, 0) as raw
            from fx_sst d left join fx_mhw m on m.gy = d.gy and m.gx = d.gx and m.date = d.date"""),
        "fx_region_daily": (("fx_sst", "fx_mhw", "fx_regions"), f"""
            select s.region, s.date, s.mean_sst, s.n_cells, s.mean_sst_clim, s.n_cells_clim,
                   coalesce(m.cat_sum, 0)/s.area as mean_mhw, coalesce(m.cat_area, 0)/s.area as mhw_area_frac,
                   coalesce(m.n, 0) as n_cells_mhw
            from (select region, date, sum(sst_raw*0.01*{_W})/sum({_W}) as mean_sst, count(*) as n_cells,
                         sum({_W}) as area,
                         sum(sst_raw*0.01*{_W}) filter (where has_clim)
                           / sum({_W}) filter (where has_clim) as mean_sst_clim,
                         count(*) filter (where has_clim) as n_cells_clim
                  from fx_sst join fx_regions on gy between gy0 and gy1 and gx between gx0 and gx1
                  group by region, date) s
            left join (select region, date, sum(cat*{_W}) as cat_sum, sum({_W}) as cat_area, count(*) as n
                       from fx_mhw join fx_regions on gy between gy0 and gy1 and gx between gx0 and gx1
                       group by region, date) m
              on m.region = s.region and m.date = s.date"""),
        "fx_region_clim": (("fx_clim", "fx_regions"), f"""
            select region, mmdd, sum(clim_raw*0.01*{_W})/sum({_W}) as mean_clim, count(*) as n_cells
            from fx_clim join fx_regions on gy between gy0 and gy1 and gx between gx0 and gx1
            group by region, mmdd"""),
        "fx_region_anom": (("fx_region_daily", "fx_region_clim"), """
            select d.region, d.date, d.mean_sst_clim - c.mean_clim as value, d.n_cells_clim as n_cells
            from fx_region_daily d join fx_region_clim c
              on c.region = d.region and c.mmdd = month(d.date)*100 + day(d.date)
            where d.mean_sst_clim is not null"""),
        "fx_monthly": (("fx_region_anom",), """
            select region, cast(date_trunc('month', date) as date) as month, avg(value) as anom, count(*) as n_days
            from fx_region_anom group by 1, 2"""),
        "fx_centres": ((), """
            select concat('s', cast(s_suppkey as varchar)) as region,
                   cast(105 + (s_suppkey*37) % 175 as double) as cx, cast(-50 + (s_suppkey*29) % 105 as double) as cy
            from supplier"""),
        "fx_edges": (("fx_centres",), ring),
        "fx_versions": ((), """
            select case when user_id % 2 = 0 then 'sst' else 'mhw' end as product, cast(ts as date) as date,
                   case when event_type in ('purchase','view','click') then 'success_ingest'
                        when event_type = 'error' then 'failed_ingest' else 'pending_download' end as status,
                   cast(floor(value*100) as bigint) as n_rows, cast(user_id as bigint) as remote_size,
                   ts as updated_at, cast(event_id as bigint) as event_id
            from events"""),
        "fx_latest": (("fx_versions",), """
            select * exclude (rn) from (
              select *, row_number() over (partition by product, date order by updated_at desc, event_id desc) as rn
              from fx_versions) where rn = 1"""),
        "fx_dates": (("fx_cells",), "select distinct date from fx_cells"),
    }


def with_views(body: str, *names: str, grid: str = "compact", extra: str = "") -> str:
    """The body with its fixture views (and theirs) in front as CTEs."""
    views, order = _views(grid), []

    def need(name: str) -> None:
        for dep in views[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    ctes = ", ".join(f"{n} as ({views[n][1]})" for n in order)
    return f"with {ctes}{', ' + extra if extra else ''} {body}"


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


# A 4 x 8 grid for the file-shaped operators: (column, aggregate, fill value)
SMALL_LAYERS = {
    "sst": ("max(case when l_tax > 0.01 then cast(l_quantity as int)*60 - 200 end)", -32768),
    "code": ("max(cast(round(l_discount*100) as int) - 5)", -127),
    "mask": ("max(case when l_quantity >= 49 then 2 else 0 end)", 1),
}


def small_rows(fx: Fixture, layer: str, key: str = "date") -> DataFrame:
    """(key, row, values): whole-grid rows of one layer, gaps as the fill value."""
    agg, fill = SMALL_LAYERS[layer]
    day_ = F.col("l_shipdate").cast("date")
    lines = fx.table("lineitem").select(
        "*", (day_ if key == "date" else mmdd(day_)).alias(key), F.expr("cast(l_suppkey % 4 as int)").alias("row"),
        F.expr("cast(l_partkey % 8 as int)").alias("col"),
    )
    cells = lines.groupBy(key, "row", "col").agg(F.expr(agg).alias("v"))
    slots = [F.coalesce(F.max(F.when(F.col("col") == i, F.col("v"))), F.lit(fill)).cast("short") for i in range(8)]
    return cells.groupBy(key, "row").agg(F.array(*slots).alias("values"))


SMALL_SQL = "small as (select cast(l_shipdate as date) as date, cast(l_suppkey % 4 as int) as row," \
    " cast(l_partkey % 8 as int) as col, " + ", ".join(
        f"{agg} as {name}" for name, (agg, _) in SMALL_LAYERS.items()
    ) + " from lineitem group by 1, 2, 3)"
