"""Fields: anomaly, bucket reduction, regridding, packing, filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.domain import VARIABLES, Subset
from tidegrid.functions import packing as pk
from tidegrid.operators import raster as ra
from tidegrid.plans import pictures as pc

from .areas import rounded
from .fixtures import with_views
from .points import MONTH, WEEK, mean
from .registry import query


@query("anomaly_field", with_views("""
    select d.date, d.gy, d.gx, cast(d.sst_raw - k.clim_raw as bigint) as raw, k.clim_raw is null as no_clim
    from fx_sst d left join fx_clim k on k.gy = d.gy and k.gx = d.gx and k.mmdd = month(d.date)*100 + day(d.date)""",
    "fx_sst", "fx_clim", grid="wide"))
def anomaly_field(fx):
    return ra.anomaly_field(fx.on("wide").archive)


def _bucket_sql(source: str, bucket: str, value: str, no_clim: str) -> str:
    return f"""
        select c.*, n.n_days
        from (select {bucket} as bucket, gy, gx, {value} as value, {no_clim} as no_clim from {source} group by 1, 2, 3) c
        join (select {bucket} as bucket, count(distinct date) as n_days from {source} group by 1) n
          on n.bucket = c.bucket"""


@query("bucket_field", with_views(
    _bucket_sql("g", MONTH, "cast(sum(raw) as double)/count(raw)*0.01", "count(raw) = 0"), "fx_sst", "fx_clim",
    grid="wide", extra="""g as (select d.date, d.gy, d.gx, d.sst_raw - k.clim_raw as raw from fx_sst d
      left join fx_clim k on k.gy = d.gy and k.gx = d.gx and k.mmdd = month(d.date)*100 + day(d.date))"""))
def bucket_field(fx):
    return ra.bucket_field(fx.on("wide").archive, "anom", "monthly")


@query("bucket_field_sst", with_views(_bucket_sql("fx_sst", MONTH, mean("sst_raw"), "false"), "fx_sst", grid="wide"))
def bucket_field_sst(fx):
    return ra.bucket_field(fx.on("wide").archive, "sst", "monthly")


@query("bucket_field_mhw", with_views(
    _bucket_sql("fx_mhw", WEEK, "cast(max(cat) as double)", "false"), "fx_mhw", grid="wide"))
def bucket_field_mhw(fx):
    return ra.bucket_field(fx.on("wide").archive, "mhw", "weekly")


# ----------------------------------------------------------------- small pictures

# 20 x 24 source cells, drawn 32 columns wide
PICTURE = Subset("picture", lat=(-57.0, 57.0), lon=(7.5, 352.5), nlat=20, nlon=24)
WIDTH = 32
SHAPE = (PICTURE.nlat, PICTURE.nlon)
HEIGHT = ra.picture_height(WIDTH, PICTURE)
_TOP, _BOTTOM = ra._mercator(64.5), ra._mercator(-64.5)

PICTURE_SQL = """pic as (
    select cast(date_trunc('week', cast(l_shipdate as date)) as date) as bucket, cast(l_suppkey % 20 as int) as y,
           cast(l_partkey % 24 as int) as x, max(l_quantity*0.6 - 2) as value,
           max(cast(round(l_discount*100) as int) - 5) as cat
    from lineitem group by 1, 2, 3)"""
TAPS_SQL = f"""
    rsrc as (select cast(i as int) as o, (degrees(2*atan(exp({_TOP!r}::double + (i + 0.5)/{float(HEIGHT)}*({_BOTTOM - _TOP!r}::double)))
                    - pi()/2) + 57.0)/6.0 as s from (select unnest(generate_series(0, {HEIGHT - 1})) as i)),
    csrc as (select cast(i as int) as o, (i + 0.5)/{float(WIDTH)}*24.0 - 0.5 as s
             from (select unnest(generate_series(0, {WIDTH - 1})) as i)),
    rt as (select o, least(greatest(cast(floor(s) as int), 0), 19) as a,
                  least(least(greatest(cast(floor(s) as int), 0), 19) + 1, 19) as b,
                  s - least(greatest(cast(floor(s) as int), 0), 19) as w,
                  least(greatest(cast(round_even(s, 0) as int), 0), 19) as near from rsrc),
    ct as (select o, least(greatest(cast(floor(s) as int), 0), 23) as a,
                  least(least(greatest(cast(floor(s) as int), 0), 23) + 1, 23) as b,
                  s - least(greatest(cast(floor(s) as int), 0), 23) as w,
                  least(greatest(cast(round_even(s, 0) as int), 0), 23) as near from csrc)"""
GRID_SQL = """
    full_grid as (select bucket, y, x from (select distinct bucket from pic),
             (select cast(unnest(generate_series(0, 19)) as int) as y), (select cast(unnest(generate_series(0, 23)) as int) as x)),
    tall as (select g.bucket, rt.o as y, g.x, coalesce(p.value*(1 - w) + q.value*w, p.value, q.value) as value
             from (select distinct bucket, x from full_grid) g cross join rt
             left join src p on p.bucket = g.bucket and p.x = g.x and p.y = rt.a
             left join src q on q.bucket = g.bucket and q.x = g.x and q.y = rt.b),
    big as (select g.bucket, g.y, ct.o as x, coalesce(p.value*(1 - w) + q.value*w, p.value, q.value) as value
            from (select distinct bucket, y from tall) g cross join ct
            left join tall p on p.bucket = g.bucket and p.y = g.y and p.x = ct.a
            left join tall q on q.bucket = g.bucket and q.y = g.y and q.x = ct.b)"""


def _picture(fx, unit="week"):
    return fx.table("lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), unit).alias("bucket"),
        F.expr("cast(l_suppkey % 20 as int)").alias("y"), F.expr("cast(l_partkey % 24 as int)").alias("x"),
        F.expr("l_quantity*0.6D - 2").alias("value"),
        F.expr("cast(round(l_discount*100) as int) - 5").alias("cat"),
    ).groupBy("bucket", "y", "x").agg(F.max("value").alias("value"), F.max("cat").alias("cat"))


def _axes(fx):
    return ra.row_sources(fx.spark, WIDTH, PICTURE), ra.col_sources(fx.spark, WIDTH, PICTURE), SHAPE


@query("regrid_bilinear", f"""
    with {PICTURE_SQL}, src as (select bucket, y, x, value from pic), {TAPS_SQL}, {GRID_SQL}
    select bucket, y, x, round(value, 6) as value from big where value is not null""")
def regrid_bilinear(fx):
    field = _picture(fx).select("bucket", "y", "x", "value")
    return rounded(ra.regrid_bilinear(field, ["bucket"], *_axes(fx)), "value")


@query("regrid_nearest", f"""
    with {PICTURE_SQL}, {TAPS_SQL}
    select bucket, rt.o as y, ct.o as x, cat as value from pic join rt on rt.near = y join ct on ct.near = x
    where cat between 1 and 5""")
def regrid_nearest(fx):
    field = _picture(fx).filter(pk.is_class("cat")).select("bucket", "y", "x", F.col("cat").alias("value"))
    return ra.regrid_nearest(field, ["bucket"], *_axes(fx))


@query("regrid_mask", f"""
    with {PICTURE_SQL}, src as (select g.bucket, g.y, g.x, case when pic.cat <= 0 then 1.0::double else 0.0::double end as value
      from (select bucket, y, x from (select distinct bucket from pic),
             (select cast(unnest(generate_series(0, 19)) as int) as y), (select cast(unnest(generate_series(0, 23)) as int) as x)) g
      left join pic on pic.bucket = g.bucket and pic.y = g.y and pic.x = g.x), {TAPS_SQL}, {GRID_SQL}
    select bucket, y, x from big where value > 0.5""")
def regrid_mask(fx):
    mask = _picture(fx).filter("cat <= 0").select("bucket", "y", "x")
    return ra.regrid_mask(mask, ["bucket"], *_axes(fx))


SST = VARIABLES["sst"].packing
ANOM = VARIABLES["anom"].packing


@query("quantise", f"""
    with {PICTURE_SQL}
    select bucket, y, x, code, (code >> 8) & 255 as high, code & 255 as low,
           round(code*0.01 - 5.0, 6)::double as decoded,
           cast(least(greatest(round_even((value - 12.0 + 12.8::double)/0.1::double, 0), 1), 255) as int) as anom_code
    from (select *, cast(least(greatest(round_even((value + 5.0::double)/0.01::double, 0), 0), 65535) as int) as code from pic)""")
def quantise(fx):
    # the anomaly is the value against a flat normal of 12 degrees
    out = _picture(fx).select(
        "bucket", "y", "x", pk.quantise("value", SST).alias("code"),
        pk.quantise(F.col("value") - 12.0, ANOM).alias("anom_code"),
    )
    out = ra.channel_bytes(out, SST).withColumn("decoded", F.round(pk.decode("code", SST), 6))
    return out


def _fill_sql(height: int, width: int, passes: int = 8) -> str:
    steps = []
    for i in range(1, passes + 1):
        steps.append(f"""k{i} as materialized (select * from k{i - 1} union all
            select bucket, y, x, cast(sum(code)//count(*) as int) as code from (
              select bucket, (y + dy + {height}) % {height} as y, (x + dx + {width}) % {width} as x, code
              from k{i - 1}, (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx)) n
            where not exists (select 1 from k{i - 1} k where k.bucket = n.bucket and k.y = n.y and k.x = n.x)
            group by 1, 2, 3)""")
    return f"""
        with {PICTURE_SQL.replace("'week'", "'month'")},
        k0 as materialized (select bucket, y, x, cast(round_even((value + 5.0::double)/0.01::double, 0) as int) as code
                            from pic),
        med as (select bucket, cast(floor(quantile_cont(code, 0.5)) as int) as code from k0 group by 1), {', '.join(steps)}
        select m.bucket, g.y, g.x, coalesce(k.code, m.code) as code, o.code is not null as known
        from med m cross join (select cast(unnest(generate_series(0, {height - 1})) as int) as y) g0
             cross join (select cast(unnest(generate_series(0, {width - 1})) as int) as x) g1
             cross join lateral (select g0.y as y, g1.x as x) g
        left join k{passes} k on k.bucket = m.bucket and k.y = g.y and k.x = g.x
        left join k0 o on o.bucket = m.bucket and o.y = g.y and o.x = g.x"""


@query("neighbour_fill", _fill_sql(20, 24))
def neighbour_fill(fx):
    known = _picture(fx, "month").select("bucket", "y", "x", pk.quantise("value", SST).alias("code"))
    return ra.neighbour_fill(known, ["bucket"], 20, 24, tile=16)


@query("encode_field", f"""
    with {PICTURE_SQL}
    select bucket, y, x, case when cat <= 0 then 0 else
      cast(least(greatest(round_even((value - 12.0 + 12.8::double)/0.1::double, 0), 1), 255) as int) end as code
    from pic""")
def encode_field(fx):
    field = _picture(fx)
    values = field.select("bucket", "y", "x", (F.col("value") - 12.0).alias("value"))
    return ra.encode_field(values, ["bucket"], ANOM, field.filter("cat <= 0").select("bucket", "y", "x"))


# anomaly against a flat normal; cells whose class is 0 have no normal
_SIDE = GRID_SQL.replace("full_grid", "{0}_grid").replace("tall", "{0}_tall").replace("big", "{0}_big").replace("src p", "{0}_src p").replace("src q", "{0}_src q")


@query("picture_codes", f"""
    with {PICTURE_SQL}, v_src as (select bucket, y, x, value*1.0137::double - 12.3456789::double as value from pic where cat <> 0),
    m_src as (select g.bucket, g.y, g.x, case when pic.cat = 0 then 1.0::double else 0.0::double end as value
      from (select bucket, y, x from (select distinct bucket from pic),
             (select cast(unnest(generate_series(0, 19)) as int) as y), (select cast(unnest(generate_series(0, 23)) as int) as x)) g
      left join pic on pic.bucket = g.bucket and pic.y = g.y and pic.x = g.x), {TAPS_SQL}, {_SIDE.format("v")}, {_SIDE.format("m")}
    select v.bucket, v.y, v.x, case when m.value > 0.5 then 0
             else cast(least(greatest(round_even((v.value + 12.8::double)/0.1::double, 0), 1), 255) as int) end as code
    from v_big v join m_big m on m.bucket = v.bucket and m.y = v.y and m.x = v.x
    where v.value is not null or m.value > 0.5""")
def picture_codes(fx):
    field = _picture(fx)
    no_clim = F.col("cat") == 0
    field = field.select("bucket", "y", "x", F.when(~no_clim, F.col("value") * 1.0137 - 12.3456789).alias("value"), no_clim.alias("no_clim"))
    return pc.codes(field, "anom", WIDTH, PICTURE)
