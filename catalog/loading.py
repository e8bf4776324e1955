"""Reading day files, planning loads, status, coverage, and the daily run."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidegrid.domain import Box, Grid
from tidegrid.functions.calendar import part_key
from tidegrid.operators import ingest as ig
from tidegrid.operators import rollup as ru
from tidegrid.session import shared_folder
from tidegrid.sources import gridfiles as gf
from tidegrid.sources.store import SCHEMAS, Store, conform

from .areas import MEANS, REGION_DAILY_SQL, rounded
from .fixtures import SMALL_SQL, day, small_rows, with_views
from .registry import query

SMALL = Grid(resolution=45.0, lat0=-67.5, lon0=22.5, nlat=4, nlon=8)
CUT = Box(1, 3, 2, 6)


def _paths(fx):
    """Names of finished and unfinished downloads, and some with impossible dates."""
    lines = fx.table("lineitem").select(F.concat(
        F.lit("/data/coraltemp_v3.1_"), F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd"),
        F.when(F.col("l_returnflag") == "R", ".nc.part").otherwise(".nc"),
    ).alias("path"))
    d = F.col("o_orderdate").cast("date")
    odd = fx.table("orders").select(F.concat(
        F.lit("/data/coraltemp_v3.1_"), F.year(d).cast("string"), F.lpad((F.month(d) + 1).cast("string"), 2, "0"),
        F.lpad(F.day(d).cast("string"), 2, "0"), F.lit(".nc"),
    ).alias("path"))
    return lines.unionByName(odd)


@query("archive_listing", """
    select filename, cast(try_strptime(stamp, '%Y%m%d') as date) as date from (
      select concat('coraltemp_v3.1_', stamp, '.nc') as filename, stamp from (
        select strftime(cast(l_shipdate as date), '%Y%m%d') as stamp from lineitem where l_returnflag <> 'R'
        union all
        select concat(cast(year(o_orderdate) as varchar), lpad(cast(month(o_orderdate) + 1 as varchar), 2, '0'),
                      lpad(cast(day(o_orderdate) as varchar), 2, '0')) from orders))
    where try_strptime(stamp, '%Y%m%d') is not null""")
def archive_listing(fx):
    return gf.archive_listing(_paths(fx), "sst")


@query("grid_to_cells", f"""
    with {SMALL_SQL} select date, row as gy, cast((col + 4) % 8 as int) as gx, cast(sst as smallint) as sst_raw from small
    where row between 1 and 3 and (col + 4) % 8 between 2 and 6 and sst is not null""")
def grid_to_cells(fx):
    return gf.sst_cells(small_rows(fx, "sst"), CUT, SMALL)


@query("shape_problems", """
    select cast(l_shipdate as date) as date,
           concat('expected a 4 x 8 grid, got ', count(distinct l_suppkey % 4), ' rows, 0 of another width, ', count(distinct l_suppkey % 4), ' in place') as problem
    from lineitem group by 1 having count(distinct l_suppkey % 4) <> 4""")
def shape_problems(fx):
    return gf.shape_problems(small_rows(fx, "sst"), SMALL)


@query("shape_problems_rows", """
    with lines as (select cast(l_shipdate as date) as date, cast(l_suppkey % 4 as int) as line from lineitem group by 1, 2),
    bad as (select date, case when day(date) % 3 = 1 and line in (1, 2) then (line - 1) * 3 else line end as line,
                   day(date) % 3 = 2 and line = 2 as blank from lines),
    whole as (select date from bad group by date
              having count(*) = 4 and count(distinct line) = 4 and count(*) filter (where blank) = 0),
    once as (select date, line from bad group by 1, 2 having count(*) = 1)
    select b.date, concat('expected a 4 x 8 grid, got ', count(*), ' rows, ', count(*) filter (where blank), ' of another width, ',
           (select count(*) from once o where o.date = b.date), ' in place') as problem
    from bad b where b.date not in (select date from whole) group by b.date""")
def shape_problems_rows(fx):
    """Files whose rows 1 and 2 repeat 0 and 3, or whose row 2 has no values."""
    n = F.day("date") % 3
    rows = small_rows(fx, "sst").withColumn("blank", (n == 2) & (F.col("row") == 2))
    moved = F.when((n == 1) & F.col("row").isin(1, 2), (F.col("row") - 1) * 3).otherwise(F.col("row"))
    return gf.shape_problems(rows.withColumn("row", moved.cast("int")).withColumn("values", F.when(~F.col("blank"), F.col("values"))), SMALL)


@query("mhw_valid_range", f"""
    with {SMALL_SQL} select date, row as gy, cast((col + 4) % 8 as int) as gx, cast(code as smallint) as cat from small
    where row between 1 and 3 and (col + 4) % 8 between 2 and 6 and code between 1 and 5""")
def mhw_valid_range(fx):
    return gf.class_cells(small_rows(fx, "code"), CUT, SMALL)


@query("mhw_land_repair", f"""
    with {SMALL_SQL},
    land as (select date, bool_or(mask = 2) as has_land from small group by date)
    select s.date, row as gy, cast((col + 4) % 8 as int) as gx, cast(code as smallint) as cat from small s join land l on l.date = s.date
    where row between 1 and 3 and (col + 4) % 8 between 2 and 6 and code between 1 and 5
      and (has_land or sst is not null)""")
def mhw_land_repair(fx):
    cells = gf.class_cells(small_rows(fx, "code"), CUT, SMALL)
    ocean = gf.sst_cells(small_rows(fx, "sst"), CUT, SMALL)
    return gf.repair_land(cells, gf.carries_land(small_rows(fx, "mask")), ocean)[0]


CLIM_SMALL = """select cast(month(l_shipdate)*100 + day(l_shipdate) as int) as mmdd,
    cast(3 - l_suppkey % 4 as int) as gy, cast((l_partkey % 8 + 4) % 8 as int) as gx,
    cast(max(case when l_tax > 0.01 then cast(l_quantity as int)*60 - 200 end) as smallint) as clim_raw
    from lineitem group by 1, 2, 3"""


@query("clim_load_pending", with_views(f"""
    select * from ({CLIM_SMALL}) where gy between 1 and 3 and gx between 2 and 6 and clim_raw is not null
      and mmdd not in (select mmdd from fx_clim where clim_raw > 2400)""", "fx_clim"))
def clim_load_pending(fx):
    incoming = gf.clim_cells(small_rows(fx, "sst", key="mmdd"), CUT, SMALL)
    return ig.clim_pending(incoming, fx.clim.filter("clim_raw > 2400"))


def scratch(fx) -> Store:
    """A store of its own for a query that writes."""
    return Store(fx.spark, f"{shared_folder(fx.spark)}/archive-{uuid.uuid4().hex}", buckets=8)


@query("clim_load_stored", with_views(f"""
    select mmdd, gy, gx, clim_raw from fx_clim where clim_raw > 2400
    union all select mmdd, gy, gx, clim_raw from ({CLIM_SMALL}) where gy between 1 and 3 and gx between 2 and 6 and clim_raw is not null
      and mmdd not in (select mmdd from fx_clim where clim_raw > 2400)""", "fx_clim"))
def clim_load_stored(fx):
    """The stored climatology after the calendar days it lacked have been added."""
    store = scratch(fx)
    store.append_climatology(fx.clim.filter("clim_raw > 2400"))
    new = ig.clim_pending(gf.clim_cells(small_rows(fx, "sst", key="mmdd"), CUT, SMALL), store.read("sst_clim"))
    store.replace_climatology(store.read("sst_clim").select(*new.columns).unionByName(new))
    return store.read("sst_clim").select("mmdd", "gy", "gx", F.col("clim_raw").cast("int").alias("clim_raw"))


@query("daily_has_clim", with_views("select date, gy, gx, sst_raw, has_clim from fx_sst", "fx_sst", grid="wide"))
def daily_has_clim(fx):
    return fx.on("wide").sst


@query("partition_key", with_views("""
    select date, gy, gx, cast(case when year(date) >= 2024 then year(date) else year(date)//10*10 end as int) as part
    from fx_cells""", "fx_cells", grid="wide"))
def partition_key(fx):
    return fx.on("wide").cells.select("date", "gy", "gx", part_key("date").alias("part"))


URGENT = "o_orderpriority = '1-URGENT'"


@query("replace_day", with_views(f"""
    select date, gy, gx, sst_raw from fx_cells where date not in (
      select cast(o_orderdate as date) from orders where {URGENT})
    union all
    select cast(o_orderdate as date), cast(900 + 500*(o_custkey % 4) as int), cast(2400 + 600*(o_custkey % 5) as int),
           max(cast(floor(o_totalprice/200) as int)) from orders where {URGENT} group by 1, 2, 3""", "fx_cells"))
def replace_day(fx):
    incoming = (
        fx.table("orders").filter(URGENT)
        .select(F.col("o_orderdate").cast("date").alias("date"), *fx._cell("o_custkey", "o_custkey"),
                F.expr("cast(floor(o_totalprice/200) as int)").alias("v"))
        .groupBy("date", "gy", "gx").agg(F.max("v").alias("sst_raw"))
    )
    return ig.replaced_days(fx.cells.select("date", "gy", "gx", "sst_raw"), incoming, incoming.select("date"))


@query("layout_verify", with_views("""
    select cast(year(date) as int) as year, count(*) as old_rows, count(*) filter (where has_clim) as new_rows, false as same_rows
    from fx_sst group by 1 having count(*) <> count(*) filter (where has_clim)""", "fx_sst", grid="wide"))
def layout_verify(fx):
    """A table of days against a written copy that lost some rows."""
    wide, store = fx.on("wide"), scratch(fx)
    store.append_days("sst", wide.sst.filter("has_clim"))
    whole = conform(wide.sst, SCHEMAS["sst_daily"])
    return ig.layout_mismatch(whole, store.read("sst_daily").drop("block", "part"))


@query("replace_day_stored", with_views(f"""
    select date, gy, gx, sst_raw, cast(case when year(date) >= 2024 then year(date) else year(date)//10*10 end as int) as part from (
      select date, gy, gx, sst_raw from fx_cells where date not in (select cast(o_orderdate as date) from orders where {URGENT})
      union all
      select cast(o_orderdate as date), cast(900 + 500*(o_custkey % 4) as int), cast(2400 + 600*(o_custkey % 5) as int),
             max(cast(floor(o_totalprice/200) as int)) from orders where {URGENT} group by 1, 2, 3)""", "fx_cells"))
def replace_day_stored(fx):
    """The same through the store: days appended, then replaced in their partitions."""
    store = scratch(fx)
    store.append_days("sst", fx.cells.withColumn("has_clim", F.lit(True)))
    incoming = (
        fx.table("orders").filter(URGENT)
        .select(F.col("o_orderdate").cast("date").alias("date"), *fx._cell("o_custkey", "o_custkey"),
                F.expr("cast(floor(o_totalprice/200) as int)").alias("v"))
        .groupBy("date", "gy", "gx").agg(F.max("v").alias("sst_raw")).withColumn("has_clim", F.lit(True))
    )
    dates = [r.date for r in incoming.select("date").distinct().collect()]  # days of the archive
    store.replace_days("sst", incoming, dates)
    return store.read("sst_daily").select("date", "gy", "gx", F.col("sst_raw").cast("int").alias("sst_raw"), "part")


@query("drop_regions", with_views(REGION_DAILY_SQL + " where region not in ('south', 'east')", "fx_region_daily"))
def drop_regions(fx):
    """A stored rollup after two regions were removed from it."""
    store = scratch(fx)
    store.append("region_daily", fx.rollup.withColumn("updated_at", F.lit(dt.datetime(2024, 1, 1))))
    store.drop_regions("region_daily", ["south", "east"])
    return rounded(store.latest("region_daily").drop("updated_at"), *MEANS)


@query("fresh_reload", with_views("""
    select product, date, status, n_rows, remote_size, (select count(*) from fx_cells where false) as sst_rows from fx_latest where product <> 'sst'""",
    "fx_latest", "fx_cells"))
def fresh_reload(fx):
    """The status that is left after one product was emptied for a fresh load, and its rows, which are gone."""
    store = scratch(fx)
    store.append_days("sst", fx.cells.withColumn("has_clim", F.lit(True)))
    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ("filename string", "file_size bigint", "source_url string", "remote_modified string", "message string")}
    store.append("ingest_status", _latest(fx).withColumns(empty))
    store.reset(["sst"])
    return store.status().select("product", "date", "status", "n_rows", "remote_size", F.lit(store.read("sst_daily").count()).alias("sst_rows"))


# ------------------------------------------------------------------------ status


def _latest(fx):
    return ig.latest_version(fx.versions, ["product", "date"], ["updated_at", "event_id"])


@query("latest_version", with_views("select * from fx_latest", "fx_latest"))
def latest_version(fx):
    return _latest(fx)


@query("status_summary", with_views("""
    select product, status, count(*) as days, cast(sum(n_rows) as bigint) as n_rows,
           min(date) as first, max(date) as last from fx_latest group by 1, 2""", "fx_latest"))
def status_summary(fx):
    return ig.status_summary(_latest(fx))


# what the source reports today: the largest size ever seen, and the newest time
REMOTE_SQL = """remote as (select product, date, max(remote_size) as size,
    strftime(max(updated_at), '%H') as modified from fx_versions group by 1, 2)"""
CURRENT_SQL = """coalesce(s.status = 'success_ingest', false) and (coalesce(s.remote_size, 0) = 0
    or not (r.size <> 0 and r.size <> s.remote_size
            or r.modified <> strftime(s.updated_at, '%H')))"""


def _remote(fx):
    return fx.versions.groupBy("product", "date").agg(
        F.max("remote_size").alias("size"), F.date_format(F.max("updated_at"), "HH").alias("modified")
    )


def _status(fx):
    return _latest(fx).withColumn("remote_modified", F.date_format("updated_at", "HH"))


@query("revised_dates", with_views(f"""
    select r.product, r.date, {CURRENT_SQL} as current from remote r left join fx_latest s
      on s.product = r.product and s.date = r.date""", "fx_versions", "fx_latest", extra=REMOTE_SQL))
def revised_dates(fx):
    return ig.revised_dates(_status(fx), _remote(fx))


@query("ingest_plan", with_views(f"""
    select r.product, r.date, strftime(r.date, 'f%Y%m%d.nc') as filename,
           case when {CURRENT_SQL} then 'skip' when coalesce(s.status = 'success_ingest', false) then 'replace'
                else 'load' end as action
    from remote r left join fx_latest s on s.product = r.product and s.date = r.date""",
    "fx_versions", "fx_latest", extra=REMOTE_SQL))
def ingest_plan(fx):
    files = _remote(fx).withColumn("filename", F.date_format("date", "'f'yyyyMMdd'.nc'"))
    return ig.ingest_plan(files, _status(fx))


# one file per product and day of the lineitem calendar, loaded or not by the order calendar
FILES_SQL = """
    files as (select distinct case when l_linestatus = 'O' then 'sst' else 'mhw' end as product,
                     cast(l_shipdate as date) as date from lineitem),
    st as (select case when o_orderstatus = 'F' then 'sst' else 'mhw' end as product, cast(o_orderdate as date) as date,
                  max(case when o_totalprice > 100000 then 'success_ingest' else 'failed_ingest' end) as status
           from orders group by 1, 2)"""


def _files(fx):
    return fx.table("lineitem").select(
        F.when(F.col("l_linestatus") == "O", "sst").otherwise("mhw").alias("product"),
        F.col("l_shipdate").cast("date").alias("date"),
    ).distinct()


def _loaded(fx):
    return fx.table("orders").select(
        F.when(F.col("o_orderstatus") == "F", "sst").otherwise("mhw").alias("product"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_totalprice") > 100000, "success_ingest").otherwise("failed_ingest").alias("status"),
    ).groupBy("product", "date").agg(F.max("status").alias("status"))


@query("scan_report", f"""
    with {FILES_SQL}
    select product, count(*) as files, min(date) as first, max(date) as last,
           count(*) filter (where done) as loaded, count(*) filter (where not done) as to_ingest,
           min(date) filter (where not done) as next_date
    from (select f.product, f.date, coalesce(s.status = 'success_ingest', false) as done
          from files f left join st s on s.product = f.product and s.date = f.date) group by product""")
def scan_report(fx):
    return ig.scan_report(_files(fx), _loaded(fx))


@query("pending_files", f"""
    with {FILES_SQL} select product, date from files f where not exists (
      select 1 from st s where s.product = f.product and s.date = f.date and s.status = 'success_ingest')""")
def pending_files(fx):
    return ig.pending_files(_files(fx), _loaded(fx))


@query("archive_range", f"with {FILES_SQL} select min(date) as first, max(date) as last from files")
def archive_range(fx):
    return ig.archive_range(_files(fx))


@query("newest_files", f"""
    with {FILES_SQL} select product, date from files where product = 'sst' and date >= date '1996-01-01'
    order by date desc limit 30""")
def newest_files(fx):
    """Newest first with a limit: the listing's own option."""
    files = _files(fx).filter("product = 'sst'")
    return gf.select_files(files, start=day("1996-01-01"), newest_first=True, limit=30)


def _loads(fx):
    """A status row for each loaded day of both products."""
    per_day = lambda df, p: df.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows")).withColumns({
        "product": F.lit(p), "status": F.lit("success_ingest")})
    return per_day(fx.sst, "sst").unionByName(per_day(fx.mhw, "mhw"))


@query("coverage", with_views("""
    select r.*, k.*, h.*, clim_keys = 366 as clim_complete, mhw_rows > 0 and mhw_days >= days - 1 as mhw_complete
    from (select count(*) as rows, min(date) as start, max(date) as "end", count(distinct date) as days from fx_sst) r,
         (select count(distinct mmdd) as clim_keys from fx_clim) k,
         (select count(*) as mhw_rows, min(date) as mhw_start, max(date) as mhw_end, count(distinct date) as mhw_days from fx_mhw) h""",
    "fx_sst", "fx_clim", "fx_mhw"))
def coverage(fx):
    """Off the status table; the SQL counts the facts."""
    return ig.coverage(_loads(fx), fx.clim.select("mmdd"))


@query("readiness", with_views("""
    select 'sst' as variable, true as ready
    union all select 'anom', (select count(distinct mmdd) from fx_clim) = 366
    union all select 'mhw', (select count(*) from fx_mhw) > 0 and
      (select count(distinct date) from fx_mhw) >= (select count(distinct date) from fx_sst) - 1""",
    "fx_sst", "fx_clim", "fx_mhw"))
def readiness(fx):
    return ig.readiness(ig.coverage(_loads(fx), fx.clim.select("mmdd")))


LOADED_AT = "2024-03-01 00:00:00"


@query("status_rows", with_views(f"""
    select product, date, strftime(date, 'f%Y%m%d.nc') as filename,
           case when bad then 'failed_ingest' else 'success_ingest' end as status,
           cast(case when bad then 0 else n end as bigint) as n_rows, cast(null as bigint) as file_size, cast(null as varchar) as source_url,
           n as remote_size, cast(null as varchar) as remote_modified, case when bad then repeat('no grid, ', 100) else '' end as message,
           timestamp '{LOADED_AT}' as updated_at
    from (select f.product, f.date, coalesce(c.n, 0) as n, day(f.date) = 13 as bad
          from files f left join (select date, count(*) as n from fx_cells group by 1) c on c.date = f.date
          where year(f.date) < 1999)""", "fx_cells", extra=FILES_SQL))
def status_rows(fx):
    """Each attempted day with its rows, or the whole text of why it failed."""
    counts = fx.cells.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))
    files = _files(fx).join(counts.withColumnRenamed("n_rows", "size"), "date", "left").withColumns({
        "filename": F.date_format("date", "'f'yyyyMMdd'.nc'"), "size": F.coalesce("size", F.lit(0)),
        "action": F.when(F.year("date") < 1999, "load").otherwise("skip")})
    bad = _files(fx).filter(F.day("date") == 13).withColumn("problem", F.repeat(F.lit("no grid, "), F.lit(100)))
    both = counts.join(_files(fx), "date")
    return ig.status_rows(files, both, bad, day("2024-03-01")).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("missing_mmdd", with_views("""
    select k.gy, k.gx, k.mmdd from (
      select gy, gx, cast(month(d)*100 + day(d) as int) as mmdd from (select distinct gy, gx from fx_clim),
        (select unnest(generate_series(date '2000-01-01', date '2000-12-31', interval 1 day)) as d)) k
    left join fx_clim c on c.gy = k.gy and c.gx = k.gx and c.mmdd = k.mmdd where c.mmdd is null""", "fx_clim"))
def missing_mmdd(fx):
    """Calendar days without a climatology, of every cell that has one on any day."""
    return ig.missing_mmdd(fx.clim, ["gy", "gx"])


@query("mmdd_completeness", with_views(
    "select count(distinct mmdd) as present, 366 - count(distinct mmdd) as missing from fx_clim", "fx_clim"))
def mmdd_completeness(fx):
    return ig.mmdd_completeness(fx.clim)


@query("orientation_flipped", with_views("""
    select d.date, count(*) filter (where s.gy is null) as orphans
    from fx_dates d join fx_clim c on c.mmdd = month(d.date)*100 + day(d.date)
    left join fx_cells s on s.date = d.date and s.gy = 3599 - c.gy and s.gx = c.gx
    group by d.date""", "fx_dates", "fx_clim", "fx_cells"))
def orientation_flipped(fx):
    """A climatology turned upside down: cells without a value on every day."""
    return ig.orientation_check(fx.sst, fx.clim.withColumn("gy", F.lit(3599) - F.col("gy")))


@query("orientation_check", with_views("""
    select d.date, count(*) filter (where s.gy is null) as orphans
    from fx_dates d join fx_clim c on c.mmdd = month(d.date)*100 + day(d.date)
    left join fx_cells s on s.date = d.date and s.gy = c.gy and s.gx = c.gx
    group by d.date""", "fx_dates", "fx_clim", "fx_cells"))
def orientation_check(fx):
    return ig.orientation_check(fx.sst, fx.clim)


# ---------------------------------------------------------------------- planning


@query("run_targets", with_views("""
    select date, min(reason) as reason from (
      select cast(unnest(generate_series(least(date_add(last, 1), date '2024-02-05'), date '2024-02-05',
                                         interval 1 day)) as date) as date, 'catch_up' as reason from w
      union all
      select date, 'recheck' from (select cast(unnest(generate_series(date '2024-01-26', date '2024-02-04',
                                         interval 1 day)) as date) as date, last from w) where date <= last)
    group by date""", "fx_latest", extra="""
    w as (select least(max(date) filter (where product = 'sst'), max(date) filter (where product = 'mhw')) as last
          from fx_latest where status = 'success_ingest')"""))
def run_targets(fx):
    return ig.run_targets(_latest(fx), day("2024-02-05"), recheck_days=10)


@query("date_outcome", """
    select cast(ts as date) as date,
           case max(case event_type when 'error' then 4 when 'purchase' then 3 when 'view' then 2 else 1 end)
             when 4 then 'failed' when 3 then 'ingested' when 2 then 'skipped' else 'unpublished' end as outcome
    from events group by 1""")
def date_outcome(fx):
    words = {"error": "failed", "purchase": "ingested", "view": "skipped"}
    outcome = F.lit("unpublished")
    for event, word in words.items():
        outcome = F.when(F.col("event_type") == event, word).otherwise(outcome)
    return ig.date_outcome(fx.table("events").select(F.col("ts").cast("date").alias("date"), outcome.alias("outcome")))


BUCKETS_SQL = """
    select distinct variable, period,
           case period when 'daily' then date when 'weekly' then cast(date_trunc('week', date) as date)
                       else cast(date_trunc('month', date) as date) end as bucket
    from {dates}, (values ('sst'), ('anom'), ('mhw')) v(variable), (values ('daily'), ('weekly'), ('monthly')) p(period)"""


@query("affected_buckets", with_views(BUCKETS_SQL.format(dates="fx_dates"), "fx_dates"))
def affected_buckets(fx):
    return ig.affected_buckets(fx.dates)


CLOSED_SQL = """closed as (
    select 'daily' as period, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as bucket, hi, 0 as n from e
    union all
    select 'weekly', cast(unnest(generate_series(cast(date_trunc('week', lo) as date), hi, interval 7 day)) as date), hi, 6 from e
    union all
    select 'monthly', cast(unnest(generate_series(cast(date_trunc('month', lo) as date), hi, interval 1 month)) as date), hi, -1 from e),
    ready as (select period, bucket from closed
              where case when n >= 0 then date_add(bucket, n) else last_day(bucket) end <= hi)"""
SPAN_SQL = "e as (select min(date) as lo, max(date) as hi from fx_dates)"


def _span(fx):
    return fx.dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))


@query("closed_buckets", with_views("select period, bucket from ready", "fx_dates", extra=f"{SPAN_SQL}, {CLOSED_SQL}"))
def closed_buckets(fx):
    return ig.closed_buckets(_span(fx))


@query("pending_buckets", with_views("""
    select variable, period, bucket from ready, (values ('sst'), ('anom'), ('mhw')) v(variable)
    except select * from made""", "fx_dates", extra=f"{SPAN_SQL}, {CLOSED_SQL}, made as (" + BUCKETS_SQL.format(
    dates="(select cast(o_orderdate as date) as date from orders where o_orderstatus = 'F')") + ")"))
def pending_buckets(fx):
    done = fx.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderdate").cast("date").alias("date"))
    return ig.pending_buckets(ig.closed_buckets(_span(fx)), ig.affected_buckets(done))


@query("retention_list", f"""
    with {FILES_SQL} select product, date from files where date < least(
      cast(date_trunc('week', date '1999-09-02') as date), date '1999-09-01')""")
def retention_list(fx):
    return ig.retention_list(_files(fx), day("1999-09-02"))


@query("leap_repair_plan", with_views("""
    select distinct leap as leap_day, date from (
      select leap, cast(unnest(generate_series(cast(date_trunc('week', leap) as date),
                               date_add(cast(date_trunc('week', leap) as date), 6), interval 1 day)) as date) as date
      from l
      union all
      select leap, cast(unnest(generate_series(cast(date_trunc('month', leap) as date), last_day(leap), interval 1 day)) as date)
      from l)""", "fx_dates", extra="""
    l as (select leap from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as leap
            from (select min(date) as lo, max(date) as hi from fx_dates))
          where month(leap) = 2 and day(leap) = 29)"""))
def leap_repair_plan(fx):
    loaded = fx.dates.select(F.lit("mhw").alias("product"), "date", F.lit("success_ingest").alias("status"))
    return ig.leap_repair_plan(loaded)


@query("incremental_rollup", with_views(REGION_DAILY_SQL, "fx_region_daily"))
def incremental_rollup(fx):
    """Temperatures first, classes later: the second version corrects the zeros. Each batch reads its own product."""
    early = ru.region_parts(fx.sst, "sst", fx.dim)
    late = ru.region_parts(fx.mhw, "mhw", fx.dim)
    first = ru.rollup_of(early).withColumn("version", F.lit(1))
    second = ru.rollup_of(early.join(late.select("region", "date"), ["region", "date"], "left_semi").unionByName(late)).withColumn("version", F.lit(2))
    newest = ig.latest_version(first.unionByName(second), ["region", "date"], ["version"])
    return rounded(newest.drop("version"), *MEANS)


# Whole weights in units of 2^-46, by two halves, as in schema.REGION_PARTS.
_UNITS = "cast(round(cos(radians(-89.975::double + gy*0.05::double)) * 70368744177664.0::double) as bigint)"
_SUM = lambda v, c: f"(sum({v}*(u >> 23)) filter (where {c})::double * 8388608.0::double + sum({v}*(u & 8388607)) filter (where {c})::double)"


@query("rollup_parts", with_views(f"""
    select region, date, {_SUM("sst_raw", "cat is null")}/{_SUM("1", "cat is null")}*0.01::double as mean_sst,
           count(*) filter (where cat is null) as n_cells,
           {_SUM("sst_raw", "has_clim")}/{_SUM("1", "has_clim")}*0.01::double as mean_sst_clim, count(*) filter (where has_clim) as n_cells_clim,
           coalesce({_SUM("cat", "cat is not null")}/{_SUM("1", "cat is null")}, 0) as mean_mhw,
           coalesce({_SUM("1", "cat is not null")}/{_SUM("1", "cat is null")}, 0) as mhw_area_frac, count(*) filter (where cat is not null) as n_cells_mhw
    from (select *, {_UNITS} as u from (
            select date, gy, gx, sst_raw, has_clim, null as cat from fx_sst union all select date, gy, gx, null, false, cat from fx_mhw)) f
    join fx_regions r on gy between gy0 and gy1 and gx between gx0 and gx1
    group by region, date having count(*) filter (where cat is null) > 0""", "fx_sst", "fx_mhw", "fx_regions", grid="wide"))
def rollup_parts(fx):
    """Means off the added parts of batches that each hold some cells of every day; exact, so nothing is rounded."""
    wide = fx.on("wide")
    batches = [
        ru.region_parts(cells.filter(half), product, wide.dim)
        for product, cells in (("sst", wide.sst), ("mhw", wide.mhw)) for half in ("(gy + gx) % 3 = 0", "(gy + gx) % 3 <> 0")
    ]
    return ru.rollup_of(ru.added(*batches))

