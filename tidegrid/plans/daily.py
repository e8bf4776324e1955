"""Loading and the daily run: which days, in which order, with which record.

The driver only handles lists of dates. Every step can be repeated: a day that
was being written when a run broke off still says `ingesting`, and is replaced
instead of added next time.
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as sc
from ..domain import GLOBAL, REGIONS, Box, Grid, Region
from ..functions.calendar import date_range, mmdd
from ..operators import ingest as ig
from ..operators import regions as rg
from ..operators import rollup as ru
from ..sources import gridfiles as gf
from ..sources.store import DAILY, SCHEMAS, Store

log = logging.getLogger(__name__)

BATCH_DAYS = 30


def region_names(store: Store, regions: dict[str, Region] | None = None) -> list[str]:
    """These regions; if none are given, the configured ones and all whose outline has been stored."""
    if regions is not None:
        return list(regions)
    stored = [r.region for r in store.read("region_cells").select("region").distinct().collect()]
    return [*REGIONS, *sorted(set(stored) - set(REGIONS))]


def region_dimension(store: Store, regions: dict[str, Region] | None = None, grid: Grid = GLOBAL) -> rg.RegionRows:
    """Boxes from the configuration, polygons from the stored cells."""
    names = region_names(store, regions)
    regions = REGIONS if regions is None else regions
    dims = []
    boxes = {k: r.box(grid) for k, r in regions.items() if not r.masked}
    if boxes:
        dims.append(rg.box_rows(store.spark, boxes, grid))
    masked = [k for k in names if k not in boxes]
    if masked:
        cells = store.read("region_cells").filter(F.col("region").isin(masked))
        dims.append(rg.interval_rows(rg.cell_intervals(cells), grid))
    return rg.combine(*dims)


def build_region_cells(store: Store, regions: dict[str, Region] | None = None, grid: Grid = GLOBAL) -> None:
    regions = REGIONS if regions is None else regions
    edges = rg.ring_edges(rg.rings_of(store.spark, list(regions.values())))
    store.set_region_cells(rg.interval_cells(rg.polygon_intervals(edges, grid)), list(regions))


def store_outline(store: Store, path: str, region: str, grid: Grid = GLOBAL) -> None:
    """Bring in a polygon region from a GeoJSON feature, in place of an earlier outline of that name."""
    if region in REGIONS and not REGIONS[region].masked:
        raise ValueError(f"{region} is a box")
    edges = rg.ring_edges(rg.rings_from_geojson(store.spark, path, region))
    store.set_region_cells(rg.interval_cells(rg.polygon_intervals(edges, grid)), [region])


def load_climatology(store: Store, rows: DataFrame, box: Box, *, force: bool = False, grid: Grid = GLOBAL) -> None:
    """Load the calendar days that are not there yet, or everything again.

    Files that are not a full grid are refused, as is a climatology with cells
    where a stored day has none (it may be upside down). With days in store, a
    forced load must bring the same cells: each day's `has_clim` was decided by
    them. The new table is written beside the old one and then put in its place.
    """
    if bad := gf.shape_problems(rows, grid, key="mmdd").collect():  # a row per calendar day at most
        raise ValueError("; ".join(f"{r.mmdd:04d}: {r.problem}" for r in sorted(bad)))
    cells = gf.clim_cells(rows, box, grid)
    present = store.read("sst_clim")
    newest = store.loaded_days("sst").groupBy(mmdd("date")).agg(F.max("date").alias("date"))
    chosen = [r.date for r in newest.collect()]  # a day for each calendar day at most
    days = store.days("sst", chosen)
    orphans = ig.orientation_check(days, cells).filter("orphans > 0").orderBy("date")
    if wrong := orphans.collect():  # likewise
        raise ValueError("climatology cells without a value on " + ", ".join(f"{r.date} ({r.orphans})" for r in wrong))
    key = ["mmdd", "gy", "gx"]
    if force:
        moved = cells.join(present, key, "left_anti").select(*key).union(present.join(cells, key, "left_anti").select(*key))
        if chosen and not moved.isEmpty():
            raise ValueError("the climatology has other cells than the one the stored days were flagged with; load them anew")
        store.replace_climatology(cells)
        return
    new = ig.clim_pending(cells, present)
    store.replace_climatology(present.select("mmdd", "gy", "gx", "clim_raw").unionByName(new) if store.exists("sst_clim") else new)


def build_region_clim(
    store: Store, updated_at: dt.datetime, regions: dict[str, Region] | None = None, grid: Grid = GLOBAL
) -> None:
    out = ru.region_clim(store.read("sst_clim"), region_dimension(store, regions, grid))
    store.append("region_clim", out.withColumn("updated_at", F.lit(updated_at)))


def build_region_daily(
    store: Store, updated_at: dt.datetime, regions: dict[str, Region] | None = None, start=None, end=None, *,
    fresh: bool = False, grid: Grid = GLOBAL,
) -> None:
    """Roll up a range for all regions in one pass."""
    names = region_names(store, regions)
    if fresh:
        for table in ("region_daily", "region_parts"):
            store.drop_regions(table, names)
    dim = region_dimension(store, regions, grid)
    for product, table in DAILY.items():
        parts = ru.region_parts(date_range(store.read(table), start, end), product, dim)
        store.append("region_parts", parts.withColumn("updated_at", F.lit(updated_at)))
    parts = date_range(store.latest("region_parts"), start, end).filter(F.col("region").isin(names))
    store.append("region_daily", ru.rollup_of(parts).withColumn("updated_at", F.lit(updated_at)))


def update_rollup(
    store: Store, loaded: dict[str, list[dt.date]], updated_at: dt.datetime, regions: dict[str, Region] | None = None, grid: Grid = GLOBAL
) -> None:
    """Bring parts and rollup up to date after days of a product were loaded (product -> dates).

    Only these days of that product are read; the other product speaks by its
    stored parts. Days whose other product was loaded without a rollup, as by a
    backfill, have no parts yet, and get them now.
    """
    names = region_names(store, regions)
    changed = sorted({d for dates in loaded.values() for d in dates})
    if not changed or not names:
        return
    frame = lambda dates: store.spark.createDataFrame([(d,) for d in dates], "date date")
    mine = lambda: store.latest("region_parts").filter(F.col("date").isin(changed) & F.col("region").isin(names))
    known = mine().groupBy("product", "date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(names)).collect()
    dim = region_dimension(store, regions, grid)
    for product in DAILY:
        have = {r.date for r in known if r["product"] == product}
        dates = [d for d in changed if d in loaded.get(product, []) or d not in have]
        if dates:
            parts = ru.region_parts(store.days(product, dates), product, dim)
            store.append("region_parts", ru.whole_days(parts, names, frame(dates), product).withColumn("updated_at", F.lit(updated_at)))
    store.append("region_daily", ru.rollup_of(mine(), keep_empty=True).withColumn("updated_at", F.lit(updated_at)))


def _cells_of(
    store: Store, product: str, rows: DataFrame, batch: list[dt.date], box: Box, grid: Grid
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A product's table rows from its file rows, the rows per day, and the days
    that cannot be used. Counting needs the batch only, not the stored table."""
    problems = gf.shape_problems(rows, grid)
    usable = rows.join(F.broadcast(problems.select("date")), "date", "left_anti")
    if product == "sst":
        mmdds = sorted({d.month * 100 + d.day for d in batch})
        ocean = gf.sst_cells(usable, box, grid)
        return ig.flag_climatology(ocean, store.read("sst_clim"), mmdds), _per_day(ocean, product), problems
    cells = gf.class_cells(usable, box, grid)
    if "mask" in rows.columns:
        land = gf.carries_land(usable.select("date", F.col("mask").alias("values")))
        ocean = date_range(store.read("sst_daily"), min(batch), max(batch))  # prunes the parts
        cells, stuck = gf.repair_land(cells, land, ocean)
        problems = problems.unionByName(stuck)
    return cells, _per_day(cells, product), problems


def _per_day(cells: DataFrame, product: str) -> DataFrame:
    return cells.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("product", F.lit(product))


def ingest_product(
    store: Store, product: str, rows: DataFrame, files: DataFrame, updated_at: dt.datetime, box: Box, *,
    force: bool = False, batch_days: int = BATCH_DAYS, grid: Grid = GLOBAL,
) -> DataFrame:
    """Load the listed days of one product; returns (date, outcome).

    `rows` are file rows (date, row, values[, mask]); `files` is (product, date,
    filename[, size, modified, ...]). Loaded and unrevised days are skipped,
    loaded ones replaced, others added, in batches. A day that cannot be read is
    recorded as failed, and a batch that fails does not stop the next one.
    """
    plan = ig.ingest_plan(files.filter(F.col("product") == product), store.status(), force=force)
    actions = {r.date: r.action for r in plan.select("date", "action").collect()}
    outcome = {d: "skipped" for d, a in actions.items() if a == "skip"}
    todo = sorted(d for d, a in actions.items() if a != "skip")
    listed = files.filter(F.col("product") == product)
    for i in range(0, len(todo), batch_days):
        batch = todo[i : i + batch_days]
        outcome.update(_ingest_batch(store, product, rows, listed, batch, actions, updated_at, box, grid))
    return store.spark.createDataFrame(sorted(outcome.items()), "date date, outcome string")


def _ingest_batch(store, product, rows, listed, batch, actions, updated_at, box, grid) -> dict[dt.date, str]:
    spark = store.spark
    mine = listed.filter(F.col("date").isin(batch)).withColumn("action", F.lit("load"))
    none = spark.createDataFrame([], "product string, date date, n_rows bigint")
    problem = spark.createDataFrame([], "product string, date date, problem string")

    def record(counts: DataFrame, problems: DataFrame, at: dt.datetime, status: str | None = None) -> None:
        out = ig.status_rows(mine, counts, problems, at)
        store.append("ingest_status", out if status is None else out.withColumn("status", F.lit(status)))

    # a little earlier than the final record, which therefore wins
    record(none, problem, updated_at - dt.timedelta(microseconds=1), sc.INGESTING)
    landed: list[dt.date] = []
    try:
        cells, counts, problems = _cells_of(store, product, rows.filter(F.col("date").isin(batch)), batch, box, grid)
        bad = {r.date: r.problem for r in problems.collect()}  # days of this batch
        good = [d for d in batch if d not in bad]
        again = [d for d in good if actions[d] == "replace"]
        new = [d for d in good if actions[d] != "replace"]
        if new:
            store.append_days(product, cells.filter(F.col("date").isin(new)))
            landed = new
        if again:
            store.replace_days(product, cells.filter(F.col("date").isin(again)), again)
        reasons = spark.createDataFrame(
            [(product, d, p) for d, p in bad.items()], "product string, date date, problem string"
        )
        record(counts, reasons, updated_at)
        return {d: "failed" if d in bad else "ingested" for d in batch}
    except Exception as exc:  # one bad batch must not stop the run
        log.exception("%s: batch of %d day(s) from %s failed", product, len(batch), batch[0])
        if landed:
            # take back what was added; if that fails too, the days stay `ingesting`
            store.replace_days(product, spark.createDataFrame([], SCHEMAS[DAILY[product]]), landed)
        reasons = spark.createDataFrame(
            [(product, d, str(exc)) for d in batch], "product string, date date, problem string"
        )
        record(none, reasons, updated_at)
        return {d: "failed" for d in batch}


def process_days(
    store: Store, incoming: dict[str, tuple[DataFrame, DataFrame]], updated_at: dt.datetime, box: Box, *,
    regions: dict[str, Region] | None = None, force: bool = False, grid: Grid = GLOBAL,
) -> DataFrame:
    """Load what has arrived of both products, then bring the rollup up to date.

    `incoming` maps a product to (rows, files). Temperatures go first, since the
    land repair of a category day needs them. The rollup of a date is renewed
    whichever product landed: a date without its classes holds a 0 that the
    classes must correct later. Returns (date, outcome), the worst per date.
    """
    results = store.spark.createDataFrame([], "date date, outcome string")
    loaded: dict[str, list[dt.date]] = {}
    for product in ("sst", "mhw"):
        if product not in incoming:
            continue
        rows, files = incoming[product]
        mine = ingest_product(store, product, rows, files, updated_at, box, force=force, grid=grid)
        loaded[product] = [r.date for r in mine.filter("outcome = 'ingested'").collect()]
        results = results.unionByName(mine)
    update_rollup(store, loaded, updated_at, regions, grid)
    if store.exists("mhw_runs"):
        store.update_runs(loaded.get("mhw", []))
    return ig.date_outcome(results)


def run(
    store: Store, listings: dict[str, DataFrame], rows: dict[str, DataFrame], yesterday: dt.date,
    updated_at: dt.datetime, box: Box, *, max_days: int | None = None, recheck_days: int = 0,
    regions: dict[str, Region] | None = None, grid: Grid = GLOBAL,
) -> DataFrame:
    """The daily run: plan the target dates, load what is published of them.

    Target dates without a file in either listing are reported as unpublished.
    """
    targets = ig.run_targets(store.status(), yesterday, max_days=max_days, recheck_days=recheck_days).select("date")
    dates = [r.date for r in targets.collect()]
    incoming = {
        p: (rows[p].filter(F.col("date").isin(dates)), files.filter(F.col("date").isin(dates)))
        for p, files in listings.items()
    }
    done = process_days(store, incoming, updated_at, box, regions=regions, grid=grid)
    waiting = store.spark.createDataFrame([(d, "unpublished") for d in dates], "date date, outcome string")
    return ig.date_outcome(done.unionByName(waiting))


def landed(store: Store, landing: str, product: str) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of a product's decoded day files, one parquet file per day.

    Files come off the folder's listing and are dated by their names; only those
    whose names carry no date are opened, for one column.
    """
    ddl = f"{sc.GRID_ROWS}, mask array<tinyint>" if product == "mhw" else sc.GRID_ROWS
    folder = f"{landing}/{product}"
    rows = store.spark.read.schema(ddl).parquet(folder)
    listed = gf.landed_files(gf.folder_listing(store.spark, folder))
    unnamed = listed.filter("date is null")
    if not unnamed.isEmpty():
        inside = rows.select("date", F.col("_metadata.file_name").alias("filename"))
        dated = inside.join(unnamed.select("filename"), "filename", "left_semi").groupBy("filename").agg(F.max("date").alias("date"))
        listed = listed.filter("date is not null").unionByName(unnamed.drop("date").join(dated, "filename"))
    files = listed.groupBy("date").agg(F.max("filename").alias("filename"), F.max("size").alias("size"), F.max("modified").alias("modified"))
    return rows, files.withColumn("product", F.lit(product))


def repair_leap_days(
    store: Store, rows: DataFrame, files: DataFrame, updated_at: dt.datetime, box: Box, *,
    regions: dict[str, Region] | None = None, grid: Grid = GLOBAL,
) -> DataFrame:
    """Load the classes of every stored 29 February again, with the land repaired,
    and rebuild the rollup of those dates. Returns (date, outcome)."""
    leaps = [r.leap_day for r in ig.leap_repair_plan(store.status()).select("leap_day").distinct().collect()]
    chosen = lambda df: df.filter(F.col("date").isin(leaps))
    return process_days(
        store, {"mhw": (chosen(rows), chosen(files))}, updated_at, box, regions=regions, force=True, grid=grid
    )
