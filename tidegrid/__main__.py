"""Command line: `python -m tidegrid --root ROOT [--landing DIR] COMMAND`.

ROOT holds the archive's tables. The landing folder holds decoded files as
parquet: `sst/` and `mhw/` with one file per day, `clim/` with (mmdd, row,
values). Both must be reachable from every executor.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import functions as F

from . import session
from .domain import GLOBAL, REGIONS, VARIABLES
from .functions.calendar import PERIODS, date_range
from .operators import ingest as ig
from .plans import daily, pictures
from .sources import gridfiles as gf
from .sources.store import BUCKETS, Store


MOST_FILES = 16  # of a bucket, before a daily run merges those of its partition


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegrid", description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("--landing")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, dates: bool = False, regions: bool = False, products: bool = False):
        c = sub.add_parser(name, help=text)
        if dates:
            c.add_argument("--date", type=dt.date.fromisoformat)
            c.add_argument("--start", type=dt.date.fromisoformat)
            c.add_argument("--end", type=dt.date.fromisoformat)
        if regions:
            c.add_argument("--region", action="append", choices=sorted(REGIONS))
        if products:
            c.add_argument("--product", action="append", choices=["sst", "mhw"])
        return c

    init = command("init", "load the climatology, region cells and region normals")
    init.add_argument("--force", action="store_true")
    init.add_argument("--buckets", type=int, default=BUCKETS, help="of a new archive; see sources/store.py")
    init.add_argument("--allow-partial", action="store_true")
    command("verify-clim", "report climatology files that are missing or not a full grid")
    command("scan", "compare the landing folder with what is loaded", dates=True)
    back = command("backfill", "load landed day files", dates=True, products=True)
    back.add_argument("--force", action="store_true")
    back.add_argument("--fresh", action="store_true", help="empty the products first")
    back.add_argument("--batch", type=int, default=daily.BATCH_DAYS)
    back.add_argument("--limit", type=int, help="load so many files that are not loaded yet")
    back.add_argument("--newest-first", action="store_true", help="with --limit")
    command("prune-list", "print the landed files that no open week or month needs any more", dates=True, products=True)
    outline = command("outline", "bring in the outline of a polygon region")
    outline.add_argument("--name", required=True)
    outline.add_argument("--geojson", required=True)
    command("mask", "rebuild the cells of polygon regions", regions=True)
    roll = command("rollup", "build the daily means of all regions", dates=True, regions=True)
    roll.add_argument("--clim", action="store_true")
    roll.add_argument("--fresh", action="store_true")
    render = command("render", "write the pictures of closed buckets", dates=True)
    render.add_argument("--variable", action="append", choices=sorted(VARIABLES))
    render.add_argument("--period", action="append", choices=PERIODS)
    render.add_argument("--width", type=int, default=2048)
    render.add_argument("--force", action="store_true")
    run = command("run", "the daily run", dates=True)
    run.add_argument("--max-days", type=int)
    run.add_argument("--recheck-days", type=int, default=3)
    repair = command("repair-leap-days", "load stored 29 Februaries again, with their land repaired")
    for c in (run, repair):
        c.add_argument("--width", type=int, default=2048, help="of the pictures to redraw; 0 for none")
    layout = command("relayout", "rewrite a daily table from another layout, verified by row counts")
    layout.add_argument("--table", choices=["sst_daily", "mhw_daily"], required=True)
    layout.add_argument("--source", required=True)
    command("status", "days, rows and spans by product and status")
    return p


def selected(df, args):
    return date_range(df, args.date or args.start, args.date or args.end)


def print_rows(df) -> None:
    """All rows of a small report, one a line."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join(str(v) for v in row))


def run_outcomes(store: Store, result, width: int) -> int:
    """Report a run's days and redraw the pictures of those that were loaded (no width: none)."""
    result = session.checkpoint(result)  # a row per day; without it the run would be planned again
    failed = outcomes(result)
    if width:
        print(f"{pictures.redraw(store, result, width)} picture(s)")
    return failed


def outcomes(result) -> int:
    counts = {r.outcome: r["count"] for r in result.groupBy("outcome").count().collect()}
    print(", ".join(f"{n} {word}" for word, n in sorted(counts.items())) or "nothing to do")
    return 1 if counts.get("failed") else 0


def render(store: Store, args) -> int:
    names, periods = args.variable or list(VARIABLES), args.period or list(PERIODS)
    files = store.status().filter("status = 'success_ingest'")
    span = selected(files.filter(F.col("product").isin(["mhw" if n == "mhw" else "sst" for n in names])), args)
    closed = ig.closed_buckets(span.agg(F.min("date").alias("lo"), F.max("date").alias("hi")))
    made = store.read("picture_list").distinct()
    todo = session.checkpoint(ig.pending_buckets(closed, made, tuple(names), force=args.force))
    print(f"{pictures.draw(store, todo, tuple(names), tuple(periods), args.width)} picture(s)")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    store = Store(session.build("tidegrid", args.master), args.root, getattr(args, "buckets", BUCKETS))
    now, box = dt.datetime.now(dt.UTC), gf.subset_box()
    chosen = {k: REGIONS[k] for k in (getattr(args, "region", None) or REGIONS)}

    def clim_rows():
        return store.spark.read.schema("mmdd int, row int, values array<smallint>").parquet(f"{args.landing}/clim")

    if args.command == "verify-clim":
        bad = [(r.mmdd, r.problem) for r in gf.shape_problems(clim_rows(), GLOBAL, key="mmdd").collect()]
        bad += [(r.mmdd, "missing") for r in ig.missing_mmdd(clim_rows()).collect()]
        for mmdd, reason in sorted(bad):
            print(f"{mmdd:04d}  {reason}")
        return 1 if bad else 0
    if args.command == "init":
        missing = ig.missing_mmdd(clim_rows()).count()
        if missing and not args.allow_partial:
            print(f"{missing} of 366 calendar days have no climatology; refusing a partial load")
            return 1
        daily.load_climatology(store, clim_rows(), box, force=args.force)
        daily.build_region_cells(store)
        daily.build_region_clim(store, now)
        return 0
    if args.command == "scan":
        both = [selected(daily.landed(store, args.landing, p)[1], args) for p in ("sst", "mhw")]
        print_rows(ig.scan_report(both[0].unionByName(both[1]), store.status()).orderBy("product"))
        return 0
    if args.command == "backfill":
        products = args.product or ["sst", "mhw"]
        if args.fresh:
            store.reset(products)
        failed = 0
        for p in products:
            rows, files = daily.landed(store, args.landing, p)
            files = selected(files, args)
            if args.limit:
                waiting = gf.select_files(ig.pending_files(files, store.status()), newest_first=args.newest_first, limit=args.limit)
                files = session.checkpoint(waiting)
            done = session.checkpoint(daily.ingest_product(
                store, p, selected(rows, args), files, now, box, force=args.force, batch_days=args.batch))
            failed |= outcomes(done)
            dates = [r.date for r in done.filter("outcome = 'ingested'").collect()]
            store.merge_files(p, dates)
            if p == "mhw":
                store.update_runs(dates)
        store.compact("ingest_status")
        return failed
    if args.command == "prune-list":
        if not args.date:
            print("--date is needed: the last day that has been processed")
            return 1
        for p in args.product or ["sst", "mhw"]:
            print_rows(ig.retention_list(daily.landed(store, args.landing, p)[1], args.date).select("product", "date", "filename").orderBy("date"))
        return 0
    if args.command == "outline":
        daily.store_outline(store, args.geojson, args.name)
        print_rows(store.read("region_cells").filter(F.col("region") == args.name).groupBy("region").count())
        return 0
    if args.command == "mask":
        daily.build_region_cells(store, chosen)
        print_rows(store.read("region_cells").groupBy("region").count().orderBy("region"))
        return 0
    if args.command == "rollup":
        daily.build_region_cells(store, chosen)
        named = chosen if args.region else None  # without names, stored outlines too
        if args.clim:
            daily.build_region_clim(store, now, named)
        daily.build_region_daily(store, now, named, args.date or args.start, args.date or args.end, fresh=args.fresh)
        for table in ("region_daily", "region_parts"):
            store.compact(table)
        return 0
    if args.command == "render":
        return render(store, args)
    if args.command == "run":
        rows, listings = {}, {}
        for p in ("sst", "mhw"):
            rows[p], listings[p] = daily.landed(store, args.landing, p)
        if args.date:
            return run_outcomes(store, daily.process_days(
                store, {p: (selected(rows[p], args), selected(listings[p], args)) for p in rows}, now, box), args.width)
        yesterday = now.date() - dt.timedelta(days=1)
        failed = run_outcomes(store, daily.run(
            store, listings, rows, yesterday, now, box, max_days=args.max_days, recheck_days=args.recheck_days), args.width)
        for p in ("sst", "mhw"):
            store.merge_files(p, [yesterday], most=MOST_FILES)
        for table in ("ingest_status", "region_daily", "region_parts"):  # a few rows per region and day
            store.compact(table)
        return failed
    if args.command == "repair-leap-days":
        return run_outcomes(store, daily.repair_leap_days(store, *daily.landed(store, args.landing, "mhw"), now, box), args.width)
    if args.command == "relayout":
        store.rewrite_layout(args.table, args.source)
        return 0
    print_rows(ig.status_summary(store.status()).orderBy("product", "status"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
