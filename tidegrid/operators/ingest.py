"""What to load, what is loaded, and whether the archive is whole."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import PERIODS, bucket_end, bucket_start, climatology_of, mmdd, mmdd_calendar
from ..functions.grid import block_of
from ..schema import FAILED, INGESTING, SUCCESS
from .stats import with_single_row

VARIABLES = ("sst", "anom", "mhw")


# ------------------------------------------------------------------- climatology


def flag_climatology(days: DataFrame, clim: DataFrame, mmdds: list[int] | None = None) -> DataFrame:
    """Add `has_clim`: whether the cell has a climatology on that calendar day.

    Decided when a day is loaded, because the ice edge moves through the year.
    A batch knows its calendar days; listing them cuts the climatology to them,
    and a stored one to the partitions of their months. The climatology stays
    where its buckets are, only the days move to it.
    """
    if mmdds is not None:
        clim = climatology_of(clim, sorted({m // 100 for m in mmdds})).filter(F.col("mmdd").isin(mmdds))
    keyed = days.withColumn("mmdd", mmdd("date"))
    if "block" in clim.columns:
        keyed = keyed.withColumn("block", block_of())
    keys = [*(["block"] if "block" in clim.columns else []), "gy", "gx", "mmdd"]
    known = clim.select(*keys, F.lit(True).alias("known"))
    return keyed.join(known, keys, "left").select(
        *days.columns, F.coalesce("known", F.lit(False)).alias("has_clim")
    )


def clim_pending(incoming: DataFrame, stored: DataFrame | None, *, force: bool = False) -> DataFrame:
    """Climatology rows whose calendar day is not stored yet; all of them if forced."""
    if force or stored is None:
        return incoming
    return incoming.join(F.broadcast(stored.select("mmdd").distinct()), "mmdd", "left_anti")


def missing_mmdd(clim: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calendar days without a climatology: (mmdd), or ([by], mmdd) for each of the keys that there are."""
    calendar = mmdd_calendar(clim.sparkSession)
    if by is None:
        return calendar.join(clim.select("mmdd").distinct(), "mmdd", "left_anti")
    whole = F.array(*[F.lit(r.mmdd) for r in calendar.collect()])  # 366 rows
    return clim.groupBy(*by).agg(F.collect_set("mmdd").alias("has")).select(*by, F.explode(F.array_except(whole, "has")).alias("mmdd"))


def mmdd_completeness(clim: DataFrame) -> DataFrame:
    return clim.agg(F.countDistinct("mmdd").alias("present")).select("present", (366 - F.col("present")).alias("missing"))


def orientation_check(daily: DataFrame, clim: DataFrame) -> DataFrame:
    """(date, orphans): climatology cells of the calendar day that have no value that day.

    On real data always 0; a climatology that is turned upside down lies on land
    and leaves many. Cells are compared, not stored flags, which may be older
    than the climatology. The anti join is shuffled on the cell.
    """
    dates = daily.select("date").distinct().withColumn("mmdd", mmdd("date"))  # a row per day
    expected = clim.select("mmdd", "gy", "gx").join(F.broadcast(dates), "mmdd").select("date", "gy", "gx")
    orphans = expected.join(daily.select("date", "gy", "gx"), ["date", "gy", "gx"], "left_anti")
    counts = orphans.groupBy("date").agg(F.count(F.lit(1)).alias("orphans"))
    zero = F.lit(0).cast("long")
    return dates.join(counts, "date", "left").select("date", F.coalesce("orphans", zero).alias("orphans"))


# ------------------------------------------------------------------------ status


def latest_version(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key. An aggregate rather than a window: versions of a
    key that is rewritten all the time are reduced before the shuffle."""
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("r"))
        .select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])
    )


def status_summary(status: DataFrame, keys: tuple[str, ...] = ("product",)) -> DataFrame:
    return status.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n_rows").alias("n_rows"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


def is_current(status, size, modified, seen_size, seen_modified) -> Column:
    """Loaded, and not revised at the source since.

    Only figures known on both sides can differ: without a recorded size, or
    without a time on one side, a loaded day counts as unchanged.
    """
    size = F.coalesce(size, F.lit(0))
    seen_size = F.coalesce(seen_size, F.lit(0))
    resized = (seen_size != 0) & (size != seen_size)
    blank = lambda c: F.coalesce(c, F.lit(""))
    touched = (blank(seen_modified) != "") & (blank(modified) != "") & (modified != seen_modified)
    return F.coalesce(status == SUCCESS, F.lit(False)) & ((size == 0) | ~(resized | touched))


def revised_dates(status: DataFrame, remote: DataFrame) -> DataFrame:
    """(product, date, current) for each remote (product, date, size, modified)."""
    mine = status.select("product", "date", "status", "remote_size", "remote_modified")
    flag = is_current(
        F.col("status"), F.col("remote_size"), F.col("remote_modified"), F.col("size"), F.col("modified")
    )
    return remote.join(mine, ["product", "date"], "left").select("product", "date", flag.alias("current"))


def ingest_plan(files: DataFrame, status: DataFrame, *, force: bool = False) -> DataFrame:
    """(product, date, filename, action): load, replace or skip.

    A day left in the middle of being loaded counts as one to replace. Where the listing carries the remote `size` and `modified`, a loaded day
    that was revised there is replaced.
    """
    mine = status.select("product", "date", "status", "remote_size", "remote_modified")
    both = files.join(mine, ["product", "date"], "left")
    loaded = F.coalesce(F.col("status") == SUCCESS, F.lit(False))
    if "size" in files.columns:
        current = is_current(
            F.col("status"), F.col("remote_size"), F.col("remote_modified"), F.col("size"), F.col("modified")
        )
    else:
        current = loaded
    begun = loaded | F.coalesce(F.col("status") == INGESTING, F.lit(False))
    action = F.when(begun, "replace").otherwise("load")
    if not force:
        action = F.when(current, "skip").otherwise(action)
    return both.select("product", "date", "filename", action.alias("action"))


def status_rows(
    plan: DataFrame, counts: DataFrame, problems: DataFrame, updated_at: dt.datetime
) -> DataFrame:
    """One status row per attempted day: rows written, or why it failed."""
    tried = plan.filter("action <> 'skip'")
    have = set(tried.columns)
    optional = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    return (
        tried.join(counts, ["product", "date"], "left")
        .join(problems, ["product", "date"], "left")
        .select(
            "product", "date", "filename",
            F.when(F.col("problem").isNull(), SUCCESS).otherwise(FAILED).alias("status"),
            F.when(F.col("problem").isNull(), F.coalesce("n_rows", F.lit(0))).otherwise(0).cast("long").alias("n_rows"),
            optional("file_size", "long").alias("file_size"),
            optional("source_url", "string").alias("source_url"),
            optional("size", "long").alias("remote_size"),
            optional("modified", "string").alias("remote_modified"),
            F.coalesce("problem", F.lit("")).alias("message"),
            F.lit(updated_at).cast("timestamp").alias("updated_at"),
        )
    )


def pending_files(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files whose day is not loaded yet."""
    done = status.filter(F.col("status") == SUCCESS).select("product", "date")
    return files.join(done, ["product", "date"], "left_anti")


def scan_report(files: DataFrame, status: DataFrame) -> DataFrame:
    """Per product: files present, already loaded, still to load, and their span."""
    done = status.filter(F.col("status") == SUCCESS).select("product", "date", F.lit(True).alias("done"))
    known = F.coalesce("done", F.lit(False))
    return (
        files.join(done, ["product", "date"], "left")
        .groupBy("product")
        .agg(
            F.count(F.lit(1)).alias("files"), F.min("date").alias("first"), F.max("date").alias("last"),
            F.count_if(known).alias("loaded"), F.count_if(~known).alias("to_ingest"),
            F.min(F.when(~known, F.col("date"))).alias("next_date"),
        )
    )


# ---------------------------------------------------------------------- coverage


def coverage(status: DataFrame, clim_keys: DataFrame) -> DataFrame:
    """One row: extent of the archive and whether each variable can be served.

    Rows and days come off the status table (product, date, status, n_rows), so
    no fact is read; `clim_keys` is (mmdd). The sparse table cannot tell a calm
    day from one that was never loaded, so classes are complete once their
    loaded days match the daily table's, give or take the one day by which they
    are published later.
    """
    ok = F.col("status") == SUCCESS

    def of(product: str, prefix: str) -> list[Column]:
        mine = ok & (F.col("product") == product)
        with_rows = mine & (F.col("n_rows") > 0)
        return [
            F.coalesce(F.sum(F.when(mine, F.col("n_rows"))), F.lit(0)).alias(f"{prefix}rows"),
            F.min(F.when(with_rows, F.col("date"))).alias(f"{prefix}start"), F.max(F.when(with_rows, F.col("date"))).alias(f"{prefix}end"),
            F.countDistinct(F.when(mine, F.col("date"))).alias(f"{prefix}days"),
        ]

    facts = status.agg(*of("sst", ""), *of("mhw", "mhw_"))
    out = with_single_row(facts, clim_keys.agg(F.countDistinct("mmdd").alias("clim_keys")))
    return out.withColumns({
        "clim_complete": F.col("clim_keys") == 366,
        "mhw_complete": (F.col("mhw_rows") > 0) & (F.col("mhw_days") >= F.col("days") - 1),
    })


def readiness(cover: DataFrame) -> DataFrame:
    """(variable, ready): anomalies unless the climatology is known to be
    incomplete, classes only if their archive is known to be complete."""
    flags = (
        ("sst", F.lit(True)),
        ("anom", F.coalesce("clim_complete", F.lit(True))),
        ("mhw", F.coalesce("mhw_complete", F.lit(False))),
    )
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), ok.alias("ready")) for v, ok in flags])
    return cover.select(F.inline(pairs))


def archive_range(files: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """First and last day over the products the variables read."""
    products = {"mhw" if v == "mhw" else "sst" for v in variables}
    return files.filter(F.col("product").isin(sorted(products))).agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )


# ------------------------------------------------------------------ daily planning


def run_targets(
    status: DataFrame, yesterday: dt.date, *, max_days: int | None = None, recheck_days: int = 0
) -> DataFrame:
    """(date, reason) that a run on the day after `yesterday` should visit.

    It resumes after the earlier of the two products' last loaded days (for at
    most `max_days` days; none or 0 sets no limit), so that
    a date with temperatures but no classes yet is visited again. `recheck` days
    are looked at for revisions at the source.
    """
    ok = F.col("status") == SUCCESS
    last_of = lambda p: F.max(F.when((F.col("product") == p) & ok, F.col("date")))
    lasts = status.agg(last_of("sst").alias("s"), last_of("mhw").alias("m"))
    # NULL unless both products have been loaded at least once
    mark = lasts.select(F.when(F.col("s").isNotNull() & F.col("m").isNotNull(), F.least("s", "m")).alias("last"))
    end = F.lit(yesterday)
    first = F.least(F.coalesce(F.date_add("last", 1), end), end)
    stop = F.least(end, F.date_add(first, max_days - 1)) if max_days else end
    catch_up = mark.select(F.explode(F.sequence(first, stop)).alias("date"), F.lit("catch_up").alias("reason"))
    if recheck_days <= 0:
        return catch_up
    back = F.explode(F.sequence(F.date_sub(end, recheck_days), F.date_sub(end, 1))).alias("date")
    recheck = mark.select(back, "last").filter(F.col("last").isNull() | (F.col("date") <= F.col("last")))
    recheck = recheck.select("date", F.lit("recheck").alias("reason"))
    return catch_up.unionByName(recheck).groupBy("date").agg(F.min("reason").alias("reason"))


# Outcomes from the mildest to the worst.
OUTCOMES = ("unpublished", "skipped", "ingested", "failed")


def date_outcome(results: DataFrame) -> DataFrame:
    """(date, outcome): the worst of a date's per-product outcomes."""
    severity = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome"))
    worst = results.groupBy("date").agg(F.max(severity).cast("int").alias("s"))
    return worst.select("date", F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("s")).alias("outcome"))


def _each(name: str, values) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def _per_period(build) -> Column:
    """The value of build(period) for the row's own `period` column."""
    out = F.when(F.col("period") == PERIODS[0], build(PERIODS[0]))
    for p in PERIODS[1:]:
        out = out.when(F.col("period") == p, build(p))
    return out


def affected_buckets(dates: DataFrame) -> DataFrame:
    """(variable, period, bucket) that the given dates contribute to."""
    return (
        dates.select("date").distinct()
        .select("date", _each("period", PERIODS))
        .select("period", _per_period(lambda p: bucket_start("date", p)).alias("bucket"))
        .distinct()
        .select(_each("variable", VARIABLES), "period", "bucket")
    )


def closed_buckets(spans: DataFrame) -> DataFrame:
    """(period, bucket) that end within [lo, hi]. The first one may begin before
    lo; a bucket with a missing day inside is closed all the same."""
    steps = {"daily": F.make_dt_interval(F.lit(1)), "weekly": F.make_dt_interval(F.lit(7)),
             "monthly": F.make_ym_interval(F.lit(0), F.lit(1))}
    parts = [
        spans.filter(F.col("lo") <= F.col("hi"))
        .select(
            F.lit(p).alias("period"), "hi",
            F.explode(F.sequence(bucket_start("lo", p), F.col("hi"), steps[p])).alias("bucket"),
        )
        .filter(bucket_end("bucket", p) <= F.col("hi"))
        .select("period", F.col("bucket").cast("date").alias("bucket"))
        for p in PERIODS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pending_buckets(
    closed: DataFrame, produced: DataFrame, variables: tuple[str, ...] = VARIABLES, *, force: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """(variable, period, bucket) still to be produced, oldest first when limited."""
    wanted = closed.select(_each("variable", variables), "period", "bucket")
    if not force:
        wanted = wanted.join(produced.select("variable", "period", "bucket"), ["variable", "period", "bucket"], "left_anti")
    return wanted if limit is None else wanted.orderBy("variable", "period", "bucket").limit(limit)


def retention_floor(d) -> Column:
    """First day whose file the open week and month of `d` still need."""
    return F.least(bucket_start(d, "weekly"), bucket_start(d, "monthly"))


def retention_list(files: DataFrame, day: dt.date) -> DataFrame:
    """Files no longer needed once `day` is processed. Nothing is deleted."""
    return files.filter(F.col("date") < retention_floor(F.lit(day)))


def leap_repair_plan(status: DataFrame) -> DataFrame:
    """(leap_day, date): each loaded 29 February with all days of its week and month."""
    loaded = status.filter((F.col("product") == "mhw") & (F.col("status") == SUCCESS)).agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    years = loaded.select("lo", "hi", F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("y"))
    last_feb = F.last_day(F.make_date(F.col("y"), F.lit(2), F.lit(1)))
    leaps = years.select("lo", "hi", last_feb.alias("leap_day")).filter(
        (F.day("leap_day") == 29) & F.col("leap_day").between(F.col("lo"), F.col("hi"))
    )
    spans = F.array_union(
        *[F.sequence(bucket_start("leap_day", p), bucket_end("leap_day", p)) for p in ("weekly", "monthly")]
    )
    return leaps.select("leap_day", F.explode(spans).alias("date"))


# ------------------------------------------------------------------------ layout


def layout_mismatch(old: DataFrame, new: DataFrame) -> DataFrame:
    """(year, old_rows, new_rows, same_rows) where a rewritten table differs; empty if equal.

    Rows are compared by number and by the sum of their hashes, so one row lost
    and another doubled shows too.
    """
    columns = sorted(c for c in old.columns if c in new.columns)

    def by_year(df: DataFrame, name: str) -> DataFrame:
        mark = F.xxhash64(*columns).cast("decimal(38,0)")
        return df.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.sum(mark).alias(name))

    both = by_year(old, "old").join(by_year(new, "new"), "year", "full")
    zero = F.lit(0).cast("long")
    both = both.select(
        "year", F.coalesce("old_rows", zero).alias("old_rows"), F.coalesce("new_rows", zero).alias("new_rows"),
        F.col("old").eqNullSafe(F.col("new")).alias("same_rows"))
    return both.filter(~F.col("same_rows") | (F.col("old_rows") != F.col("new_rows")))


def replaced_days(existing: DataFrame, incoming: DataFrame, dates: DataFrame) -> DataFrame:
    """The table after the given dates were replaced by the incoming rows. A date
    without incoming rows ends up empty."""
    kept = existing.join(F.broadcast(dates.select("date").distinct()), "date", "left_anti")
    return kept.unionByName(incoming.select(*[c for c in existing.columns if c in incoming.columns]))
