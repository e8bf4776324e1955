"""Day, week and month arithmetic on DATE columns.

Weeks begin on Monday and months are calendar months; a bucket is named by its
first day. `mmdd` is the climatology key, month * 100 + day, with 366 values.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = ("daily", "weekly", "monthly")

# Fixed value: years from here on get a partition each, earlier ones share a decade.
YEARLY_FROM = 2024


def _col(d) -> Column:
    if isinstance(d, dt.date):
        return F.lit(d)
    return F.col(d) if isinstance(d, str) else d


def check_period(period: str) -> str:
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; expected one of {PERIODS}")
    return period


def mmdd(d) -> Column:
    d = _col(d)
    return F.month(d) * 100 + F.day(d)


def bucket_start(d, period: str) -> Column:
    d = _col(d)
    return {"daily": d, "weekly": F.trunc(d, "week"), "monthly": F.trunc(d, "month")}[check_period(period)]


def bucket_end(d, period: str) -> Column:
    start = bucket_start(d, period)
    return {"daily": start, "weekly": F.date_add(start, 6), "monthly": F.last_day(start)}[period]


def shift_buckets(d, period: str, n) -> Column:
    start = bucket_start(d, period)
    n = F.lit(n) if isinstance(n, int) else n
    if period == "monthly":
        return F.add_months(start, n)
    return F.date_add(start, n * 7 if period == "weekly" else n)


def next_bucket(d, period: str, coverage_end) -> Column:
    """The following bucket, or NULL once it starts after the archive's last one."""
    step = shift_buckets(d, period, 1)
    return F.when(step <= bucket_start(coverage_end, period), step)


def step_within(d, period: str, n, coverage_start, coverage_end) -> Column:
    """Move by n buckets and stay inside the archive's first and last day."""
    return F.least(F.greatest(shift_buckets(d, period, n), _col(coverage_start)), _col(coverage_end))


def first_bucket_in_month(year, month, period: str) -> Column:
    """First bucket start that is not before the first of the month."""
    first = F.make_date(_col(year), _col(month), F.lit(1))
    start = bucket_start(first, period)
    return F.when(start < first, F.date_add(start, 7)).otherwise(start)


def bucket_label(d, period: str) -> Column:
    """`May 2024`, `6 May – 12 May`, or `6 May 2024`. Month names are English."""
    start = bucket_start(d, period)
    if period == "monthly":
        return F.date_format(start, "MMMM yyyy")
    if period == "weekly":
        return F.concat_ws(" – ", F.date_format(start, "d MMM"), F.date_format(bucket_end(d, period), "d MMM"))
    return F.date_format(start, "d MMM yyyy")


def days_in_month(d) -> Column:
    return F.day(F.last_day(_col(d)))


def days_in_year(d) -> Column:
    return F.dayofyear(F.make_date(F.year(_col(d)), F.lit(12), F.lit(31)))


def doy_gap(a, b) -> Column:
    """Distance between two days of the year, around the turn of the year."""
    gap = F.abs(F.dayofyear(_col(a)) - F.dayofyear(_col(b)))
    return F.least(gap, 366 - gap)


def part_key(d) -> Column:
    """Partition of a day: its year from YEARLY_FROM on, else the decade."""
    year = F.year(_col(d))
    return F.when(year >= YEARLY_FROM, year).otherwise(F.floor(year / 10).cast("int") * 10)


def part_of(day: dt.date) -> int:
    return day.year if day.year >= YEARLY_FROM else day.year // 10 * 10


def date_range(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Inclusive date filter. Catalyst does not derive a partition filter from a
    date filter, so on tables that carry `part` the matching one is added; the
    key never decreases with the date, hence a plain range."""
    stored = "part" in df.columns
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
        if stored:
            df = df.filter(F.col("part") >= part_of(start))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end))
        if stored:
            df = df.filter(F.col("part") <= part_of(end))
    return df


def months_between(start: dt.date, end: dt.date) -> list[int]:
    """Calendar months that a span touches."""
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return sorted({k % 12 + 1 for k in range(first, min(last, first + 11) + 1)})


def climatology_of(clim: DataFrame, months: list[int] | None) -> DataFrame:
    """The climatology of some calendar months; where the table carries `month`, only their partitions are read."""
    if months is None or len(months) == 12 or "month" not in clim.columns:
        return clim
    return clim.filter(F.col("month").isin(months))


def mmdd_calendar(spark: SparkSession) -> DataFrame:
    """The 366 climatology keys."""
    leap = spark.range(366).select(F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int")).alias("d"))
    return leap.select(mmdd("d").alias("mmdd"))
