"""Runs of consecutive event days.

A run is a property of days, never of buckets, and it ends at a missing date.
The windows below are partitioned by cell, and a cell has at most one row per
day of the archive, so no partition grows with the number of cells.

Stored runs carry the classes of their days, so that a batch of new or revised
days changes the runs it touches and nothing else is read again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .series import CELL, cell_keys


def event_runs(events: DataFrame, *, classes: bool = False) -> DataFrame:
    """(gy, gx, start, end, days, peak) from (gy, gx, date, cat).

    With `classes`, also the class of each of its days in order, so that the run
    can be taken apart again.

    Consecutive dates minus their row number are constant, which names a run.
    Window and both groupings share one shuffle on the cell, and need none on a
    stored table, whose buckets hold whole cells.
    """
    keys = cell_keys(events)
    order = F.row_number().over(W.partitionBy(*keys).orderBy("date"))
    return (
        events.select(*keys, "date", F.col("cat").cast("int").alias("cat"))
        .withColumn("island", F.date_sub("date", order))
        .groupBy(*keys, "island")
        .agg(
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            F.count(F.lit(1)).alias("days"),
            F.max("cat").alias("peak"),
            *([F.transform(F.array_sort(F.collect_list(F.struct("date", "cat"))), lambda d: d["cat"]).alias("classes")] if classes else []),
        )
        .drop("island", "block")
    )


def run_days(runs: DataFrame) -> DataFrame:
    """The days (gy, gx, date, cat) that runs with their classes consist of."""
    day = F.posexplode("classes").alias("after", "cat")
    return runs.select(*CELL, "start", day).select(*CELL, F.date_add("start", F.col("after")).alias("date"), "cat")


def near(dates: list[dt.date]) -> Column:
    """Whether a run holds one of these dates or ends beside one, so that a change of them may change it.

    The run's own days are looked up among the dates, so that the work does not grow with their number.
    """
    return F.exists(F.sequence(F.date_sub("start", 1), F.date_add("end", 1)), lambda d: d.isin(dates))


def renewed_runs(runs: DataFrame, events: DataFrame, dates: list[dt.date]) -> tuple[DataFrame, DataFrame]:
    """(runs that stay, runs that are new) once the events of these dates are replaced by the given ones.

    `runs` carries classes. Only runs at these dates are taken apart: days that
    are gone split them, new days prolong or join them.
    """
    if not dates:
        return runs, runs.filter(F.lit(False)).select(*CELL, "start", "end", "days", "peak", "classes")
    kept = run_days(runs.filter(near(dates))).filter(~F.col("date").isin(dates))
    fresh = events.filter(F.col("date").isin(dates)).select(*CELL, "date", F.col("cat").cast("int").alias("cat"))
    return runs.filter(~near(dates)), event_runs(kept.unionByName(fresh), classes=True)


def run_summary(runs: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per cell of `daily`: the run in progress, the longest, and totals.

    A run is in progress only if it reaches the last day the cell has any data
    for. Equally long runs: the earliest is reported.
    """
    through = daily.groupBy(*CELL).agg(F.max("date").alias("through"))
    shape = F.struct("start", "end", "days", "peak")
    # larger struct wins: more days first, then the earlier start
    preference = F.struct("days", F.datediff(F.lit("1900-01-01").cast("date"), F.col("start")))
    totals = runs.groupBy(*CELL).agg(
        F.max_by(shape, preference).alias("longest"),
        F.max_by(shape, "end").alias("latest"),
        F.sum("days").alias("days"),
        F.count(F.lit(1)).alias("events"),
    )
    current = F.when(F.col("latest.end") == F.col("through"), F.col("latest"))
    return (
        through.join(totals, CELL, "left")
        .withColumn("current", current)
        .select(
            *CELL,
            *[F.col(f"current.{f}").alias(f"current_{f}") for f in ("start", "end", "days", "peak")],
            *[F.col(f"longest.{f}").alias(f"longest_{f}") for f in ("start", "end", "days", "peak")],
            F.coalesce("days", F.lit(0).cast("long")).alias("days"),
            F.coalesce("events", F.lit(0).cast("long")).alias("events"),
            "through",
        )
    )
