"""Summary numbers of a series, for any number of series at once.

A series is (keys..., bucket, value), with each bucket once. NULL and NaN values
are gaps and never count. Windows run over one series at a time, which has at
most a row per day of the archive however many cells there are; without keys
there is one series, and what a window would add comes as a scalar subquery.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DAYS_PER_DECADE = 3652.5
RECENT_DAYS = 365


def with_single_row(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (NULLs if it is empty), as a scalar
    subquery that is evaluated once, so that no join is needed."""
    packed = facts.select(F.struct(*facts.columns).alias("f")).scalar()
    return df.withColumn("_f", packed).select(*df.columns, *[F.col(f"_f.{c}").alias(c) for c in facts.columns])


def exact_mean(value: Column) -> Column:
    """Mean of doubles that is the same for every order of the rows, so that equal series have equal means.

    Values are summed as decimals of twelve places. Where one is not finite or
    has more than sixteen digits before the point, doubles are summed.
    """
    fixed = value.try_cast("decimal(28,12)")
    total = F.when(F.count(fixed) == F.count(value), F.sum(fixed).cast("double")).otherwise(F.sum(value))
    return total / F.count(value)


def _points(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "bucket", "value")


def _per_series(points: DataFrame, keys: list[str], **facts: Column) -> DataFrame:
    """Each point with facts about its whole series."""
    if keys:
        return points.withColumns({n: c.over(W.partitionBy(*keys)) for n, c in facts.items()})
    return with_single_row(points, points.agg(*[c.alias(n) for n, c in facts.items()]))


def _last_bucket(points: DataFrame, keys: list[str]) -> DataFrame:
    return _per_series(points, keys, last_bucket=F.max("bucket"))


def _current(points: DataFrame, keys: list[str], selected: dt.date | DataFrame) -> DataFrame:
    """Each point with its series' selected bucket and the value there."""
    if isinstance(selected, DataFrame):
        chosen = selected.select(*keys, F.col("bucket").alias("_at"))
        points = points.join(chosen, keys, "left") if keys else with_single_row(points, chosen)
    else:
        points = points.withColumn("_at", F.lit(selected))
    here = F.col("bucket") == F.col("_at")
    return _per_series(
        points, keys,
        current_bucket=F.max(F.when(here, F.col("bucket"))), current_value=F.max(F.when(here, F.col("value"))),
    ).drop("_at")


def _first_with_largest(value: Column) -> Column:
    """The (bucket, value) with the largest `value`; ties go to the first bucket."""
    age = F.datediff(F.lit(dt.date(1900, 1, 1)), F.col("bucket"))
    return F.max_by(F.struct("bucket", "value"), F.struct(value, age))


def _extremes() -> dict[str, Column]:
    return {
        "n": F.count(F.lit(1)), "mean": F.avg("value"), "last_bucket": F.max("bucket"),
        "max_bucket": _first_with_largest(F.col("value"))["bucket"], "max_value": F.max("value"),
        "min_bucket": _first_with_largest(-F.col("value"))["bucket"], "min_value": F.min("value"),
    }


def _trend() -> dict[str, Column]:
    day = F.datediff(F.col("bucket"), F.lit(dt.date(1970, 1, 1))).cast("double")
    slope = F.regr_slope(F.col("value"), day) * DAYS_PER_DECADE
    return {"trend_per_decade": F.when(F.min("bucket") < F.max("bucket"), slope)}


def _recent(last: str = "last_bucket") -> dict[str, Column]:
    inside = F.col("bucket") > F.date_sub(last, RECENT_DAYS)
    return {
        "recent_mean": F.avg(F.when(inside, F.col("value"))),
        "active_hits": F.count_if(inside & (F.col("value") >= 1)),
        "active_of": F.count_if(inside),
    }


def _rank() -> dict[str, Column]:
    return {"rank": F.count_if(F.col("value") > F.col("current_value")) + 1, "of": F.count(F.lit(1))}


def _aggregate(points: DataFrame, by: list[str], parts: dict[str, Column]) -> DataFrame:
    return points.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])


def extremes(series: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, and the first occurrence of the largest and smallest value."""
    return _aggregate(_points(series, keys), keys, _extremes())


def trend_per_decade(series: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares slope on the date; NULL below two points or for one date."""
    return _aggregate(_points(series, keys), keys, _trend())


def recent(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the last 365 days, and how many of its buckets reach a class.

    The window ends at the series' own last bucket, not at today.
    """
    return _aggregate(_last_bucket(_points(series, keys), keys), keys, _recent())


def value_rank(series: DataFrame, keys: list[str], selected: dt.date | DataFrame) -> DataFrame:
    """Rank of the selected bucket's value, largest first, ties sharing the better.

    `selected` is one date, or a table (keys..., bucket). Series without that
    bucket have no row. Counting the larger values needs no ordering.
    """
    points = _current(_points(series, keys), keys, selected).filter(F.col("current_bucket").isNotNull())
    return _aggregate(points, [*keys, "current_bucket", "current_value"], _rank())


def whole_classes(series: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all values are whole, so that they can be named as classes."""
    whole = F.bool_and(F.col("value").isNull() | (F.col("value") == F.floor("value")))
    return series.groupBy(*keys).agg(whole.alias("whole_classes"))


def summarise(
    series: DataFrame, keys: list[str], selected: dt.date | DataFrame | None = None, *, categorical: bool = False
) -> DataFrame:
    """All of the above in one row per series, from one pass over it.

    Lowest bucket, recent mean and trend mean nothing for ordinal classes and
    are NULL there; the count of active buckets takes their place.
    """
    points = _last_bucket(_points(series, keys), keys).withColumnRenamed("last_bucket", "_last")
    parts = {**_extremes(), **_trend(), **_recent("_last")}
    if selected is None:
        out = _aggregate(points, keys, parts).withColumns({
            "current_bucket": F.lit(None).cast("date"), "current_value": F.lit(None).cast("double"),
            "rank": F.lit(None).cast("long"),
        })
    else:
        current = {"current_bucket": F.max("current_bucket"), "current_value": F.max("current_value")}
        rank = F.when(F.max("current_value").isNotNull(), _rank()["rank"])
        out = _aggregate(_current(points, keys, selected), keys, {**parts, **current, "rank": rank})
    unused = ["min_bucket", "min_value", "recent_mean", "trend_per_decade"] if categorical else ["active_hits", "active_of"]
    out = out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in unused})
    return out.withColumn("recent_vs_mean", F.col("recent_mean") - F.col("mean"))


def nearest_bucket(series: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """For each probe (keys..., x) the series bucket nearest in time.

    `x` is a date or timestamp; an exact middle goes to the earlier bucket. All
    probes of one day have the same neighbours, the last bucket up to that day
    and the first one after it. So these are found once per series and day, in
    windows of a year at most, and the probes, however many fall on one day,
    meet them in a plain equi-join that adaptive execution can split.
    """
    asked = probes.withColumn("_day", F.col("x").cast("date"))
    days = asked.select(*keys, F.col("_day").alias("day")).distinct()
    marks = series.select(*keys, F.col("bucket").cast("date").alias("bucket")).distinct()

    cut = [*keys, "yr"]
    days, marks = days.withColumn("yr", F.year("day")), marks.withColumn("yr", F.year("bucket"))
    # per series and year: the outermost buckets, to look across the turn of years
    edge = marks.groupBy(*cut).agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    years = days.select(*cut).distinct().join(edge, cut, "full")
    by_series = W.partitionBy(*keys).orderBy("yr") if keys else W.orderBy("yr")
    years = years.select(
        *cut,
        F.last("last", True).over(by_series.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", True).over(by_series.rowsBetween(1, W.unboundedFollowing)).alias("later"),
    )
    both = days.select(*cut, "day", F.lit(None).cast("date").alias("bucket")).unionByName(
        marks.select(*cut, F.col("bucket").alias("day"), "bucket")
    )
    walk = W.partitionBy(*cut).orderBy("day")
    around = both.groupBy(*cut, "day").agg(F.max("bucket").alias("bucket"))
    around = around.select(
        *cut, "day",
        F.last("bucket", True).over(walk.rowsBetween(W.unboundedPreceding, 0)).alias("prev"),
        F.first("bucket", True).over(walk.rowsBetween(1, W.unboundedFollowing)).alias("next"),
    )
    around = around.join(years, cut).select(
        *keys, F.col("day").alias("_day"),
        F.coalesce("prev", "earlier").alias("prev"), F.coalesce("next", "later").alias("next"),
    )

    # time of day and whole days apart, so that no time zone plays a part
    of_day = (F.hour("x").cast("long") * 3600 + F.minute("x") * 60) * 1_000_000 + (
        F.extract(F.lit("SECOND"), F.col("x").cast("timestamp_ntz")) * 1_000_000
    ).cast("long")
    apart = lambda later, earlier: F.datediff(later, earlier).cast("long") * 86_400_000_000
    closer = apart("next", "_day") - of_day < apart("_day", "prev") + of_day
    best = F.when(F.col("prev").isNull() | closer, F.col("next")).otherwise(F.col("prev"))
    return asked.join(around, [*keys, "_day"]).select(*keys, "x", best.alias("bucket"))
