"""Years ranked within each calendar month, and within the whole year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.calendar import days_in_month, days_in_year
from ..functions.wording import month_name, partial_note
from .stats import exact_mean, with_single_row


def archive_edges(daily: DataFrame) -> DataFrame:
    """One row: first and last day of the archive, NULL when it is empty."""
    return daily.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def ranked_periods(
    series: DataFrame, edges: DataFrame, keys: list[str] | None = None, *, scale: float | None = None, top: int = 10
) -> DataFrame:
    """(keys..., month, year, mean, sd, n, rank, partial, is_top).

    `series` is (keys..., date, value). Month 0 stands for the whole year, whose
    mean is that of its days. Both groupings come off one scan. With `scale`
    the values are integer counts, summed exactly and scaled once; without it,
    means do not depend on the order of the days (stats.exact_mean). Warmest
    first; equal means are ordered by year. `top` marks rows and drops none.

    Only the archive's two edge periods can be partial. A missing day inside is
    not going to change any more and does not count.
    """
    keys = keys or []
    dated = series.select(
        *keys, F.month("date").alias("month"), F.year("date").alias("year"), F.col("value").alias("v")
    ).filter(F.col("v").isNotNull())
    factor = F.lit(1.0 if scale is None else scale)
    counted = F.sum(F.col("v").cast("long")).cast("double") / F.count(F.lit(1)) * factor
    by_month, by_year = [*keys, "month", "year"], [*keys, "year"]
    means = (
        dated.groupingSets(
            [[F.col(c) for c in by_month], [F.col(c) for c in by_year]], *[F.col(c) for c in by_month]
        )
        .agg(
            F.grouping("month").alias("whole_year"),
            (exact_mean(F.col("v").cast("double")) if scale is None else counted).alias("mean"),
            (F.stddev_samp("v") * factor).alias("sd"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("month", F.when(F.col("whole_year") == 1, 0).otherwise(F.col("month")))
        .drop("whole_year")
    )
    within = W.partitionBy(*keys, "month").orderBy(F.col("mean").desc(), F.col("year"))
    first, last = F.col("first_day"), F.col("last_day")
    same_year = lambda d: F.col("year") == F.year(d)
    same_month = lambda d: same_year(d) & (F.col("month") == F.month(d))
    partial = F.when(
        F.col("month") == 0,
        (same_year(first) & (F.dayofyear(first) > 1)) | (same_year(last) & (F.dayofyear(last) < days_in_year(last))),
    ).otherwise(
        (same_month(first) & (F.day(first) > 1)) | (same_month(last) & (F.day(last) < days_in_month(last)))
    )
    ranked = means.withColumn("rank", F.row_number().over(within))
    return (
        with_single_row(ranked, edges)
        .withColumn("partial", F.coalesce(partial, F.lit(False)))
        .withColumn("is_top", F.col("rank") <= top)
        .select(*keys, "month", "year", "mean", "sd", "n", "rank", "partial", "is_top")
    )


def ranking_span(edges: DataFrame) -> DataFrame:
    """First of the first month, end of the last month, and the last day itself."""
    return edges.select(
        F.trunc("first_day", "month").alias("span_start"), F.last_day("last_day").alias("span_end"),
        F.col("last_day").alias("through"),
    )


def partial_notes(ranking: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The caveat for every partial row."""
    return ranking.filter("partial").select(
        *(keys or []), "month", "year", partial_note("month", "year", "n").alias("note")
    )


def with_month_names(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("month_name", F.when(F.col("month") > 0, month_name(F.greatest("month", F.lit(1)))))
