"""Index state from the rollups: phase, episode, and the day-of-year normal.

All inputs are rollup-sized, one row per region and day or month. Windows are
partitioned by region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.calendar import days_in_month, doy_gap
from ..functions.wording import EPISODE_SEASONS, INDEX_THRESHOLD, phase, phase_sign, season, strength
from .rollup import region_values
from .stats import exact_mean

# Half-width of the normal's window and its base years.
NORMAL_WINDOW_DAYS = 7
NORMAL_YEARS = (1991, 2020)


def monthly_index(rollup: DataFrame, normals: DataFrame) -> DataFrame:
    """(region, month, anom, n_days): monthly means of the daily region anomaly, the same for every order of the days."""
    return (
        region_values(rollup, normals, "anom")
        .groupBy("region", F.trunc("date", "month").alias("month"))
        .agg(exact_mean(F.col("value")).alias("anom"), F.count(F.lit(1)).alias("n_days"))
    )


def _region():
    return W.partitionBy("region")


def _with_seasons(monthly: DataFrame) -> DataFrame:
    """Monthly rows plus `newest`, `partial`, and the running `index` around them.

    The newest month is left out of the seasons while it is still filling up;
    earlier ones stay as they are, since they will not change any more.
    """
    walk = _region().orderBy("month")
    rows = monthly.withColumns({
        "newest": F.max("month").over(_region()), "partial": F.col("n_days") < days_in_month("month"),
    })
    usable = ~((F.col("month") == F.col("newest")) & F.col("partial"))
    value = F.when(usable, F.col("anom"))
    adjoining = (F.lag("month").over(walk) == F.add_months("month", -1)) & (
        F.lead("month").over(walk) == F.add_months("month", 1)
    )
    three = (F.lag(value).over(walk) + value + F.lead(value).over(walk)) / 3
    return rows.withColumn("index", F.when(adjoining, three))


def running_index(monthly: DataFrame) -> DataFrame:
    """(region, middle, index): means of three consecutive calendar months.

    The three rows must be neighbours in the calendar; across a missing month
    there is no season.
    """
    seasons = _with_seasons(monthly).filter(F.col("index").isNotNull())
    return seasons.select("region", F.col("month").alias("middle"), "index")


def _with_run(rows: DataFrame, middle: str) -> DataFrame:
    """Rows plus the latest season of their region, its sign, and where it began.

    Rows without an index are no seasons and are passed over.
    """
    at = F.when(F.col("index").isNotNull(), F.col(middle))
    rows = rows.withColumns({"season_end": F.max(at).over(_region()), "latest": F.max_by("index", at).over(_region())})
    rows = rows.withColumn("sign", phase_sign("latest"))
    broken = F.col("index") * F.col("sign") < INDEX_THRESHOLD
    return rows.withColumn("last_break", F.max(F.when(broken, F.col(middle))).over(_region())).withColumn(
        "lasting", F.col("index").isNotNull() & (F.col("last_break").isNull() | (F.col(middle) > F.col("last_break")))
    )


def _episode_columns(extra: list[str]) -> list:
    run = F.when(F.col("sign") == 0, F.lit(0).cast("long")).otherwise(F.col("run"))
    return [
        F.col("region"), season("season_end").alias("season"), F.col("season_end"), F.col("latest").alias("index"),
        phase("latest").alias("phase"), F.when(F.col("sign") != 0, strength("latest")).alias("strength"),
        run.alias("seasons"), (run >= EPISODE_SEASONS).alias("episode"), *[F.col(c) for c in extra],
    ]


def episode_run(seasons: DataFrame) -> DataFrame:
    """One row per region: latest season, phase, and how long it has lasted.

    The run counts seasons after the last one that was not past the threshold
    on the latest one's side.
    """
    marked = _with_run(seasons, "middle")
    counted = marked.groupBy("region", "season_end", "latest", "sign").agg(F.count_if("lasting").alias("run"))
    return counted.select(*_episode_columns([]))


def _with_month_rank(monthly: DataFrame) -> DataFrame:
    peers = W.partitionBy("region", F.month("month"))
    return monthly.withColumns({
        "rank": F.rank().over(peers.orderBy(F.col("anom").desc())), "of": F.count(F.lit(1)).over(peers),
    })


def same_month_rank(monthly: DataFrame) -> DataFrame:
    """Every month's place among the same calendar month of all years."""
    partial = (F.col("n_days") < days_in_month("month")).alias("partial")
    return _with_month_rank(monthly).select("region", "month", "anom", "n_days", partial, "rank", "of")


def latest_month(monthly: DataFrame) -> DataFrame:
    newest = F.max("month").over(_region())
    return (
        same_month_rank(monthly).withColumn("newest", newest).filter(F.col("month") == F.col("newest")).drop("newest")
    )


def index_state(rollup: DataFrame, normals: DataFrame) -> DataFrame:
    """Phase and episode per region, with the latest (perhaps partial) month.

    Regions without a season have no row. One pass over the monthly means.
    """
    monthly = monthly_index(rollup, normals)
    rows = _with_run(_with_seasons(_with_month_rank(monthly)), "month")
    newest = F.col("month") == F.col("newest")
    of_newest = {"anom": "latest_value", "n_days": "latest_days", "partial": "latest_partial", "rank": "latest_rank",
                 "of": "latest_of"}
    state = (
        rows.filter(F.col("latest").isNotNull())
        .groupBy("region", "season_end", "latest", "sign", F.col("newest").alias("latest_month"))
        .agg(
            F.count_if("lasting").alias("run"),
            *[F.max(F.when(newest, F.col(c))).alias(name) for c, name in of_newest.items()],
        )
    )
    return state.select(*_episode_columns(["latest_month", *of_newest.values()]))


def extent_state(rollup: DataFrame, years: tuple[int, int] = NORMAL_YEARS) -> DataFrame:
    """Latest extent per region against the mean of the same time of the year.

    The normal takes all days of the base years within seven days of the date's
    day of the year, around the turn of the year; it is NULL without such days.
    """
    whole = W.partitionBy("region")  # a row per day of the archive
    series = region_values(rollup, None, "mhw").select("region", "date", F.col("value").alias("v")).withColumns({
        "last": F.max("date").over(whole), "extent": F.max_by("v", "date").over(whole),
    })
    near = F.year("date").between(*years) & (doy_gap("date", "last") <= NORMAL_WINDOW_DAYS)
    return (
        series.groupBy("region", F.col("last").alias("date"), "extent")
        .agg(
            F.avg(F.when(near, F.col("v"))).alias("normal"),
            (F.count_if(F.col("v") > F.col("extent")) + 1).alias("rank"),
            F.count(F.lit(1)).alias("of"),
        )
        .withColumn("ratio", F.when(F.col("normal") != 0, F.col("extent") / F.col("normal")))
    )
