"""Series and rankings as CSV: fixed decimals, empty fields for gaps, CRLF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import series_quantity, series_units, variable
from ..functions.calendar import bucket_end
from ..functions.wording import fixed
from ..operators.ranking import with_month_names


def value_column(name: str, *, region: bool, mean: bool = False) -> str:
    """`anom_degC`, `mhw_extent_pct`, `mhw`; with `mean`, prefixed accordingly."""
    label = series_quantity(name, region=region) or variable(name).name
    suffix = {"degC": "_degC", "%": "_pct"}.get(series_units(name, region=region), "")
    return f"{'mean_' if mean else ''}{label}{suffix}"


def series_rows(
    series: DataFrame, name: str, period: str, *, region: bool = False, precision: int = 2, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys..., start_date, end_date, <value>): a bucket is written with both its
    days, since its value is not that of the first one."""
    return series.select(
        *keys, F.col("bucket").alias("start_date"), bucket_end("bucket", period).alias("end_date"),
        fixed("value", precision).alias(value_column(name, region=region)),
    )


def ranking_rows(
    ranking: DataFrame, name: str, basis: str = "month", *, region: bool = False, precision: int = 2,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """All twelve months, or the years. Annual rows carry no month columns."""
    if basis not in ("month", "year"):
        raise ValueError(f"unknown basis {basis!r}; expected 'month' or 'year'")
    monthly = basis == "month"
    rows = with_month_names(ranking).filter(F.col("month") > 0 if monthly else F.col("month") == 0)
    return rows.select(
        *keys, *(["month", "month_name"] if monthly else []), "year", "rank",
        fixed("mean", precision).alias(value_column(name, region=region, mean=True)),
        fixed("sd", precision).alias("sd"), F.col("n").alias("days"), F.col("partial").cast("string").alias("partial"),
    )


def write_csv(rows: DataFrame, path: str, order: list[str], *, single: bool = False) -> None:
    """Write sorted. A single file is meant for one series, which has at most a
    row per day; many series are range-partitioned into as many files as fit."""
    if single:
        ordered = rows.repartition(1).sortWithinPartitions(*order)  # what stands above keeps its tasks
    else:
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").csv(path, header=True, lineSep="\r\n", nullValue="", emptyValue="", dateFormat="yyyy-MM-dd")
