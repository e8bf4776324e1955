"""Table schemas, and the bundle of tables that the operators read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SST_DAILY = "date date, gy int, gx int, sst_raw smallint, has_clim boolean"
SST_CLIM = "mmdd int, gy int, gx int, clim_raw smallint"
MHW_DAILY = "date date, gy int, gx int, cat tinyint"
# Runs of event days by cell, with the class of each day.
MHW_RUNS = "gy int, gx int, start date, end date, days bigint, peak int, classes array<int>"
REGION_CELLS = "region string, gy int, gx int"
REGION_CLIM = "region string, mmdd int, mean_clim double, n_cells bigint"
REGION_DAILY = (
    "region string, date date, mean_sst double, n_cells bigint, mean_sst_clim double, n_cells_clim bigint,"
    " mean_mhw double, mhw_area_frac double, n_cells_mhw bigint"
)
# Additive: rows of the same region, date and product add up. Sums of weighted counts and of weights are in units of
# 2^-46, each as a high and a low part (functions/grid.weight_units).
REGION_PARTS = (
    "region string, date date, product string, total_hi bigint, total_lo bigint, area_hi bigint, area_lo bigint, n_cells bigint,"
    " clim_total_hi bigint, clim_total_lo bigint, clim_area_hi bigint, clim_area_lo bigint, n_cells_clim bigint"
)
INGEST_STATUS = (
    "product string, date date, filename string, status string, n_rows bigint, file_size bigint,"
    " source_url string, remote_size bigint, remote_modified string, message string, updated_at timestamp"
)
# One row for each time a picture was written.
PICTURE_LIST = "variable string, period string, bucket date"
# One row for each micro-batch of a stream that has taken effect.
STREAM_LEDGER = "stream string, epoch bigint, updated_at timestamp"
# Full-grid source file, one row per grid row.
GRID_ROWS = "date date, row int, values array<smallint>"

PENDING_DOWNLOAD = "pending_download"
DOWNLOADING = "downloading"
SUCCESS_DOWNLOAD = "success_download"
FAILED_DOWNLOAD = "failed_download"
INGESTING = "ingesting"
SUCCESS = "success_ingest"
FAILED = "failed_ingest"


@dataclass(frozen=True)
class Archive:
    """The three fact tables. Keys are unique: `(date, gy, gx)` in the two daily
    tables and `(mmdd, gy, gx)` in the climatology, so one cell never holds more
    rows than there are days (or 366 climatology rows)."""

    sst: DataFrame
    clim: DataFrame | None = None
    mhw: DataFrame | None = None
