"""The archive's tables on a shared folder, as plain partitioned parquet.

The daily tables and the climatology are dealt into the same buckets by the
block of 32 x 32 cells that a cell lies in, and sorted by cell within. So joins
and groupings by cell find both sides in place and shuffle nothing, and a point
query opens one bucket of each partition. Partitions are years of the daily
tables (decades before 2024) and months of the climatology, so that a day's load
reads one month of it. The folder holds all there is to know; a session's
catalog is told of the tables when they are first used, so that Spark knows the
buckets.

Replacing days writes their partitions once, beside the table, and renames them
into place. A break at any point leaves the old state or the new one: what has
been written whole is put in place by the next access.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as sc
from ..functions.calendar import part_key, part_of
from ..functions.grid import block_of
from ..operators.events import event_runs, near, renewed_runs
from ..operators.ingest import latest_version, layout_mismatch, replaced_days
from ..operators.ranking import archive_edges
from ..session import checkpoint

DAILY = {"sst": "sst_daily", "mhw": "mhw_daily"}
SCHEMAS = {
    "sst_daily": sc.SST_DAILY, "mhw_daily": sc.MHW_DAILY, "mhw_runs": sc.MHW_RUNS, "sst_clim": sc.SST_CLIM, "region_cells": sc.REGION_CELLS,
    "region_clim": f"{sc.REGION_CLIM}, updated_at timestamp", "region_daily": f"{sc.REGION_DAILY}, updated_at timestamp",
    "region_parts": f"{sc.REGION_PARTS}, updated_at timestamp", "ingest_status": sc.INGEST_STATUS, "picture_list": sc.PICTURE_LIST,
    "stream_ledger": sc.STREAM_LEDGER,
}
KEYS = {
    "region_clim": ["region", "mmdd"], "region_daily": ["region", "date"], "region_parts": ["region", "date", "product"], "ingest_status": ["product", "date"],
}
# Bucketed tables: their partition key, and how rows are sorted within a bucket.
BUCKETED = {
    "sst_daily": ("part", ["block", "gy", "gx", "date"]), "mhw_daily": ("part", ["block", "gy", "gx", "date"]),
    "sst_clim": ("month", ["block", "gy", "gx", "mmdd"]),
    "mhw_runs": ("part", ["block", "gy", "gx", "start"]),  # the part of the run's last day
}
# Of a new archive. A year of the whole Pacific is some 3 * 10^9 rows and wants about a thousand.
BUCKETS = 16
REBUILD_DAYS = 400  # new days from which event runs are built anew


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a table, in order and type. ANSI casts reject overflow."""
    fields = [part.strip().rsplit(" ", 1) for part in ddl.split(",")]
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


class Store:
    """An archive under `root`. `buckets` is for a new one; one that exists knows its own."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._wanted = spark, root.rstrip("/"), buckets

    @cached_property
    def buckets(self) -> int:
        if not self.exists("_layout"):
            self.spark.createDataFrame([(self._wanted,)], "buckets int").coalesce(1).write.parquet(self.path("_layout"))
        return self.spark.read.schema("buckets int").parquet(self.path("_layout")).first()["buckets"]

    # ------------------------------------------------------------------ paths

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, table: str) -> bool:
        fs, p = self._fs(self.path(table))
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        if fs.exists(p):
            fs.delete(p, True)

    def _rename(self, source: str, target: str) -> None:
        fs, p = self._fs(source)
        if not fs.rename(p, self._fs(target)[1]):
            raise OSError(f"cannot move {source} to {target}")

    def _names(self, path: str) -> list[str]:
        """What a folder holds; nothing, if there is none."""
        fs, p = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _partitions(self, path: str, key: str) -> list[str]:
        return [n for n in self._names(path) if n.startswith(f"{key}=")]

    def _swap(self, staged: str, table: str) -> None:
        """Put a staged table in place. The old one is moved aside first, so that
        at every moment both states still exist somewhere under the root."""
        aside = self._staging(f"{table}-old")
        if self.exists(table):
            self._rename(self.path(table), aside)
        self._rename(staged, self.path(table))
        self._delete(aside)

    def _staging(self, table: str) -> str:
        return f"{self.root}/_staging/{table}-{uuid.uuid4().hex}"

    # ------------------------------------------------------------------ reads

    def read(self, table: str) -> DataFrame:
        if table in BUCKETED:
            self._recover(table)
        ddl = SCHEMAS[table] + (f", block int, {BUCKETED[table][0]} int" if table in BUCKETED else "")
        if not self.exists(table):
            return self.spark.createDataFrame([], ddl)
        if table in BUCKETED:
            return self.spark.table(self._in_catalog(table))
        return self.spark.read.schema(ddl).parquet(self.path(table))

    def _create(self, name: str, table: str, path: str) -> None:
        key, order = BUCKETED[table]
        self.spark.sql(
            f"create table {name} ({SCHEMAS[table]}, block int, {key} int) using parquet partitioned by ({key})"
            f" clustered by (block) sorted by ({', '.join(order)}) into {self.buckets} buckets location '{path}'"
        )

    def _in_catalog(self, table: str) -> str:
        """The table's name in this session's catalog, with the partitions that the folder has now."""
        name = f"tidegrid_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{table}"
        if not self.spark.catalog.tableExists(name):
            self._create(name, table, self.path(table))
        known = [r.partition for r in self.spark.sql(f"show partitions {name}").collect()]  # a few dozen
        if sorted(known) != self._partitions(self.path(table), BUCKETED[table][0]):
            self.spark.sql(f"msck repair table {name} sync partitions")
        self.spark.catalog.refreshTable(name)
        return name

    def days(self, product: str, dates: list[dt.date]) -> DataFrame:
        """Some days of a product; only their partitions are read."""
        rows = self.read(DAILY[product])
        return rows.filter(F.col("part").isin(sorted({part_of(d) for d in dates})) & F.col("date").isin(dates))

    def latest(self, table: str) -> DataFrame:
        """Newest version of each row of a versioned table (of a rollup, only dates that have cells)."""
        rows = latest_version(self.read(table), KEYS[table], ["updated_at"])
        return rows.filter("n_cells > 0") if table == "region_daily" else rows

    def status(self) -> DataFrame:
        return self.latest("ingest_status")

    def loaded_days(self, product: str) -> DataFrame:
        """(date) with rows, off the status table instead of the facts."""
        done = (F.col("product") == product) & (F.col("status") == sc.SUCCESS) & (F.col("n_rows") > 0)
        return self.status().filter(done).select("date")

    def edges(self) -> DataFrame:
        """First and last day of the temperatures, for rankings."""
        return archive_edges(self.loaded_days("sst"))

    def archive(self) -> sc.Archive:
        return sc.Archive(self.read("sst_daily"), self.read("sst_clim"), self.read("mhw_daily"))

    # ----------------------------------------------------------------- writes

    def _write_bucketed(self, table: str, rows: DataFrame, path: str) -> None:
        """Add rows to a table's files at a path: one file for each partition and bucket that they touch."""
        key, order = BUCKETED[table]
        columns = [part.strip().rsplit(" ", 1)[0] for part in SCHEMAS[table].split(",")]
        value = F.expr("mmdd div 100").cast("int") if key == "month" else part_key("end" if table == "mhw_runs" else "date")
        keyed = conform(rows, SCHEMAS[table]).select(*columns, block_of().alias("block"), value.alias(key))
        name = f"tidegrid_write_{uuid.uuid4().hex}"
        self._create(name, table, path)
        try:
            # dealt like the buckets, so that a task holds whole ones
            keyed.repartition(self.buckets, "block").sortWithinPartitions(key, *order).write.insertInto(name)
        finally:
            self.spark.sql(f"drop table {name}")  # the files stay

    def _put_in_place(self, staged: str, table: str, partitions: list[str]) -> None:
        """Replace partitions by staged ones; those not staged end up empty."""
        for p in partitions:
            mine = f"{self.root}/_swap/{table}/{p}"
            fs, folder = self._fs(mine)
            fs.mkdirs(folder)
            if p in self._names(staged):
                self._rename(f"{staged}/{p}", f"{mine}/new")
            else:
                fs.mkdirs(self._fs(f"{mine}/none")[1])
            self._finish(table, p)
        self._delete(staged)

    def _finish(self, table: str, partition: str) -> None:
        """Bring a replacement to its end, from wherever it was broken off."""
        mine, place = f"{self.root}/_swap/{table}/{partition}", f"{self.path(table)}/{partition}"
        has = self._names(mine)
        if ("new" in has or "none" in has) and "old" not in has and partition in self._names(self.path(table)):
            self._rename(place, f"{mine}/old")
        if "new" in has:
            fs, folder = self._fs(self.path(table))
            fs.mkdirs(folder)
            self._rename(f"{mine}/new", place)
        self._delete(mine)

    def _recover(self, table: str) -> None:
        for p in self._names(f"{self.root}/_swap/{table}"):
            self._finish(table, p)

    def append_days(self, product: str, rows: DataFrame) -> None:
        """Add days the table does not hold yet."""
        table = DAILY[product]
        self._recover(table)
        self._write_bucketed(table, rows, self.path(table))

    def replace_days(self, product: str, rows: DataFrame, dates: list[dt.date]) -> None:
        """Replace days. Only the partitions they lie in are read, and written once.

        Repeating the call after an interruption gives the same table.
        """
        table = DAILY[product]
        parts = sorted({part_of(d) for d in dates})
        days = self.spark.createDataFrame([(d,) for d in dates], "date date")
        existing = self.read(table).filter(F.col("part").isin(parts))
        self._rewrite(table, replaced_days(existing.drop("block", "part"), conform(rows, SCHEMAS[table]), days), parts)

    def _rewrite(self, table: str, rows: DataFrame, parts: list[int]) -> None:
        staged = self._staging(table)
        self._write_bucketed(table, rows, staged)
        self._put_in_place(staged, table, [f"part={p}" for p in parts])

    def recluster(self, product: str, parts: list[int]) -> None:
        """Write some partitions again, with one file for each bucket."""
        table = DAILY[product]
        self._rewrite(table, self.read(table).filter(F.col("part").isin(parts)), parts)

    def files(self, table: str, part: int) -> int:
        """Data files of a partition, from the folder's listing."""
        return sum(n.endswith(".parquet") for n in self._names(f"{self.path(table)}/{BUCKETED[table][0]}={part}"))

    def merge_files(self, product: str, dates: list[dt.date], most: int = 1) -> list[int]:
        """Merge the files of the partitions that these dates lie in, where a bucket has more than `most` of them
        (on average of the buckets in use); returns those partitions. Others are not touched."""
        table = DAILY[product]
        many = []
        for part in sorted({part_of(d) for d in dates}):
            names = [n for n in self._names(f"{self.path(table)}/part={part}") if n.endswith(".parquet")]
            used = {n.rsplit("_", 1)[1].split(".")[0] for n in names}  # a file's name ends with its bucket
            if len(names) > most * len(used):
                many.append(part)
        for part in many:
            self.recluster(product, [part])
        return many

    def update_runs(self, dates: list[dt.date]) -> None:
        """Bring the stored event runs up to date after days of the classes were loaded or replaced.

        Reads these days and the runs beside them, and rewrites the partitions
        that hold or held such a run. The first call builds all runs, as does
        one after so many days that taking runs apart would not pay.
        """
        table = "mhw_runs"
        if not self.exists(table) or len(dates) > REBUILD_DAYS:
            staged = self._staging(table)
            self._write_bucketed(table, event_runs(self.read("mhw_daily"), classes=True), staged)
            if self._names(staged):
                self._swap(staged, table)
            return
        if not dates:
            return
        # a run near these dates ends on the day before the first of them at the earliest
        runs = self.read(table).filter(F.col("part") >= part_of(min(dates) - dt.timedelta(days=1)))
        stay, new = renewed_runs(runs, self.days("mhw", dates), dates)
        new = checkpoint(new)
        touched = runs.filter(near(dates)).select("part").union(new.select(part_key("end"))).distinct()
        parts = sorted(r.part for r in touched.collect())  # a few
        if parts:
            stay = stay.filter(F.col("part").isin(parts)).select(*new.columns)
            self._rewrite(table, stay.unionByName(new), parts)

    def append(self, table: str, rows: DataFrame) -> None:
        conform(rows, SCHEMAS[table]).write.mode("append").parquet(self.path(table))

    def append_climatology(self, rows: DataFrame) -> None:
        self._write_bucketed("sst_clim", rows, self.path("sst_clim"))

    def replace_climatology(self, rows: DataFrame) -> None:
        """Swap in a new climatology that may have been computed from the old one."""
        staged = self._staging("sst_clim")
        self._write_bucketed("sst_clim", rows, staged)
        self._swap(staged, "sst_clim")

    def overwrite(self, table: str, rows: DataFrame) -> None:
        """Swap in a new state that may have been computed from the old one."""
        staged = self._staging(table)
        conform(rows, SCHEMAS[table]).write.mode("overwrite").parquet(staged)
        self._swap(staged, table)

    def compact(self, table: str) -> None:
        """Drop superseded versions."""
        self.overwrite(table, self.latest(table))

    def drop_regions(self, table: str, regions: list[str] | None = None) -> None:
        """Empty a region table, or remove some regions from it."""
        if regions is None:
            self._delete(self.path(table))
        elif self.exists(table):
            self.overwrite(table, self.read(table).filter(~F.col("region").isin(regions)))

    def set_region_cells(self, cells: DataFrame, regions: list[str]) -> None:
        """Put these in place of all cells of the listed regions (of some, that may be none)."""
        kept = self.read("region_cells").filter(~F.col("region").isin(regions))
        self.overwrite("region_cells", kept.unionByName(conform(cells, SCHEMAS["region_cells"])))

    def reset(self, products: list[str]) -> None:
        """Forget products before a fresh load. The status goes first: if this breaks off, days
        are loaded again that are still there, and none is taken for loaded that is not."""
        if self.exists("ingest_status"):
            self.overwrite("ingest_status", self.read("ingest_status").filter(~F.col("product").isin(products)))
        for p in products:
            self._delete(self.path(DAILY[p]))
        if "mhw" in products:
            self._delete(self.path("mhw_runs"))

    def rewrite_layout(self, table: str, source: str) -> None:
        """Bring a daily table at `source`, in whatever layout, onto this one's.

        The rows are counted per year on both sides before the swap; any
        difference leaves the present table untouched.
        """
        old = conform(self.spark.read.parquet(source), SCHEMAS[table])
        staged = self._staging(table)
        self._write_bucketed(table, old, staged)
        self.verify_copy(old, self.spark.read.parquet(staged), table)
        self._swap(staged, table)

    @staticmethod
    def verify_copy(old: DataFrame, new: DataFrame, table: str) -> None:
        bad = layout_mismatch(old, new).orderBy("year").collect()  # one row per year at most
        if bad:
            raise ValueError(f"{table}: rows differ in {[(r.year, r.old_rows, r.new_rows) for r in bad]}")
