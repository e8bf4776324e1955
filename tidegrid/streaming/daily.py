"""The daily run as a stream of arriving day files.

One decoded parquet file per product and day lands in `<landing>/<product>`.
Each micro-batch loads the days it contains, refreshes the rollup for just
those, redraws the pictures of their weeks and months, open ones included, and
is then noted in the store's ledger. A batch that is replayed after that is
skipped; one that broke off before is loaded again, which replaces the same days
and appends the same rollup rows in a newer version. So each batch has its
effect once, and no state store is needed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..domain import GLOBAL, PACIFIC, Box, Grid, Region, Subset
from ..plans.daily import process_days
from ..plans.pictures import redraw
from ..schema import GRID_ROWS
from ..session import checkpoint
from ..sources.store import Store

FILE_ROWS = {"sst": GRID_ROWS, "mhw": f"{GRID_ROWS}, mask array<tinyint>"}


def day_files(store: Store, landing: str, product: str, per_batch: int) -> DataFrame:
    """Streaming rows of a product's day files, each with its file's facts."""
    source = store.spark.readStream.schema(FILE_ROWS[product]).option("maxFilesPerTrigger", per_batch)
    return source.parquet(f"{landing}/{product}").select(
        "*",
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("size"),
        F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"),
    )


def loader(
    store: Store, product: str, box: Box, name: str, *, regions: dict[str, Region] | None = None, grid: Grid = GLOBAL,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC), width: int = 0, subset: Subset = PACIFIC,
) -> Callable[[DataFrame, int], None]:
    """What a stream of this name does with a micro-batch: load it, unless the ledger has it. No width: no pictures."""

    def load(batch: DataFrame, epoch: int) -> None:
        inner = Store(batch.sparkSession, store.root)
        if not inner.read("stream_ledger").filter((F.col("stream") == name) & (F.col("epoch") == epoch)).isEmpty():
            return
        batch = batch.persist()  # read once; spills to disk, and is read again if lost
        files = batch.groupBy("date").agg(
            F.max("filename").alias("filename"), F.max("size").alias("size"), F.max("modified").alias("modified")
        ).withColumn("product", F.lit(product))
        rows = batch.drop("filename", "size", "modified")
        # a file only arrives again if it was revised
        done = checkpoint(process_days(inner, {product: (rows, files)}, clock(), box, regions=regions, force=True, grid=grid))
        batch.unpersist()
        if width:
            redraw(inner, done, width, subset=subset, grid=grid)
        note = batch.sparkSession.createDataFrame([(name, epoch, clock())], "stream string, epoch bigint, updated_at timestamp")
        inner.append("stream_ledger", note)

    return load


def start(
    store: Store, landing: str, product: str, box: Box, checkpoint_folder: str, *, files_per_batch: int = 30, **how,
) -> StreamingQuery:
    """Load everything that has arrived for one product, then stop.

    Start the temperatures first: the land repair of a category day reads them.
    `how` is as for `loader`. The stream's name in the ledger is its checkpoint's.
    """
    stream = day_files(store, landing, product, files_per_batch)
    load = loader(store, product, box, f"{product} {checkpoint_folder}", **how)
    return (
        stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()
    )
