"""Helpers that the operators of this package share: stored tables, text buffers, hashing, connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text handled at once inside a task


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where everything runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: a lost executor costs nothing that lies before."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else the table holds; a null text is an empty one."""
    return df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remainder(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about `most` bytes of text each (a longer text is a part of its own), with its buffer."""
    for batch in batches:
        data, at = text_buffer(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, stop - row), data[at[row] : at[stop]], at[row : stop + 1] - at[row]
            row = stop


def give_back() -> None:
    """Return memory that is free in this process to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def lean(task: Callable) -> Callable:
    """The function of batches, for mapInArrow; at its end, what it has freed goes back to the machine.

    Spark keeps Python workers for later tasks, of whatever stage, and a worker
    without a task would hold what its largest one took.
    """

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def rows_of_items(counts: np.ndarray) -> np.ndarray:
    """The row of each item, given the number of items of each row."""
    return np.repeat(np.arange(len(counts)), counts)


def sums_by_row(values: np.ndarray, counts: np.ndarray, dtype=None) -> np.ndarray:
    """Sum the items of each row (rows without items give zero)."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype or values.dtype)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=dtype or values.dtype)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finalizer of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined_roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets that pairs (a, b) join; labels[i] is the smallest member known of the set of i, and stays so."""
    while len(a):
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def components(edges: DataFrame) -> DataFrame:
    """Nodes of an undirected graph and the smallest node each can reach: (node, component).

    edges has two columns, a and b, of one type. Each round, every node is
    replaced by its neighbour of least priority (a hash of the node and round, so
    chains stay short) and that node's own choice; edges within a set vanish. The
    number of rounds grows with the logarithm of the nodes. Rounds are stored in
    the shared folder; nothing but counts comes to the driver. Both sides of each
    join are plain shuffles, so that AQE can split a node with very many edges.
    """
    e = edges.select("a", "b").where("a <> b")
    e = stored(e.union(e.select("b", "a")).distinct())
    maps, step = [], 0
    while step == 0 or not e.isEmpty():
        priority = lambda c: F.xxhash64(F.col(c), F.lit(step))  # noqa: B023, E731
        first = e.groupBy("a").agg(F.min(priority("b")).alias("h"))
        held = e.groupBy("a", priority("b").alias("h")).agg(F.min("b").alias("b"))
        choice = F.when(priority("a") < F.col("h"), F.col("a")).otherwise(F.col("b"))
        best = stored(first.join(held, ["a", "h"]).select("a", choice.alias("p")))
        up = best.select(F.col("a").alias("p"), F.col("p").alias("q"))
        best = stored(best.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p")))
        maps.append(best)
        ends = best.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e = stored(e.join(best, "a").join(ends, "b").select(F.col("p").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
        step += 1
    out = maps[0].select(F.col("a").alias("node"), F.col("p"))
    for later in maps[1:]:
        out = out.join(later.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("node", F.coalesce("q", "p").alias("p"))
    out = stored(out)
    least = stored(out.groupBy("p").agg(F.min("node").alias("least")))
    return out.join(least, "p").select("node", F.least("node", "least", "p").alias("component"))
