"""Approximate nearest neighbours by inner product with a forest of hash prefixes.

Rows are dealt into shards of about SHARD_ROWS by a hash of their id. A shard
holds, for each tree, the sorted array of its rows' hash strings, BITS signs of
projections (rows are first given one component more, so that all have the
length of the longest; then inner product and angle agree in order). In such an
array the rows that share a prefix with a query are a range. A query goes down
each tree to its longest prefix match; then all trees go up together, a bit at a
time, until their ranges hold at least `share` times the shard's rows, and
LEAST_CANDIDATES more, counted with repeats. These are compared on the original
vectors. The best of all shards are the answer.

With vectors of no structure, nearest neighbours are hardly nearer than others,
and a high recall takes a large share; with real clusters a small one does. All
rows are in the index, and nothing is cut off but by that rule.

Work and memory of a task are bounded by a shard and a block of queries; the
number of such pairs grows with the product of both tables.

Results in special cases: vectors that are null, zero, or hold a null or
non-finite component take no part, neither do rows without a vec_id. Vectors
meet those of their own width only. Equal scores go to the smaller vec_id. Of
several rows with a query's vec_id the least vector asks, and none of them is
its candidate. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import blocks, directions, matrix, squared_norm, usable

TREES = 64
BITS = 24
SHARE = 1.0
LEAST_CANDIDATES = 1024
SHARD_ROWS = 8192
QUERY_ROWS = 2048
SEED = 11


class Forest:
    """The trees of a shard: hash strings in order, and the rows in that order."""

    def __init__(self, rows: np.ndarray, longest: float):
        self.rows = rows
        lifted = np.column_stack([rows / longest, np.sqrt(np.maximum(0, 1 - (rows * rows).sum(axis=1) / longest**2))])
        strings = self.strings(lifted)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    @staticmethod
    def strings(lifted: np.ndarray) -> np.ndarray:
        """Hash strings as numbers: (trees, rows)."""
        signs = lifted @ directions(TREES * BITS, lifted.shape[1], SEED) > 0
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return (signs.reshape(len(lifted), TREES, BITS) @ weight).T.copy()

    def ranges(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query, the range of each tree's array at the level where the forest holds enough: (trees, queries) twice."""
        lifted = np.column_stack([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros(len(queries))])
        asked = self.strings(lifted)
        low, high = np.zeros_like(asked), np.zeros_like(asked)
        todo = np.arange(len(queries))
        for level in range(BITS, -1, -1):  # prefix length; the deepest level with rows is the longest match
            rest = np.int64(BITS - level)
            first = (asked[:, todo] >> rest) << rest
            for t in range(TREES):
                low[t, todo] = np.searchsorted(self.sorted[t], first[t])
                high[t, todo] = np.searchsorted(self.sorted[t], first[t] + (np.int64(1) << rest))
            enough = (high[:, todo] - low[:, todo]).sum(axis=0) >= min(wanted, TREES * len(self.rows))
            todo = todo[~enough]
            if not len(todo):
                break
        return low, high

    def nearest(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, share: float) -> tuple[np.ndarray, ...]:
        """Query number, row and score of the best k candidates of each query (not those of its own id)."""
        low, high = self.ranges(queries, int(share * len(self.rows)) + LEAST_CANDIDATES)
        out = []
        for q in range(len(queries)):
            marked = np.zeros(len(self.rows), bool)
            for t in range(TREES):
                marked[self.order[t, low[t, q] : high[t, q]]] = True
            found = np.flatnonzero(marked & (ids != own[q]))
            score = self.rows[found] @ queries[q]
            if len(found) > k:
                best = score >= -np.partition(-score, k - 1)[k - 1]
                found, score = found[best], score[best]
            order = np.lexsort((ids[found], -score))[:k]
            out.append((np.full(len(order), q), found[order], score[order]))
        return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def neighbours(rows: DataFrame, queries: DataFrame, k: int, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query; both tables have vec_id and embedding."""
    own = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = own(rows)
    queries = stored(own(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    size = rows.agg(F.max(squared_norm(F.col("embedding"))).alias("n")).first()["n"]
    longest = float(np.sqrt(size)) if size else 1.0
    shards, parts = blocks(rows, SHARD_ROWS), blocks(queries, QUERY_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("embedding").alias("width")
    dealt = rows.select("*", width, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), every(parts).alias("part"))
    asked = queries.select("*", width, every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    key = ["width", "shard", "part"]

    def search(key, rows, queries):
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and queries.num_rows:
            width = key[0].as_py()
            ids, own_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            forest = Forest(matrix(rows.column("embedding"), width), longest)
            q, row, score = forest.nearest(matrix(queries.column("embedding"), width), own_ids, ids, k, share)
            out = [own_ids[q], ids[row], score]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows, rows.where("vec_id % 20 = 0"), 20)
