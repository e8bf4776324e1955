"""Near duplicates among embeddings by counting collisions of projections.

Equal vectors of a label are one class with a weight. Classes of a label that
may be near meet in blocks: cells of their first projection, wide enough that
a linked pair lies in one cell or two that follow each other, dealt into parts
of about BLOCK_ROWS, every two of which are a task. In a block, each further
projection is sorted and every vector's window looked up in it; the collisions
are counted by pair, and pairs with enough of them are compared by cosine. The
windows and the count are calibrated so that a pair just at the threshold is
missed with a chance of MISS at most.

Projections of one dimension cannot tell unrelated vectors apart one by one, so
the pairs looked at grow with the square of a label's classes (by a constant
that cells and windows lower), in blocks of bounded size.

A block gives the number of links of each class and a spanning forest of its
links, so copies are never expanded into pairs.

Results in special cases: vectors that are null, zero, or hold a null or
non-finite component, and those without a label, link with nothing and keep to
themselves, and so does a row without a vec_id (component null, not kept).
Repeated rows are vectors of one id that link with each other. Vectors meet
those of their own width only. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, joined_roots, rows_of_items, stored
from .vectors import directions, matrix, usable

THRESHOLD = 0.98
PROJECTIONS = 24
WINDOW = 2.0  # half a window, in standard deviations of a pair at the threshold
INSIDE = 0.9545  # chance that such a pair is inside
CELL = 5.0  # width of a cell of the first projection, likewise
MISS = 1e-6
BLOCK_ROWS = 1024
SEED = 5


def least_count() -> int:
    """The largest count that a pair at the threshold falls short of with a chance of MISS at most."""
    chance = 0.0
    for k in range(PROJECTIONS + 1):
        chance += comb(PROJECTIONS, k) * INSIDE**k * (1 - INSIDE) ** (PROJECTIONS - k)
        if chance > MISS:
            return k
    return PROJECTIONS


def deviation(threshold: float, width: int) -> float:
    """Standard deviation of a projection's difference for unit vectors with this cosine."""
    return float(np.sqrt(2 * (1 - threshold) / width))


def collision_counts(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """How many projections (columns) have row i of a and row j of b within half of each other."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    flat = counts.reshape(-1)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        low, high = np.searchsorted(line, a[:, k] - half), np.searchsorted(line, a[:, k] + half, "right")
        sizes = high - low
        row = rows_of_items(sizes)
        place = np.arange(len(row)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        flat[row * len(b) + order[place]] += 1  # a pair comes once in a projection
    return counts


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two blocks of vectors whose cosine reaches the threshold."""
    unit_a, unit_b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    lines = directions(PROJECTIONS + 1, a.shape[1], SEED)[:, 1:]
    counts = collision_counts(unit_a @ lines, unit_b @ lines, WINDOW * deviation(threshold, a.shape[1]))
    i, j = np.nonzero(counts >= least_count())
    near = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        own = slice(k, k + (1 << 16))
        near[own] = (unit_a[i[own]] * unit_b[j[own]]).sum(axis=1) >= threshold
    return i[near], j[near]


def in_cells(classes: DataFrame, threshold: float) -> DataFrame:
    """Classes with their cell of the first projection."""
    schema = "node long, weight long, label_key long, width int, cell long, vector array<double>"

    def place(batches):
        for batch in batches:
            width, vectors = batch.column("width").to_numpy(), batch.column("vector")
            cell = np.zeros(len(width), np.int64)
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                rows = matrix(vectors.take(pa.array(own)), int(w))
                first = (rows / np.linalg.norm(rows, axis=1)[:, None]) @ directions(PROJECTIONS + 1, int(w), SEED)[:, 0]
                cell[own] = np.floor(first / (CELL * deviation(threshold, int(w))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "weight", "label_key", "width")), pa.array(cell), vectors], [f.split()[0] for f in schema.split(", ")])

    return classes.mapInArrow(place, schema)


def block_links(cells: DataFrame, threshold: float) -> DataFrame:
    """From all blocks: rows (a, null, n) with n links of class a, and rows (a, b, null) for the edges of spanning forests."""
    group = ["label_key", "width", "cell"]
    parts = stored(cells.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")))
    shifted = lambda by, name: parts.select("label_key", "width", (F.col("cell") + by).alias("cell"), F.col("parts").alias(name))
    around = parts.join(shifted(1, "before"), group, "left").join(shifted(-1, "after"), group, "left")
    rows = cells.join(stored(around), group).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda cell, kind, i, j, side: F.struct(cell.alias("at"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    own, cell = F.col("own"), F.col("cell")
    within = F.transform(upto(F.col("parts")), lambda j: block(cell, 0, F.least(own, j), F.greatest(own, j), F.when(own <= j, 0).otherwise(1)))
    right = F.transform(upto(F.col("after")), lambda j: block(cell, 1, own, j, 0))
    left = F.transform(upto(F.col("before")), lambda i: block(cell - 1, 1, i, own, 1))
    dealt = rows.select("node", "weight", "vector", "label_key", "width", F.explode(F.concat(within, right, left)).alias("k")).select("*", "k.*").drop("k")

    def link(key, table):
        width, self_ = key[1].as_py(), key[3].as_py() == 0 and key[4] == key[5]
        node, weight, side = (table.column(c).to_numpy() for c in ("node", "weight", "side"))
        vectors = matrix(table.column("vector"), width)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if self_:
            second = first
        empty = np.zeros(0, np.int64)
        i, j = linked_pairs(vectors[first], vectors[second], threshold) if len(first) and len(second) else (empty, empty)
        i, j = first[i], second[j]
        if self_:
            i, j = i[i != j], j[i != j]
        links = np.bincount(i, weights=weight[j], minlength=len(node))
        if not self_:
            links += np.bincount(j, weights=weight[i], minlength=len(node))
        labels = joined_roots(np.arange(len(node)), i, j)
        linked, child = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(node)))
        a = np.concatenate([node[linked], node[child]])
        b = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(node[labels[child]], pa.int64())])
        n = pa.concat_arrays([pa.array(links[linked].astype(np.int64)), pa.nulls(len(child), pa.int64())])
        return pa.table([pa.array(a, pa.int64()), b, n], ["a", "b", "n"])

    return dealt.groupBy("label_key", "width", "at", "kind", "i", "j").applyInArrow(link, "a long, b long, n long")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = rows.withColumn("node", F.when(takes_part, F.xxhash64("label", "embedding")))
    whole = F.transform("embedding", lambda x: x.cast("double"))
    classes = rows.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.min(F.xxhash64("label")).alias("label_key"), F.min(whole).alias("vector"))
    classes = stored(classes.withColumn("width", F.size("vector")))
    links = stored(block_links(in_cells(classes, threshold), threshold))
    reach = components(links.where("b is not null").select("a", "b"))
    named = classes.select("node", "weight", "least").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named)
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")))
    sums = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    named = stored(named.join(least, "component").join(sums, "node", "left").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    out = rows.select("vec_id", "node").join(named, "node", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op4_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked within a label at a cosine of 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
