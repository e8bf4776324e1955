"""Codes of vectors: eight codebooks of sixteen entries, fitted by Lloyd rounds over cover trees.

Components become integers, floor(4096 x), and a vector is cut into eight equal
parts. Each task builds, for blocks of its rows and for each part, a cover tree:
a node's points lie within its radius of the node's point, children are spread
more than half a power of two apart, and the node's own point is the first of
its children. Points are kept in the order of the tree, so that a subtree is a
range and its sum the difference of two cumulative sums. Trees are written once;
each round reads them and walks down: where the nearest entry is nearer than any
other by more than twice the radius, the triangle inequality gives it the whole
subtree; only nodes for which that is open descend, and points in leaves are
compared one by one. Sums by (part, entry) are added up in Spark; the driver
holds nothing but the codebooks, 16 vectors.

All comparisons are exact: squared distances are whole numbers below 2^53 in
doubles, or Python integers where components are too large for that; bounds
with roots carry a margin, and what they leave open descends.

Results in special cases: rows whose vector is null or holds a null or
non-finite component are left out. Vectors shorter than the longest, or of a
length that eight does not divide, count as followed by zeros. With fewer than
16 rows, each is an entry. A null vec_id comes after all others, rows of the
same vec_id are rows of their own, ordered by their vectors. Vectors all alike
are one point of a tree. An error beyond a long is given as the largest long.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 4096  # rows under one tree, less for wide vectors:
BLOCK_COMPONENTS = 1 << 20
LEAF_POINTS = 32
CENTRES = 32  # points looked at together as centres of a node's children
SALTS = 16  # parts that the rows of a label are dealt to when its error is given back
MOST_EXACT = 1 << 53
MOST_LONG = (1 << 63) - 1
TREES = "vec_id array<long>, label array<long>, wide boolean, orders array<binary>, points array<binary>, nodes array<binary>, radii array<binary>"
SUMS = "part int, entry int, count long, sums array<string>"
CODES = "vec_id long, label long, code string, error string"


def kept(df: DataFrame) -> DataFrame:
    """Rows with a usable vector: vec_id, label, vector (doubles)."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    return rows.where(F.col("vector").isNotNull()).where(fine)


def exact_below(width: int) -> float:
    """Components below this have squared distances that doubles hold exactly."""
    return (MOST_EXACT / (16 * width)) ** 0.5


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(4096 x) of lists of doubles as rows of a matrix: doubles, or Python integers where these are too large."""
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(counts), width), np.float64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    if len(flat) and np.abs(flat).max() >= exact_below(width // PARTS) / SCALE:
        return np.array([[int(np.floor(x)) * SCALE + int(np.floor((x - np.floor(x)) * SCALE)) for x in r] for r in out], object).reshape(out.shape)
    return np.floor(out * SCALE)


def places(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of ranges, end to end."""
    return np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def nearest(squares: np.ndarray) -> np.ndarray:
    """The least column of each row, the first of equal ones."""
    return squares.argmin(1) if squares.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in squares], np.int64)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by entries: in doubles all sums are whole numbers below 2^53."""
    if points.dtype == object or entries.dtype == object:
        points, entries = points.astype(object), entries.astype(object)
        return np.array([[sum(d * d for d in p - e) for e in entries] for p in points], object).reshape(len(points), len(entries))
    return (points**2).sum(1)[:, None] - 2 * (points @ entries.T) + (entries**2).sum(1)


@dataclass
class Tree:
    """Nodes are rows (from, to, first child, number of children); a node's point is the first of its range.

    order gives the row of each point in the tree's order.
    """

    order: np.ndarray
    points: np.ndarray
    nodes: np.ndarray
    radii: np.ndarray


def spread_out(points: np.ndarray, least: float) -> list[int]:
    """Of a few points, the first and each that is more than the (squared) distance from those taken before."""
    apart = squared_distances(points, points) > least
    taken = [0]
    for k in range(1, len(points)):
        if apart[k, taken].all():
            taken.append(k)
    return taken


def cover_tree(points: np.ndarray) -> Tree:
    """A cover tree of at least one point; Python integers make one leaf, so that no bound is needed for them."""
    order = np.arange(len(points))
    nodes, radii = [[0, len(points), 0, 0]], [float("inf")]
    at = 0 if points.dtype != object else 1
    while at < len(nodes):  # nodes are made level by level, the children of one side by side
        start, stop = nodes[at][:2]
        inside = order[start:stop]
        far = np.sqrt(((points[inside] - points[inside[0]]) ** 2).sum(1)).max()
        radii[at] = float(far) * (1 + 1e-9)
        if stop - start > LEAF_POINTS and far > 0:
            spread = 2.0 ** (np.ceil(np.log2(far)) - 1)
            first, left, there, groups = len(nodes), inside, points[inside], []
            while len(left):
                centres = there[spread_out(there[:CENTRES], spread * spread)]
                apart = squared_distances(there, centres)
                mine = apart.argmin(1)
                apart = apart[np.arange(len(left)), mine]
                close = np.flatnonzero(apart <= spread * spread)
                groups.append(left[close[np.lexsort((apart[close], mine[close]))]])  # each centre before the others it covers
                for size in np.bincount(mine[close], minlength=len(centres)):
                    nodes.append([start, start + int(size), 0, 0])
                    radii.append(0.0)
                    start += int(size)
                left, there = np.delete(left, close), np.delete(there, close, axis=0)
            order[nodes[at][0] : stop] = np.concatenate(groups)
            nodes[at][2:] = [first, len(nodes) - first]
        at += 1
    return Tree(order.astype(np.int32), points[order], np.array(nodes, np.int32), np.array(radii))


def assigned(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges (from, to, entry) of the tree's order that the entry is nearest to; every point is in one range."""
    front = np.zeros(1, np.int64)
    while len(front):
        node, radius = tree.nodes[front], tree.radii[front]
        squares = squared_distances(tree.points[node[:, 0]], entries)
        best, sure = nearest(squares), radius == 0
        if squares.dtype != object:
            far = np.sqrt(squares)
            low = far[np.arange(len(front)), best]
            far[np.arange(len(front)), best] = np.inf
            sure |= (low + 2 * radius) * (1 + 1e-9) < far.min(1)
        yield node[sure, 0], node[sure, 1], best[sure]
        open_ = node[~sure]
        leaves, inner = open_[open_[:, 3] == 0], open_[open_[:, 3] > 0]
        if len(leaves):
            place = places(leaves[:, 0], leaves[:, 1] - leaves[:, 0])
            yield place, place + 1, nearest(squared_distances(tree.points[place], entries))
        front = places(inner[:, 2], inner[:, 3])


def _packed(points: np.ndarray) -> bytes:
    """Whole numbers as bytes: digits where they are Python integers."""
    if points.dtype == object:
        return "\n".join(str(int(x)) for x in points.ravel()).encode()
    return points.astype(np.int32).tobytes()


def _unpacked(data: bytes, wide: bool, n: int) -> np.ndarray:
    if wide:
        return np.array([int(x) for x in data.decode().split("\n")], object).reshape(n, -1)
    return np.frombuffer(data, np.int32).reshape(n, -1).astype(np.float64)


def trees(rows: DataFrame, width: int) -> DataFrame:
    """A row for each block of rows: its vec_ids and labels, and the cover trees of all parts."""
    most = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // width))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                block = batch.slice(start, most)
                parts = np.split(whole_numbers(block.column("vector"), width), PARTS, axis=1)
                grown = [cover_tree(p) for p in parts]
                yield pa.RecordBatch.from_pylist([{
                    "vec_id": block.column("vec_id").to_pylist(), "label": block.column("label").to_pylist(), "wide": parts[0].dtype == object,
                    "orders": [t.order.tobytes() for t in grown], "points": [_packed(t.points) for t in grown],
                    "nodes": [t.nodes.tobytes() for t in grown], "radii": [t.radii.tobytes() for t in grown],
                }], schema)

    many = pa.list_(pa.binary())
    schema = pa.schema([("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("wide", pa.bool_()), ("orders", many), ("points", many), ("nodes", many), ("radii", many)])
    return rows.select("vec_id", "label", "vector").mapInArrow(build, TREES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Tree]]]:
    """Blocks (one row each) and their trees."""
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.slice(k, 1)
            row = block.select(["wide", "orders", "points", "nodes", "radii"]).to_pylist()[0]
            n = len(row["orders"][0]) // 4
            yield block, [
                Tree(np.frombuffer(o, np.int32), _unpacked(p, row["wide"], n), np.frombuffer(t, np.int32).reshape(-1, 4), np.frombuffer(r, np.float64))
                for o, p, t, r in zip(row["orders"], row["points"], row["nodes"], row["radii"])
            ]


def _entries(book: list[list[int]]) -> np.ndarray:
    """A part's entries as doubles, or as Python integers where these would not be exact."""
    exact = all(abs(x) < exact_below(len(e)) for e in book for x in e)
    return np.array(book, np.float64 if exact else object)


def one_round(forest: DataFrame, codebooks: list[list[list[int]]]) -> list[list[list[int]]]:
    """Assign all parts to their nearest entries and replace these by the means, rounded down."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for _, grown in _read(batches):
            for part, tree in enumerate(grown):
                points = tree.points if tree.points.dtype == object else tree.points.astype(np.int64)
                upto = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points, axis=0)])
                for start, stop, entry in assigned(tree, _entries(codebooks[part])):
                    for e in np.unique(entry):
                        mine = entry == e
                        held = found.setdefault((part, int(e)), [0, np.zeros(points.shape[1], object)])
                        held[0] += int((stop[mine] - start[mine]).sum())
                        held[1] += (upto[stop[mine]] - upto[start[mine]]).sum(0)
        yield pa.RecordBatch.from_pylist([{"part": p, "entry": e, "count": c, "sums": [str(int(x)) for x in s]} for (p, e), (c, s) in found.items()], schema)

    def added(group: pa.Table) -> pa.Table:
        total = [str(sum(int(x) for x in column)) for column in zip(*group.column("sums").to_pylist())]
        return pa.Table.from_pylist([{"part": group.column("part")[0].as_py(), "entry": group.column("entry")[0].as_py(), "count": sum(group.column("count").to_pylist()), "sums": total}], schema)

    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.string()))])
    partial = forest.select("wide", "orders", "points", "nodes", "radii").mapInArrow(sums, SUMS)
    new = [[list(e) for e in book] for book in codebooks]
    # A group has one row of each task; what comes to the driver is PARTS * ENTRIES rows.
    for r in partial.groupBy("part", "entry").applyInArrow(added, SUMS).collect():
        new[r["part"]][r["entry"]] = [int(s) // r["count"] for s in r["sums"]]
    return new


def coded(forest: DataFrame, codebooks: list[list[list[int]]]) -> DataFrame:
    """The last assignment: vec_id, label, code, error."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, grown in _read(batches):
            n = len(grown[0].order)
            codes, errors = np.zeros((n, PARTS), np.int64), np.zeros(n, object if block.column("wide")[0].as_py() else np.int64)
            for part, tree in enumerate(grown):
                entries, code = _entries(codebooks[part]), np.zeros(n, np.int64)
                for start, stop, entry in assigned(tree, entries):
                    code[places(start, stop - start)] = np.repeat(entry, stop - start)
                apart = (tree.points - entries[code]) ** 2
                codes[tree.order, part] = code
                errors[tree.order] += apart.sum(1).astype(errors.dtype)
            text = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([block.column("vec_id").flatten(), block.column("label").flatten(), pa.array(text), pa.array([str(x) for x in errors], pa.string())], schema=schema)

    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.string())])
    rows = forest.mapInArrow(assign, CODES)
    return rows.select("vec_id", "label", "code", F.least(F.length("error"), F.lit(39)).alias("digits"), "error").select(
        "vec_id", "label", "code", F.when(F.col("digits") < 39, F.col("error").cast("decimal(38,0)")).otherwise(F.lit(MOST_LONG).cast("decimal(38,0)")).alias("error"))


def codebook_start(rows: DataFrame, width: int) -> list[list[list[int]]]:
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").toArrow().column("vector").combine_chunks()
    vectors = [[int(x) for x in v] for v in whole_numbers(first, width)]
    wide = width // PARTS
    return [[v[p * wide : (p + 1) * wide] for v in vectors] for p in range(PARTS)]


def vector_codes(df: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of all usable vectors (vec_id, label, code, error decimal), and the codebooks by part and entry."""
    rows = kept(df)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, -(-(longest or 0) // PARTS)) * PARTS
    if longest is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error")), [[] for _ in range(PARTS)]
    codebooks = codebook_start(rows, width)
    forest = stored(trees(rows, width))
    for _ in range(rounds):
        codebooks = one_round(forest, codebooks)
    return coded(forest, codebooks), codebooks


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings after six rounds."""
    codes, codebooks = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()
    codes = stored(codes)
    most = F.lit(MOST_LONG).cast("decimal(38,0)")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), F.least("label_error", most).cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    codes = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    both = codes.join(sums, codes["label"].eqNullSafe(sums["of"]) & (codes["salt"] == sums["part"]))
    return both.select("vec_id", "code", F.least("error", most).cast("long").alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    part = "list_slice(v, p * w + 1, p * w + w)"
    apart = "list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} as materialized (
  select x.id, x.p, x.v, arg_min(e.e, {apart} * {ENTRIES} + e.e) as e, min({apart}) as d
  from parts x join book{k} e using (p) group by x.id, x.p, x.v),""")
        if k < rounds:
            steps.append(f"""
sums{k} as (
  select p, e, i, sum(v[i]) as s, count(*) as n from near{k}, unnest(range(1, len(v) + 1)) t(i) group by p, e, i),
book{k + 1} as materialized (
  select b.p, b.e, coalesce(m.v, b.v) as v
  from book{k} b left join (
    select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from sums{k} group by p, e) m using (p, e)),""")
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id nulls last, embedding) as id, vec_id, label,
         list_transform(embedding, lambda x: cast(floor(cast(x as double) * {SCALE}) as bigint)) as v, len(embedding) // {PARTS} as w
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select id, p, {part} as v from kept, unnest(range({PARTS})) t(p)),
book0 as materialized (select p, id - 1 as e, v from parts where id <= {ENTRIES}),
{"".join(steps)}
coded as (
  select id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{rounds} group by id),
digest as (
  select coalesce(sha256(string_agg(array_to_string(v, ','), ',' order by p, e)), '') as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (id), digest
"""


SQL = codes_sql()
