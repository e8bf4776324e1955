"""Removing long repeated strings by a sparse suffix array over all documents.

A string of LENGTH bytes that starts at two places or more is repeated, and so
is every byte that such a string covers. To find them without sorting every
suffix, each window of LENGTH bytes is named by an anchor in it: the place whose
16 bytes hash least among its first places. Equal windows have their anchors at
the same distance, so only suffixes at anchors are sorted, and the windows of an
anchor (its zone) are judged together.

1.  Every anchor gives a row with hashes of its core (the bytes after it that
    all its windows hold) and of its whole zone. Cores that come once are done
    with. Where all zones of a core are equal, all their windows are repeated.
2.  Of the others, one place of each different zone is fetched. Their suffixes
    from the anchor on are put in order (multikey quicksort to a shallow depth,
    blind tries below), those before it likewise from the right. Two windows at
    one distance from their anchors are equal if the order's common prefixes
    reach from one end of the window to the other.
3.  A core with more different zones than a task should order (a third of all
    documents may be near copies) has its windows compared by hash instead,
    which splits them over all tasks.

Hashes have 64 bits; a zone's equality takes two of them. Texts longer than
SEGMENT_BYTES are read in overlapping segments.

Results in special cases: a null text is empty; a text shorter than LENGTH keeps
all. Each row is a document: repeated rows repeat each other. A document without
a doc_id is one like any other. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, mixed, stored, text_slices
from .deepshallow import blind_trie, common, ordered

LENGTH = 400
GRAM = 16  # bytes that are hashed to choose an anchor
SEGMENT_BYTES = 4 << 20
SHALLOW_BYTES = 64  # of a suffix that multikey quicksort looks at (all zones of a core agree in more)
FEW = 16  # zones of a core that are compared pair by pair
MOST_ZONES = 20_000  # zones of a core that one task orders
CHUNK_ZONES = 50_000  # zones a task orders at once

BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 2**64)


def reach_of(length: int) -> int:
    """Places of a window among which its anchor is."""
    return min(192, max(1, length // 2))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each `width` consecutive ones."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    if have < width:
        keys = np.minimum(keys[: len(keys) - (width - have)], keys[width - have :])
    return keys


def zones(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Zones of texts end to end: text, first window, number of windows, anchor, hash of core, hash of zone."""
    n, reach = len(data), reach_of(length)
    sizes = at[1:] - at[:-1]
    empty = np.zeros(0, np.int64)
    if n < length or not (sizes >= length).any():
        return (empty,) * 6
    h, mult, step = BYTE_HASH[data], BASE, 1
    terms = h * powers(BASE, n)
    while step < min(GRAM, length - reach + 1):
        h[:-step] += h[step:] * np.uint64(mult)
        mult, step = mult * mult % 2**64, step * 2
    keys = (mixed(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    anchor = (least_in_windows(keys, reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(n + 1, np.int32)
    fits = sizes >= length
    np.add.at(change, at[:-1][fits], 1)
    np.add.at(change, at[1:][fits] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    name = anchor[start]
    text = np.searchsorted(at, start, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, len(start)))
    low, name, text = start[first], name[first], text[first]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    inverse = powers(BASE_INVERSE, n)

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((sums[b] - sums[a]) * inverse[a])

    core = hashed(name, name + length - reach + 1)
    shape = ((name - low) * 2**20 + count).astype(np.uint64)
    zone = mixed(hashed(low, low + count + length - 1) + mixed(shape))
    return text, low, count, name, core.view(np.int64), zone.view(np.int64)


def segments(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts themselves, or overlapping parts of a single long one with their place in it."""
    if len(data) <= 2 * SEGMENT_BYTES:
        yield data, at, 0
        return
    for k in range(0, len(data) - length + 1, SEGMENT_BYTES):
        part = data[k : k + SEGMENT_BYTES + length - 1]
        yield part, np.array([0, len(part)]), k


def with_place(docs: DataFrame) -> DataFrame:
    return documents_of(docs).withColumn("place", F.xxhash64("doc_id", "text"))


def zone_rows(docs: DataFrame, length: int) -> DataFrame:
    """core, zone, place (of the document), low (first window), many (windows), to (anchor after low)."""
    schema = "core long, zone long, place long, low long, many int, to int"

    def emit(batches):
        for batch, data, at in text_slices(batches):
            places = batch.column("place").to_numpy()
            for part, bounds, base in segments(data, at, length):
                text, low, count, name, core, zone = zones(part, bounds, length)
                columns = [pa.array(core, pa.int64()), pa.array(zone, pa.int64()), pa.array(places[text], pa.int64()), pa.array(low - bounds[:-1][text] + base, pa.int64()), pa.array(count.astype(np.int32)), pa.array((name - low).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return docs.mapInArrow(emit, schema)


def repeated_distances(lefts: list[bytes], rights: list[bytes], shared: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each zone of a core: ranges (from, to) of distances from window to anchor whose windows another zone has too.

    Zones come in the order of their suffixes (rights); shared says what each
    has in common with the one before. lefts are read from the anchor leftwards.
    A zone has the distances from length - len(right) to len(left).
    """
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= FEW:
        for i in range(n):
            right = len(rights[i])
            for j in range(i + 1, n):
                right = min(right, shared[j])
                low, high = length - right, common(lefts[i], lefts[j])
                if low <= high:
                    out[i].append((low, high))
                    out[j].append((low, high))
        return out
    order, left_shared = blind_trie(lefts, list(range(n)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    right_cut, left_cut = np.array(shared), np.array(left_shared)
    low, high = length - np.array([len(r) for r in rights]), np.array([len(x) for x in lefts])
    edges = np.unique(np.concatenate([length - right_cut[1:], left_cut[1:] + 1, low, high + 1]))
    for a, b in zip(edges, edges[1:]):
        right_class = np.cumsum(np.concatenate([[0], right_cut[1:] < length - a]))
        left_class = np.cumsum(np.concatenate([[0], left_cut[1:] < a]))[rank]
        inside = np.flatnonzero((low <= a) & (a <= high))
        _, which, times = np.unique(right_class[inside] * n + left_class[inside], return_inverse=True, return_counts=True)
        for i in inside[times[which] > 1]:
            out[i].append((int(a), int(b) - 1))
    return out


def fetched(docs: DataFrame, zones_of: DataFrame, length: int) -> DataFrame:
    """zones_of with the bytes of each zone."""
    each = zones_of.groupBy("place").agg(F.collect_list(F.struct("core", "zone", "times", "low", "many", "to")).alias("wanted"))
    schema = "core long, zone long, times long, place long, low long, many int, to int, bytes binary"

    def cut(batches):
        for batch, data, at in text_slices(batches):
            raw, rows = data.tobytes(), []
            for k, (place, wanted) in enumerate(zip(batch.column("place").to_pylist(), batch.column("wanted").to_pylist())):
                for z in wanted:
                    a = int(at[k]) + z["low"]
                    rows.append((z["core"], z["zone"], z["times"], place, z["low"], z["many"], z["to"], raw[a : a + z["many"] + length - 1]))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

    return docs.join(stored(each), "place").select("place", "text", "wanted").mapInArrow(cut, schema)


def ordered_spans(cut: DataFrame, length: int) -> DataFrame:
    """place, low, many: repeated windows of zones that come once, from the order of suffixes of their core."""
    schema = "place long, low long, many int"

    def judge(held: list[dict]) -> pa.RecordBatch:
        rights = [z["bytes"][z["to"] :] for z in held]
        order, shared = ordered(rights, min(SHALLOW_BYTES, length - reach_of(length) + 1))
        out = []
        begin = 0
        for end in range(1, len(order) + 1):
            if end < len(order) and held[order[end]]["core"] == held[order[end - 1]]["core"]:
                continue
            group = order[begin:end]
            if len(group) > 1:
                lefts = [held[i]["bytes"][: held[i]["to"]][::-1] for i in group]
                found = repeated_distances(lefts, [rights[i] for i in group], shared[begin:end], length)
                for i, ranges in zip(group, found):
                    z = held[i]
                    if z["times"] == 1:
                        out += [(z["place"], z["low"] + z["to"] - b, b - a + 1) for a, b in ranges]
            begin = end
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], ["place", "low", "many"])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            rows = batch.to_pylist()
            for z in rows:
                if len(held) >= CHUNK_ZONES and z["core"] != held[-1]["core"]:
                    yield judge(held)
                    held = []
                held.append(z)
        if held:
            yield judge(held)

    return cut.repartition("core").sortWithinPartitions("core").mapInArrow(run, schema)


def hashed_spans(cut: DataFrame, length: int) -> DataFrame:
    """The same, for cores with very many zones, by a hash of each window."""
    schema = "core long, back int, window long, times long, place long, low long"

    def emit(batches):
        for batch in batches:
            for z in batch.to_pylist():
                raw = z["bytes"]
                found = [int.from_bytes(hashlib.blake2b(raw[k : k + length], digest_size=8).digest(), "big", signed=True) for k in range(z["many"])]
                k = np.arange(z["many"])
                columns = [pa.array(np.full(len(k), z["core"])), pa.array((z["to"] - k).astype(np.int32)), pa.array(found, pa.int64()), pa.array(np.full(len(k), z["times"])), pa.array(np.full(len(k), z["place"])), pa.array(z["low"] + k)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    rows = stored(cut.mapInArrow(emit, schema))
    again = stored(rows.groupBy("core", "back", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return rows.where("times = 1").join(again, ["core", "back", "window"]).select("place", "low", F.lit(1).alias("many"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, most_zones: int = MOST_ZONES) -> DataFrame:
    """place, low, many: runs of window starts (rows of with_place) whose windows are repeated."""
    rows = stored(zone_rows(docs, length))
    cores = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("zone").alias("a"), F.max("zone").alias("b")).where("n > 1")
    cores = stored(cores.select("core", (F.col("a") == F.col("b")).alias("alike")))
    rows = stored(rows.join(cores, "core"))
    spans = rows.where("alike").select("place", "low", "many")
    one = [F.first(c).alias(c) for c in ("place", "low", "many", "to")]  # of one row: all see the rows in one order
    kinds = stored(rows.where("not alike").groupBy("core", "zone").agg(F.count(F.lit(1)).alias("times"), *one))
    same = kinds.where("times > 1").select("core", "zone")
    spans = spans.union(rows.where("not alike").join(same, ["core", "zone"]).select("place", "low", "many"))
    sizes = stored(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")))
    cut = stored(fetched(docs, kinds, length).join(sizes, "core"))
    spans = spans.union(ordered_spans(cut.where(F.col("kinds") <= most_zones).drop("kinds"), length))
    return spans.union(hashed_spans(cut.where(F.col("kinds") > most_zones).drop("kinds"), length))


def without_repeats(docs: DataFrame, length: int = LENGTH, most_zones: int = MOST_ZONES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    own = with_place(docs)
    spans = repeated_spans(own, length, most_zones)
    each = stored(spans.groupBy("place").agg(F.collect_list(F.struct("low", "many")).alias("spans")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def remove(batches):
        for batch, data, at in text_slices(batches):
            rows = []
            for k, (doc_id, spans) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("spans"))):
                text = data[at[k] : at[k + 1]]
                keep, runs = np.ones(len(text), bool), 0
                if spans.is_valid:
                    low = spans.values.field("low").to_numpy()
                    high = low + spans.values.field("many").to_numpy() + length - 1
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, low, 1)
                    np.add.at(change, high, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    runs = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
                rows.append((doc_id, len(text), int((~keep).sum()), runs, hashlib.sha256(text[keep].tobytes()).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

    return own.join(each, "place", "left").select("doc_id", "text", "spans").mapInArrow(remove, schema)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that come again anywhere."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
