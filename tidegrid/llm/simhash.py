"""SimHash fingerprints and a self-join of their binary trie within an error budget.

A text's words are lower-cased (A-Z) and cut at ASCII white space; its shingles
are runs of consecutive words. A bit of the fingerprint is set where more than
half of the shingles' hashes set it. Wider fingerprints take further words of
bits from each shingle's hash.

Fingerprints link when they differ in at most `budget` bits. Different ones are
dealt out by sets of hex digits on which a linked pair agrees: with 64 bits and
a budget of 3, one of the four blocks of 16 bits is always untouched, so no link
is lost. Within a block, the sorted fingerprints
are a binary trie whose nodes are ranges. Pairs of nodes go down together and
add up the bits in which they differ; a pair over the budget ends. A pair whose
leaves are all known to be of one set ends too, which keeps large groups of
near copies near-linear. What leaves a task is a spanning forest of its links.

Wide fingerprints (`similar_groups`) only propose pairs, and the texts decide: a
pair stays if its sets of shingles have a similarity (shared by all) of at least
SIMILARITY. The bits are those of the set, so repeated lines do not move them.
Blocks are of texts that agree in a band of BAND minima of their sets under
different hashes, which a pair does with its similarity to the power of BAND,
whatever the size of the table: a pair at 0.8 misses all BANDS with a chance of
3 in a million. Blocks propose a spanning forest of their near pairs, which the
texts confirm or not. What the forest holds together is a cluster; where its
true links leave several sets in one, the cluster is dealt into tiles of a
bounded number of shingles, and for every two tiles one task counts exactly what
their texts share, so that no link is lost behind a false one. What leaves a
task is links; no pairs are listed.

Results in special cases: no words (or a null text) give the fingerprint zero,
which links like any other; fewer words than a shingle has give one shingle of
them all. Rows that share a doc_id are one document of several fingerprints,
and each row is returned. A document without a doc_id is of no one's group: its
component is null. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents_of, give_back, joined_roots, lean, mixed, rows_of_items, stored, text_slices

SEED = 42
SIMILARITY = (4, 5)  # of two sets of shingles, as a fraction
BUDGET = 76  # of 256 bits: a pair of texts at 0.8 differs in 39 of them (48 at most, in the shortest texts), give or take 6
CHUNK_ROWS = 250_000  # fingerprints a task joins at once, a larger block apart
BANDS, BAND = 24, 4  # blocks of a text in a table of wide fingerprints, and the minima that make one
WIDE_ROWS = 65_536  # the same of wide ones
TILE_SHINGLES, SET_SHINGLES = 1 << 17, 128  # of a tile, about, where a set counts as some more; a larger text has its own
COLUMNS_AT_ONCE = 4096  # shingles that are counted together
PAIRS_AT_ONCE = 500_000  # node pairs that go down together
LEAF_PAIRS, WIDE_LEAF_PAIRS = 4, 16_384  # pairs of rows under two nodes that are compared at once; a wide budget prunes late
PAIRS_IN_BATCH = 65_536  # proposed pairs in a batch that leaves a task
SHINGLES_AT_ONCE = 65_536


def text_hashes(text: bytes, width: int) -> bytes:
    """XXH64 of each shingle, eight big-endian bytes each."""
    words = text.lower().split()
    if not words:
        return b""
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return digest(line, SEED)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [s - 1 for s in starts[width:]] + [len(line)]
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends)])


# A byte's bits, first one first, each in a byte of its own, so that up to 255 of them add up without a carry.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def majority_bits(hashes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints of rows with `counts` hashes each, as big-endian bytes (rows, bits / 8)."""
    set_in = np.zeros((len(counts), bits), np.int32)
    row = rows_of_items(counts)
    for a in range(0, len(hashes), SHINGLES_AT_ONCE):
        part, rows = hashes[a : a + SHINGLES_AT_ONCE], row[a : a + SHINGLES_AT_ONCE]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        begin = np.flatnonzero(place % 255 == 0)
        for word in range(bits // 64):
            h = part if word == 0 else mixed(part + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64))
            lanes = BYTE_BITS[h.astype(">u8").view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(lanes, begin, axis=0).view(np.uint8)
            np.add.at(set_in[:, word * 64 : word * 64 + 64], rows[begin], sums.astype(np.int32))
    return np.packbits(set_in * 2 > counts[:, None], axis=1)


def fingerprints(docs: DataFrame, width: int, bits: int = 64) -> DataFrame:
    """doc_id and fingerprint (hex digits) of each row."""

    @lean
    def prints(batches):
        for batch, data, at in text_slices(batches):
            raw = data.tobytes()
            found = [text_hashes(raw[at[k] : at[k + 1]], width) for k in range(batch.num_rows)]
            counts = np.array([len(x) // 8 for x in found], np.int64)
            hashes = np.frombuffer(b"".join(found), ">u8").astype(np.uint64)
            hexed = [x.tobytes().hex() for x in majority_bits(hashes, counts, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hexed, pa.string())], ["doc_id", "fingerprint"])

    return documents_of(docs).mapInArrow(prints, "doc_id long, fingerprint string")


def tables_of(bits: int, budget: int) -> list[list[int]]:
    """Sets of hex digits (from 1) of which fingerprints that link agree on one."""
    assert budget + 1 <= bits // 16
    return [list(range(k, k + 4)) for k in range(1, bits // 4 + 1, 4)]


# Odd numbers: a product by each orders the hashes of shingles anew.
ORDERS = mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64)) | np.uint64(1)


def bands_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Blocks (rows, BANDS) of rows with `counts` different hashes each; rows without any share theirs."""
    starts, full = (np.cumsum(counts) - counts)[counts > 0], counts > 0
    out = np.zeros((len(counts), BANDS), np.uint64)
    for k, order in enumerate(ORDERS):
        least = np.full(len(counts), 2**64 - 1, np.uint64)
        if len(starts):
            h = hashes ^ order
            h ^= h >> np.uint64(32)
            least[full] = np.minimum.reduceat(h * order, starts)
        out[:, k // BAND] = mixed(out[:, k // BAND] ^ least) + np.uint64(k // BAND)
    return out.view(np.int64)


def trie_links(prints: np.ndarray, group: np.ndarray, budget: int) -> np.ndarray:
    """Smallest row of each row's set, for rows (n, words) sorted by group and then as big-endian numbers."""
    labels = np.arange(len(prints))
    for _ in near_pairs(prints, group, budget, labels):
        pass
    return labels


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach SIMILARITY."""
    return np.minimum(a, b) * SIMILARITY[1] >= np.maximum(a, b) * SIMILARITY[0]


def spanning(labels: np.ndarray, p: np.ndarray, q: np.ndarray, off: np.ndarray):
    """Join the sets (labels, in place) that pairs link, and give the pairs that did it, those of fewest different bits first."""
    order = np.argsort(off, kind="stable")
    p, q = p[order], q[order]
    while True:
        apart = labels[p] != labels[q]
        p, q = p[apart], q[apart]
        if not len(p):
            return
        _, ends = np.unique(np.concatenate([labels[p], labels[q]]), return_inverse=True)
        best = np.full(ends.max() + 1, len(p))
        np.minimum.at(best, ends, np.tile(np.arange(len(p)), 2))
        pick = np.unique(best)
        yield p[pick], q[pick]
        labels[:] = joined_roots(labels, p[pick], q[pick])


def near_pairs(prints: np.ndarray, group: np.ndarray, budget: int, labels: np.ndarray, sizes: np.ndarray | None = None):
    """Join in `labels`, which name sets by their smallest row, rows (sorted by group and print) within the budget.

    With `sizes` (of the rows' sets of shingles), the pairs that joined come out, a spanning forest.

    The nodes of a group's trie are ranges of its rows. Levels are the bits of the
    first word, then leaves: what is left of a pair is then counted at once.
    """
    n, word = len(prints), prints[:, 0]
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, np.int64)
    spans = np.diff(np.append(edge, n))
    many = spans > 1
    a, z = edge[many], (edge + spans)[many]
    # a frame: ranges [a, b) and [c, d), bits that differ so far, level
    todo = [(a, z, a, z, np.zeros(len(a), np.int32), 0)]
    while todo:
        lo1, hi1, lo2, hi2, off, level = todo.pop()
        breaks = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        whole = (breaks[hi1 - 1] == breaks[lo1]) & (breaks[hi2 - 1] == breaks[lo2]) & (labels[lo1] == labels[lo2])
        keep = ~whole
        lo1, hi1, lo2, hi2, off = (x[keep] for x in (lo1, hi1, lo2, hi2, off))
        if not len(lo1):
            continue
        leaves = ((hi1 - lo1) * (hi2 - lo2) <= (LEAF_PAIRS if sizes is None else WIDE_LEAF_PAIRS)) | (level == 64)
        if leaves.any():
            for i, j in pairs_under(lo1[leaves], hi1[leaves], lo2[leaves], hi2[leaves]):
                p, q = i[i < j], j[i < j]
                if sizes is not None:
                    able = (labels[p] != labels[q]) & similar_sizes(sizes[p], sizes[q])
                    p, q = p[able], q[able]
                off_by = np.bitwise_count(prints[p] ^ prints[q]).sum(axis=1, dtype=np.int32)
                near = off_by <= budget
                if sizes is not None:
                    yield from spanning(labels, p[near], q[near], off_by[near])
                else:
                    labels[:] = joined_roots(labels, p[near], q[near])
        lo1, hi1, lo2, hi2, off = (x[~leaves] for x in (lo1, hi1, lo2, hi2, off))
        if not len(lo1):
            continue
        if len(lo1) > PAIRS_AT_ONCE:
            half = len(lo1) // 2
            todo += [(lo1[:half], hi1[:half], lo2[:half], hi2[:half], off[:half], level), (lo1[half:], hi1[half:], lo2[half:], hi2[half:], off[half:], level)]
            continue
        cut1, cut2 = split_at(word, lo1, hi1, level), split_at(word, lo2, hi2, level)
        own = lo1 == lo2
        far, near = [], []
        for x, (p0, p1) in enumerate(((lo1, cut1), (cut1, hi1))):
            for y, (q0, q1) in enumerate(((lo2, cut2), (cut2, hi2))):
                d = off + (x != y)
                ok = (p1 > p0) & (q1 > q0) & (d <= budget) & ~(own & (x > y)) & ~(own & (x == y) & (p1 - p0 < 2))
                (far if x != y else near).append((p0[ok], p1[ok], q0[ok], q1[ok], d[ok].astype(np.int32)))
        for side in (far, near):  # the near sides are taken up first, so that sets form before far pairs are met
            todo.append((*(np.concatenate([s[k] for s in side]) for k in range(5)), level + 1))


def pairs_under(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray):
    """All pairs of rows of each two ranges, in parts of about PAIRS_AT_ONCE."""
    n2, size = hi2 - lo2, (hi1 - lo1) * (hi2 - lo2)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + PAIRS_AT_ONCE, "right")))
        for first in range(0, int(size[start : stop].sum()), PAIRS_AT_ONCE):  # one pair of ranges may hold more
            place = np.arange(first, min(first + PAIRS_AT_ONCE, int(size[start:stop].sum())))
            which = start + np.searchsorted(ends[start:stop] - ends[start] + size[start], place, "right")
            place -= (ends[which] - size[which]) - (ends[start] - size[start])
            yield lo1[which] + place // n2[which], lo2[which] + place % n2[which]
        start = stop


def split_at(word: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """In each sorted range, the first row whose bit at this level is set (rows agree on the bits before)."""
    bit = np.uint64(1) << np.uint64(63 - level)
    a, b = lo.copy(), hi.copy()
    while True:
        open_ = a < b
        if not open_.any():
            return a
        mid = (a + b) // 2
        is_set = (word[np.minimum(mid, len(word) - 1)] & bit) != 0
        b = np.where(open_ & is_set, mid, b)
        a = np.where(open_ & ~is_set, mid + 1, a)


def links(prints: DataFrame, bits: int, budget: int) -> DataFrame:
    """Spanning edges (a, b) among different fingerprints (hex, stored) that link within some block."""
    keys = F.array(*[F.concat(F.lit(f"{t}:"), *[F.substring("fingerprint", p, 1) for p in places]) for t, places in enumerate(tables_of(bits, budget))])
    dealt = prints.select("fingerprint", F.explode(keys).alias("block")).repartition("block").sortWithinPartitions("block", "fingerprint")
    width = bits // 8

    @lean
    def join(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush(last: bool):
            nonlocal held, count
            if not held:
                return None
            rows, blocks = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            stop = len(rows) if last else int(np.flatnonzero(blocks[1:] != blocks[:-1]).max(initial=-1)) + 1
            held, count = ([(rows[stop:], blocks[stop:])] if stop < len(rows) else []), len(rows) - stop
            if not stop:
                return None
            rows, blocks = rows[:stop], blocks[:stop]
            group = np.cumsum(np.concatenate([[0], blocks[1:] != blocks[:-1]]))
            words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
            labels = trie_links(words, group, budget)
            child = np.flatnonzero(labels != np.arange(stop))
            return pa.RecordBatch.from_arrays([pa.array([rows[k].tobytes().hex() for k in x], pa.string()) for x in (child, labels[child])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(bytes.fromhex("".join(batch.column("fingerprint").to_pylist())), np.uint8).reshape(-1, width)
            held.append((raw, np.array(batch.column("block").to_pylist(), object)))
            count += batch.num_rows
            if count >= CHUNK_ROWS:
                if (out := flush(False)) is not None:
                    yield out
        if (out := flush(True)) is not None:
            yield out

    return dealt.mapInArrow(join, "a string, b string")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(np.frombuffer(text_hashes(text, width), ">u8").astype(np.uint64))


def set_key(own: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(own.tobytes(), SEED)


def sketches(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Of each row: doc_id, text_key (hash of the text), key (of its set of shingles), n (size of the set), the set's fingerprint and its blocks."""

    @lean
    def sketch(batches):
        for batch, data, at in text_slices(batches):
            raw = data.tobytes()
            sets = [shingle_set(raw[at[k] : at[k + 1]], width) for k in range(batch.num_rows)]
            counts = np.array([len(x) for x in sets], np.int64)
            hashes = np.concatenate(sets)
            hexed = [x.tobytes().hex() for x in majority_bits(hashes, counts, bits)]
            blocks = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands_of(hashes, counts).reshape(-1)))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(map(set_key, sets), pa.string()), pa.array(counts), pa.array(hexed, pa.string()), blocks]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "key", "n", "fingerprint", "blocks"])

    return documents_of(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(sketch, "doc_id long, text_key long, key string, n long, fingerprint string, blocks array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """key and shingles (array) of the texts whose text_key is wanted."""

    @lean
    def hashed(batches):
        for batch, data, at in text_slices(batches):
            raw = data.tobytes()
            sets = [shingle_set(raw[at[k] : at[k + 1]], width) for k in range(batch.num_rows)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.string()), values], ["key", "shingles"])

    texts = documents_of(docs).select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key", "left_semi")
    return texts.select("text").mapInArrow(hashed, "key string, shingles array<long>").groupBy("key").agg(F.first("shingles").alias("shingles"))


def whole_blocks(batches):
    """Tables of about WIDE_ROWS rows, cut where the block changes (rows come by block)."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= WIDE_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            block = table["block"].to_numpy()
            stop = int(np.flatnonzero(block[1:] != block[:-1]).max(initial=-1)) + 1
            if stop:
                yield table.slice(0, stop)
            held = table.slice(stop).to_batches()
            count -= stop
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def proposed(dealt: DataFrame, bits: int, budget: int) -> DataFrame:
    """Pairs of keys (a, b), a spanning forest of those of the same block whose fingerprints and sizes are near."""

    @lean
    def join(batches):
        for table in whole_blocks(batches):
            raw = np.frombuffer(bytes.fromhex("".join(table["fingerprint"].to_pylist())), np.uint8).reshape(-1, bits // 8)
            words = np.ascontiguousarray(raw).view(">u8").astype(np.uint64)
            block, sizes, labels = table["block"].to_numpy(), table["n"].to_numpy(), np.arange(len(words))
            group = np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))
            keys = table["key"].combine_chunks()
            held, count = [], 0
            for pair in near_pairs(words, group, budget, labels, sizes):
                held.append(pair)
                count += len(pair[0])
                if count >= PAIRS_IN_BATCH:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x))) for x in zip(*held)], ["a", "b"])
                    held, count = [], 0
            if count:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x))) for x in zip(*held)], ["a", "b"])

    pairs = dealt.repartition("block").sortWithinPartitions("block", "fingerprint").mapInArrow(join, "a string, b string")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles have a similarity of at least SIMILARITY."""
    part, whole = SIMILARITY
    a, b = (sets.select(F.col("key").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").where(shared * (part + whole) >= (F.size("of_a") + F.size("of_b")) * part).select("a", "b")


def shared_counts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many ids each two of some sets share; the sets' ids lie end to end."""
    row = rows_of_items(counts)
    _, column, n = np.unique(ids, return_inverse=True, return_counts=True)
    common = n > 1  # what only one set has is shared by no two
    number = np.cumsum(common) - 1
    row, column = row[common[column]], number[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(counts), len(counts)), np.float64)
    for first in range(0, int(common.sum()), COLUMNS_AT_ONCE):
        a, z = np.searchsorted(column, [first, first + COLUMNS_AT_ONCE])
        there = np.zeros((len(counts), COLUMNS_AT_ONCE), np.float32)
        there[row[a:z], column[a:z] - first] = 1  # sums of ones below 2^24 are exact
        out += there @ there.T
    return out


def links_between(sets: DataFrame) -> DataFrame:
    """Links (a, b) between different `known` sets of each cluster.

    sets: key, shingles, cluster, known. A spanning forest of the links that two
    tiles have between them is returned.
    """
    whole = sets.groupBy("cluster").agg(F.ceil(F.sum(F.size("shingles") + SET_SHINGLES) / TILE_SHINGLES).cast("int").alias("tiles"), F.countDistinct("known").alias("sets"))
    rows = sets.join(whole.where("sets > 1"), "cluster").withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.select("cluster", "key", "known", "shingles", "tile", partner.alias("other"))
    rows = rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def decide(table: pa.Table) -> pa.Table:
        column = table["shingles"].combine_chunks()
        counts = np.diff(column.offsets.to_numpy()).astype(np.int64)
        known = table["known"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        _, first, own = np.unique(known, return_index=True, return_inverse=True)
        part, both = SIMILARITY
        shared = shared_counts(column.flatten().to_numpy(), counts)
        p, q = np.nonzero(np.triu((shared * (part + both) >= (counts[:, None] + counts) * part) & (known[:, None] != known), 1))
        labels, found = first[own], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        found += list(spanning(labels, p, q, np.zeros(len(p), np.int64)))
        keys = table["key"].combine_chunks()
        give_back()
        return pa.table([keys.take(pa.array(np.concatenate(x))) for x in zip(*found)], ["a", "b"])

    return rows.select("cluster", "low", "high", "key", "known", "shingles").groupBy("cluster", "low", "high").applyInArrow(decide, "a string, b string")


def similar_groups(docs: DataFrame, width: int, bits: int, budget: int) -> DataFrame:
    """doc_id, fingerprint and component_id of each row: links are pairs that the fingerprints propose and the texts confirm."""
    found = stored(sketches(docs, width, bits))
    classes = stored(found.groupBy("key", "n", "fingerprint", "blocks").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key")))
    chosen = stored(proposed(classes.select("key", "n", "fingerprint", F.explode("blocks").alias("block")), bits, budget))
    nodes = stored(chosen.select(F.col("a").alias("key")).union(chosen.select("b")).distinct())
    sets = stored(shingle_sets(docs, stored(classes.join(nodes, "key").select("text_key").distinct()), width))
    sure = stored(verified(chosen, sets))
    known = nodes.join(components(sure), F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("known"))
    clusters = components(chosen).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    more = links_between(sets.join(clusters, "key").join(stored(known), "key"))
    reach = components(stored(sure.union(more)))
    named = stored(classes.join(reach, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("component")))
    least = stored(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = stored(named.join(least, "component").select("key", "component_id"))
    return found.join(named, "key").select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_groups(docs: DataFrame, width: int = 5, bits: int = 256, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id that links reach) of each row."""
    if budget + 1 > bits // 16:  # fingerprints alone cannot tell
        return similar_groups(docs, width, bits, budget)
    found = stored(fingerprints(docs, width, bits))
    classes = stored(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    reach = components(links(classes.select("fingerprint"), bits, budget))
    named = stored(classes.join(reach, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")))
    least = stored(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = stored(named.join(least, "component").select("fingerprint", "component_id"))
    return found.join(named, "fingerprint").select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 64 bits, at most 3 of them different."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 64, 3)
