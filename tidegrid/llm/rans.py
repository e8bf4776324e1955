"""Token ids in a compressed binary format: static range asymmetric numeral systems.

The format is a folder of two Parquet tables. `frequencies` has the one table
that all blocks share: for each id that occurs, its share of 2**SCALE_BITS.
`blocks` has a row for each block of up to BLOCK_IDS consecutive ids: part and
number, the ids' count, the stream of 32-bit words, the states of the LANES
interleaved coders at every checkpoint with the words read before it, and a
CRC-32 of the block's ids. Lane l of a block has its ids l, l + LANES, ... A
block needs no other; from a checkpoint on, neither does what follows in it.
`documents` has doc_id and number of ids in the order of the stream.

Parts are ranges of doc_id, so parts and blocks in order are the ids in ascending
doc_id order. All blocks of a part are coded side by side.

Results in special cases: an empty or null text is its end id alone. Rows that
share a doc_id follow one another by their ids' CRC-32. A null doc_id goes
first. Empty tables give empty files. Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents_of, shared_folder, stored, text_slices
from .tokens import LARGE_CACHE, VOCABULARY, crc_of, encoder

SCALE_BITS = 20
LANES = 64
BLOCK_IDS = 1 << 16
CHECKPOINT_STEPS = 256  # steps of all lanes between checkpoints
PART_BYTES = 4 << 20  # text of a part, about
LOW = np.uint64(1 << 31)  # states lie in [LOW, LOW << 32)
WORD = np.uint64(32)

IDS = "doc_id long, n_tokens long, ids_crc32 long, ids binary"
BLOCKS = "part int, block int, n_ids long, ids_crc32 long, words binary, states binary, marks binary"
DOCUMENTS = "part int, place int, doc_id long, n_tokens long"


def token_rows(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """The ids of each document, as little-endian 16-bit integers."""

    def encode(batches):
        encoded, end = encoder(vocabulary, LARGE_CACHE).texts, np.array([end_id], np.uint16)
        for batch, data, at in text_slices(batches):
            ids = [np.concatenate([x, end]) for x in encoded(data.tobytes(), at)]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([crc_of(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in IDS.split(", ")])

    return documents_of(docs).mapInArrow(encode, IDS)


def counted(rows: DataFrame) -> DataFrame:
    """How often each id occurs: (id, n)."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    return rows.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def shares(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole shares of 2**SCALE_BITS, at least 1 for each id that occurs (65,536 at most)."""
    out = np.zeros(1 << 16, np.int64)
    if not len(ids):
        return out
    free = (1 << SCALE_BITS) - len(ids)
    ideal = counts / counts.sum() * free
    part = 1 + np.floor(ideal).astype(np.int64)
    order = np.lexsort((ids, np.floor(ideal) - ideal))
    part[order[: (1 << SCALE_BITS) - part.sum()]] += 1
    out[ids] = part
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint16)

    def encode(self, ids: np.ndarray, blocks: int, steps: int) -> list[tuple[bytes, bytes, bytes]]:
        """Code blocks side by side: ids has the shape (blocks, steps, LANES), unused places hold -1.

        Coding runs from the last step to the first and the words are then turned
        round, so that decoding reads forward. An unused place is a symbol with all
        shares, the last of the tables here, which leaves a state as it is.
        """
        freq = np.append(self.freq, np.uint64(1 << SCALE_BITS))
        start, rest = np.append(self.start, np.uint64(0)), np.uint64(1 << SCALE_BITS) - freq
        bound = ((LOW >> np.uint64(SCALE_BITS)) << WORD) * freq
        state = np.full(blocks * LANES, LOW, np.uint64)
        count, states, marks = np.zeros(blocks, np.int64), [], []
        words, where = [], []
        for step in range(steps - 1, -1, -1):
            now = ids[:, step].reshape(-1)
            spill = np.flatnonzero(state >= bound[now])
            if len(spill):
                # within a step, lanes are read in ascending order; the stream is being built backwards
                full, block = state[spill], spill // LANES
                words.append(full.astype(np.uint32)[::-1])
                where.append(block[::-1])
                state[spill] = full >> WORD
                count += np.bincount(block, minlength=blocks)
            state += state // freq[now] * rest[now] + start[now]
            if step % CHECKPOINT_STEPS == 0:
                states.append(state.reshape(blocks, LANES).copy())
                marks.append(count.copy())
        words = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
        where = np.concatenate(where)[::-1] if where else np.zeros(0, np.int64)
        order = np.argsort(where, kind="stable")
        streams = np.split(words[order], np.cumsum(np.bincount(where, minlength=blocks))[:-1])
        states, marks = np.stack(states[::-1]), np.stack(marks[::-1])
        return [(streams[b].astype("<u4").tobytes(), states[:, b].astype("<u8").tobytes(), (count[b] - marks[:, b]).astype("<i8").tobytes()) for b in range(blocks)]

    def decode(self, rows: list[tuple[int, bytes, bytes, bytes]], first: int = 0) -> list[np.ndarray]:
        """Ids of blocks (n_ids, words, states, marks), all side by side, from a checkpoint on."""
        sizes = np.array([r[0] for r in rows])
        streams = [np.frombuffer(r[1], "<u4") for r in rows]
        base = np.cumsum([0, *map(len, streams)])
        words = np.append(np.concatenate(streams), np.zeros(1, np.uint32)).astype(np.uint64)
        state = np.concatenate([np.frombuffer(r[2], "<u8").reshape(-1, LANES)[first] for r in rows]).astype(np.uint64)
        at = base[:-1] + np.array([np.frombuffer(r[3], "<i8")[first] for r in rows])
        begin = first * CHECKPOINT_STEPS
        steps = -(-int(sizes.max()) // LANES)
        out = np.zeros((len(rows), steps - begin, LANES), np.uint16)
        mask, lanes = np.uint64((1 << SCALE_BITS) - 1), np.arange(LANES)
        for step in range(begin, steps):
            slot = state & mask
            sym = self.symbol[slot]
            out[:, step - begin] = sym.reshape(-1, LANES)
            new = self.freq[sym] * (state >> np.uint64(SCALE_BITS)) + slot - self.start[sym]
            if (step + 1) * LANES > sizes.min():  # a block that has ended keeps its state
                new = np.where((step * LANES + lanes < sizes[:, None]).reshape(-1), new, state)
            state = new
            short = np.flatnonzero(state < LOW)  # no state that has ended is
            if len(short):
                block = short // LANES
                read = np.bincount(block, minlength=len(rows))
                state[short] = (state[short] << WORD) | words[(at - (np.cumsum(read) - read))[block] + np.arange(len(short))]
                at += read
        return [out[b].reshape(-1)[: max(0, sizes[b] - begin * LANES)] for b in range(len(rows))]


def write(rows: DataFrame, path: str) -> None:
    """Write token rows (see token_rows; read twice, so stored) as files of the format."""
    spark = rows.sparkSession
    counts = counted(rows).toPandas()  # 65,536 at most
    freq = shares(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], "id int, share int").write.parquet(f"{path}/frequencies")
    total = rows.agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).first()
    parts = max(1, -(-2 * (total["n"] or 0) // PART_BYTES))
    # Parts are ranges of doc_id of about equally many rows. Only doc_id is read for their bounds.
    edges = rows.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("e")).first()["e"] if parts > 1 else []
    ranged = rows.withColumn("part", part_of(F.col("doc_id"), sorted(set(edges or []))))

    def encode(key, table):
        part = key[0].as_py()
        ids = np.concatenate([np.frombuffer(x, np.uint16) for x in ordered(table).column("ids").to_pylist()])
        blocks = -(-len(ids) // BLOCK_IDS)
        cuts = [ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS] for k in range(blocks)]
        steps = -(-len(cuts[0]) // LANES)
        grid = np.full((blocks, steps * LANES), -1, np.int32)
        for b, c in enumerate(cuts):
            grid[b, : len(c)] = c
        coded = Coder(freq).encode(grid.reshape(blocks, steps, LANES), blocks, steps)
        columns = zip(*[(part, b, len(c), crc_of(c), *coded[b]) for b, c in enumerate(cuts)])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], [f.split()[0] for f in BLOCKS.split(", ")])

    ranged.select("part", "doc_id", "ids_crc32", "ids").groupBy("part").applyInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    place = Window.partitionBy("part").orderBy("doc_id", "ids_crc32")
    ranged.withColumn("place", F.row_number().over(place)).select("part", "place", "doc_id", "n_tokens").write.parquet(f"{path}/documents")


def part_of(doc_id, edges: list[int]):
    """The number of edges below a doc_id, by halving."""

    def among(a: int, b: int):
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(doc_id > edges[mid], among(mid + 1, b)).otherwise(among(a, mid))

    return among(0, len(edges)).cast("int")


def ordered(table: pa.Table) -> pa.Table:
    """Rows of a part by doc_id (null first) and CRC."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("ids_crc32", "ascending")], null_placement="at_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, all from decoded blocks whose check sums hold."""
    table = spark.read.parquet(f"{path}/frequencies").toPandas()  # 65,536 at most
    freq = np.zeros(1 << 16, np.int64)
    freq[table["id"]] = table["share"]
    docs = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents")
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def decode(key, blocks, docs):
        docs = docs.sort_by("place")
        sizes = docs.column("n_tokens").to_numpy()
        rows = [tuple(r[n] for n in names) for r in blocks.sort_by("block").to_pylist()]
        found = Coder(freq).decode([(r[2], *r[4:]) for r in rows])
        for r, ids in zip(rows, found):
            if crc_of(ids) != r[3]:
                raise ValueError(f"part {r[0]}, block {r[1]}: check sum differs")
        ids = np.concatenate(found)
        ends = np.cumsum(sizes)
        crc = [crc_of(ids[e - n : e]) for e, n in zip(ends, sizes)]
        return pa.table({"part": docs.column("part"), "doc_id": docs.column("doc_id"), "within": pa.array(ends - sizes, pa.int64()), "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    back = blocks.groupBy("part").cogroup(docs.groupBy("part")).applyInArrow(decode, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return back.join(first, "part").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files and read them back."""
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(stored(token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)), path)
    return read(spark, path)
