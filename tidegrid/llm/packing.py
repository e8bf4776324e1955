"""Packing documents into sequences of fixed capacity by harmonic classes.

A document's ids (with its end id) are cut by length alone: whole sequences of
the capacity, then the powers of two of what remains down to a grain, then a
tail below the grain. A piece of length l is of class floor(capacity / l): a
sequence of that class holds exactly so many pieces. All pieces of a class have
one length, so each worker fills sequences on its own by counting, and a place
in a sequence is a multiple of the length. Power-of-two classes fill a sequence
without a gap; a tail's class of j pieces leaves less than capacity / j.

What does not fill a sequence at one worker goes on to a worker for many of
them, and so on to one. There, each class has less than a sequence of pieces
left, a number of pieces that depends on the capacity alone. Of the power-of-two
classes, these make sequences whose length is a power of two; the tails are laid
end to end.

Results in special cases: an empty or null text is a piece of one id (the end
id). Rows that share a doc_id are packed one by one. An empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents_of, lean, stored, text_slices
from .tokens import LARGE_CACHE, VOCABULARY, crc_of, encoder, forget_encoders

CAPACITY = 4096
GRAIN = 64
WORKER_PIECES = 50_000  # pieces that one worker fills sequences with, about
FAN_IN = 64  # workers whose left pieces one worker of the next round takes

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def piece_lengths(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """How a document of n ids is cut."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    size = capacity // 2
    while size >= grain:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] if rest else out


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, grain: int = GRAIN, cache_bytes: int | None = None) -> DataFrame:
    """One row per piece: where it starts in its document, its length and the CRC-32 of its ids.

    Without a size of the cache, a task leaves nothing of its encoder in its worker, which other stages use after it.
    """

    @lean
    def cut(batches):
        try:
            yield from cut_up(batches)
        finally:
            if cache_bytes is None:
                forget_encoders()

    def cut_up(batches):
        encode = encoder(vocabulary, cache_bytes).texts
        for batch, data, at in text_slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(data.tobytes(), at)):
                ids = np.append(ids, np.uint16(end_id))
                start = 0
                for n in piece_lengths(len(ids), capacity, grain):
                    rows.append((doc_id, start, n, crc_of(ids[start : start + n]), len(ids)))
                    start += n
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in PIECES.split(", ")])

    return documents_of(docs).mapInArrow(cut, PIECES)


def packed(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Add sequence_id and offset to the pieces."""
    order = ("doc_id", "start", "ids_crc32")
    group = Window.partitionBy("worker", "per")
    done: list[DataFrame] = []

    def placed(rows: DataFrame, first: int, number, offset) -> DataFrame:
        """A sequence's id is made of its worker (counted through all rounds), its class and its number there."""
        name = ((F.col("worker") + first) * (capacity + 1) + F.col("per")) * 2**31 + number
        return rows.select(*[f.split()[0] for f in PIECES.split(", ")], name.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    left = stored(cut.withColumn("per", F.floor(F.lit(capacity) / F.col("length"))))
    workers, first = max(1, -(-left.count() // WORKER_PIECES)), 0
    left = left.withColumn("worker", F.pmod(F.xxhash64(*order), F.lit(workers)))
    while True:
        ranked = left.withColumn("rank", F.row_number().over(group.orderBy(*order)) - 1)
        ranked = stored(ranked.withColumn("all", F.count(F.lit(1)).over(group)).withColumn("bin", F.floor(F.col("rank") / F.col("per"))))
        is_full = F.col("bin") < F.floor(F.col("all") / F.col("per"))
        done.append(placed(ranked.where(is_full), first, F.col("bin"), F.col("rank") % F.col("per") * F.col("length")))
        left = ranked.where(~is_full).drop("rank", "all", "bin")
        if workers == 1:
            break
        first += workers
        workers = -(-workers // FAN_IN)
        left = left.withColumn("worker", F.pmod(F.col("worker"), F.lit(workers)))
    # Less than a sequence of each class is left. A number of pieces is a sum of powers of two, and so many pieces of a
    # power of two fill such a sequence; r of m pieces is in the group of the highest bit in which r and m differ.
    rest = ranked.where(~is_full).withColumn("m", F.col("all") % F.col("per")).withColumn("r", F.col("rank") % F.col("per"))
    bit = F.floor(F.log2(F.col("r").bitwiseXOR(F.col("m")).cast("double"))).cast("int")
    large = rest.where(F.col("length") >= grain).withColumn("bit", bit)
    done.append(placed(large, first + 1, F.col("bit"), F.col("r").bitwiseAND(F.expr("shiftleft(1L, bit)") - 1) * F.col("length")))
    # Tails are laid end to end; a sequence takes those that begin within its first capacity - grain places.
    line = Window.orderBy(F.desc("length"), *order)
    small = rest.where(F.col("length") < grain).withColumn("to", F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    small = small.withColumn("at", F.col("to") - F.col("length")).withColumn("bin", F.floor(F.col("at") / (capacity - grain)))
    begin = F.min("at").over(Window.partitionBy("bin"))
    done.append(placed(small.withColumn("per", F.lit(0)).withColumn("begin", begin), first + 2, F.col("bin"), F.col("at") - F.col("begin")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, grain: int = GRAIN, cache_bytes: int | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place; see the module's text."""
    return packed(pieces(docs, vocabulary, end_id, capacity, grain, cache_bytes), capacity, grain)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY, cache_bytes=LARGE_CACHE)
