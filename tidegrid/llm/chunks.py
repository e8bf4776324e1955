"""Removing repeated passages by content-defined chunks.

A gear hash rolls over each text's bytes; a chunk ends before a blank where the
hash so far (it depends on the last 32 bytes alone) meets a mask. So chunks are
whole words, and an insertion moves only the ends near it. Two consecutive
chunks make a pair, and a pair's digest (XXH3, 64 bits) is what is compared.

Of each digest, the document of smallest doc_id keeps its passage; in all later
documents the pair's bytes are repeated. What comes again in one document is
repeated too if `within` says so; else a document may repeat itself. Runs of repeated bytes go if they are long enough to be a passage
rather than a common phrase. What is compared is the input, not what is left.

Results in special cases: a null or empty text, and one of a single chunk, has
no pair and stays (null as an empty text). Rows that share a doc_id are one
document for comparison: each keeps what is first in it. Documents without a
doc_id lose nothing. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents_of, lean, mixed, stored, text_slices

GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
ODDS = 4  # a blank ends a chunk with one chance in so many
LEAST_BYTES = 24  # of a chunk
MOST_BYTES = 256  # after which any character may end it
PASSAGE_BYTES = 120  # a shorter run of repeated bytes stays


def chunk_ends(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text end (in the buffer), the text's end included."""
    h = GEAR[data]
    for k in range(5):  # sums of 2, 4, ... 32 shifted terms
        step = 1 << k
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step) if len(h) > step else 0
        h = more
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    marked = blank.copy()
    marked[1:] &= h[:-1] < np.uint32(2**32 // ODDS)
    marked[:1] = False
    places = np.flatnonzero(marked)
    bounds = np.searchsorted(places, at)
    tail = (data & 0xC0) == 0x80
    out = []
    for k in range(len(at) - 1):
        start, end, ends = int(at[k]), int(at[k + 1]), []
        last = start
        for p in [*places[bounds[k] : bounds[k + 1]].tolist(), end]:
            while p - last > MOST_BYTES:
                cut = last + MOST_BYTES
                while cut < end and tail[cut]:
                    cut += 1
                if cut >= p:
                    break
                ends.append(cut)
                last = cut
            if p - last >= LEAST_BYTES:
                ends.append(p)
                last = p
        if last < end:
            ends.append(end)
        out.append(ends)
    return out


def pair_digests(raw: bytes, start: int, ends: list[int]) -> list[int]:
    """Digest of each two consecutive chunks, as signed 64-bit integers."""
    digest = xxhash.xxh3_64_digest
    edges = [start, *ends]
    found = b"".join([digest(raw[a:b]) for a, b in zip(edges, edges[2:])])
    return np.frombuffer(found, ">i8").astype(np.int64)


def digest_rows(docs: DataFrame) -> DataFrame:
    """The different digests of each document: (digest, doc_id)."""

    @lean
    def emit(batches):
        for batch, data, at in text_slices(batches):
            raw, ends, ids = data.tobytes(), chunk_ends(data, at), batch.column("doc_id").to_numpy(zero_copy_only=False)
            each = [np.unique(pair_digests(raw, int(at[k]), ends[k])) for k in range(batch.num_rows)]
            sizes = [len(x) for x in each]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each), pa.int64()), pa.array(np.repeat(ids, sizes), pa.int64())], ["digest", "doc_id"])

    return documents_of(docs).where("doc_id is not null").mapInArrow(emit, "digest long, doc_id long")


def without_repeats(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, text (what is kept), n_bytes, n_chunks, n_repeated (chunk pairs), n_removed (bytes), n_spans and `row` (all columns) of each row."""
    rows = digest_rows(docs)
    seen = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    seen = stored(seen.select("digest", "first"))
    known = rows.join(seen, "digest").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("known"))
    known = known.withColumnRenamed("doc_id", "known_of")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    paired = own.join(known, F.col("doc_id") == F.col("known_of"), "left").select("row", "doc_id", "text", "known")
    schema = "doc_id long, text string, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long"
    whole = StructType([*StructType.fromDDL(schema), row.schema["row"]])

    @lean
    def remove(batches):
        for batch, data, at in text_slices(batches):
            raw, ends = data.tobytes(), chunk_ends(data, at)
            out = []
            for k, (doc_id, known) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("known"))):
                start, edges = int(at[k]), [int(at[k]), *ends[k]]
                digests = pair_digests(raw, start, ends[k])
                text = raw[start : int(at[k + 1])]
                repeated = np.full(len(digests), within)
                repeated[np.unique(digests, return_index=True)[1]] = False
                if known.is_valid:
                    repeated |= np.isin(digests, known.values.to_numpy())
                if doc_id is None:
                    repeated[:] = False
                spans: list[list[int]] = []
                for j in np.flatnonzero(repeated):
                    a, b = edges[j] - start, edges[j + 2] - start
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
                spans = [s for s in spans if s[1] - s[0] >= PASSAGE_BYTES]
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept.append(text[last:])
                out.append((doc_id, b"".join(kept).decode(), len(text), len(ends[k]), int(repeated.sum()), sum(b - a for a, b in spans), len(spans)))
            columns = list(zip(*out))
            arrays = [pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("row")], [*(f.split()[0] for f in schema.split(", ")), "row"])

    return paired.mapInArrow(remove, whole)


def op7_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages that an earlier one has."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("row")
