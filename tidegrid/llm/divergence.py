"""Divergence of the sources of each language by their terms, priced pair by pair.

Each (language, source) group is a sparse count vector over the terms its
language keeps. Terms get numbers in the order of a range partitioning by
(language, term), so that a block of numbers holds a bounded run of a language's
terms; a group is a sorted array of (number, count) for each block. For every
unordered pair of groups of a language and every block, one task row holds both
arrays. They are merged by a galloping intersection: from where the last run of
the shorter array ended, steps double until they pass the run's end, and only
what lies between is searched. Overlaps are priced by both counts, terms of one
side by the other's price of a count of zero, and the terms absent from both,
whose number is known, by the two prices of zero. Blocks are added up by pair,
and a pair serves both of its groups.

A price is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the counts of the group
over the V terms kept. The division is done by three digits at a time, which
stays within longs up to totals of 9 * 10^15. A difference of prices is
floor((p - q)^2 / (p + q)); both are exact.

Results in special cases: a null text, language or source is an empty one; a
text without terms still makes its group occur. Every row is a document, also
where doc_id repeats. A language that keeps no term has pairs of value 0 and no
`term` rows; a language of one source has no pairs. Ties rank by item. Texts of
any length are counted a piece at a time, cut between terms. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_slices

LEAST_DOCUMENTS = 10  # of a language that a kept term is in
TERM_RANKS = 10
UNIT = 1_000_000_000
EXTRA = 2  # what is added to each count
BLOCK_BITS = 16  # a block spans 2^16 numbers of terms
RUN = 128  # items of the shorter array that are searched for together
HELD_TERMS = 1 << 18  # partial counts that a task holds before it hands them on
PIECE_BYTES = 1 << 20
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, count long, documents long"
PRICED = "lang string, a string, b string, value long"


def terms_of(text: bytes) -> Counter:
    """Terms and how often each occurs: runs of letters A-Z (in lower case) and of non-ASCII bytes."""
    found: Counter = Counter()
    start = 0
    while start < len(text):
        stop = start + PIECE_BYTES
        piece = text[start:stop].translate(LETTERS)
        if stop < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and stop < len(text):  # a term longer than a piece
                more = text[stop : stop + PIECE_BYTES].translate(LETTERS)
                cut = len(piece) + more.find(b" ") if b" " in more else -1
                piece, stop = piece + more, stop + PIECE_BYTES
            if cut >= 0:
                piece = piece[:cut]
        found.update(piece.split())
        start += max(len(piece), 1)
    return found


def counted(docs: DataFrame) -> DataFrame:
    """Partial counts: (lang, source, term, count, documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0
        for part, data, at in text_slices(batches):
            groups = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist()))
            for k, group in enumerate(groups):
                mine = held.setdefault(group, {})
                size -= len(mine)
                for term, n in terms_of(data[at[k] : at[k + 1]].tobytes()).items():
                    have = mine.get(term)
                    if have is None:
                        mine[term] = [n, 1]
                    else:
                        have[0] += n
                        have[1] += 1
                size += len(mine)
                if size >= HELD_TERMS:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), mine in held.items():
            if mine:
                n = len(mine)
                counts = np.array(list(mine.values()), np.int64)
                term = pa.array(list(mine), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), term, pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=[c.split()[0] for c in COUNTS.split(", ")])

    return docs.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def price(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total), by three decimal digits at a time."""
    whole, left = F.lit(0).cast("long"), count
    for _ in range(3):
        left = left * 1000
        whole, left = whole * 1000 + F.call_function("div", left, total), left % total
    return whole + 1


def prices(count: np.ndarray, total: int) -> np.ndarray:
    whole, left = np.zeros(len(count), np.int64), count.astype(np.int64)
    for _ in range(3):
        left = left * 1000
        whole, left = whole * 1000 + left // total, left % total
    return whole + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def galloped(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each item of one sorted array would stand in a longer one."""
    out, at = np.empty(len(short), np.int64), 0
    for k in range(0, len(short), RUN):
        run, step = short[k : k + RUN], RUN
        while at + step < len(long) and long[at + step] < run[-1]:
            step *= 2
        out[k : k + RUN] = at + np.searchsorted(long[at : at + step + 1], run)
        at = int(out[min(k + RUN, len(short)) - 1])
    return out


def pair_value(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> int:
    """The summed differences of two groups over `terms` terms; a group is its sorted numbers, counts and total (N + 2 V)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    place = galloped(a[0], b[0])
    there = place < len(b[0])
    there[there] = b[0][place[there]] == a[0][there]
    zero_a, zero_b = (prices(np.array([EXTRA]), x[2]) for x in (a, b))
    price_a, price_b = (prices(x[1] + EXTRA, x[2]) for x in (a, b))
    alone = np.ones(len(b[0]), bool)
    alone[place[there]] = False
    value = differences(price_a[there], price_b[place[there]]).sum() + differences(price_a[~there], zero_b).sum() + differences(zero_a, price_b[alone]).sum()
    absent = terms - len(a[0]) - int(alone.sum())
    return int(value) + absent * int(differences(zero_a, zero_b)[0])


def priced(pairs: DataFrame) -> DataFrame:
    """Values of task rows (lang, a, b, terms, ids_a, counts_a, total_a, ids_b, counts_b, total_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            side = lambda s, k: (_items(column[f"ids_{s}"], k), _items(column[f"counts_{s}"], k), column[f"total_{s}"][k].as_py())  # noqa: B023, E731
            values = [pair_value(side("a", k), side("b", k), column["terms"][k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([column["lang"], column["a"], column["b"], pa.array(values, pa.int64())], names=["lang", "a", "b", "value"])

    return pairs.mapInArrow(run, PRICED).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _items(column: pa.Array, k: int) -> np.ndarray:
    item = column[k].values
    return item.to_numpy() if item is not None else np.zeros(0, np.int64)


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    counts = stored(counted(docs))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("documents").alias("documents"))
    of_lang = of_lang.where(F.col("documents") >= least_documents).select("lang", "term", "lang_count")
    # Numbers are unique and ascending within a partition of the ranges; a block holds at most 2^BLOCK_BITS of them.
    terms = stored(of_lang.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id()))
    block = F.shiftright("id", BLOCK_BITS).alias("block")
    blocks = terms.groupBy("lang", block).agg(F.count("*").alias("terms"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("n"))
    langs = langs.select("lang", "v", (F.col("n") + EXTRA * F.col("v")).alias("lang_total"))
    known = stored(counts.select("lang", "source", "term", "count").join(terms, ["lang", "term"]))
    sizes = known.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    groups = stored(groups.select("lang", "source", v.alias("v"), (F.coalesce("n", F.lit(0)) + EXTRA * v).alias("total"), "lang_total"))

    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pair_part(known, groups, blocks).unionByName(term_part(known, groups).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= term_ranks))


def pair_part(known: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    item = F.struct("id", "count")
    arrays = known.groupBy("lang", "source", F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    arrays = groups.select("lang", "source", "total").join(blocks, "lang").join(arrays, ["lang", "source", "block"], "left")
    arrays = stored(arrays.select("lang", "source", "block", "terms", "total", F.col("items.id").alias("ids"), F.col("items.count").alias("counts")))
    side = lambda s, *more: arrays.select("lang", "block", *more, F.col("source").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "total")])
    names = groups.select("lang", F.col("source").alias("a"))
    pairs = names.join(names.withColumnRenamed("a", "b"), "lang").where("a < b")
    both = pairs.join(side("a", "terms"), ["lang", "a"]).join(side("b"), ["lang", "b", "block"])
    values = pairs.join(priced(both), ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    values = stored(values).select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def term_part(known: DataFrame, groups: DataFrame) -> DataFrame:
    rows = known.join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), price(F.col("count") + EXTRA, F.col("total")).alias("p"), price(F.col("lang_count") + EXTRA, F.col("lang_total")).alias("q"))
    return rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def op11_pair_merge_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and over-used terms of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with docs as materialized (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
words as materialized (select id, lang, source, unnest(terms) as term from docs),
kept as materialized (
  select lang, term, count(*) as lang_count from words group by lang, term having count(distinct id) >= {LEAST_DOCUMENTS}),
counts as (
  select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
groups as (select distinct lang, source from docs),
dense as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.lang_count
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
priced as materialized (
  select lang, source, term, n,
         1 + {UNIT}::hugeint * (n + {EXTRA}) // (sum(n) over w + {EXTRA} * count(*) over w) as p,
         1 + {UNIT}::hugeint * (lang_count + {EXTRA}) // (sum(lang_count) over w + {EXTRA} * count(*) over w) as q
  from dense window w as (partition by lang, source)),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source as s, y.source as t, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
    from priced x join priced y on x.lang = y.lang and x.term = y.term group by all) v on v.lang = a.lang and v.s = a.source and v.t = b.source),
terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from priced where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from ranked where part = 'pair' or rank <= {TERM_RANKS}
"""
