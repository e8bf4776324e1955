"""Language identification as inference of a mixture of languages.

Learning counts byte trigrams of letters by language over all labelled training
documents. A text is cut into short runs of words, each of one language; how
likely a language makes a run is the product of its trigrams' probabilities.
Expectation-maximisation estimates a document's shares of the languages. Then
languages leave one by one, the smallest share first, shares being estimated
anew, and the set with the best likelihood less a penalty for each language in
it is taken. The language with the largest share is the prediction and its
share the score.

`told` adds whether a text is in any language that was learnt. Of a text's
trigrams, the mean log-probability (each run of words in the language that makes
it best) may lie FIT_MEAN standard deviations of a trigram below what training
texts reach on average, or down to that of a slot if all were alike, whichever
is less; and, for chance, below this by FIT_CHANCE deviations over the root of
the number of trigrams.

Results in special cases: a null text, or one without a letter, is `und` with a
score of 0; so is every text if no training document has a language. Ties go to
the language first by name. Predictions depend on the text alone, so repeated
rows agree. Documents without a doc_id train (they fall in no held-out part). An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, remainder, rows_of_items, stored, sums_by_row, text_slices

SLOTS = 1 << 15  # trigrams are counted by hash
SLICE = 1 << 20  # bytes of text at once: each needs some numbers for every language
RUN_WORDS = 8  # words of a run
ROUNDS = 8  # of expectation and maximisation for each set of languages
LEAST_SHARE = 0.02  # languages below it after the first estimate leave together
PENALTY = 2.0  # in natural logarithms, times half the logarithm of the number of runs
UNDETERMINED = "und"
FIT_MEAN, FIT_CHANCE = 2.0, 3.0  # bound on how far a text may lie below training texts

LETTER = re.compile(r"[^\W\d_]")
# Other than letters and bytes of longer characters, all bytes count as a blank.
FOLDED = np.full(256, 32, np.uint32)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[65:91] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)


def trigram_slots(data: np.ndarray) -> np.ndarray:
    """The slot of the trigram that ends at each byte (the first two look back on blanks)."""
    b = FOLDED[data]
    x = b.copy()
    x[1:] |= b[:-1] << np.uint32(8)
    x[2:] |= b[:-2] << np.uint32(16)
    x[:1] |= np.uint32(0x202000)
    x[1:2] |= np.uint32(0x200000)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(17)


def doc_slots(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slots of texts end to end; what would reach across a text's start looks back on blanks."""
    out = trigram_slots(data)
    for k in (0, 1):
        i = at[:-1][at[1:] - at[:-1] > k] + k
        b = FOLDED[data[i]] | (FOLDED[data[i - 1]] << np.uint32(8) if k else np.uint32(0x2000)) | np.uint32(0x200000)
        out[i] = (b * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return out


def learn(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log-probability of each slot in each (slots, languages).

    Slots are counted in the tasks and summed by language and slot; what comes to
    the driver is a number for each of them, however many documents there are.
    """

    @lean
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch, data, at in text_slices(batches, most=SLICE):
            slots, langs = doc_slots(data, at), batch.column("lang").to_pylist()
            for k, lang in enumerate(langs):
                own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                part = slots[at[k] : at[k + 1]]
                if len(part) > SLOTS // 8:
                    own += np.bincount(part, minlength=SLOTS)
                else:
                    np.add.at(own, part, 1)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used], pa.int64())], ["lang", "slot", "n"])

    rows = training.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((SLOTS, len(langs)))
    counts[rows["slot"], rows["lang"].map({x: k for k, x in enumerate(langs)})] = rows["n"]
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def run_likelihoods(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each run in each language, and the number of runs of each text."""
    blank = FOLDED[data] == 32
    begins = ~blank
    begins[1:] &= blank[:-1]
    starts = at[:-1][at[1:] > at[:-1]]
    begins[starts] = ~blank[starts]
    words = np.cumsum(begins)
    before = words[np.maximum(starts, 1) - 1] * (starts > 0)
    texts = np.searchsorted(at, np.flatnonzero(begins), "right") - 1
    first = np.zeros(len(at) - 1, np.int64)
    first[at[1:] > at[:-1]] = before
    position = np.arange(len(texts)) - first[texts]
    opens = position % RUN_WORDS == 0
    edges = np.flatnonzero(begins)[opens]
    counts = np.bincount(texts[opens], minlength=len(at) - 1)
    if not len(edges):
        return np.zeros((0, table.shape[1]), np.float32), counts
    ends = np.append(edges[1:], len(data))
    last = np.cumsum(counts)[counts > 0] - 1
    ends[last] = at[1:][counts > 0]
    values = np.concatenate([table[doc_slots(data, at)], np.zeros((1, table.shape[1]), np.float32)])
    # sums from each run's start to its end, then (left out) from there to the next start
    return np.add.reduceat(values, np.stack([edges, ends], axis=1).reshape(-1), axis=0)[::2], counts


def shares_of(likelihoods: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of the languages in each text by expectation-maximisation with backward choice of the set; NaN without runs."""
    n, languages = len(counts), likelihoods.shape[1]
    top = likelihoods.max(axis=1, keepdims=True)
    odds, row = np.exp(likelihoods - top), rows_of_items(counts)
    fixed = sums_by_row(top[:, 0].astype(np.float64), counts)
    full = counts > 0
    total = np.maximum(counts, 1)[:, None]

    def estimate(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
        for _ in range(ROUNDS):
            part = odds * share[row].astype(np.float32) + np.float32(1e-30)
            part /= part.sum(axis=1, keepdims=True)
            share = np.where(allowed, sums_by_row(part, counts, np.float64) / total, 0)
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        made = np.log(np.maximum((odds * share[row].astype(np.float32)).sum(axis=1, dtype=np.float64), 1e-30))
        return share, fixed + sums_by_row(made, counts)

    penalty = PENALTY * 0.5 * np.log(np.maximum(counts, 2))
    allowed = np.repeat(full[:, None], languages, axis=1)
    best = np.full((n, languages), np.nan)
    gain = np.full(n, -np.inf)
    share, _ = estimate(allowed)
    allowed = full[:, None] & ((share >= LEAST_SHARE) | (share == share.max(axis=1, keepdims=True)))
    while True:
        share, made = estimate(allowed)
        value = made - penalty * allowed.sum(axis=1)
        better = full & (value > gain)
        best[better], gain[better] = share[better], value[better]
        more = full & (allowed.sum(axis=1) > 1)
        if not more.any():
            return best
        least = np.where(allowed, share, np.inf).argmin(axis=1)
        allowed[more, least[more]] = False


def standardized(table: np.ndarray) -> np.ndarray:
    """Log-probabilities less the bound on their mean, by their deviation in a language's own texts; a trigram of blanks says nothing."""
    p = np.expm1(table.astype(np.float64) - table.min(axis=0))  # as counted: what is least likely was not seen
    p /= np.maximum(p.sum(axis=0), 1e-12)
    mean = (p * table).sum(axis=0)
    spread = np.sqrt(np.maximum((p * table.astype(np.float64) ** 2).sum(axis=0) - mean**2, 1e-12))
    out = ((table - np.minimum(mean - FIT_MEAN * spread, -np.log(SLOTS))) / spread).astype(np.float32)
    out[trigram_slots(np.full(3, 32, np.uint8))[2]] = 0
    return out


def fits(data: np.ndarray, at: np.ndarray, standard: np.ndarray) -> np.ndarray:
    """Whether each text is as likely as the bound on texts of the languages asks."""
    found, counts = run_likelihoods(data, at, standard)
    best = sums_by_row(found.max(axis=1, initial=-np.inf).astype(np.float64), counts)
    says = doc_slots(data, at) != trigram_slots(np.full(3, 32, np.uint8))[2]
    n = np.diff(np.concatenate([[0], np.cumsum(says)])[at])
    return best >= -FIT_CHANCE * np.sqrt(n)


def predictor(langs: list[str], table: np.ndarray):
    """A function of a string column that gives lang_pred and score."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(column: pa.Array) -> pa.Array:
        names, scores = [], []
        source = pa.RecordBatch.from_arrays([column.cast(pa.string())], ["text"])
        for batch, data, at in text_slices(iter([source]), most=SLICE):
            texts = batch.column("text").to_pylist()
            shares = shares_of(*run_likelihoods(data, at, table)) if langs else np.full((len(texts), 1), np.nan)
            for text, share in zip(texts, shares):
                if np.isnan(share[0]) or not LETTER.search(text or ""):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    k = int(share.argmax())
                    names.append(langs[k])
                    scores.append(float(min(1.0, share[k])))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict


def identified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with a column `found` of lang_pred and score, from what `training` (text, lang) teaches."""
    langs, table = learn(training)
    predict = predictor(langs, table)

    @F.arrow_udf("lang_pred string, score double")
    def found(text: pa.Array) -> pa.Array:
        return predict(text)

    return docs.withColumn("found", found(F.col("text").cast("string")))


def told(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with a column `found` of lang_pred, score and keep: whether the text has letters and is in a language.

    Where nothing could be learnt, letters are enough, and lang_pred is null.
    """
    langs, table = learn(training)
    predict, standard = predictor(langs, table), standardized(table)
    kind = StructType.fromDDL("found struct<lang_pred:string,score:double,keep:boolean>")

    def judged(text: pa.Array) -> pa.Array:
        if not langs:
            keep = pa.array([LETTER.search(x or "") is not None for x in text.to_pylist()], pa.bool_())
            return pa.StructArray.from_arrays([pa.nulls(len(text), pa.string()), pa.array(np.zeros(len(text))), keep], ["lang_pred", "score", "keep"])
        best = predict(text)
        source = pa.RecordBatch.from_arrays([text.cast(pa.string())], ["text"])
        fit = [fits(data, at, standard) for _, data, at in text_slices(iter([source]), most=SLICE)]
        keep = np.concatenate([np.zeros(0, bool), *fit]) & (best.field("lang_pred").to_numpy(zero_copy_only=False) != UNDETERMINED)
        return pa.StructArray.from_arrays([best.field("lang_pred"), best.field("score"), pa.array(keep)], ["lang_pred", "score", "keep"])

    @lean
    def judge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, judged(batch.column("text"))], [*batch.schema.names, "found"])

    # Not a function of a column: Spark has workers of their own for those, which would stay beside the other stages' workers.
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(judge, StructType([*docs.schema.fields, *kind.fields]))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents, without those held out (crc32 of the doc_id leaves 2 by 4)."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return own.where("text is not null and lang is not null").where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))).select("text", "lang")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return identified(own, training_rows(docs)).select("doc_id", "held_out", "found.lang_pred", "found.score")
