"""A corpus in five stages: language, near duplicates, repeated passages, mixture, packing.

A stage takes the documents its predecessor kept, in the columns of documents,
and its decisions take effect on them. Rows that share a doc_id are one
document for the decisions of a stage, as each operator's module says; a
document without a doc_id is in no group of near duplicates, and stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.chunks import without_repeats
from tidegrid.llm.common import shared_folder
from tidegrid.llm.langid import told, training_rows
from tidegrid.llm.mixing import LEVELS, leaves_of, mixed_sources
from tidegrid.llm.packing import pack
from tidegrid.llm.simhash import near_groups
from tidegrid.llm.tokens import VOCABULARY

MIXTURE_SHARE = 1.0  # tokens to select, of all that there are
MIXTURE_EPOCHS = 2  # of a source that is short of its weight


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose language cannot be told (no letter, or unlike all languages learnt); fill a null lang."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kept = told(row, training_rows(docs)).where("found.keep")
    new = {"lang": F.coalesce("row.lang", "found.lang_pred")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group (five words, a similarity of 0.8)."""
    groups = near_groups(docs)
    kept = groups.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that an earlier document has."""
    kept = without_repeats(docs).select("row", "text", "n_removed")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their weights; a document is there once for each epoch it is selected in."""
    chosen = mixed_sources(docs, MIXTURE_SHARE, MIXTURE_EPOCHS).select(F.struct(F.col("doc_id"), *LEVELS).alias("chosen"))
    named = leaves_of(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "lang", "source"))
    same = [F.col("doc_id").cast("long").eqNullSafe(F.col("chosen.doc_id")), *[F.col(f"leaf_of.{c}") == F.col(f"chosen.{c}") for c in LEVELS]]
    return named.where("leaf_of.n_tokens > 0").join(chosen, same).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 ids; one row per piece."""
    return pack(docs, VOCABULARY)


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

ORACLE_SQL = None  # language models, fingerprints and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after one another; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
