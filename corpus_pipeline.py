"""A training corpus from ``documents``: toxic documents go, copies and near copies go, sources are
mixed to target weights, and what is left is packed into sequences.

Each stage takes all that the one before kept; stage results are Parquet tables in the shared folder, and
what a stage staged on its way is deleted when its result is written.  Defined results of all stages:
null texts count as empty; empty texts and texts of any length are documents like others; an empty table
gives an empty one; further columns may have any names and are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, minhash_forest, mixture, packing, toxicity
from quarry.scratch import delete, fresh_path, joined, read_table, scope, staged

#: Near copies up to which their table is sent to all executors; texts stay where they lie.
MOST_SENT = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.  Repeated rows stay or go together; without labels all stay."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id; of rows that also share that, one; a row
    without a doc_id stays only where its text has no other."""
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id, and of several rows with that
    the one whose text has the least digest.  Rows without a doc_id, which can't be named, and rows without
    words stay."""
    # a doc_id may be repeated, so a row is named by it and its text
    text = "unhex(sha2(coalesce(text, ''), 256))"
    rows = minhash_forest.grouped(docs, key=text).where("comp is not null and doc_id is not null")
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = rows.join(first, "comp").where("doc_id <> first.doc_id or key <> first.key").select(F.struct("doc_id", "key").alias("name")).distinct()
    named = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.expr(text).alias("key")).alias("name"))
    return joined(named, staged(gone, "near-copies"), ["name"], "left_anti", MOST_SENT).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say; repeated rows draw alike, rows
    without a doc_id as one, and rows without a source are one source."""
    return mixture.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset; each emitted copy is packed on its own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens and learned scores are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root, before = read_table(spark, sf_dir, "documents"), fresh_path(spark, "pipeline"), ""
    for name, stage in STAGES:
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        if before:
            delete(spark, before)
        before = f"{root}/{name}"
        docs = spark.read.parquet(before)
    return docs
