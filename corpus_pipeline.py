"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafuse.llm.columns import col, free, only
from mediafuse.llm import decontaminate, language_id, line_dedup, near_dups, packing
from mediafuse.operators.scratch import Scratch

#: Bytes of texts that go to a Python worker at a time: both sides of the exchange hold a few such batches for each running task.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Ids of dropped documents that are sent to all tasks at most (8 bytes each); more are joined by id.
BROADCAST_IDS = 1_000_000


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches by BATCH_BYTES, unless it has a bound of its own: texts are long, and workers keep the memory of their largest batch."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null, empty or blank texts and texts without a letter.

    Every stage takes columns of any name beside those of documents, equal rows (each counts), texts of any
    length, which are read whole, and a table without rows, which gives none.
    """
    _small_batches(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    (told,) = free(docs, "told")
    return only(language_id.identify(docs, model, names=(told, f"{told}_score")).where(F.col(told) != language_id.UNKNOWN), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source; n_chars follows the text. Null texts and rows without a source stay as they are."""
    freed = line_dedup.dedup_lines(docs, Scratch(spark, "pipeline-lines"))
    return only(freed.withColumn("n_chars", F.length("text").cast("long")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates (five words, 0.8).

    Documents without words or without an id stay; of repeated rows all stay where the id is kept.
    """
    _small_batches(spark)
    scratch, (gone_id,) = Scratch(spark, "pipeline-near-dups"), free(docs, "gone_id")
    gone = near_dups.near_duplicate_groups(docs, scratch).where("not kept and id is not null").select(F.col("id").alias(gone_id)).distinct()
    gone = scratch.write(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, col("doc_id") == F.col(gone_id), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark. Null and empty texts hold none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items, Scratch(spark, "pipeline-benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids. Null and empty texts are the end id alone."""
    _small_batches(spark)
    return packing.pack(docs, Scratch(spark, "pipeline-packing"), public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", pack),
]
#: SQL cannot express the trained language model, MinHash groups and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
