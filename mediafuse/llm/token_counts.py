"""Token counts without ids: the pieces of every distinct pre-token are counted once and joined to the
documents' pre-token frequencies.

The distinct pre-tokens of the corpus are a written table (hash, pieces, frequency). Its most frequent
part, of at most ``HOT_LIMIT`` rows, is sent to all tasks and settles most occurrences where the text
is read; only the rest is shuffled to meet the table, so that no frequent key is ever one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafuse.llm import pretokens, wordhash as W
from mediafuse.llm.columns import col
from mediafuse.operators.scratch import Scratch

#: Rows of (hash, count) that are sent to every task: 12 bytes each, 6 MB at most.
HOT_LIMIT = 500_000
TOKENIZER = "word_bpe_49k.json"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in W.slices(batch.column("text")):
            h, start, end, _ = pretokens.split(data, off)
            key, first, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            piece = (raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True))
            piece = [p if b"<|" in p else p.lower() for p in piece]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(piece, pa.binary()), pa.array(n)], names=["h", "piece", "n"])


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pretokens.Pieces.of(path)
        for batch in batches:
            n = [len(table.ids_of(p.decode("utf-8", "replace"))) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(n, pa.int32()), batch.column("n")], names=["h", "pieces", "n"])
    return run


def _frequencies(hot):
    """Per document a row with the tokens of its hot pre-tokens, and a row for each other pre-token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_h, hot_n = hot.value
        for batch in batches:
            for i, j, data, off in W.slices(batch.column("text")):
                h, _, _, bound = pretokens.split(data, off)
                key, inverse = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(hot_h, key), max(0, len(hot_h) - 1))
                known = hot_h[at] == key if len(hot_h) else np.zeros(len(key), bool)
                pieces = np.where(known, hot_n[at], 0)[inverse] if len(hot_h) else np.zeros(len(h), np.int64)
                ends = np.concatenate([[0], np.cumsum(pieces)])
                tokens = ends[bound[1:]] - ends[bound[:-1]]
                rare = np.flatnonzero(~known[inverse])
                text = np.searchsorted(bound, rare, side="right") - 1
                order = np.lexsort((h[rare], text))
                text, rare_h = text[order], h[rare][order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (rare_h[1:] != rare_h[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate([first, [len(rare)]]))
                ids, keys = batch.column("doc_id").slice(i, j - i), batch.column("k").slice(i, j - i)
                took, m = pa.array(text[first]), len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([ids, ids.take(took)]), pa.concat_arrays([keys, keys.take(took)]),
                     pa.array(np.concatenate([tokens, np.zeros(m, np.int64)])),
                     pa.array(np.concatenate([np.zeros(j - i, np.int64), rare_h[first].view(np.int64)]), mask=np.arange(j - i + m) < j - i),
                     pa.array(np.concatenate([np.diff(off), times]).astype(np.int64))],
                    names=["doc_id", "k", "tokens", "h", "n"])
    return run


def token_counts(docs: DataFrame, scratch: Scratch, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs, as the library counts each whole text.

    Null text counts as empty: 0 and 0. Rows that repeat stay as many rows; a null id is kept.
    """
    spark = docs.sparkSession
    base = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = base.select("text").mapInArrow(_distinct, "h long, piece binary, n long")
    vocabulary = scratch.write(
        pieces.groupBy("h", "piece").agg(F.sum("n").alias("n")).mapInArrow(_counted(path), "h long, pieces int, n long"), "vocabulary")

    levels = {r["level"]: r["count"] for r in vocabulary.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()}
    level, room = 64, HOT_LIMIT
    while level > 0 and levels.get(level - 1, 0) <= room:
        level -= 1
        room -= levels.get(level, 0)
    table = vocabulary.where(F.floor(F.log2("n")) >= level).select("h", "pieces").toArrow()
    hot_h, hot_n = table.column("h").to_numpy().view(np.uint64), table.column("pieces").to_numpy()
    order = np.argsort(hot_h, kind="stable")
    hot = spark.sparkContext.broadcast((hot_h[order], hot_n[order].astype(np.int64)))

    counts = scratch.write(base.withColumn("k", F.xxhash64("doc_id", "text")).mapInArrow(
        _frequencies(hot), "doc_id long, k long, tokens long, h long, n long"), "counts")
    rare = counts.where("h is not null").join(vocabulary.where(F.floor(F.log2("n")) < level).select("h", "pieces"), "h")
    parts = counts.where("h is null").select("doc_id", "k", F.col("n").alias("n_bytes"), F.lit(1).alias("rows"), "tokens").unionByName(
        rare.select("doc_id", "k", F.lit(None).cast("long").alias("n_bytes"), F.lit(0).alias("rows"), (F.col("n") * F.col("pieces")).alias("tokens")))
    whole = parts.groupBy("doc_id", "k").agg(F.max("n_bytes").alias("n_bytes"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
    n = (F.col("tokens") / F.col("rows")).cast("long")
    one = whole.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), "rows")
    return one.where("rows = 1").drop("rows").unionByName(
        one.where("rows > 1").withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, Scratch(spark, "token-counts"), public_tokenizers.path(TOKENIZER))
