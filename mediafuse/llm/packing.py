"""Training sequences of lexically related documents: BM25 neighbours fill each seed's window.

The terms are the token ids, so the document frequencies of the whole corpus are one vector of the
vocabulary's size. Documents are first ranged by their two terms of highest BM25 weight, so that lexical
neighbours come to lie together whatever their order in the input; a hash of the row comes last in that
order and splits groups of any size. Shards are about ``SHARD_TOKENS`` consecutive tokens of it; each has an
inverted index, weighted with the statistics of the whole corpus. A seed is the
rest of a document that was cut, or else the first unused document; its unused neighbours follow by
score until the window is full, the last of them being cut there. What remains of a shard becomes
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafuse.llm.pretokens import Pieces
from mediafuse.llm.columns import col
from mediafuse.operators.scratch import Scratch

WINDOW = 4096
SHARD_TOKENS = 1 << 20
END_ID, VOCABULARY = 2, 1 << 16
K1, B = 1.2, 0.75
TOKENIZER = "word_bpe_49k.json"
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces.of(path)
        for batch in batches:
            for i, j, ids, bound in table.encode(batch.column("text")):
                out = np.insert(ids, bound[1:], np.uint16(END_ID))
                ends = (bound + np.arange(len(bound))) * 2
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), column.cast(pa.binary())], names=["doc_id", "ids"])
    return run


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n, tokens = np.zeros(VOCABULARY, dtype=np.int64), 0, 0
    for batch in batches:
        for raw in batch.column("ids"):
            ids = np.frombuffer(raw.as_buffer(), dtype="<u2")
            df[np.unique(ids)] += 1
            n, tokens = n + 1, tokens + len(ids)
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([term, [-1, -2]])), pa.array(np.concatenate([df[term], [n, tokens]]))], names=["term", "df"])


def _weights(tf: np.ndarray, term: np.ndarray, size: np.ndarray | float, idf: np.ndarray, mean: float) -> np.ndarray:
    tf = tf.astype(np.float32)
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _routed(statistics):
    """Adds the two terms of highest weight and a hash of the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = statistics.value
        for batch in batches:
            first = np.full((batch.num_rows, 3), -1, dtype=np.int64)
            for i, raw in enumerate(batch.column("ids")):
                data = raw.as_buffer()
                term, tf = np.unique(np.frombuffer(data, dtype="<u2"), return_counts=True)
                top = np.argsort(-_weights(tf, term, float(len(data) // 2), idf, mean), kind="stable")[:2]
                first[i, : len(top)] = term[top]
                first[i, 2] = zlib.crc32(data, (batch.column("doc_id")[i].as_py() or 0) & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in first.T)], names=["doc_id", "ids", "t1", "t2", "salt"])
    return run


class _Index:
    """Inverted index of one shard. Postings lie by term; a weight holds the whole BM25 factor."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        parts = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [p[0] for p in parts]
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        size = np.array([len(d) for d in docs], dtype=np.float32)
        weight = _weights(np.concatenate([p[1] for p in parts]), term, size[doc], idf, mean)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.bound = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        a, b = self.bound[t], self.bound[t + 1]
        size = b - a
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(a - ends + size, size)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def _windows(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, start, length); all but the last few are full windows."""
    index = _Index(docs, idf, mean)
    used = np.zeros(len(docs), dtype=bool)
    cursor, carry = 0, None
    while True:
        if carry is None:
            while cursor < len(docs) and used[cursor]:
                cursor += 1
            if cursor == len(docs):
                return
            carry = (cursor, 0)
            used[cursor] = True
        seed, at = carry
        carry = None
        take = min(WINDOW, len(docs[seed]) - at)
        window, room = [(seed, at, take)], WINDOW - take
        if at + take < len(docs[seed]):
            carry = (seed, at + take)
        elif room and not used.all():
            s = np.where(used, -1.0, index.scores(seed))
            near = np.argsort(-s, kind="stable")
            for d in near.tolist():
                if used[d] or not room:
                    break
                used[d] = True
                take = min(room, len(docs[d]))
                window.append((d, 0, take))
                room -= take
                if take < len(docs[d]):
                    carry = (d, take)
        yield window


def _cut_to_powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    left = sum(n for _, _, n in window)
    pieces = list(window)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            d, at, n = pieces.pop(0)
            take = min(n, room)
            out.append((d, at, take))
            room -= take
            if take < n:
                pieces.insert(0, (d, at + take, n - take))
        yield out


def _packed(statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = statistics.value
        number = TaskContext.get().partitionId() << 32

        def shard(names: list, docs: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for window in _windows(docs, idf, mean):
                full = sum(n for _, _, n in window) == WINDOW
                for sequence in [window] if full else _cut_to_powers(window):
                    offset = 0
                    for d, at, n in sequence:
                        crc = zlib.crc32(docs[d][at : at + n].astype("<u4").tobytes())
                        rows.append((names[d], at, n, crc, len(docs[d]), number, offset))
                        offset += n
                    number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                              names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        names, docs, size = [], [], 0
        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2").copy()
                names.append(name)
                docs.append(ids)
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield shard(names, docs)
                    names, docs, size = [], [], 0
        if docs:
            yield shard(names, docs)
    return run


def pack(docs: DataFrame, scratch: Scratch, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Every row of docs is a document of its own, also where ids
    repeat or are null. Texts of any length are read whole and cut over as many sequences as they need; other
    columns take no part. Sequences have 4096 ids, but for the last of a shard, whose lengths are powers of two.
    """
    base = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = scratch.write(base.mapInArrow(_tokenized(path), "doc_id long, ids binary"), "ids")
    counted = ids.mapInArrow(_document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(VOCABULARY, dtype=np.int64)
    totals = dict(zip(counted.column("term").to_pylist(), counted.column("df").to_pylist(), strict=True))
    n, tokens = totals.pop(-1, 0), totals.pop(-2, 0)
    df[list(totals)] = list(totals.values())
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    statistics = docs.sparkSession.sparkContext.broadcast((idf, max(1.0, tokens / max(1, n))))
    # Written, so that sampling for the ranges reads three columns and the terms are weighed once.
    routed = scratch.write(ids.mapInArrow(_routed(statistics), "doc_id long, ids binary, t1 long, t2 long, salt long"), "routed")
    scratch.drop(ids)
    return routed.repartitionByRange("t1", "t2", "salt").sortWithinPartitions("t1", "t2", "salt", "doc_id").select("doc_id", "ids").mapInArrow(_packed(statistics), COLUMNS)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, Scratch(spark, "packing"), public_tokenizers.path(TOKENIZER))
