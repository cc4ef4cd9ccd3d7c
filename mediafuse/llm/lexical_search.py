"""Ranked lexical search over a bit-sliced impact index.

A term's impact on a document is an integer. In a block of documents each term of the queries has one bitmap
for every bit of its impacts; the scores of a query are the sums of its terms' bitmaps by full adders (bitwise
and, or, exclusive or), so they are bit-sliced as well, and its best documents are found from the most
significant slice downwards without any score being read.

Documents stay where they are: one map counts terms, and the index of each block is made and searched inside
a task. Only each task's best rows of a query are shuffled. The queries are dealt into groups of a bounded
number of terms, whose vocabulary goes to all tasks; each group is a pass over the written counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.llm import wordhash as W
from mediafuse.llm.columns import col
from mediafuse.operators.scratch import Scratch

NEAREST = 10
#: Documents of a block (a multiple of 64), and terms of queries that a block indexes at a time.
BLOCK, TERMS_AT_ONCE = 4096, 8192
#: Terms of queries, with repeats, of one pass: 8 bytes each in every task.
TERMS_A_PASS = 200_000
#: A query's rows meet in so many parts before they meet as a whole.
PARTS = 64
_U = np.uint64


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, 64-bit hashes of the terms in order, their bounds) of slices of texts."""
    for i, j, data, off in W.slices(texts):
        h, _, _, bound = W.words(data, off, between=W.NO_ALNUM)
        yield i, j, h, bound


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, h, bound in _terms(batch.column("text")):
            lists = pa.LargeListArray.from_arrays(pa.array(bound.astype(np.int64)), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, j - i), lists], names=["k", "terms"])


def _counted(vocabulary):
    """Of each document with terms: its number of terms, and place and frequency of those in the vocabulary (ascending)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for i, j, h, bound in _terms(batch.column("text")):
                n = np.diff(bound)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                text = np.searchsorted(bound, hit, side="right") - 1
                key, times = np.unique(text * len(known) + at[hit], return_counts=True)
                ends = pa.array(np.searchsorted(key // len(known), np.arange(j - i + 1)).astype(np.int32))
                made = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array((key % len(known)).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))], names=["doc_id", "n", "terms", "tf"])
                yield made.filter(pa.array(n > 0))
    return run


def bit_slices(place: np.ndarray, doc: np.ndarray, value: np.ndarray, places: int, words: int) -> np.ndarray:
    """(bits, places + 1, words): bit d % 64 of word d // 64 of slice b of a place is bit b of its value on document d. The last place is empty."""
    bits = int(value.max()).bit_length() if len(value) else 0
    out = np.zeros((bits, (places + 1) * words), dtype=_U)
    cell = place * words + (doc >> 6)
    order = np.argsort(cell, kind="stable")
    cell, value, shift = cell[order], value[order].astype(_U), (doc[order] & 63).astype(_U)
    if bits:
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for b in range(bits):
            out[b, cell[first]] = np.bitwise_or.reduceat(((value >> _U(b)) & _U(1)) << shift, first)
    return out.reshape(bits, places + 1, words)


def summed(slices: np.ndarray, queries: list[np.ndarray]) -> np.ndarray:
    """(bits, queries, words): the bit-sliced sums of each query's places. Queries are in descending order of length."""
    bits, _, words = slices.shape
    longest = len(queries[0])
    acc = np.zeros((bits + longest.bit_length(), len(queries), words), dtype=_U)
    lengths = -np.array([len(q) for q in queries])
    for j in range(longest if bits else 0):
        n = int(np.searchsorted(lengths, -j, side="left"))  # those of more than j terms
        place = np.array([q[j] for q in queries[:n]])
        carry = np.zeros((n, words), dtype=_U)
        for b in range(len(acc)):
            a = acc[b, :n]
            if b < bits:
                x = slices[b][place]
                s = a ^ x
                both = a & x
                acc[b, :n] = s ^ carry
                carry = both | (s & carry)
            else:
                if not carry.any():
                    break
                acc[b, :n], carry = a ^ carry, a & carry
    return acc


def top_slices(acc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k highest scores above 0 of each query; of equal ones, the first documents."""
    queries, words = acc.shape[1:]
    open_ = np.bitwise_or.reduce(acc, axis=0) if len(acc) else np.zeros((queries, words), _U)
    sure = np.zeros_like(open_)
    for b in range(len(acc) - 1, -1, -1):
        more = open_ & acc[b]
        full = np.bitwise_count(sure | more).sum(axis=1) >= k
        sure[~full] |= more[~full]
        open_ = np.where(full[:, None], more, open_ & ~more)
    spread = lambda x: np.unpackbits(x.astype("<u8").view(np.uint8).reshape(queries, -1), axis=1, bitorder="little")
    room = k - np.bitwise_count(sure).sum(axis=1).astype(np.int64)
    ties = spread(open_)
    q, d = np.nonzero(spread(sure) | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= room[:, None])))
    score = np.zeros(len(q), dtype=np.int64)
    for b in range(len(acc)):
        score |= ((acc[b, q, d >> 6] >> (d & 63).astype(_U)) & _U(1)).astype(np.int64) << b
    return q, d, score


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[place < k], ids[place < k], score[place < k]


def _groups(queries: list[np.ndarray]) -> list[list[int]]:
    """Numbers of queries, longest first, in groups of at most TERMS_AT_ONCE terms (or of one query)."""
    out: list[list[int]] = []
    held = 0
    for i in sorted(range(len(queries)), key=lambda i: -len(queries[i])):
        if not out or held + len(queries[i]) > TERMS_AT_ONCE:
            out.append([])
            held = 0
        out[-1].append(i)
        held += len(queries[i])
    return out


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries, count, total = shared.value
        groups = [(g, np.unique(np.concatenate([queries[i] for i in g]))) for g in _groups(queries)]
        best = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                ids = block.column("doc_id").to_numpy()
                rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # documents in order of their ids
                ids = np.sort(ids)
                lists = block.column("terms")
                doc = np.repeat(rank, np.asarray(lists.value_lengths()))
                term, tf = lists.flatten().to_numpy().astype(np.int64), block.column("tf").flatten().to_numpy()
                m = np.zeros(len(ids), np.int64)
                m[rank] = 25 + (75 * block.column("n").to_numpy() * count) // total
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                for numbers, own in groups:
                    place = np.minimum(np.searchsorted(own, term), len(own) - 1)
                    mine = np.flatnonzero((own[place] == term) & (impact > 0))
                    slices = bit_slices(place[mine], doc[mine], impact[mine], len(own), (len(ids) + 63) // 64)
                    q, d, score = top_slices(summed(slices, [np.searchsorted(own, queries[i]) for i in numbers]), k)
                    best = _best(*(np.concatenate(p) for p in zip(best, (np.array(numbers)[q], ids[d], score), strict=True)), k)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best)), names=["q", "doc_id", "score"])
    return run


def _top(rows: DataFrame, keys: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("doc_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = NEAREST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of items, ties to the smaller id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Whole texts count; null and
    empty texts hold no term and take no part. Rows that repeat are documents, and items, of their own. A document
    without an id counts in the statistics and is never found. An item without terms, or whose terms no document
    holds, has no rows; empty tables give none. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    asked = items.select(col(item_col).alias("item_id"), col(item_text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("k"))
    asked = scratch.write(asked, "items")
    terms = scratch.write(asked.select("k", "text").mapInArrow(_listed, "k long, terms array<long>").where("size(terms) > 0"), "terms")
    size = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = math.ceil(size / TERMS_A_PASS)
    found = None
    for p in range(passes):
        rows = terms.where(F.pmod(F.xxhash64("k"), F.lit(passes)) == p).toArrow()
        if not rows.num_rows:
            continue
        key, lists = rows.column("k").to_numpy(), rows.column("terms").combine_chunks()
        bound = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        vocabulary, place = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
        base = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
        counted = scratch.write(base.mapInArrow(_counted(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tf array<long>"), "counts")
        count, total = counted.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(vocabulary))
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # one row a term of the pass at most
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.astype(int).tolist()], dtype=np.int64)
        shared = spark.sparkContext.broadcast((weight, [place[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)], count, total))
        best = counted.where("doc_id is not null").mapInArrow(_searched(shared, k), "q long, doc_id long, score long")
        near = scratch.write(_top(_top(best, ["q", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))], k).drop("rank"), ["q"], k), "best")
        named = spark.createDataFrame([(i, int(x)) for i, x in enumerate(key)], "q long, k long")
        part = near.join(F.broadcast(named), "q").select("k", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "k long, rank int, doc_id long, score long")
    return found.join(asked.select("k", "item_id"), "k").select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return search(read("documents"), read("benchmark"), Scratch(spark, "lexical-search"))


SQL = f"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM texts),
tf AS (SELECT side, id, w, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY ALL),
docs AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf WHERE side = 'd' GROUP BY id),
corpus AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
weights AS (SELECT w, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, corpus WHERE side = 'd' GROUP BY w, nd),
impacts AS (SELECT t.id, t.w, weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * n * nd) // l))) AS impact
  FROM tf t JOIN weights USING (w) JOIN docs USING (id), corpus WHERE t.side = 'd'),
scores AS (SELECT i.id AS item_id, p.id AS doc_id, CAST(sum(i.tf * impact) AS BIGINT) AS score FROM tf i JOIN impacts p USING (w) WHERE i.side = 'i' GROUP BY i.id, p.id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {NEAREST}
"""
