"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns a unit vector by three rounds of random signs and a Hadamard transform; its hash is the
signed axis nearest to the result. A query probes the PROBES nearest axes of each of TABLES tables, and
what it meets there is ranked by the exact inner product. Buckets and their queries are dealt out in
blocks of bounded size, so a bucket that holds a third of all vectors is the work of many tasks. Blocks
return their best rows per query, which then meet by query. Vectors are hashed by direction, whatever
their norms; since a long vector can have a large inner product with a query that it is far from in angle,
the longest tenth of the vectors of each length is one more bucket that every query meets. Queries that
find too few rows meet all vectors of their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.llm.columns import col
from mediafuse.operators.scratch import Scratch

TABLES, PROBES, NEAREST = 8, 16, 20
#: The share of vectors, those of largest norm, that all queries meet.
LONGEST = 0.1
#: Vectors and queries of a block at most, about.
BLOCK_VECTORS, BLOCK_QUERIES = 1024, 512
SEED = 20240607


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotations(x: np.ndarray) -> Iterator[np.ndarray]:
    """The vectors of x (padded to a power of two) under the pseudo-rotation of each table."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.default_rng([SEED, size]).choice([-1.0, 1.0], size=(TABLES, 3, size))
    for table in range(TABLES):
        y = x
        for s in signs[table]:
            y = _hadamard(y * s)
        yield y


def axes(y: np.ndarray, k: int) -> np.ndarray:
    """(vectors, k) codes of the k nearest signed axes, nearest first: 2 * axis, and 1 more where negative."""
    both = np.stack([-y, y], axis=2).reshape(len(y), -1)
    return np.argsort(both, axis=1, kind="stable")[:, : min(k, both.shape[1])]


def _coded():
    """Rows (is_query, table, code, dim, id, v) of a batch of (id, v): one per table, and for queries one per probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("v")
            query = batch.column("is_query").to_numpy(zero_copy_only=False)
            dims = np.asarray(lists.value_lengths())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own = lists.take(pa.array(at))
                x = np.asarray(own.flatten()).reshape(len(at), d).astype(np.float64)
                for asks in (False, True):
                    rows = np.flatnonzero(query[at]) if asks else np.arange(len(at))
                    if not len(rows):
                        continue
                    for table, y in enumerate(rotations(x[rows])):
                        code = axes(y, PROBES if asks else 1)
                        who = np.repeat(rows, code.shape[1])
                        n = len(who)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, asks)), pa.array(np.full(n, table, np.int32)), pa.array(code.reshape(-1).astype(np.int32)),
                             pa.array(np.full(n, d, np.int32)), pa.array(ids[at][who]), own.take(pa.array(who))],
                            names=["is_query", "table", "code", "dim", "id", "v"])
    return run


def _ranked(k: int):
    def run(block: pa.Table) -> pa.Table:
        query = block.column("is_query").to_numpy(zero_copy_only=False)
        ids = block.column("id").to_numpy()
        dim = block.column("dim")[0].as_py()
        x = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim).astype(np.float64)
        c = np.flatnonzero(~query)
        c = c[np.argsort(ids[c], kind="stable")]
        out: tuple[list, list, list] = ([], [], [])
        if len(c):
            candidates = x[c]
            for q in np.flatnonzero(query):
                # A product of matrices may round differently with its shape: it only tells which rows can be among the
                # best, whose scores are then summed in one fixed order, so that equal vectors tie.
                rough = candidates @ x[q]
                rough[ids[c] == ids[q]] = -np.inf
                near = np.arange(len(c))
                if len(c) > k:
                    slack = 1e-12 * (1.0 + np.abs(x[q]).sum() * np.abs(candidates).max())
                    near = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - slack)
                near = near[rough[near] > -np.inf]
                score = np.zeros(len(rough))
                score[near] = (candidates[near] * x[q]).sum(axis=1)
                best = near[np.argsort(-score[near], kind="stable")[:k]]
                for column, values in zip(out, (np.full(len(best), ids[q]), ids[c][best], score[best]), strict=True):
                    column.append(values)
        joined = [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": joined[0], "vec_id": joined[1], "score": joined[2]})
    return run


def _met(coded: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k rows of each query in each block of a bucket that it meets."""
    # At most tables * axes rows for each length of vectors.
    bucket = ["table", "code", "dim"]
    vectors = coded.where("not is_query").groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("nv"))
    asking = coded.where("is_query").groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq"))
    blocks = scratch.write(vectors.join(asking, bucket), "blocks")
    dealt = coded.join(F.broadcast(blocks), bucket)
    part = F.xxhash64("id", F.lit(1))
    both = dealt.select("is_query", *bucket, "id", "v", F.explode(F.when(
        F.col("is_query"), F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda i: F.struct(i.alias("a"), F.pmod(part, F.col("nq")).cast("int").alias("b")))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda i: F.struct(F.pmod(part, F.col("nv")).cast("int").alias("a"), i.alias("b"))))).alias("block"))
    return both.groupBy(*bucket, "block").applyInArrow(_ranked(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, scratch: Scratch, queries, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k others of largest inner product found.

    Scores are exact, in double precision; ties go to the smaller id. Null ids and vectors, empty and zero
    vectors and those with a null, NaN or infinite component take no part. Vectors meet only others of their
    length. Rows that repeat an id are one candidate (with the best score) and never their own neighbour.
    """
    v = col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(col(id_col).isNotNull() & sound).select(col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = scratch.write(rows, "rows")
    coded = scratch.write(rows.mapInArrow(_coded(), "is_query boolean, table int, code int, dim int, id long, v array<double>"), "coded")

    # The bucket of the longest: those above the percentile of their dimension, and all queries of it. Equal norms are not above it.
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sized = rows.withColumns({"table": F.lit(-1), "code": F.lit(0), "dim": F.size("v"), "norm": norm})
    cut = sized.groupBy("dim").agg(F.percentile_approx("norm", 1 - LONGEST, 10_000).alias("cut"))
    columns = ["is_query", "table", "code", "dim", "id", "v"]
    long = sized.join(cut, "dim").where(F.col("norm") > F.col("cut")).withColumn("is_query", F.lit(False)).select(*columns)
    longest = scratch.write(long.unionByName(sized.where("is_query").select(*columns)), "longest")

    found = scratch.write(_met(coded.unionByName(longest), scratch, k), "found")

    # Queries with fewer than k rows: their exact rows, from all vectors of their length.
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    one = [F.lit(0).alias(c) for c in ("table", "code")] + [F.size("v").alias("dim"), "id", "v"]
    short = scratch.write(rows.where("is_query").join(enough, "id", "left_anti").select(F.lit(True).alias("is_query"), *one), "short")
    if not short.isEmpty():
        everyone = rows.select(F.lit(False).alias("is_query"), *one).join(F.broadcast(short.select("dim").distinct()), "dim", "left_semi")
        exact = _met(scratch.write(short.unionByName(everyone), "exact"), scratch, k)
        found = found.unionByName(scratch.write(exact, "found-exact"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return best.withColumn("rank", top).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, Scratch(spark, "nearest"), F.col("vec_id") % 20 == 0)
