"""Importance resampling towards a target: documents are drawn, without replacement, by hashed-feature weights.

Two passes over the texts. The first counts the features of the corpus and of the target in a fixed number
of buckets; the second adds up each document's gains from one array of that size. Each partition's eligible
rows are then a sorted run, written to the shared folder. The runs are cut into ranges of the order, of
bounded size; a task merges the segments of its range, one for each run that reaches into it, by a tournament
tree, emits ranks from the number of rows in the ranges before it, and stops where the draw is complete.
Rows that the draw cannot reach are never shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.llm import wordhash as W
from mediafuse.llm.columns import col
from mediafuse.operators.scratch import Scratch

BUCKETS, LEAST_WORDS, PERCENT, RUNS_OF, SEED = 10_000, 20, 10, 1, "2024"
#: Rows of a range that one task merges, about.
RANGE_ROWS = 100_000
#: Bytes of a word that are hashed side by side with other words'; the rest of longer ones goes one by one.
_SIDE_BY_SIDE = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def _fed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each range."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, at, size = state[order], start[order], size[order]
    for i in range(min(int(size[0]) if len(size) else 0, _SIDE_BY_SIDE)):
        n = int(np.searchsorted(-size, -i, side="left"))  # those of more than i bytes
        s[:n] = _CRC[(s[:n] ^ data[at[:n] + i]) & 255] ^ (s[:n] >> np.uint32(8))
    for j in range(int(np.searchsorted(-size, -_SIDE_BY_SIDE, side="left"))):
        rest = data[at[j] + _SIDE_BY_SIDE : at[j] + size[j]].tobytes()
        s[j] = np.uint32(zlib.crc32(rest, int(s[j] ^ _ALL))) ^ _ALL
    out = np.empty_like(s)
    out[order] = s
    return out


def feature_buckets(data: np.ndarray, off: np.ndarray, runs_of: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the bucket of each run of 1 to runs_of words, the text it belongs to, and the texts' numbers of words."""
    low = W.lowered(data)
    start, end, bound = W.word_ranges(data, off, W.NO_ALNUM)
    text = np.repeat(np.arange(len(off) - 1), np.diff(bound))
    state = np.full(len(start), _ALL, dtype=np.uint32)
    found, owner = [], []
    for k in range(runs_of):
        state = state[: max(0, len(start) - k)]
        if k:  # the run so far, a space and the next word, where that is of the same text
            state = _CRC[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8))
        state = _fed(state, low, start[k:], end[k:])
        inside = text[: len(state)] == text[k:]
        found.append(((state ^ _ALL) % np.uint32(buckets)).astype(np.int64)[inside])
        owner.append(text[: len(state)][inside])
    return np.concatenate(found), np.concatenate(owner), np.diff(bound)


def _counted(runs_of: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, off in W.slices(batch.column("text")):
                total += np.bincount(feature_buckets(data, off, runs_of, buckets)[0], minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", runs_of: int = RUNS_OF, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts: an array of fixed size, made from one such array a task."""
    rows = texts.select(col(text_col).cast("string").alias("text")).mapInArrow(_counted(runs_of, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus), for each bucket."""
    size, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _weighed(gains, runs_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = gains.value
        for batch in batches:
            for i, j, data, off in W.slices(batch.column("text")):
                bucket, text, n_words = feature_buckets(data, off, runs_of, len(of))
                weight = np.zeros(j - i, dtype=np.int64)
                np.add.at(weight, text, of[bucket])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.bincount(text, minlength=j - i)), pa.array(n_words.astype(np.int64)), pa.array(weight)],
                                                 names=["doc_id", "n_features", "n_words", "weight"])
    return run


def merged(segments: list[tuple[int, int]], key: list[tuple], want: int) -> list[int]:
    """Places of the ``want`` smallest keys in order; segments are (first, after the last) of ascending keys. A tournament tree of the segments' heads."""
    end_key = (math.inf,)
    leaves = 1 << max(0, (len(segments) - 1).bit_length())
    at, end = [a for a, _ in segments], [b for _, b in segments]
    head = [key[a] if a < b else end_key for a, b in segments] + [end_key] * (leaves - len(segments))
    tree = [0] * leaves + list(range(leaves))
    for i in range(leaves - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if head[x] <= head[y] else y
    out: list[int] = []
    while len(out) < want and head[best := tree[1]] is not end_key:
        out.append(at[best])
        at[best] += 1
        head[best] = key[at[best]] if at[best] < end[best] else end_key
        i = (leaves + best) >> 1
        while i:
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if head[x] <= head[y] else y
            i >>= 1
    return out


_ROW = "doc_id long, n_features long, weight long, score long"


def _range_ranked(rows: pa.Table) -> pa.Table:
    """The rows of one range, ranked as far as its quota goes."""
    before, want = rows.column("before")[0].as_py(), rows.column("want")[0].as_py()
    rows = rows.sort_by([("run", "ascending"), ("pos", "ascending")])  # the segments as the runs were written
    run = rows.column("run").to_numpy()
    cut = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    key = list(zip((-rows.column("score").to_numpy()).tolist(), rows.column("doc_id").to_pylist(), rows.column("pos").to_pylist(), strict=True))
    order = merged(list(zip(cut[:-1], cut[1:], strict=True)), key, want)
    rank = np.zeros(len(run), dtype=np.int64)
    rank[order] = np.arange(before + 1, before + 1 + len(order))
    return rows.select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, mask=rank == 0))


def _reach(eligible: DataFrame, n: int, k: int) -> int:
    """A score that at least k of the n rows have: near the k-th, from below."""
    slack = 0.002
    while True:
        c = eligible.agg(F.percentile_approx("score", max(0.0, 1 - k / n - slack), 10_000).alias("c")).first().c
        if slack >= 1 or eligible.where(F.col("score") >= c).count() >= k:
            return c
        slack *= 4


def ranked_draw(scored: DataFrame, scratch: Scratch, k: int, n: int) -> DataFrame:
    """scored (doc_id, n_features, weight, score, eligible) with ``rank`` 1 to k of the eligible by (score descending, doc_id); null elsewhere.

    n is the number of eligible rows. Each partition's rows are sorted and written once: its run.
    """
    unranked = lambda df: df.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if k <= 0:
        return unranked(scored)
    order = [F.desc("score"), F.asc("doc_id")]
    eligible = scored.where("eligible")
    cut = _reach(eligible, n, k)
    reached = F.col("eligible") & (F.col("score") >= cut)
    runs = scratch.write(scored.where(reached).sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("pos")), "runs")
    ranges = max(1, math.ceil(runs.count() / RANGE_ROWS))
    dealt = scratch.write(runs.repartitionByRange(ranges, *order, F.asc("pos")).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))  # one row a range
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", F.coalesce("before", F.lit(0)).alias("before"))
    quota = before.withColumn("want", F.greatest(F.lit(0), F.lit(k) - F.col("before"))).where("want > 0")
    whole = dealt.join(F.broadcast(quota), "range", "left")
    drawn = whole.where("want is not null").groupBy("range").applyInArrow(_range_ranked, _ROW + ", rank long")
    return drawn.unionByName(unranked(whole.where("want is null"))).unionByName(unranked(scored.where(~F.coalesce(reached, F.lit(False)))))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs_of: int = RUNS_OF,
             buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; ``percent`` of those with ``least_words`` words get a rank.

    The weight is the sum of the gains of a document's features, runs of 1 to ``runs_of`` words; the score adds
    noise that depends on the seed and the id alone, so that taking the highest scores draws without replacement
    in proportion to the weights. Null and empty texts have no features and weight 0. A row without an id has no
    score and takes no part in the draw, though its text counts in the corpus. Repeated rows count each; rows of
    one score and id are ranked one after the other. Texts of any length are read whole. An empty table gives
    no rows; an empty target leaves the corpus counts alone. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    base = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(base, "text", runs_of, buckets), bucket_counts(target, target_col, runs_of, buckets))
    weighed = base.mapInArrow(_weighed(spark.sparkContext.broadcast(gains), runs_of), "doc_id long, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + noise).select(
        "doc_id", "n_features", "weight", "score", ((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()).alias("eligible")), "scored")
    n = scored.where("eligible").count()
    return ranked_draw(scored, scratch, percent * n // 100, n)


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return resample(read("documents"), read("benchmark"), Scratch(spark, "resample"))


SQL = f"""
WITH bit AS (SELECT list(c ORDER BY n) AS tab FROM (
  SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS n))),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts),
counted AS (SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST(concat('0x', substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM counted)), bit),
featured AS (SELECT side, id, bucket, n FROM counted JOIN hashed USING (w)),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM featured),
gains AS (SELECT bucket, CAST(floor(1000 * ln((f.t + 1) * (totals.s + {BUCKETS}) / ((f.s + 1) * (totals.t + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM featured GROUP BY bucket) AS f, totals),
weights AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM featured JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('{SEED}:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
