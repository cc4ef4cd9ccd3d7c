"""Benchmark items inside documents: SimHash fingerprints of item-sized windows, a multi-index over
their blocks, then the exact weighted-shingle similarity. DataFrame functions only.

A window has an item's number of words and starts at any word, or is the whole text where that is shorter.
Which item it resembles is for the fingerprints to tell; but a window that can reach the similarity with some
item of its size holds a least number of shingles that such items have, so all others are passed over without
a fingerprint. This is a bound and loses nothing that the last step would keep, wherever words were moved,
left out or put in. Every 8-bit block of an item's fingerprint is indexed with all values up to FLIPS bits away,
so that by the pigeonhole principle every window within RADIUS bits meets its item in one of the 8 blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.llm.columns import col, free
from mediafuse.operators.scratch import Scratch

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
#: A window of the similarity differs from its item in some 9 bits on average, and in more than this hardly ever.
RADIUS = (FLIPS + 1) * BLOCKS - 1
_MASKS = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n)]
#: A table of at most so many values (8 bytes each) is sent to all tasks; a larger one is shuffled.
BROADCAST_VALUES = 2_000_000


def _words(text: Column) -> Column:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text."""
    return F.transform(F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, k: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(
        F.array().cast("array<long>"))


def fingerprint(words: Column) -> Column:
    """64-bit SimHash: a bit is set where more than half of the words' hashes have it."""
    ones = lambda b: F.aggregate(words, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
    bit = lambda b: F.when(2 * ones(b) > F.size(words), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _blocks(fp: Column, masks: list[int]) -> Column:
    """array<struct<block, value>>: the blocks of a fingerprint, each under every mask."""
    block = lambda b: F.call_function("shiftrightunsigned", fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    flipped = lambda b: F.transform(F.lit(masks), lambda m: F.struct(b.alias("block"), block(b).bitwiseXOR(m).alias("value")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), flipped))


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    times = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s)))


def _starts(similarity: float, shingle: int) -> Column:
    """All starts of windows of n words (of n_words, if fewer) with enough of the positions ``at`` for the similarity."""
    size, width = F.least("n", F.lit(shingle)), F.least("n", "n_words")
    # common / (a + b - common) >= similarity, where common is at most the number of positions in the window.
    need = F.greatest(F.lit(1), F.ceil(similarity * (F.col("n") + width - 2 * size + 2) / (1 + similarity) - 1e-9).cast("int"))
    last = lambda i: F.get("at", i + need - 1)
    runs = F.filter(F.sequence(F.lit(0), F.size("at") - need), lambda i: last(i) - F.get("at", i) <= width - size)
    starts = F.transform(runs, lambda i: F.sequence(F.greatest(F.lit(0), last(i) - width + size), F.least(F.get("at", i), F.col("n_words") - width)))
    return F.when(F.size("at") >= need, F.array_distinct(F.flatten(starts)))


def _sent(df: DataFrame, values: Column | int) -> DataFrame:
    """df for a join: broadcast if its rows, of so many values each, are few enough."""
    values = F.lit(values) if isinstance(values, int) else values
    return F.broadcast(df) if (df.agg(F.sum(values)).first()[0] or 0) <= BROADCAST_VALUES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, shingle: int = SHINGLE, similarity: float = SIMILARITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, item_id, similarity, first_word) for every pair of a document and an item it holds.

    The similarity is that of the best window: shingle multisets of ``shingle`` words, weighted Jaccard.
    An item of fewer words has one shingle of all its words. Null, empty and blank texts and items match
    nothing. k is a hash of id and text that tells rows of equal or null id apart; repeated rows give one
    result. Items with a null item_id are kept apart by their text only. Texts are searched whole, however
    long; columns other than the named ones take no part.
    """
    words = F.col("words")
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct().select(
        "item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(shingle)).alias("k"))
    items = scratch.write(items.withColumns({"fp": fingerprint(words), "row": F.monotonically_increasing_id()}), "items")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]

    base = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(id_col), col(text_col)).alias("k"), col(text_col).alias("text"))
    parts, with_shingles = [], []
    for k in sizes:
        own = items.where(F.col("k") == k).withColumn("shingles", _shingles(words, k))
        with_shingles.append(own)
        keys = own.select("n", F.explode("shingles").alias("s")).distinct()
        found = base.select("doc_id", "k", _words(F.col("text")).alias("words")).select("doc_id", "k", F.size("words").alias("n_words"), F.posexplode(_shingles(words, k)).alias("pos", "s"))
        parts.append(found.join(_sent(scratch.write(keys, "keys"), 2), "s").select("doc_id", "k", "n_words", "n", "pos"))
    if not sizes:
        return scratch.write(base.select("doc_id", "k", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word")).limit(0), "none")
    hits = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "k", "n_words", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    placed = scratch.write(hits.select("doc_id", "k", "n", F.explode(_starts(similarity, shingle)).alias("start")), "placed")

    starts = placed.groupBy("doc_id", "k").agg(F.collect_set(F.struct("start", "n")).alias("windows")).select(
        F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "windows")
    held = base.join(_sent(scratch.write(starts, "starts"), 2 + 2 * F.size("windows")), (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "doc_id", "k", _words(F.col("text")).alias("words"), "windows").select("doc_id", "k", F.explode(F.transform("windows", lambda w: F.struct(
            w.start.alias("start"), w.n.alias("n"), F.slice("words", w.start + 1, w.n).alias("words")))).alias("w")).select("doc_id", "k", "w.*")
    windows = scratch.write(held.withColumn("fp", fingerprint(words)), "windows")

    # The index holds numbers of items, and probes those of windows: words are joined back to the pairs that pass.
    index = items.select("row", "n", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"), _MASKS)).alias("e")).select("row", "n", "item_fp", "e.block", "e.value")
    probes = windows.select("doc_id", "k", "start", "n", "fp", F.explode(_blocks(F.col("fp"), [0])).alias("e")).select("doc_id", "k", "start", "n", "fp", "e.block", "e.value")
    pairs = probes.join(_sent(scratch.write(index, "index"), 4), ["n", "block", "value"]).where(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("doc_id", "k", "start", "n", "row").distinct()
    pairs = scratch.write(pairs, "pairs")
    own = windows.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), F.col("start").alias("_start"), F.col("n").alias("_n"), "words")
    here = (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_start")) & (F.col("n") == F.col("_n"))
    near = pairs.join(own, here).join(_sent(items.select("row", "item_id", F.col("k").alias("size"), F.col("words").alias("item")), 3 + F.size("item")), "row").select("doc_id", "k", "start", "size", "words", "item_id", "item")
    near = scratch.write(near, "near")
    size_cases = lambda c: reduce(lambda x, y: F.coalesce(x, y), (F.when(F.col("size") == k, _shingles(F.col(c), k)) for k in sizes))
    scored = near.withColumns({"a": size_cases("words"), "b": size_cases("item")}).withColumn("common", _common(F.col("a"), F.col("b")))
    scored = scored.withColumn("similarity", F.col("common") / (F.size("a") + F.size("b") - F.col("common"))).where(F.col("similarity") >= similarity)
    return scored.groupBy("doc_id", "k", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs without the rows that hold an item; all other rows and all columns stay."""
    key, ident = free(docs, "k", "id")
    bad = scratch.write(contaminated(docs, benchmark, scratch, id_col=id_col, text_col=text_col, **more).select(
        F.col("doc_id").alias(ident), F.col("k").alias(key)).distinct(), "bad")
    return docs.join(_sent(bad, 2), (F.xxhash64(col(id_col), col(text_col)) == F.col(key)) & col(id_col).eqNullSafe(F.col(ident)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the leaks, one row per document and item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items, Scratch(spark, "decontaminate")).drop("k")
