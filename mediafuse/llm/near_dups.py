"""Near-duplicate groups: min-max MinHash banding finds candidates, full shingle sets confirm them.

A permutation gives two signature values, the smallest and the largest image, so the hash evaluations
are half of the signature's length; both agree with probability J for sets of Jaccard similarity J.

Shape of the job: one map over the texts gives each document the identity of its set, its bands and a
sketch of one bit of each signature value; documents of equal sets become one representative before
anything is grouped. In each bucket the representatives are first measured against one of them, the hub:
the one that meets most others in all its buckets, so that the hub of a group of copies is the same in
nearly all bands and lies at the group's centre. Buckets that then still hold several groups get a second
hub among those that did not join the first. What is left is compared member by member, in blocks of
bounded size: those whose overlap with a hub is known, once a hub and not once a bucket. Each carries a bit
for every shingle of the hub that it holds, so that of two of them the overlap inside the hub is known without
their sets, and outside of it no more can be common than the smaller of the two has there; pairs that this
rules out go no further. The sketch removes hopeless pairs before any set is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.llm import wordhash as W
from mediafuse.operators.components import connected_components, extended_components
from mediafuse.llm.columns import col
from mediafuse.operators.scratch import Scratch

#: Pairs with one hub that are measured side by side.
PAIRS_A_SET = 2048
#: A pair of similarity 0.8 shares none of 64 bands of 7 values with probability (1 - 0.8**7)**64 = 3e-7.
BANDS, ROWS = 64, 7
#: Of the 448 bits of a sketch a pair of similarity 0.8 differs in 44.8 on average with a deviation of 6.4, and in more than 80 with probability 1e-7.
SKETCH_LONGS, SKETCH_LIMIT = BANDS * ROWS // 64, 80
#: Rounds of hubs.
HUBS = 2
#: Members of a hub or a bucket are compared in blocks: each block of about so many of them meets all members.
BLOCK = 512


def _seeds(n: int, stream: int) -> np.ndarray:
    return W.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream))


_PERMS = (BANDS * ROWS + 1) // 2
_MUL = (_seeds(_PERMS, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_seeds(_PERMS, 12) >> np.uint64(32)).astype(np.uint32)


def minmax_signatures(shingles: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """(sets, 2 * permutations) of uint32: all minima, then all maxima. Every set must have a shingle."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * _PERMS, len(bound) - 1), dtype=np.uint32)
    v = np.empty_like(x)
    for k in range(_PERMS):
        np.multiply(x, _MUL[k], out=v)
        v += _ADD[k]
        v ^= v >> np.uint32(15)
        out[k] = np.minimum.reduceat(v, bound[:-1])
        out[_PERMS + k] = np.maximum.reduceat(v, bound[:-1])
    return np.ascontiguousarray(out.T)


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """(sets, BANDS) of int64; a band holds ROWS values of as many different permutations."""
    n = len(signatures)
    sig = signatures[:, : BANDS * ROWS].astype(np.uint64).reshape(n, BANDS, ROWS)
    h = np.broadcast_to(_seeds(BANDS, 15), (n, BANDS)).copy()
    for r in range(ROWS):
        h = W.mix(h * np.uint64(3) + sig[:, :, r])
    return h.view(np.int64)


def sketches_of(signatures: np.ndarray) -> np.ndarray:
    """(sets, SKETCH_LONGS) of int64: a scrambled bit of each signature value."""
    bit = (signatures * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bit.astype(np.uint8), axis=1).view(np.int64)


def _list_column(flat: np.ndarray, bound: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(flat.view(np.int64)))


def _sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, off in W.slices(texts):
        h, _, _, wb = W.words(data, off)
        yield (i, j, *W.distinct_sorted(*W.word_shingles(h, wb, k)))


def _keys_of(s: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(sets, 2) of int64, the identity of each set: two sums of different scramblings of its members."""
    key = np.zeros((len(b) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(b))
    if len(full):
        at = b[:-1][full]
        for c, m in enumerate((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)):
            key[full, c] = np.add.reduceat(W.mix(s * np.uint64(m)), at)
    return key.view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s, b in _sets_of(batch.column("text"), k):
                size = np.diff(b)
                key = _keys_of(s, b)
                bands = np.zeros((j - i, BANDS), dtype=np.int64)
                sketch = np.zeros((j - i, SKETCH_LONGS), dtype=np.int64)
                full = np.flatnonzero(size)
                if len(full):
                    fb = np.concatenate([b[:-1][full], b[-1:]])
                    sig = minmax_signatures(s, fb)
                    bands[full], sketch[full] = bands_of(sig), sketches_of(sig)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(key[:, 0]), pa.array(key[:, 1]),
                     _list_column(sketch.reshape(-1), np.arange(j - i + 1) * SKETCH_LONGS), _list_column(bands.reshape(-1), np.arange(j - i + 1) * BANDS)],
                    names=["id", "n", "k1", "k2", "sketch", "bands"])
    return run


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s, b in _sets_of(batch.column("text"), k):
                key = _keys_of(s, b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(key[:, 0]), pa.array(key[:, 1]), _list_column(s, b)], names=["id", "k1", "k2", "s"])
    return run


def _sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, s): the shingle set of each id; ids that several different texts carry have several rows."""
    texts = docs.join(ids, "id", "left_semi").select("id", "text")
    return texts.mapInArrow(_shingled(k), "id long, k1 long, k2 long, s array<long>").dropDuplicates(["id", "k1", "k2"]).select("id", "s")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the sorted sets sa and sb of pairs: their sizes, the size of the intersection, and for each member of sa whether sb holds it."""
    for batch in batches:
        sa, sb = batch.column("sa"), batch.column("sb")
        sizes, held, words = np.zeros((batch.num_rows, 3), dtype=np.int32), [], np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            x, y = (np.asarray(c[i].values).view(np.uint64) for c in (sa, sb))
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            has = y[at] == x
            bits = np.zeros(-(-len(x) // 64) * 8, dtype=np.uint8)
            packed = np.packbits(has)
            bits[: len(packed)] = packed
            held.append(bits.view(np.int64))
            sizes[i], words[i] = (len(x), len(y), int(has.sum())), len(bits) // 8
        bound = np.concatenate([[0], np.cumsum(words)])
        flat = np.concatenate(held) if held else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, sizes.T), _list_column(flat, bound)], names=["a", "b", "na", "nb", "common", "held"])


def _measured(pairs: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb, common, held) of the pairs (a, b): sizes of the full sets and of their intersection, and a's members that b holds as bits."""
    pairs = scratch.write(pairs.distinct(), "pairs")
    need = scratch.write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "need")
    sets = scratch.write(_sets(need, docs, k), "sets")
    # A hub's set goes once to each PAIRS_A_SET of its pairs, to which the others' sets come: it is not carried along with every pair.
    parts = scratch.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_SET).cast("int").alias("parts")), "parts")
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    hubs = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).join(parts, "a").select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(hubs, ["a", "part"])
    out = scratch.write(both.mapInArrow(_overlaps, "a long, b long, na int, nb int, common int, held array<long>"), "measured")
    scratch.drop(need, sets, pairs, parts)
    return out


def near_duplicate_groups(docs: DataFrame, scratch: Scratch, shingle_words: int = 5, percent: int = 80,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct shingles of
    ``shingle_words`` words, or the whole sequence if there are fewer. Null, empty and blank texts have an
    empty set and no link. Rows of equal sets are one class. component_id is the smallest id that links
    reach, kept says that it is the row's own. Repeated rows give equal rows. Rows that share an id but not a
    text each have the class of their own text; classes whose smallest id is the same count as linked. A null id
    takes no part in links and gives a null component. Texts of any length are read whole, block by block.
    The columns of docs but for the two named take no part, whatever their names.
    """
    base = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    signed = scratch.write(base.mapInArrow(_signed(shingle_words), "id long, n long, k1 long, k2 long, sketch array<long>, bands array<long>"), "signed")
    real = signed.where("n > 0 and id is not null")
    classes = scratch.write(real.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = scratch.write(
        real.join(classes.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"]).select("id", "n", "sketch", "bands"), "reps")
    slim = scratch.write(signed.select("id", "n", "k1", "k2"), "slim")
    scratch.drop(signed)
    differ = reduce(Column.__add__, (F.bit_count(F.get("sketcha", i).bitwiseXOR(F.get("sketchb", i))) for i in range(SKETCH_LONGS)))
    alike = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differ <= SKETCH_LIMIT)
    enough = lambda common: (100 + percent) * common >= percent * (F.col("na") + F.col("nb"))

    def linked(measured: DataFrame, parts: DataFrame | None) -> DataFrame:
        """The components of the measured pairs that are links, and of ``parts``."""
        links = scratch.write(measured.where(enough(F.col("common"))).select("a", "b").distinct(), "links")
        return connected_components(links, scratch) if parts is None else extended_components(parts, links, scratch)

    def labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """rows of the buckets that hold several groups, with each row's group as ``label`` and that of the bucket's hub as ``of_hub``."""
        named = scratch.write(rows.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), "labels")
        mixed = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("label", F.struct("score", "id")).alias("of_hub")).where("lo < hi")
        out = scratch.write(named.join(mixed.select("band", "of_hub"), "band"), "rest")
        scratch.drop(named)
        return out

    banded = reps.select("id", F.explode("bands").alias("band"))
    buckets = scratch.write(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    member = scratch.write(banded.join(buckets, "band"), "members")
    # A row of several texts under one id has the largest of their scores, too.
    score = member.groupBy("id").agg(F.sum("m").alias("score"))
    rest = scratch.write(member.join(score, "id").join(reps.select("id", "n", "sketch"), "id"), "scored")
    scratch.drop(buckets, member)
    parts, overlaps, every = None, [], [rest]
    for turn in range(HUBS):
        candidates = rest if turn == 0 else rest.where("label <> of_hub")
        hub = F.max_by(F.struct("id", "n", "sketch"), F.struct("score", "id")).alias("h")
        hubs = scratch.write(candidates.groupBy("band").agg(hub).select("band", F.col("h.id").alias("a"), F.col("h.n").alias("na"), F.col("h.sketch").alias("sketcha")), "hubs")
        member = rest.select("band", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketchb"))
        pairs = member.join(hubs, "band").where((F.col("a") != F.col("b")) & alike).select("a", "b")
        measured = _measured(pairs, base, shingle_words, scratch)
        parts = linked(measured, parts)
        known = measured.groupBy(F.col("a").alias(f"hub{turn}"), F.col("b").alias("id")).agg(F.max_by(F.struct("common", "held"), "common").alias(f"in{turn}"))
        overlaps.append((hubs.select("band", F.col("a").alias(f"hub{turn}")), known))
        rest = labelled(rest.drop("label", "of_hub"), parts)
        every.append(rest)

    for turn, (hubs, known) in enumerate(overlaps):
        rest = rest.join(hubs, "band", "left").join(known, [f"hub{turn}", "id"], "left")
    turns = range(HUBS)
    shown = ["id", "label", "n", "sketch", *(f"hub{t}" for t in turns), *(f"in{t}" for t in turns)]
    rest = scratch.write(rest.where(reduce(Column.__and__, (~F.col("id").eqNullSafe(F.col(f"hub{t}")) for t in turns))).select("band", "m", *shown), "open")
    side = lambda rows, x, key, block: rows.select(*key, block.alias("block"), *(F.col(c).alias(f"{c}{x}") for c in shown if c not in key))
    one_of = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    all_of = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocks = lambda m: F.ceil(F.col(m) / F.lit(BLOCK)).cast("int").alias("blocks")

    def possible(t: int, same: Column) -> Column:
        a, b = F.col(f"in{t}a"), F.col(f"in{t}b")
        inside = F.aggregate(F.zip_with(a.held, b.held, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
        return F.coalesce(~same | enough(inside + F.least(F.col("na") - a.common, F.col("nb") - b.common)), F.lit(True))

    apart = (F.col("labela") != F.col("labelb")) & alike
    same_second = [F.col(f"hub{t}a") == F.col(f"hub{t}b") for t in turns[1:]]
    # Those that the first hub's overlap is known of, once a hub.
    near = rest.where("in0 is not null").groupBy("hub0", "id").agg(*(F.max_by(c, "band").alias(c) for c in shown if c not in ("hub0", "id")))
    near = scratch.write(near, "near")
    near = scratch.write(near.join(near.groupBy("hub0").agg(F.count("*").alias("m")), "hub0").withColumn("blocks", blocks("m")), "by-hub")
    met = side(near, "a", ["hub0"], one_of).join(side(near, "b", ["hub0"], all_of), ["hub0", "block"]).where(
        (F.col("ida") < F.col("idb")) & apart & reduce(Column.__and__, [possible(0, F.lit(True)), *(possible(t, s) for t, s in zip(turns[1:], same_second, strict=True))])).select("ida", "idb")
    # All others by bucket.
    rest = rest.withColumn("blocks", blocks("m"))
    far = side(rest.where("in0 is null"), "a", ["band"], one_of)
    met_far = far.join(side(rest, "b", ["band"], all_of), ["band", "block"]).where(
        (F.col("in0b").isNotNull() | (F.col("ida") < F.col("idb"))) & apart & reduce(Column.__and__, [F.lit(True), *(possible(t, s) for t, s in zip(turns[1:], same_second, strict=True))])).select(
        F.least("ida", "idb").alias("ida"), F.greatest("ida", "idb").alias("idb"))
    crossed = met.unionByName(met_far)
    crossed = scratch.write(crossed.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "crossed")
    if not crossed.isEmpty():
        parts = linked(_measured(crossed, base, shingle_words, scratch), parts)

    named = scratch.write(classes.join(parts, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component_id")), "named")
    scratch.drop(reps, rest, near, classes, crossed, *every)
    return slim.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: two-word shingles over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_groups(docs, Scratch(spark, "near-dups"), shingle_words=2).withColumnRenamed("id", "doc_id")
