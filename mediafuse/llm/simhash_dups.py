"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of a covering code: five perfect codes side by side on 63 of a fingerprint's 64 bits, two
Golay codes of length 23 and repetition codes of lengths 5, 5 and 7, so 2^27 anchors. In each of its five parts a
fingerprint lies within the code's covering radius of one word; these words are its home. Fingerprints within
``radius`` bits of each other differ by at most so many in the parts together; therefore the one reaches the
other's home within the covering radii and that many bits. Each fingerprint is replicated to all anchors so near
(432 on average for 3 bits) and compared, at each, with the fingerprints at home there.

Equal fingerprints are one row before anything is replicated, and anchors that are nobody's home are left out
(they are known from a bitmap of 16 MB, whatever the size of the corpus). An anchor whose comparisons stand out is
dealt out in blocks. A task returns spanning stars of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafuse.llm import wordhash as W
from mediafuse.llm.columns import col
from mediafuse.operators.components import connected_components
from mediafuse.operators.scratch import Scratch

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: The binary Golay code: length, covering radius, generator polynomial. Fixed values.
LENGTH, COVERING, GENERATOR = 23, 3, 0b101011100011
MASK = (1 << LENGTH) - 1
#: Lengths of the repetition codes behind the two Golay codes.
REPEATED = (5, 5, 7)
ANCHORS = 1 << (24 + len(REPEATED))
#: Home and replicated fingerprints of a block of an anchor whose comparisons are dealt out, and comparisons made at a time.
HOMES, MEMBERS, AT_ONCE = 2048, 8192, 1 << 20
#: An anchor is dealt out beyond so many comparisons and this multiple of the mean, so that 2^27 / 512 are, at most.
LARGE, TIMES = 1 << 22, 512
#: Fingerprints of more rows than this are joined back by broadcast; there is at most one for each so many rows.
HOT_ROWS = 10_000
_U = np.uint64


# -- fingerprints ------------------------------------------------------------------------------------------------

_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=_U)


def _bit_counts(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """(texts, 64): how many of each text's hashes have each bit set."""
    out = np.zeros((len(bound) - 1, 64), dtype=np.int64)
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    if len(h):
        within = np.arange(len(h)) - bound[:-1][text]
        first = np.flatnonzero(within % 255 == 0)  # 255 ones fit a lane of 8 bits
        lanes = _LANES[h.astype("<u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, first, axis=0).astype("<u8").view(np.uint8).reshape(len(first), 64)
        np.add.at(out, text[first], sums.astype(np.int64))
    return out


def _joined(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts with one space after each word, and start, end and bounds of the words therein."""
    start, end, bound = W.word_ranges(data, off)
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = W.lowered(data)[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
    return out.tobytes(), at[:-1], at[1:] - 1, bound


def _block_counts(data: np.ndarray, off: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bit counts and numbers of shingles of texts; ``whole``: fewer words than k are one shingle."""
    raw, start, end, bound = _joined(data, off)
    n = np.diff(bound)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1) if whole else 0)
    ends = np.concatenate([[0], np.cumsum(m)])
    at = np.arange(int(ends[-1])) - np.repeat(ends[:-1] - bound[:-1], m)
    stop = end[at + np.repeat(np.minimum(n, k) - 1, m)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], SEED) for a, b in zip(start[at].tolist(), stop.tolist(), strict=True)], dtype=_U)
    return _bit_counts(h, ends), m


def _pieces(data: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """A long text in blocks that end between words, each with the k - 1 words before it."""
    gap = np.flatnonzero(W.SPACE[data])
    at, n = 0, len(data)
    while at < n:
        i = int(np.searchsorted(gap, at + W.SLICE_BYTES))
        end = int(gap[i]) if i < len(gap) else n
        yield data[(_back(data, at, k - 1) if at and k > 1 else at) : end]
        at = end


def _back(data: np.ndarray, at: int, words: int) -> int:
    """Where the last ``words`` words before ``at`` begin (``at`` is between words)."""
    reach = W.SLICE_BYTES
    while True:
        low = max(0, at - reach)
        start, _, _ = W.word_ranges(data[low:at], np.array([0, at - low]))
        if low == 0 or len(start) > words:
            return low + int(start[-words]) if len(start) >= words else low
        reach *= 4


def fingerprints(data: np.ndarray, off: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text (bytes and offsets): a bit is set where over half of the shingles' hashes have it."""
    if len(off) == 2 and len(data) > 2 * W.SLICE_BYTES:  # one long text
        counts, n = np.zeros((1, 64), np.int64), np.zeros(1, np.int64)
        for piece in _pieces(data, k):
            c, m = _block_counts(piece, np.array([0, len(piece)]), k, False)
            counts, n = counts + c, n + m
        if n[0] == 0:
            counts, n = _block_counts(data, off, k, True)
    else:
        counts, n = _block_counts(data, off, k, True)
    return ((2 * counts > n[:, None]).astype(_U) << np.arange(64, dtype=_U)).sum(axis=1, dtype=_U)


def _marked(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(fingerprints(data, off, k).view(np.int64))], names=["doc_id", "fp"])
    return run


# -- anchors -----------------------------------------------------------------------------------------------------


def _remainder(v: np.ndarray) -> np.ndarray:
    """The syndrome of words of 23 bits: the remainder by the generator polynomial."""
    v = v.copy()
    for i in range(LENGTH - 1, LENGTH - 13, -1):
        v = np.where((v >> i) & 1, v ^ (GENERATOR << (i - 11)), v)
    return v


@cache
def _errors(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to COVERING + radius bits, ordered by syndrome and excess (bits beyond COVERING); the first
    pattern of each syndrome; and, by syndrome and excess, how many have no greater excess."""
    pattern, weight = [0], [0]
    for w in range(1, COVERING + radius + 1):
        for bits in combinations(range(LENGTH), w):
            pattern.append(sum(1 << b for b in bits))
            weight.append(w)
    pattern, excess = np.array(pattern, dtype=np.int64), np.maximum(0, np.array(weight) - COVERING)
    syndrome = _remainder(pattern)
    order = np.lexsort((excess, syndrome))
    pattern, excess, syndrome = pattern[order], excess[order], syndrome[order]
    first = np.searchsorted(syndrome, np.arange(2048))
    upto = np.stack([np.bincount(syndrome[excess <= x], minlength=2048) for x in range(radius + 1)], axis=1)
    return pattern, excess, np.concatenate([first[:, None], upto], axis=1)


@cache
def _repeated(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the bits behind the Golay codes: its home among the words of the repetition codes, and the excess of each of them."""
    value = np.arange(1 << sum(REPEATED))
    home, excess, at = np.zeros(len(value), np.int64), np.zeros((len(value), 1 << len(REPEATED)), np.int64), 0
    for i, n in enumerate(REPEATED):
        ones = np.bitwise_count((value >> at) & ((1 << n) - 1)).astype(np.int64)
        home |= (2 * ones > n).astype(np.int64) << i
        for word in range(1 << len(REPEATED)):
            excess[:, word] += np.maximum(0, (n - ones if (word >> i) & 1 else ones) - n // 2)
        at += n
    return home, np.minimum(excess, radius + 1).astype(np.uint8)


def _parts(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = fp.view(np.int64) if fp.dtype == _U else fp
    return v & MASK, (v >> LENGTH) & MASK, (v >> 2 * LENGTH) & ((1 << sum(REPEATED)) - 1)


def home_anchors(fp: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint in every part: 12 bits of either Golay word and a bit of each repetition."""
    pattern, _, of = _errors(RADIUS)
    *golay, rest = _parts(fp)
    x, y = ((v ^ pattern[of[_remainder(v), 0]]) >> 11 for v in golay)
    return (((x << 12) | y) << len(REPEATED)) | _repeated(RADIUS)[0][rest]


def near_anchors(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within the covering radius in every part, and ``radius`` bits more in the parts together."""
    pattern, excess, of = _errors(radius)
    x, y, rest = _parts(fp)
    sx, sy = _remainder(x), _remainder(y)
    n = of[sy, 1 + radius]
    row = np.repeat(np.arange(len(fp)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + of[sy[row], 0]
    low, used = (y[row] ^ pattern[at]) >> 11, excess[at]
    n = of[sx[row], 1 + radius - used]
    again = np.repeat(np.arange(len(row)), n)
    at = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n) + of[sx[row[again]], 0]
    row, used = row[again], used[again] + excess[at]
    golay = ((((x[row] ^ pattern[at]) >> 11) << 12) | low[again]) << len(REPEATED)
    beyond = _repeated(radius)[1][rest]
    kept = [(np.flatnonzero(used + beyond[row, word] <= radius), word) for word in range(1 << len(REPEATED))]
    return np.concatenate([row[k] for k, _ in kept]), np.concatenate([golay[k] | word for k, word in kept])


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(home_anchors(fp))], names=["fp", "anchor"])


def _replicated(occupied, radius: int):
    """Rows (anchor, fp, home): each fingerprint at its home and at the other anchors near it that are somebody's home."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = occupied.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                fp = batch.column("fp").slice(i, 2048).to_numpy()
                row, anchor = near_anchors(fp, radius)
                on = (bitmap[anchor >> 3] >> (anchor & 7).astype(np.uint8)) & 1 == 1
                row, anchor = row[on], anchor[on]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[row]), pa.array(anchor == home_anchors(fp)[row])], names=["anchor", "fp", "home"])
    return run


# -- comparison --------------------------------------------------------------------------------------------------


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (a, b): each end that is not the least of its component, and that least one."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)  # the roots move, and all that hang on them
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new[new]
    off = np.flatnonzero(label != np.arange(len(node)))
    return node[off], node[label[off]]


def _linked(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the home rows and all rows of each cell (rows are in order of cells), as stars of at most AT_ONCE comparisons."""
    h = np.flatnonzero(home)
    low, high = np.searchsorted(cell, cell[h], side="left"), np.searchsorted(cell, cell[h], side="right")
    n = high - low
    i = 0
    while i < len(h):
        j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), AT_ONCE, side="right")) + i)
        m = n[i:j]
        left = np.repeat(h[i:j], m)
        right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[i:j], m)
        near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        near &= left != right
        if near.any():
            yield stars(fp[left[near]], fp[right[near]])
        i = j


def _compared(radius: int):
    """Rows sorted by (anchor, block): cells are compared as soon as they are complete."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool))
        def out(cell, fp, home):
            for a, b in _linked(cell, fp, home, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        for batch in batches:
            fresh = ((batch.column("anchor").to_numpy().astype(np.int64) << 32) | batch.column("block").to_numpy(), batch.column("fp").to_numpy().view(_U), batch.column("home").to_numpy(zero_copy_only=False))
            cell, fp, home = (np.concatenate(p) for p in zip(held, fresh, strict=True))
            done = int(np.searchsorted(cell, cell[-1], side="left")) if len(cell) else 0
            yield from out(cell[:done], fp[:done], home[:done])
            held = cell[done:], fp[done:], home[done:]
        yield from out(*held)
    return run


def links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b): stars that connect the distinct fingerprints (column fp) exactly as the links of up to ``radius`` bits do."""
    spark = classes.sparkSession
    homes = scratch.write(classes.select("fp").mapInArrow(_at_home, "fp long, anchor long"), "homes")
    bits = homes.groupBy(F.bitmap_bucket_number(F.col("anchor") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("anchor") + 1)).alias("bits")).collect()  # 4096 rows of 4 KB at most
    bitmap = np.zeros(ANCHORS >> 3, dtype=np.uint8)
    for r in bits:
        bitmap[(r.bucket - 1) << 12 : r.bucket << 12] = np.frombuffer(r.bits, np.uint8)
    occupied = spark.sparkContext.broadcast(bitmap)
    rows = scratch.write(homes.select("fp").mapInArrow(_replicated(occupied, radius), "anchor int, fp long, home boolean"), "replicas")
    cells = scratch.write(rows.groupBy("anchor").agg(F.sum(F.col("home").cast("int")).alias("h"), F.count("*").alias("m")), "cells")
    total, n = cells.agg(F.sum(F.col("h") * F.col("m")), F.count("*")).first()
    large = F.broadcast(cells.where(F.col("h") * F.col("m") > max(LARGE, TIMES * (total or 0) / max(1, n))).select(
        "anchor", F.ceil(F.col("h") / HOMES).cast("int").alias("nh"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("nm")))
    own = F.xxhash64("fp")
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # A home row goes as such to the blocks of its own strip, and as a plain member to those of the others; a replica to one block of each strip.
    strip, column = F.pmod(own, F.col("nh")).cast("int"), F.pmod(F.shiftright(own, 32), F.col("nm")).cast("int")
    cell = lambda s, c, home: F.struct((s * F.col("nm") + c).cast("int").alias("block"), home.alias("home"))
    as_member = F.transform(up_to("nh"), lambda s: cell(s, column, F.lit(False)))
    as_home = F.transform(up_to("nm"), lambda c: cell(strip, c, F.lit(True)))
    dealt = rows.join(large, "anchor", "left").withColumn("cells", F.when(F.col("nh").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.col("home").alias("home")))).when(
        F.col("home"), F.concat(as_home, as_member)).otherwise(as_member)).select("anchor", "fp", F.explode("cells").alias("c")).select("anchor", "fp", "c.block", "c.home")
    return dealt.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(_compared(radius), "a long, b long")


def simhash_groups(docs: DataFrame, scratch: Scratch, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; component_id is the smallest id reachable by links.

    Rows link where their fingerprints differ in ``radius`` bits or fewer. Null, empty and blank texts have
    fingerprint zero, which links like any other. Texts of any length are read whole. A row without an id has a
    fingerprint, links nothing, and has no component. Rows that repeat come back as often; rows of one id and
    different texts are apart unless their fingerprints link. Other columns, whatever their names, are not read.
    """
    base = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    marked = scratch.write(base.mapInArrow(_marked(shingle_words), "doc_id long, fp long"), "fingerprints")
    classes = scratch.write(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    parts = connected_components(links(classes, scratch, radius), scratch)
    grouped = classes.join(parts.select(F.col("node").alias("fp"), "component"), "fp")  # only fingerprints that link
    best = grouped.groupBy("component").agg(F.min("least").alias("least_of"))
    joined = scratch.write(grouped.join(best, "component").select("fp", "least_of"), "joined")
    labels = scratch.write(classes.join(joined, "fp", "left").select("fp", F.coalesce("least_of", "least").alias("component_id"), "n"), "labels")
    hot = F.broadcast(labels.where(F.col("n") > HOT_ROWS).select("fp", "component_id"))
    often = marked.join(hot, "fp")
    seldom = marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(labels.where(F.col("n") <= HOT_ROWS).select("fp", "component_id"), "fp", "left")
    both = often.select("doc_id", "fp", "component_id").unionByName(seldom.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "simhash"))
