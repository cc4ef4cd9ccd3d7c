"""Importance resampling, lexical search and SimHash groups on small fixtures, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mediafuse.llm import lexical_search, resample, simhash_dups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def prose(n, seed, vocabulary=200):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def texts():
    base = prose(200, 5)
    out = [None, "", " \t\n", "one", "One TWO", "one two three", "ÄÖ é日本, x-y_z (q) \U0001f600", "z" * 5000, prose(30000, 9) + "\n" + "y" * 300 + " tail", base, base, base.upper()]
    out += [base.replace(f"w{i}", f"v{i}") for i in range(0, 12)] + [prose(25, i) for i in range(30)] + ["spam " * 300, "spam ham " * 150]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[9], (None, texts[12], None, None, None)], SCHEMA).withColumns({"fp": F.lit("clash"), "score": F.lit(1), "rank": F.lit(2), "k": F.lit(3)})


@pytest.fixture(scope="module")
def items(spark, texts):
    return spark.createDataFrame([(0, prose(30, 77)), (1, "ONE two two absent"), (2, None), (3, "nowhere"), (4, "日本 y"), (1, "ONE two two absent"), (6, prose(900, 3))], "item_id long, text string")


@pytest.mark.parametrize("runs_of", [1, 3])
def test_resampling_equals_brute_force(spark, scratch, docs, items, texts, monkeypatch, runs_of):
    monkeypatch.setattr(resample, "RANGE_ROWS", 4)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def features(text):
        w = ALNUM.findall(lower(text))
        return [zlib.crc32(b" ".join(w[i : i + k])) % 10000 for k in range(1, runs_of + 1) for i in range(len(w) - k + 1)], len(w)

    s = Counter(b for _, t in rows for b in features(t)[0])
    t = Counter(b for r in items.collect() for b in features(r.text)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    want = []
    for i, text in rows:
        f, n = features(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    eligible = sorted((r for r in want if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    order = {id(r): i + 1 for i, r in enumerate(eligible[: 50 * len(eligible) // 100])}
    want = sorted(([*r[:4], order.get(id(r))] for r in want), key=repr)
    got = resample.resample(docs.repartition(5), items, scratch, percent=50, runs_of=runs_of)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(list, got.collect()), key=repr) == want


def test_resampling_of_no_rows_and_no_target(spark, scratch, docs, items):
    assert resample.resample(docs.limit(0), items, scratch).count() == 0
    assert resample.resample(docs, items.limit(0), scratch).where("rank is not null").count() == 4  # a tenth of the 49 of twenty words


def test_tournament_merges_runs_and_stops():
    r = np.random.default_rng(1)
    runs = [sorted((int(x), i) for i, x in enumerate(r.integers(0, 9, n))) for n in (0, 1, 7, 30, 2)]
    flat = [k for run in runs for k in run]
    cut = np.cumsum([0, *map(len, runs)]).tolist()
    for want in (0, 1, 25, len(flat), len(flat) + 5):
        got = resample.merged(list(zip(cut[:-1], cut[1:])), flat, want)
        assert [flat[i] for i in got] == sorted(flat)[:want] and len(set(got)) == len(got)


def test_search_equals_brute_force(spark, scratch, docs, items, texts, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 64)
    monkeypatch.setattr(lexical_search, "TERMS_A_PASS", 500)
    held = [(r.doc_id, Counter(ALNUM.findall(lower(r.text)))) for r in docs.select("doc_id", "text").collect()]
    held = [(i, c) for i, c in held if c]
    count, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    want = []
    for item in items.collect():
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in ALNUM.findall(lower(item.text)) if w in df)
            if score and i is not None:
                scores.append((-score, i))
        want += [(item.item_id, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:10])]
    got = lexical_search.search(docs.repartition(3), items, scratch)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert lexical_search.search(docs.limit(0), items, scratch).count() == 0
    assert lexical_search.search(docs, items.limit(0), scratch).count() == 0


def test_slices_add_and_rank_like_integers():
    r = np.random.default_rng(2)
    place, doc = map(np.ravel, np.meshgrid(np.arange(20), np.arange(150)))
    value = r.integers(0, 1 << 34, len(place)) * (r.random(len(place)) < 0.3)
    queries = [r.integers(0, 21, n) for n in (70, 9, 2, 1)]
    table = np.zeros((21, 150), np.int64)
    table[place, doc] = value
    acc = lexical_search.summed(lexical_search.bit_slices(place, doc, value, 20, 3), queries)
    q, d, s = lexical_search.top_slices(acc, 7)
    for i, own in enumerate(queries):
        sums = table[own].sum(axis=0)
        best = sorted((-int(x), j) for j, x in enumerate(sums) if x)[:7]
        assert sorted((-int(y), int(x)) for x, y in zip(d[q == i], s[q == i])) == best


def brute_fingerprint(text):
    w = WORD.findall(lower(text))
    n = max(1, len(w) - 2) if w else 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius=3):
    least = {i: i for i, _ in pairs}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, x in pairs:
        for b, y in pairs:
            if a < b and (x ^ y).bit_count() <= radius:
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return {i: find(i) for i in least}


def test_simhash_groups_equal_brute_force(spark, scratch, docs, texts, monkeypatch):
    monkeypatch.setattr(simhash_dups, "HOT_ROWS", 2)
    monkeypatch.setattr(simhash_dups.W, "SLICE_BYTES", 1 << 12)
    prints = [brute_fingerprint(t) for t in texts]
    parts = brute_components(list(enumerate(prints)))
    got = simhash_dups.simhash_groups(docs, scratch).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.fingerprint == f"{prints[12]:016x}"
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", parts[r.doc_id])
    assert simhash_dups.simhash_groups(docs.limit(0), scratch).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_anchors_lose_no_link(spark, scratch, monkeypatch, small):
    """Fingerprints at random places of up to three bits from one another, a dense ball, and fingerprints four bits apart."""
    if small:
        for name, value in (("LARGE", 16), ("TIMES", 0), ("HOMES", 8), ("MEMBERS", 8), ("AT_ONCE", 64)):
            monkeypatch.setattr(simhash_dups, name, value)
    r = np.random.default_rng(3)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in r.choice(64, n, replace=False))
    start = [int(x) for x in r.integers(0, 1 << 63, 300)]
    prints = sorted({*start, *(flip(x, int(n)) for x, n in zip(start, r.integers(1, 5, 300))), *(flip(start[0], 2) for _ in range(60)), *(flip(start[1], 4) for _ in range(60)), 0, 1, (1 << 64) - 1})
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in map(tuple, simhash_dups.links(frame, scratch).collect())]
    want = brute_components([(x, x) for x in prints])
    least = {x: x for x in prints}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in got:
        p, q = find(a), find(b)
        least[max(p, q)] = min(p, q)
    assert {x: find(x) for x in prints} == want


def test_the_code_is_perfect():
    pattern, excess, of = simhash_dups._errors(3)
    assert (of[:, 1] == 1).all() and (excess[of[:, 0]] == 0).all() and len(pattern) == sum(math.comb(23, i) for i in range(7))
