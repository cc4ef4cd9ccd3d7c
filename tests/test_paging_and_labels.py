"""Page walks and label folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from mediafuse.operators import labels as L
from mediafuse.sources import paging


def test_walk_until_a_short_page_or_a_gap(spark):
    sizes = {"whole": [5, 5, 2, 5], "one": [1], "gap": [5, None, 5], "late": [None, 5], "full": [5, 5, 5], "empty": [0, 5]}
    rows = [(c, i + 1, n) for c, ns in sizes.items() for i, n in enumerate(ns) if n is not None] + [("whole", 0, 5)]
    got = paging.until_short(spark.createDataFrame(rows, "c string, page long, n long"), "c", "page", "n", 5)
    want = {"whole": [1, 2, 3], "one": [1], "gap": [1], "full": [1, 2, 3], "empty": [1]}
    assert sorted((r.c, r.page) for r in got.collect()) == sorted((c, p) for c, ps in want.items() for p in ps) and got.columns == ["c", "page", "n"]


def test_fixed_pages_and_first_and_more(spark):
    df = spark.createDataFrame([("a", p, p != 2, p == 3) for p in range(0, 12)] + [("b", p, True, False) for p in (1, 2, 3, 4)] + [("c", p, True, False) for p in (1, 3)] + [("d", 1, None, None), ("d", 2, True, False)], "c string, page long, next boolean, failed boolean")
    assert sorted(r.page for r in paging.fixed_pages(df.where("c = 'a'"), failed=F.col("failed")).collect()) == [1, 2, 4, 5, 6, 7, 8]
    assert sorted((r.c, r.page) for r in paging.first_and_more(df, "c", "page", F.col("next")).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("d", 1)]


def test_links_are_followed_by_doubling(spark, scratch):
    r = random.Random(3)
    following = {i: r.choice([None, i + 1, i + 1, i + 1, r.randrange(130)]) for i in range(120)} | {200: 201, 201: 202, 202: 200, 210: 210}
    starts = [0, 5, 40, 200, 210, 119, 999]
    want = set()
    for s in starts:
        seen, at = [], s
        while at in following and at not in seen:
            seen.append(at)
            at = following[at]
        want |= {(s, p, i) for i, p in enumerate(seen)}
    pages = spark.createDataFrame(list(following.items()), "key long, following long")
    got = paging.following_links(pages, spark.createDataFrame([(s,) for s in starts], "key long"), scratch)
    assert {(x.start, x.key, x.step) for x in got.collect()} == want


CHANGE = "node string, seq long, op string, add array<string>, remove array<string>, a string, tags array<string>"


def brute(changes, merging=()):
    """The store's own way: one change after the other."""
    nodes, labels = {}, {}
    for node, _, op, add, remove, a, tags in sorted(changes, key=lambda c: c[1]):
        if op == "label":
            if node in nodes:
                labels.setdefault(node, set()).update(add or [])
            continue
        on = (labels.get(node, set()) | set(add or [])) - set(remove or [])
        old = nodes.get(node)
        if old and on & set(merging):
            nodes[node] = (a if a is not None else old[0], old[1] if tags is None or old[1] is not None and len(old[1]) > len(tags) else tags)
        else:
            nodes[node] = (a, tags)
        labels[node] = on
    return nodes, {(n, l) for n, ls in labels.items() for l in ls}


@pytest.fixture(params=[5, 100_000])
def changes(spark, monkeypatch, request):
    monkeypatch.setattr(L, "SPAN", request.param)
    r = random.Random(7)
    some = lambda: r.sample(["item", "special", "tag"], r.randint(0, 2)) or None
    rows = [(r.choice("abcde"), i, r.choice(["set", "set", "set", "label"]), some(), r.choice([None, None, some()]), r.choice([None, f"v{i}"]), r.choice([None, ["t"] * r.randint(0, 4)])) for i in range(90)]
    rows.append(("unknown", 95, "label", ["item"], None, None, None))
    return rows, spark.createDataFrame(random.Random(1).sample(rows, len(rows)), CHANGE)


def test_labels_equal_the_changes_made_in_order(changes):
    rows, df = changes
    got = L.labels_of(df)
    assert {tuple(r) for r in got.collect()} == brute(rows)[1]
    assert L.labeled(got, "no such").count() == 0 and "unknown" not in {r.node for r in L.labeled(got, "item").collect()}


def test_values_merge_as_the_labels_in_force_say(spark, changes):
    rows, df = changes
    sets = [r for r in rows if r[2] == "set"]
    got = L.fold_by_labels(df.where("op = 'set'"), {"item": "fold", "special": "latest"}, ["a"], ["tags"]) if not any(
        {"item", "special"} <= on for on in _in_force(sets)) else None
    one = L.fold_by_labels(df.where("op = 'set'"), {"item": "fold"}, ["a"], ["tags"])
    assert {r.node: (r.a, r.tags) for r in one.collect()} == brute(sets, ["item"])[0]
    if got is None:
        with pytest.raises(Exception, match="several labels of a node merge"):
            L.fold_by_labels(df.where("op = 'set'"), {"item": "fold", "special": "latest"}, ["a"], ["tags"]).collect()
    with pytest.raises(ValueError, match="unknown policy"):
        L.fold_by_labels(df, {"item": "sum"}, ["a"])


def _in_force(sets):
    on: dict = {}
    for node, _, _, add, remove, *_ in sorted(sets, key=lambda c: c[1]):
        on[node] = (on.get(node, set()) | set(add or [])) - set(remove or [])
        yield on[node]


def test_the_label_matrix(spark):
    rows = [("a", 1, "set", ["item"], None, "Ann", ["p", "q"]), ("a", 2, "set", ["item"], None, "Bea", ["r"]), ("a", 3, "set", None, None, "Cid", ["s", "t", "u"]),
            ("b", 1, "set", None, None, "first", ["1", "2"]), ("b", 2, "set", None, None, "second", []), ("c", 1, "set", ["item"], None, "x", ["1", "2"]), ("c", 2, "set", None, ["item"], "y", [])]
    got = L.fold_by_labels(spark.createDataFrame(rows, CHANGE), {"item": "fold"}, ["a"], ["tags"])
    assert {r.node: (r.a, r.tags) for r in got.collect()} == {"a": ("Cid", ["s", "t", "u"]), "b": ("second", []), "c": ("y", [])}
    latest = L.fold_by_labels(spark.createDataFrame(rows, CHANGE), {"item": "latest"}, ["a"], ["tags"])
    assert {r.node: r.tags for r in latest.collect()}["a"] == ["s", "t", "u"]


def test_clusters_of_one_label(spark):
    nodes = spark.createDataFrame([("m1",), ("m2",), ("e1",)], "node string")
    parts = spark.createDataFrame([("m1", "m1"), ("m2", "m1")], "node string, component string")
    labels = spark.createDataFrame([("m1", "media"), ("m2", "media"), ("e1", "episode")], "node string, label string")
    assert L.clusters_labeled(nodes, parts, labels, "media").select("component").distinct().count() == 1
    assert L.clusters_labeled(nodes, parts, labels).select("component").distinct().count() == 2
