"""Clusters, folding, fusion and fuzzy merging on hand-made records."""

import random

import pytest
from pyspark.sql import functions as F

from mediafuse.operators import fold, fuse, fuzzy, identity
from mediafuse.operators.components import connected_components

MEDIA = "uri string, origin string, id string, score double, type string, categories array<string>, titles array<struct<title:string,score:double>>, start_date string, popularity long"


def media(spark, *rows):
    full = []
    for uri, more in rows:
        r = {"uri": uri, "origin": uri.split(":")[0], "id": uri.split(":")[1], "score": 0.5, "type": None, "categories": [], "titles": [], "start_date": None, "popularity": None} | more
        full.append(tuple(r[c.split()[0]] for c in "uri origin id score type categories titles start_date popularity".split()))
    return spark.createDataFrame(full, MEDIA)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], set()).add(r["uri"])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, scratch, seed):
    r = random.Random(seed)
    n = 400
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice((60, 200, 380)))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark, scratch):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), scratch).count() == 0


def test_show_level_handles_do_not_link_and_ids_without_record_do(spark, scratch):
    records = media(spark, ("a:1", {}), ("a:2", {}), ("b:1", {}), ("b:2", {}))
    edges = spark.createDataFrame([("a:1", "imdb:9"), ("b:1", "imdb:9"), ("a:2", "x:7"), ("b:2", "x:7")], "src_uri string, dst_uri string")
    assert groups(identity.clusters(records, edges, scratch)) == [["a:1"], ["a:2", "b:2"], ["b:1"]]


def test_fold_keeps_last_value_and_longest_array_in_any_order(spark):
    rows = [("k", 1, 1000, ["a", "b"]), ("k", 2, None, []), ("k", 3, 2000, ["c", "d"]), ("k", 4, None, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "key string, seq long, popularity long, titles array<string>")
        assert [tuple(r) for r in fold.upsert_fold(df, "key", "seq", ["popularity"], ["titles"]).collect()] == [("k", 2000, ["c", "d"])]


def test_fold_by_label_overwrites_what_has_no_policy(spark):
    df = spark.createDataFrame([("k", "m", 1, 5), ("k", "m", 2, None), ("k", "u", 1, 5), ("k", "u", 2, None)], "key string, label string, seq long, v long")
    assert {(r.label, r.v) for r in fold.fold_by_label(df, "key", "label", "seq", ["v"], {"m": "fold"}).collect()} == {("m", 5), ("u", None)}
    with pytest.raises(ValueError):
        fold.fold_by_label(df, "key", "label", "seq", ["v"], {"m": "other"})


def test_fusion_of_ties_nulls_and_singletons(spark):
    m = media(
        spark, ("b:1", {"score": 0.9, "titles": [("X", None), ("Y", 0.2)], "categories": ["SERIES"], "popularity": None}), ("a:1", {"score": 0.9, "titles": [("Y", 0.9)], "categories": ["ANIME", "MOVIE"], "popularity": 7}),
        ("c:1", {"score": None, "titles": [("X", 0.95)], "popularity": 9}), ("z:1", {"titles": [("Q", 0.1), ("Q", 0.9)], "categories": ["MOVIE", "MOVIE"]}),
    ).withColumn("component", F.when(F.col("uri") == "z:1", "z").otherwise("abc"))
    out = {r.component: r for r in fuse.fuse_media(m).collect()}
    abc, z = out["abc"], out["z"]
    assert (abc.uri, abc.origin, abc.score, abc.popularity, abc.categories) == ("ag:(a:1,b:1,c:1)", "ag", 0.9, 7, ["ANIME", "MOVIE"])
    assert [t.title for t in abc.titles] == ["X", "Y"]
    assert (z.uri, z.categories, [t.title for t in z.titles]) == ("z:1", ["MOVIE", "MOVIE"], ["Q", "Q"])


def fuzzy_groups(spark, scratch, *rows):
    return groups(fuzzy.fuzzy_merge(media(spark, *rows).withColumn("component", F.col("uri")), scratch))


def show(title, year=2024, **more):
    return {"titles": [(t, 0.5) for t in ([title] if isinstance(title, str) else title)], "start_date": year and f"{year}-04-01"} | more


def test_nine_records_become_six_clusters(spark, scratch):
    rows = [("a:1", show("The Great Show", type="TV")), ("b:1", show("Great Show", type="TV")), ("c:1", show("Great, Show!", type="TV")), ("a:2", show("Great Show", 2019, type="TV")), ("a:3", show("Unrelated Thing", type="TV")),
            ("a:4", show("Lone Film", type="MOVIE")), ("b:4", show("Lone Film", type="SPECIAL")), ("a:5", show("Great Show", None, type="TV")), ("a:6", show("Great Show", 2024, type="MOVIE"))]
    got = fuzzy_groups(spark, scratch, *rows)
    assert len(got) == 6 and ["a:1", "b:1", "c:1"] in got and ["a:4", "b:4"] in got


@pytest.mark.parametrize("a,b,merge", [
    ("転生したらスライムだった件", "薬屋のひとりごと", False), ("薬屋のひとりごと", "薬屋のひとりごと", True), ("2024", "2024", False), (["Hero Show", "Hero Season 3"], ["Hero Show", "Hero Season 4"], False),
    (["Hero Show", "Hero 4th Season"], ["Hero Show", "Hero 第4期"], True), ("Yami Shibai 16", "Yami Shibai 17", False), ("Attack on the Giants", "Attack on Giants!", True)])
def test_fuzzy_pairs(spark, scratch, a, b, merge):
    assert (len(fuzzy_groups(spark, scratch, ("a:1", show(a)), ("b:1", show(b)))) == 1) == merge


def test_movie_episodes_group_by_number(spark):
    rows = media(spark, ("a:1", {"categories": ["MOVIE"]}), ("b:1", {"categories": ["MOVIE"]}), ("c:1", {"categories": ["SERIES"]}))
    episodes = fuse.movie_episodes(rows).withColumns({"component": F.lit("x"), "season_number": F.lit(None).cast("long")})
    assert sorted(r.uri for r in episodes.collect()) == ["a:1-1", "b:1-1"]
    one = fuse.group_episodes(episodes).collect()
    assert [(r.episode_number, r.members, r.media_uri) for r in one] == [(1, 2, "ag:(a:1-1,b:1-1)")]
