"""Requests while sources join and leave, searches through an index, plans of a selection, artefacts written once."""

import random

import pytest
from pyspark.sql import functions as F

from mediafuse.functions import similarity
from mediafuse.operators import fuse, search
from mediafuse.sources import builds
from mediafuse.streaming.fanout import RECORD, REQUEST, Fanout
from mediafuse.streaming.upserts import observations, wait_for


@pytest.fixture
def fan(spark, scratch):
    return Fanout(spark, f"{scratch.root}/store", buckets=4)


def answers(fan):
    return sorted(tuple(r) for r in fan.answers().collect())


def test_late_sources_answer_open_requests(spark, fan):
    asks = lambda *rows: spark.createDataFrame(list(rows), REQUEST)
    gives = lambda *rows: spark.createDataFrame(list(rows), RECORD)
    fan.apply_records("a", gives(("k1", "a:1"), ("k2", "a:2"), (None, "a:3")), 0)
    fan.apply_requests(asks(("r1", "k1", True, 1), ("r2", "k2", True, 1), ("r3", "k3", True, 1), ("r4", "k1", True, 1), ("r4", "k1", False, 2)), 0)
    assert answers(fan) == [("r1", "a", "a:1"), ("r2", "a", "a:2")]
    fan.apply_records("late", gives(("k1", "l:1"), ("k3", "l:3"), ("k1", "l:1")), 0)
    assert answers(fan)[-1] == ("r3", "late", "l:3") and len(answers(fan)) == 4
    fan.apply_requests(asks(("r1", "k1", False, 5), ("r5", "k2", True, 5)), 1)
    fan.apply_records("a", gives(("k1", "a:9"), ("k2", "a:2"), ("k2", "a:8")), 1)
    fan.apply_records("a", gives(("k2", "a:77")), 1)  # a batch that is repeated is not applied again
    fan.apply_requests(asks(("r2", "k2", True, 9)), 2)  # open already: nothing is answered twice
    assert answers(fan) == [("r1", "a", "a:1"), ("r1", "late", "l:1"), ("r2", "a", "a:2"), ("r2", "a", "a:8"), ("r3", "late", "l:3"), ("r5", "a", "a:2"), ("r5", "a", "a:8")]


def test_a_source_that_leaves_ends_its_stream_and_its_rows_stay(spark, fan, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("k", "a:1")], RECORD).write.mode("append").parquet(folder)
    fan.apply_requests(spark.createDataFrame([("r", "k", True, 1)], REQUEST), 0)
    query = fan.join("a", observations(spark, spark.createDataFrame([], RECORD).schema, [folder], "*.parquet"), str(tmp_path / "checkpoint"))
    assert fan.join("a", None, "") is query  # it is there already
    assert wait_for(lambda: fan.store.version() >= 1, 60) and answers(fan) == [("r", "a", "a:1")]
    fan.leave("a")
    fan.leave("never joined")
    assert not query.isActive and fan.sources == {}
    spark.createDataFrame([("k", "a:2")], RECORD).write.mode("append").parquet(folder)
    fan.apply_requests(spark.createDataFrame([("late", "k", True, 2)], REQUEST), 1)
    assert answers(fan) == [("late", "a", "a:1"), ("r", "a", "a:1")]


def test_search_through_the_index_equals_the_full_scan(spark, scratch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    names = [" ".join(word() for _ in range(r.randint(1, 5))) for _ in range(250)] + ["日本語", "!!", "", "a", "ab"]
    queries = sorted({q for n in names[:60] for q in (n, n[: len(n) // 2], n[1:], n.replace("a", "x"), n[:3] + n[4:])} | {"日本", "a", "ab", "", "?"})
    titles = spark.createDataFrame([(f"m{i % 120}", n) for i, n in enumerate(names)], "component string, title string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = {(x.query_id, x.component): x.relevance for x in search.search_many(titles, asked, scratch).collect()}
    every = asked.crossJoin(titles).withColumn("s", similarity.search_score(F.col("query"), F.col("title"))).groupBy("query_id", "component").agg(F.max("s").alias("s")).where(F.col("s") >= 0.7)
    assert got == {(x.query_id, x.component): x.s for x in every.collect()} and len(got) > 300
    aligned = search.candidates(asked, search.title_index(titles, scratch), scratch).count()
    assert aligned < 0.35 * len(queries) * len(names)  # letters from eight, the hardest for it
    media = titles.groupBy("component").agg(F.collect_list(F.struct("title")).alias("titles"))
    for q in ("ab", queries[30], "a"):
        page, scan = search.search_page(media, q), search.relevance(media, q).where(F.col("relevance") >= 0.7)
        assert {(x.component, x.relevance) for x in page.collect()} == {(x.component, x.relevance) for x in scan.collect()}


MEMBER = "component string, uri string, origin string, score double, popularity long, status string, titles array<struct<title:string,score:double>>, covers array<struct<url:string,score:double>>, categories array<string>"
EPISODE = "component string, uri string, origin string, score double, episode_number long"


def test_what_a_request_does_not_select_is_not_in_the_plan(spark, tmp_path):
    spark.createDataFrame([("c", "a:1", "a", 0.5, 3, "FINISHED", [("t", 0.5)], [("u", 0.5)], ["ANIME"]), ("c", "b:1", "b", 0.9, None, None, [("s", 0.9)], [], ["MOVIE"])], MEMBER).write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([("c", "e:2", "a", 0.5, 2), ("c", "e:1", "a", 0.5, 1), ("c", "f:1", "b", 0.9, 1)], EPISODE).write.parquet(str(tmp_path / "e"))
    members, episodes = spark.read.parquet(str(tmp_path / "m")), spark.read.parquet(str(tmp_path / "e"))
    plan = lambda fields: fuse.detail(members, episodes, fields)._jdf.queryExecution().optimizedPlan().toString()
    read = lambda fields: fuse.detail(members, episodes, fields)._jdf.queryExecution().executedPlan().toString()
    assert "titles" in plan(["titles"]) and not any(x in read(["titles"]) for x in ("covers", "status", "episode_number"))
    assert "explode" not in plan(["popularity"]) and "episode_number" in plan(["episodes"])
    row = fuse.detail(members, episodes, ["titles", "episodes", "popularity"]).first()
    assert [t.title for t in row.titles] == ["s", "t"] and row.popularity == 3 and "covers" not in row.asDict()
    assert [(e.episode_number, e.uri) for e in row.episodes] == [(1, "ag:(e:1,f:1)"), (2, "e:2")]


def test_an_artefact_is_evaluated_once_and_put_in_place_whole(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(count, "id long")
    about = builds.write_artifact(rows, str(tmp_path / "a"), {"s": "1"}, 100, "rows", {"last": F.max("id")}).first()
    assert seen.value == 100 and (about.rows, about.metrics) == (100, {"last": "99"})
    with pytest.raises(ValueError, match="5 rows"):
        builds.write_artifact(spark.range(5), str(tmp_path / "a"), {}, 6, "few")
    assert spark.read.parquet(str(tmp_path / "a" / "data")).count() == 100
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["about", "data"]


def test_the_first_hit_is_gated_rung_by_rung(spark):
    asked = spark.createDataFrame([(1, "The Long Road Season 2"), (2, "Nothing Alike"), (3, "Known")], "query_id long, query string")
    hits = spark.createDataFrame([("The Long Road Season 2", 1, 10, "zzzz"), ("The Long Road Season 2", 2, 11, "The Long Road Season 2"), ("The Long Road", 1, 12, "Long Road Season"), ("Nothing Alike", 1, 13, "q"), ("Known", 0, 14, "Known!")],
                                 "rung_query string, pos long, candidate_id long, title string")
    got = {r.query_id: (r.rung, r.candidate_id) for r in search.top_then_gate(asked, hits).collect()}
    assert got == {1: (1, 12), 3: (0, 14)}
