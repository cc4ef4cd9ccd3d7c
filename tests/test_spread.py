"""Work is dealt over tasks, and shared steps are taken once, whatever the number of rows that repeat them."""

import glob
import os
import random
import time
from itertools import combinations

from mediafuse.functions import similarity
from mediafuse.operators import fuzzy, identity, search
from mediafuse.operators.components import connected_components
from mediafuse.operators.scratch import Scratch
from mediafuse.plans import registry, stream_queries
from mediafuse.sources import records
from pyspark.sql import functions as F


def test_pairs_of_one_year_come_once_and_from_several_tasks(spark):
    years = {i: {2000, 2001 + i % 3, 2001 + i % 2} for i in range(40)} | {99: {2000}, 98: {1950}}
    made = {"years": spark.createDataFrame([(f"c{i}", y) for i, ys in years.items() for y in ys], "component string, year int"),
            "titles": spark.createDataFrame([(f"c{i}", "t") for i in years], "component string, title string")}
    pairs = fuzzy.blocking_pairs(made)
    got = sorted((r.a, r.b) for r in pairs.collect())
    assert got == sorted(tuple(sorted((f"c{i}", f"c{j}"))) for i, j in combinations(years, 2) if years[i] & years[j])
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1


def test_pairs_of_one_year_take_little_disk(spark, tmp_path):
    n = 6000
    titles = spark.range(n).select(F.concat(F.lit("part:"), (F.col("id") + 100_000).cast("string")).alias("component"), F.lit("t").alias("title"))
    years = titles.select("component", F.lit(2000).alias("year"))
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before = shuffled()
    fuzzy.blocking_pairs({"years": years, "titles": titles}).write.parquet(f"{tmp_path}/pairs")
    moved = shuffled() - before
    kept = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/pairs/*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/pairs").where("a < b").count() == n * (n - 1) // 2
    assert moved < 60 * n and kept < 0.35 * n * (n - 1) / 2, (moved / n, kept / (n * (n - 1) / 2))


def aligned_pairs(spark, monkeypatch, make):
    """How many pairs the alignment is given when the table that ``make`` makes is evaluated, and its rows."""
    seen = spark.sparkContext.accumulator(0)

    def counted(a, b):
        times = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
        return plain(times(a), b)

    plain = similarity.alignment_score
    monkeypatch.setattr(similarity, "alignment_score", counted)
    rows = make().collect()
    return seen.value, rows


def test_a_query_that_many_ask_is_matched_once(spark, monkeypatch):
    requests = spark.createDataFrame([(i, f"the old ring{i % 2} : tale") for i in range(40)], "query_id long, query string")
    hits = spark.createDataFrame([("the old ring0 : tale", 1, 7, "old ring0 tale"), ("old ring1 : tale", 1, 8, "old ring1 tale")], "rung_query string, pos long, candidate_id long, title string")
    for match, rungs in ((search.top_then_gate, {0: 0, 1: 1}), (search.first_rung_match, {0: 0, 1: 1})):
        n, rows = aligned_pairs(spark, monkeypatch, lambda: match(requests, hits))
        assert sorted((r.query_id, r.rung, r.candidate_id) for r in rows) == [(i, rungs[i % 2], 7 + i % 2) for i in range(40)]
        assert n <= 8
        monkeypatch.undo()


def test_titles_that_are_searched_are_aligned_in_several_tasks(spark, scratch):
    names = spark.createDataFrame([(f"c{i}", f"small ring {i}") for i in range(64)], "component string, title string")
    asked = names.select(F.col("component").alias("query_id"), F.col("title").alias("query"))
    near = search.candidates(asked, search.title_index(names, scratch), scratch)
    assert near.where("q = t").count() == 64 and near.rdd.getNumPartitions() > 1


def test_linking_pairs_connect_what_all_pairs_connect(spark, scratch):
    r = random.Random(5)
    titles = ["a long road of rings", "a long road of ringz", "a long road of ringzz", "another tale of it", "the third one of all"]
    rows = [(f"u{i}", f"u{i}", [(r.choice(titles) + r.choice(["", "", " season 2"]), 0.5), (r.choice(titles), 0.1)][: r.randint(1, 2)], f"{2000 + r.randint(0, 40)}-01-01", r.choice(["MOVIE", "TV", "SPECIAL", None]), []) for i in range(160)]
    members = spark.createDataFrame(rows, "component string, uri string, titles array<struct<title:string,score:double>>, start_date string, type string, categories array<string>")
    made = fuzzy.profiles(members)
    every, few = (f(made, scratch) for f in (fuzzy.title_pairs, fuzzy.linking_pairs))
    parts = lambda pairs: sorted(tuple(x) for x in connected_components(pairs, scratch).collect())
    assert parts(few) == parts(every) and {tuple(x) for x in few.collect()} <= {tuple(x) for x in every.collect()}


def test_links_of_one_title_grow_with_the_components_and_not_their_pairs(spark, scratch):
    members = spark.range(300).select(F.concat(F.lit("u"), "id").alias("component"), F.concat(F.lit("u"), "id").alias("uri"), F.expr("array(named_struct('title', 'one and the same', 'score', 0.5D))").alias("titles"),
                                      F.lit("2001-04-01").alias("start_date"), F.lit("TV").alias("type"), F.expr("cast(array() as array<string>)").alias("categories"))
    root = Scratch(spark, "one-title")
    merged, linked = fuzzy.merge_step(members, root)
    assert linked and merged.select("component").distinct().count() == 1
    assert spark.read.parquet(*glob.glob(f"{root.root.removeprefix('file://')}/*-links")).count() == 299


def test_handles_are_made_once(spark):
    handle = lambda u: F.struct(u.alias("uri"), F.lit("o").alias("origin"), F.lit("i").alias("id"), F.lit(None).cast("string").alias("url"))
    made = F.transform(F.array(F.lit("a"), F.lit("b"), F.lit(None), F.lit("a")), handle)
    rows = spark.range(1).select(records.distinct_handles(made).alias("h"))
    assert [h.uri for h in rows.first().h] == ["a", "b"]
    plan = rows.select(records.distinct_handles(F.col("h")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("h#") <= 3


def test_answers_and_requests_are_dealt_over_tasks(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    assert registry.QUERIES["watchmode_media"](spark, data).rdd.getNumPartitions() > 1
    asked = spark.createDataFrame([(f"ag:(a:{i},b:{i})",) for i in range(50)], "aggregated_uri string").coalesce(1)
    members = asked.select(F.expr("concat('b:', regexp_extract(aggregated_uri, 'b:([0-9]+)', 1))").alias("uri")).withColumn("component", F.col("uri"))
    found = identity.first_live_handle(asked, members)
    assert found.count() == 50 and found.where("component is not null").count() == 50
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_arriving_rows_are_made_once_for_all_their_parts(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    made = F.udf(lambda x: seen.add(1) or x, "long").asNondeterministic()
    rows = spark.range(20).select("id", made("id").alias("v"))
    stream_queries.arriving(rows, F.col("id") % 4, f"{tmp_path}/in", lambda s: s.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start())
    assert seen.value == 20 and spark.read.parquet(f"{tmp_path}/in").count() == 20
