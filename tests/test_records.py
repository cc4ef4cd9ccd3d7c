"""Record pieces, catalogue answers and builds on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from mediafuse.operators import choose, identity
from mediafuse.sources import builds, records
from mediafuse.sources.catalogues import CATALOGUES


def test_answers_that_do_not_parse_go_alone(spark):
    good = json.dumps({"data": {"Page": {"media": [{"id": 1, "title": {"romaji": "A"}}, None, {"title": {"romaji": "no id"}}, {"id": 2, "trailer": {"site": "youtube", "id": "v"}}]}}})
    rows = spark.createDataFrame([(good,), ("{broken",), ("",), (None,), ('{"data": null}',)], "payload string")
    got = {r.uri: r for r in CATALOGUES["anilist"].read(rows).collect()}
    assert set(got) == {"anilist:1", "anilist:2"} and got["anilist:1"].titles[0].title == "A" and got["anilist:1"].score == 0.8
    assert (got["anilist:2"].titles, got["anilist:2"].trailers[0].url, got["anilist:2"].covers) == ([], "https://www.youtube.com/watch?v=v", [])
    assert CATALOGUES["anilist"].read(rows.limit(0)).count() == 0


def test_answers_in_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"imdbID": "tt1", "Title": "T", "Year": "N/A",
                                                   "Type": "movie"}, indent=2))
    (tmp_path / "two.json").write_text("not json")
    got = CATALOGUES["omdb"].files(spark, str(tmp_path)).collect()
    assert [(r.uri, r.categories, r.start_date, [h.uri for h in r.handles]) for r in got] == [("omdb:tt1", ["MOVIE"], None, ["imdb:tt1"])]


def test_ids_images_and_names(spark):
    versions = "array<struct<audio_locale:string,guid:string,original:boolean>>"
    rows = spark.createDataFrame([("S1JAJP", [("en-US", "E", True), ("ja-JP", "J", False)]), ("S2JAJP", [("en-US", "E", True)]), ("S3JAJP", None)], f"id string, v {versions}")
    assert [r[0] for r in rows.select(records.original_season(F.col("id"), F.col("v"))).collect()] == ["J", "E", "S3"]
    one = spark.range(1).select(
        records.series_id(F.lit("G"), F.lit("S1JAJP"), F.lit(None).cast("string")).alias("a"), records.series_id(F.lit("G")).alias("b"),
        records.embedded_video(F.lit("https://y/embed/abcdefghijk?x")).alias("c"), records.is_movie(F.array(F.lit("MOVIE"))).alias("d"), records.is_movie(F.lit(None).cast("array<string>")).alias("e"),
        records.rated(F.lit(None).cast("double"), F.lit(7.25), times=10, whole=True).alias("f"), records.first_title(records.titles(1.0, ("en", F.lit("")), ("ja", F.lit("x")))).alias("g")).first()
    assert tuple(one) == ("G-S1", "G", "abcdefghijk", True, False, 73.0, "x")
    with pytest.raises(ValueError):
        records.media("o", F.lit("1"), nonsense=F.lit(1))


def test_nested_handles_and_seeds(spark):
    rows = spark.createDataFrame([("a:1", [("b:1", [("c:1", None), ("a:1", None)]), ("d:1", [])]), ("e:1", None)], "uri string, handles array<struct<uri:string,handles:array<struct<uri:string,handles:string>>>>")
    assert sorted(map(tuple, identity.nested_handles(rows).collect())) == [("a:1", "b:1"), ("a:1", "c:1"), ("a:1", "d:1")]
    members = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "component string, uri string")
    assert identity.seeded(members, spark.createDataFrame([("b",)], "uri string")).count() == 2
    assert identity.seeded(members, members.select("uri").limit(0)).count() == 3 and identity.seeded(members, spark.createDataFrame([("z",)], "uri string")).count() == 0


def test_retries_and_links(spark):
    assert spark.range(1).select(choose.retryable(F.lit(429)), choose.retryable(F.lit(500)), choose.retry_delay(F.lit(9))).first()[:] == (True, False, 15000)


def test_builds_fall_back_guard_and_describe(spark, tmp_path):
    schema = "mal long, anilist long"
    (tmp_path / "cached.json").write_text('{"mal": 1, "anilist": 2}\n')
    rows = builds.read_or_cached(spark, str(tmp_path / "absent.json"), str(tmp_path / "cached.json"), schema)
    assert [tuple(r) for r in rows.collect()] == [(1, 2)]
    with pytest.raises(FileNotFoundError):
        builds.read_or_cached(spark, str(tmp_path / "no"), str(tmp_path / "none"), schema)
    about = builds.write_artifact(rows, str(tmp_path / "index"), {"dump": "2024-01-05"}, 1, "index").first()
    assert (about["name"], about["rows"], about["sources"]) == ("index", 1, {"dump": "2024-01-05"}) and spark.read.parquet(str(tmp_path / "index/data")).count() == 1
    with pytest.raises(ValueError):
        builds.write_artifact(rows, str(tmp_path / "few"), {}, 2, "few")
    assert not (tmp_path / "few").exists()
    lines = spark.createDataFrame([('{"lastUpdate": "d", "repository": "r"}',), ('{"sources": ["a"], "title": "t"}',), ("x",)], "value string")
    assert builds.dump_entries(lines, least=1).count() == 1 and builds.dump_header(lines, "lastUpdate string").first()[0] == "d"
    with pytest.raises(ValueError):
        builds.dump_entries(lines)
