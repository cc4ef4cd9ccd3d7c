"""The plug-in data source: tasks, pushed filters, isolation of failures, streams."""

import json

import pytest
from pyspark.sql import functions as F

from mediafuse.sources import plugin_source
from mediafuse.sources.plugin_source import Plugin


def _records(page):
    for item in page["items"]:
        yield {"origin": item.get("o", "demo"), "id": item["id"], "title": item["title"].strip(), "year": item.get("year")}


DEMO = Plugin("demo", "id string, title string, year int", _records)
ENTRY = "tests.test_plugin_source:DEMO"  # as tasks import it


@pytest.fixture
def folder(tmp_path):
    pages = [{"items": [{"id": "1", "title": " One "}, {"id": "2", "title": "Two", "year": 2001}]}, {"items": [{"id": "3", "title": "Three"}, {"id": "4", "title": None}, {"id": "5", "title": "lost"}]}, {"items": [{"id": "6", "title": "Other", "o": "else"}]}]
    for i, page in enumerate(pages):
        (tmp_path / f"page-{i}.json").write_text(json.dumps(page))
    (tmp_path / "page-3.jsonl").write_text(json.dumps(pages[0]) + "\n{broken\n\n" + json.dumps({"items": [{"id": "7", "title": "Seven"}]}) + "\n")
    return str(tmp_path)


def test_records_and_failures(spark, folder):
    rows = plugin_source.read(spark, ENTRY, "file://" + folder).cache()
    got = sorted((r.page, r.id, r.title, r.year) for r in plugin_source.records(rows).collect())
    assert got == [(0, "1", "One", None), (0, "2", "Two", 2001), (1, "3", "Three", None), (3, "1", "One", None), (3, "2", "Two", 2001), (3, "7", "Seven", None)]
    assert sorted((r.page, r.failure.split(":")[0]) for r in plugin_source.failures(rows).collect()) == [(1, "AttributeError"), (3, "JSONDecodeError")]
    assert {r.origin for r in rows.collect()} == {"demo"}
    rows.unpersist()


def test_filters_reach_the_source(spark, folder):
    rows = plugin_source.read(spark, ENTRY, "file://" + folder)
    late = rows.where((F.col("page") >= 3) & (F.col("title") == "Seven"))
    plan = late._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:*(1)").startswith("Filter")]
    assert "page" not in " ".join(filters) and "title" in " ".join(filters) and [r.id for r in late.collect()] == ["7"]
    reader = plugin_source.PluginSource({"plugin": ENTRY, "path": "file://" + folder, "filespertask": "1"}).reader(rows.schema)
    assert [f.attribute for f in reader.pushFilters([plugin_source.GreaterThanOrEqual(("page",), 2), plugin_source.EqualTo(("title",), "x")])] == [("title",)]
    assert [p.files[0][0] for p in reader.partitions()] == [2, 3]
    list(reader.pushFilters([plugin_source.EqualTo(("origin",), "another")]))
    assert [p.files for p in reader.partitions()] == [[]]
    assert rows.where("origin = 'another'").count() == 0


def test_a_stream_reads_what_comes(spark, folder, tmp_path):
    plugin_source.register(spark)
    out = str(tmp_path / "out")

    def drain():
        rows = spark.readStream.format(plugin_source.FORMAT).option("plugin", ENTRY).option("path", "file://" + folder).load()
        query = rows.where("failure is null").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        return sorted((r.page, r.id) for r in spark.read.parquet(out).collect())

    before = drain()
    assert len(before) == 6 and drain() == before
    with open(f"{folder}/page-9.json", "w") as f:
        f.write(json.dumps({"items": [{"id": "9", "title": "Nine"}]}))
    assert drain() == [*before, (4, "9")]


def test_what_is_no_plugin_is_refused():
    with pytest.raises(TypeError):
        plugin_source.named("json:loads")
