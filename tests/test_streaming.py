"""Streams: the merging sink against the batch operators, arrival by arrival."""

import pytest
from pyspark.sql import functions as F

from mediafuse.operators import fuse, identity
from mediafuse.operators.fold import upsert_fold
from mediafuse.streaming import folding
from mediafuse.streaming.merging import HAS_EPISODE, SAME_EPISODE, SAME_MEDIA, MergingSink
from mediafuse.streaming.upserts import observations

TITLES = "array<struct<language:string,title:string,score:double>>"
MEDIA = f"uri string, origin string, score double, categories array<string>, titles {TITLES}, popularity long"
OBSERVED = f"struct<uri:string,origin:string,score:double,categories:array<string>,titles:{TITLES},popularity:long,seq:long,handles:array<string>>"
EPISODE = "struct<uri:string,origin:string,media_uri:string,score:double,episode_number:long,seq:long,handles:array<string>>"
SCHEMA = f"media {OBSERVED}, episode {EPISODE}"


def media(uri, seq, title=None, popularity=None, handles=(), score=0.5):
    return ((uri, uri.split(":")[0], score, ["SERIES"], [("en", t, score) for t in title.split("|")] if title else None, popularity, seq, list(handles)), None)


def episode(uri, media_uri, seq, number=None, handles=()):
    return (None, (uri, "e", media_uri, 0.5, number, seq, list(handles)))


BATCHES = [
    [media(f"a:{i}", 1, f"t{i}", i) for i in range(6)] + [media("b:0", 2, "zero", handles=["a:0"]), media("c:9", 2, "nine", handles=["imdb:1"]), media("c:8", 2, "eight", handles=["imdb:1"])],
    [media("a:1", 3, None, None, ["x:1"]), media("a:2", 3, "t2|other", 50, ["x:1"]), episode("e:1", "a:1", 1, 1), episode("e:2", "a:2", 1, 1, ["e:1"])],
    [media("a:3", 4, handles=["a:2"]), media("b:0", 1, "an|old|list", 7), media("a:3", 4, handles=["a:2"]), episode("e:1", "a:1", 2, 2)],
    [media("b:0", 6, handles=["a:4", "a:1"])],
    [media("z:1", 7, "alone", 3), media("a:5", 7, popularity=99)],
    [media("b:0", 8, handles=["a:4"])],
]


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.fixture
def sink(spark, scratch):
    schema = spark.createDataFrame([], MEDIA).schema
    episodes = spark.createDataFrame([], "uri string, origin string, media_uri string, score double, episode_number long").schema
    return MergingSink(spark, f"{scratch.root}/store", schema, episodes, buckets=16)


def expected(spark, scratch, rows):
    seen = spark.createDataFrame(rows, SCHEMA).where("media is not null").select("media.*")
    records = upsert_fold(seen, "uri", "seq", ["origin", "score", "popularity"], ["categories", "titles"])
    members = identity.clusters(records, identity.handle_edges(seen), scratch)
    return fuse.fuse_media(members)


def test_every_version_of_the_view_equals_the_batch_result(spark, scratch, sink):
    changes = []
    sink.after = changes.append
    shown: dict = {}
    for i, batch in enumerate(BATCHES):
        sink.apply(spark.createDataFrame(batch, SCHEMA), i)
        want = expected(spark, scratch, [r for b in BATCHES[: i + 1] for r in b])
        view = sink.view()
        assert rows_of(view) == rows_of(want.select(*view.columns))
        for r in changes[-1].retracted.collect():
            shown.pop(r.component, None)
        shown |= {r.component: tuple(map(str, r)) for r in changes[-1].upserts.collect()}
        assert sorted(shown.values()) == rows_of(view)  # the changes alone keep a reader up to date
    assert [c.upserts.count() for c in changes] == [8, 1, 2, 1, 2, 1]
    assert rows_of(sink.members().select("uri", "component")) == rows_of(identity.clusters(sink.records(), sink.links(SAME_MEDIA), scratch).select("uri", "component"))


def test_links_are_new_once_and_episodes_fold(spark, scratch, sink):
    changes = []
    sink.after = changes.append
    for i, batch in enumerate(BATCHES):
        sink.apply(spark.createDataFrame(batch, SCHEMA), i)
    assert [c.new_links.count() for c in changes] == [3, 2 + 2 + 1, 1, 2, 0, 0]
    assert rows_of(sink.links(HAS_EPISODE).select("src_uri", "dst_uri", "since")) == [("a:1", "e:1", "1"), ("a:2", "e:2", "1")]
    assert rows_of(sink.links(SAME_EPISODE).select("src_uri", "dst_uri")) == [("e:1", "e:2")]
    assert rows_of(sink.records("episodes").select("uri", "episode_number")) == [("e:1", "2"), ("e:2", "1")]


def test_a_batch_writes_what_it_touches_and_is_applied_once(spark, scratch, sink):
    sink.apply(spark.createDataFrame([media(f"a:{i}", 1, f"title {i}" * 20, i) for i in range(4000)], SCHEMA), 0)
    before = sink.store.read("media").count()
    small = spark.createDataFrame([media("a:7", 2, popularity=8)], SCHEMA)
    sink.apply(small, 1)
    assert sink.store.bytes_written(1) * 4 < sink.store.bytes_written(0) and sink.store.read("media").count() == before
    held = rows_of(sink.view())
    sink.apply(spark.createDataFrame([media("a:7", 9, popularity=1000)], SCHEMA), 1)  # a repeated batch is not applied again
    assert rows_of(sink.view()) == held and sink.store.version() == 1


def test_a_version_that_was_interrupted_leaves_no_trace(spark, scratch, sink, monkeypatch):
    sink.apply(spark.createDataFrame(BATCHES[0], SCHEMA), 0)
    held = rows_of(sink.view())
    monkeypatch.setattr(type(sink.store), "commit", lambda self, v: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        sink.apply(spark.createDataFrame(BATCHES[3], SCHEMA), 1)
    monkeypatch.undo()
    assert rows_of(sink.view()) == held and sink.store.version() == 0
    sink.apply(spark.createDataFrame(BATCHES[1], SCHEMA), 1)
    assert rows_of(sink.view()) == rows_of(expected(spark, scratch, BATCHES[0] + BATCHES[1]).select(*sink.view().columns))


def test_old_files_go_and_full_buckets_are_joined(spark, scratch, sink, monkeypatch):
    monkeypatch.setattr("mediafuse.streaming.store.MAX_PARTS", 2)
    for i in range(6):
        sink.apply(spark.createDataFrame([media("a:0", i, handles=[f"x:{i}"])], SCHEMA), i)
    assert sink.store.versions() == [4, 5] and sink.links().count() == 6
    assert max(len(p) for p in sink.store._manifest(5)["links"].values()) <= 3


def test_the_sink_runs_on_a_stream_and_goes_on_after_a_restart(spark, scratch, sink):
    folder, checkpoint = f"{scratch.root}/in", f"{scratch.root}/checkpoint"
    for i, batch in enumerate(BATCHES[:3]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = observations(spark, spark.createDataFrame([], SCHEMA).schema, [folder], "*.parquet")
        query = sink.start(stream, checkpoint, availableNow=True)
        query.awaitTermination()
        assert query.exception() is None and sink.store.version() == i
    assert rows_of(sink.view()) == rows_of(expected(spark, scratch, sum(BATCHES[:3], [])).select(*sink.view().columns))


def test_null_values_have_no_order(spark):
    record = spark.createDataFrame([], "uri string, a long, l array<long>").schema
    rows = spark.createDataFrame([("u", 1, [1, 2], 1), ("u", None, [3], 2), ("u", None, None, 3)], "uri string, a long, l array<long>, seq long")
    once = folding.folded(folding.observed(rows, record, "uri"), record, "uri")
    assert rows_of(once.select("uri", "a", "l")) == [("u", "1", "[1, 2]")]
    assert rows_of(folding.folded(once.unionByName(once), record, "uri")) == rows_of(once)
