"""Keyed state of streams: folds in any order of arrival and after restarts, and debounced bursts."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from mediafuse.operators.fold import upsert_fold
from mediafuse.streaming import keyed_state
from mediafuse.streaming.upserts import observations

SCHEMA = "k long, seq long, a string, n long, tags array<string>"
ROWS = [(i % 5, i, None if i % 4 == 0 else f"v{i}", i if i % 3 else None, None if i % 6 == 5 else [f"t{i}"] * (i * 7 % 4)) for i in range(60)]


def drain(spark, folder, checkpoint, make, schema, into):
    """What a stream over the folder emits until it is drained; it goes on from its checkpoint."""
    def keep(batch, _):
        into.extend(batch.collect())
    query = make(observations(spark, schema, [folder], "*.parquet", max_files=1)).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_the_batch_fold_in_any_order_and_after_a_restart(spark, tmp_path, seed):
    folder, checkpoint, out = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    rows = random.Random(seed).sample(ROWS, len(ROWS))
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (rows[:20], rows[20:45], rows[45:]):  # each start goes on with the state of the one before
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        drain(spark, folder, checkpoint, lambda s: keyed_state.folded_stream(s, "k", "seq"), schema, out)
    got = {r.k: (r.a, r.n, r.tags) for r in out}  # the last row of a key
    want = upsert_fold(spark.createDataFrame(ROWS, SCHEMA), "k", "seq", ["a", "n"], ["tags"])
    assert got == {r.k: (r.a, r.n, r.tags) for r in want.collect()} and len(out) <= 15


def expected(times, quiet, longest):
    out, held = [], None
    for t in sorted(times):
        if held and t >= min(held[1] + quiet, held[0] + longest):
            out.append((held[0], min(held[1] + quiet, held[0] + longest), held[2]))
            held = None
        held = (held[0], t, held[2] + 1) if held else (t, t, 1)
    return out, held


def test_bursts_are_emitted_once_and_none_starves(spark, tmp_path):
    """The clock is that of the rows: one key in bursts, one that never rests, one alone."""
    folder, checkpoint, out = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    bursts = {"b": [0, 40, 90, 500, 505, 2000], "never rests": list(range(0, 2000, 50)), "alone": [700]}
    rows = [(k, t) for k, times in bursts.items() for t in times] + [("clock", 60_000), ("clock", 90_000)]
    stamped = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=t), t) for k, t in rows]
    frame = lambda part: spark.createDataFrame(part, "k string, at timestamp_ntz, t long").select("k", F.col("at").cast("timestamp").alias("at"), "t")
    for low, high in ((0, 100), (100, 1000), (1000, 50_000), (50_000, 70_000), (70_000, 100_000)):
        frame([r for r in stamped if low <= r[2] < high]).coalesce(1).write.mode("append").parquet(folder)
        drain(spark, folder, checkpoint, lambda s: keyed_state.debounced(s.withWatermark("at", "1 second"), "k", 100, 400, "at"), frame(stamped[:1]).schema, out)
    zero = datetime.datetime(2024, 1, 1)
    got = {}
    for r in out:
        ms = lambda x: round((x - zero).total_seconds() * 1000)
        got.setdefault(r.k, []).append((ms(r.first), ms(r.due), r.changes))
    for k, times in bursts.items():
        done, held = expected(times, 100, 400)
        assert sorted(got[k]) == [*done, (held[0], min(held[1] + 100, held[0] + 400), held[2])]
    assert max(due - first for first, due, _ in got["never rests"]) == 400 and sum(n for *_, n in got["never rests"]) == 40


def test_bursts_by_the_clusters_clock(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    schema = spark.createDataFrame([], "k string, n long").schema
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], schema).write.mode("append").parquet(folder)
    stream = keyed_state.debounced(observations(spark, schema, [folder], "*.parquet"), "k", 300, 5000)
    query = stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="100 milliseconds").start()
    end = time.monotonic() + 60
    while len(out) < 2 and time.monotonic() < end:
        time.sleep(0.2)
    query.stop()  # a reader that leaves ends its query
    assert not query.isActive and sorted((r.k, r.changes) for r in out) == [("a", 2), ("b", 1)]
