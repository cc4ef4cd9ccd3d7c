"""Observations as a stream: each micro-batch is folded into a versioned state, and views are re-emitted whole.

A batch is one version of the state; writing it again after a failure gives the same version, so results are exact
although batches may be repeated.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mediafuse.operators.scratch import Scratch
from mediafuse.streaming import folding
from mediafuse.streaming.store import Store, Table


def observations(spark: SparkSession, schema, folders: list[str], pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """The union of the Parquet files that arrive in the folders; at most ``max_files`` of each make a batch."""
    read = lambda f: spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(f)
    return reduce(DataFrame.unionByName, map(read, folders))


class FoldedState:
    """The folded state of a stream in a bucketed store, one version per batch: a batch rewrites the buckets of its own keys."""

    def __init__(self, spark: SparkSession, folder: str, key: str, seq: str, columns: list[str], after: Callable[[DataFrame, int], None] | None = None, buckets: int = 16):
        self.key, self.seq, self.columns, self.after = key, seq, columns, after
        self.store = Store(spark, folder, {"state": Table(None, key)}, buckets)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """Folds a batch into the state; a batch that the state holds already does nothing."""
        record = batch.select(self.key, *self.columns).schema
        self.store.tables["state"] = Table(folding.state_schema(record, self.key), self.key)
        if batch_id > self.store.version():
            self.store.begin()
            scratch = Scratch(batch.sparkSession, f"fold-{batch_id}")
            fresh = scratch.write(folding.folded(folding.observed(batch, record, self.key, self.seq), record, self.key), "fresh")
            own = self.store.touched(fresh, self.key)
            self.store.replace(batch_id, "state", folding.folded(self.store.read("state", own).unionByName(fresh), record, self.key), own)
            self.store.commit(batch_id)
            scratch.drop(fresh)
        if self.after:
            self.after(self.current(), batch_id)

    def current(self) -> DataFrame:
        return self.store.read("state").select(self.key, *self.columns)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """trigger: as of ``DataStreamWriter.trigger``; processingTime bounds the delay, availableNow drains and ends."""
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()


def wait_for(probe: Callable[[], bool], timeout: float = 15.0, every: float = 0.1) -> bool:
    """Whether probe came true within the time."""
    end = time.monotonic() + timeout
    while not (done := probe()) and time.monotonic() < end:
        time.sleep(every)
    return done
