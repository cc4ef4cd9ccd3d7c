"""Requests that stay open while sources join and leave.

Each source is a stream of its own, and the requests are one more; all of them write one store. A record answers the
open requests for its key, whichever of the two came first, so a source that joins late answers what is still open.
A source that leaves ends its stream; its rows, and the answers that they gave, stay.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mediafuse.operators.scratch import Scratch
from mediafuse.streaming.store import Store, Table

_TEXT = lambda *names: StructType([StructField(n, StringType()) for n in names])
#: A change of a request: ``open`` or not, by its sequence.
REQUEST = "request string, key string, open boolean, seq long"
RECORD = "key string, uri string"


class Fanout:
    """requests: open ones by key; records: of all sources, by key; answers: (request, origin, uri), once each."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        requests = StructType([*_TEXT("request", "key"), StructField("seq", LongType())])
        self.spark, self.store = spark, Store(spark, folder, {"requests": Table(requests, "key"), "records": Table(_TEXT("origin", "key", "uri"), "key"), "answers": Table(_TEXT("request", "origin", "uri"), "request")}, buckets)
        self.sources: dict[str, StreamingQuery] = {}
        self._one = threading.Lock()  # the streams' batches take turns

    def answers(self) -> DataFrame:
        return self.store.read("answers")

    def _commit(self, stream: str, batch: int, version: int, answers: DataFrame, scratch: Scratch) -> None:
        found = scratch.write(answers.select("request", "origin", "uri").distinct(), "answers")
        self.store.append(version, "answers", found, self.store.touched(found, "request"))
        self.store.commit(version, {stream: batch})

    def apply_records(self, origin: str, batch: DataFrame, batch_id: int) -> None:
        """Adds a source's records that are new, and answers the open requests for their keys."""
        with self._one:
            if batch_id <= self.store.applied().get(origin, -1):
                return
            self.store.begin()
            version, scratch = self.store.version() + 1, Scratch(self.spark, "fanout")
            rows = scratch.write(batch.select(F.lit(origin).alias("origin"), "key", "uri").where("key is not null and uri is not null").distinct(), "records")
            own = self.store.touched(rows, "key")
            fresh = scratch.write(rows.join(self.store.read("records", own), ["origin", "key", "uri"], "left_anti"), "fresh")
            self.store.append(version, "records", fresh, own)
            self._commit(origin, batch_id, version, self.store.read("requests", own).join(fresh, "key"), scratch)

    def apply_requests(self, batch: DataFrame, batch_id: int) -> None:
        """Opens and closes requests; the last change of a request counts. Opened ones are answered by the records that are there."""
        with self._one:
            if batch_id <= self.store.applied().get("", -1):
                return
            self.store.begin()
            version, scratch = self.store.version() + 1, Scratch(self.spark, "fanout")
            last = scratch.write(batch.where("key is not null").groupBy("request", "key").agg(F.max_by("open", "seq").alias("open"), F.max("seq").alias("seq")), "requests")
            own = self.store.touched(last, "key")
            held = self.store.read("requests", own)
            stays = held.join(last.select("request", "key"), ["request", "key"], "left_anti")
            opened = scratch.write(last.where("open").select("request", "key", "seq"), "opened")
            self.store.replace(version, "requests", stays.unionByName(opened), own)
            before = held.select("request", "key")
            self._commit("", batch_id, version, opened.join(before, ["request", "key"], "left_anti").join(self.store.read("records", own), "key"), scratch)

    def serve(self, requests: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Takes a stream of REQUEST."""
        return requests.writeStream.foreachBatch(self.apply_requests).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()

    def join(self, origin: str, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """A source joins with its stream of RECORD; one that is there already goes on. A source that cannot start takes no other with it."""
        if (now := self.sources.get(origin)) is None or not now.isActive:
            self.sources[origin] = records.writeStream.foreachBatch(lambda b, i: self.apply_records(origin, b, i)).option("checkpointLocation", checkpoint).trigger(
                **(trigger or {"processingTime": "100 milliseconds"})).start()
        return self.sources[origin]

    def leave(self, origin: str) -> None:
        """A source leaves: nothing more of it is read, what it gave stays."""
        if (query := self.sources.pop(origin, None)) is not None:
            query.stop()
