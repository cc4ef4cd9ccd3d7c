"""Streams whose state is kept by key: folded records, and bursts of changes that are emitted once.

``transformWithState`` keeps the state in Spark's own store, so it survives lost executors and restarts from the
checkpoint. The store has to be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Fold(StatefulProcessor):
    """Per key the latest value of each scalar that is not null, and the longest of each list, the latest of those.

    Scalars and the orders of all values are one value state; the entries of each list are a list state, which is
    written only when a longer list comes.
    """

    def __init__(self, key: str, seq: str, record: StructType):
        self.key, self.seq = key, seq
        self.scalars = [f for f in record if f.name not in (key, seq) and not isinstance(f.dataType, ArrayType)]
        self.lists = [f for f in record if isinstance(f.dataType, ArrayType)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        orders = [StructField(f"_{f.name}", LongType()) for f in self.scalars] + [StructField(f"{p}_{f.name}", LongType()) for f in self.lists for p in ("n", "s")]
        self.held = handle.getValueState("held", StructType([*(StructField(f.name, f.dataType) for f in self.scalars), *orders]))
        self.entries = {f.name: handle.getListState(f"entries_{f.name}", StructType([StructField("e", f.dataType.elementType)])) for f in self.lists}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [f.name for f in self.scalars]
        held = self.held.get() if self.held.exists() else None
        columns = names + [f"_{n}" for n in names] + [f"{p}_{f.name}" for f in self.lists for p in ("n", "s")]
        state = dict(zip(columns, held, strict=True)) if held is not None else dict.fromkeys(columns)
        longer: dict[str, list] = {}
        for row in rows:
            at = row[self.seq]
            for n in names:
                if row[n] is not None and (state[f"_{n}"] is None or at >= state[f"_{n}"]):
                    state[n], state[f"_{n}"] = row[n], at
            for f in self.lists:
                value = row[f.name]
                if value is not None and (state[f"s_{f.name}"] is None or (len(value), at) >= (state[f"n_{f.name}"], state[f"s_{f.name}"])):
                    longer[f.name], state[f"n_{f.name}"], state[f"s_{f.name}"] = value, len(value), at
        self.held.update(tuple(state[c] for c in columns))
        for name, value in longer.items():
            self.entries[name].put([(e,) for e in value]) if value else self.entries[name].clear()
        lists = {f.name: None if state[f"s_{f.name}"] is None else list(longer[f.name]) if f.name in longer else [e[0] for e in self.entries[f.name].get()] for f in self.lists}
        yield Row(**{self.key: key[0]}, **{n: state[n] for n in names}, **lists)


def folded_stream(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The changed rows of the fold of a stream, one for each key of a batch. The last row of a key is its folded record."""
    use_rocksdb(rows.sparkSession)
    fold = Fold(key, seq, rows.schema)
    out = StructType([rows.schema[key], *fold.scalars, *fold.lists])
    return rows.groupBy(key).transformWithState(statefulProcessor=fold, outputStructType=out, outputMode="Update", timeMode="None")


class Debounce(StatefulProcessor):
    """Changes of a key are held back until none has come for ``quiet`` milliseconds, but for ``longest`` at most.

    State: the first and last time and the number of the changes held back. Time is that of the rows, or the
    cluster's clock where ``at`` is not given.
    """

    def __init__(self, key: str, quiet: int, longest: int, at: str | None = None):
        self.key, self.quiet, self.longest, self.at = key, quiet, longest, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", StructType([StructField(n, LongType()) for n in ("first", "last", "n")]))

    def _due(self, first: int, last: int) -> int:
        return min(last + self.quiet, first + self.longest)

    def _emitted(self, key, first: int, last: int, n: int) -> Row:
        return Row(**{self.key: key[0]}, first=first, due=self._due(first, last), changes=n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.at is None:
            now = timerValues.getCurrentProcessingTimeInMs()
            times = [now for _ in rows]
        else:
            times = sorted(r[self.at] for r in rows)
        held = tuple(self.burst.get()) if self.burst.exists() else None
        if held:
            self.handle.deleteTimer(self._due(held[0], held[1]))
        for t in times:
            if held and t >= self._due(held[0], held[1]):
                yield self._emitted(key, *held)
                held = None
            held = (held[0], t, held[2] + 1) if held else (t, t, 1)
        self.burst.update(held)
        self.handle.registerTimer(self._due(held[0], held[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.burst.exists():
            held = tuple(self.burst.get())
            self.burst.clear()
            yield self._emitted(key, *held)


def debounced(rows: DataFrame, key: str, quiet: int, longest: int, at: str | None = None) -> DataFrame:
    """(key, first, due, changes): one row for each burst of changes of a key, when it is due.

    ``at`` names the column of the rows' times (timestamps in UTC, with a watermark); bursts are then the same whatever
    the batches. Without it the cluster's clock counts.
    """
    use_rocksdb(rows.sparkSession)
    timed = rows.withColumn("_ms", F.unix_millis(at)) if at else rows
    out = StructType([rows.schema[key], StructField("first", LongType()), StructField("due", LongType()), StructField("changes", LongType())])
    bursts = timed.groupBy(key).transformWithState(
        statefulProcessor=Debounce(key, quiet, longest, "_ms" if at else None), outputStructType=out, outputMode="Append", timeMode="EventTime" if at else "ProcessingTime")
    return bursts.withColumns({c: F.timestamp_millis(c) for c in ("first", "due")})
