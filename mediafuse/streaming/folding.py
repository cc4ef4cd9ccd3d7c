"""Folded records that can be folded further: each value is kept with its order, so that batches may come in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def _is_list(field: StructField) -> bool:
    return isinstance(field.dataType, ArrayType)


def _values(record: StructType, key: str) -> list[StructField]:
    return [f for f in record if f.name != key]


def state_schema(record: StructType, key: str) -> StructType:
    """The record's columns, the key first, each with the order of its value: the sequence, for lists after their length."""
    order = lambda f: StructField(f"_{f.name}", StructType([StructField("n", LongType()), StructField("seq", LongType())]))
    return StructType([record[key], *(g for f in _values(record, key) for g in (f, order(f)))])


def observed(rows: DataFrame, record: StructType, key: str, seq: str = "seq") -> DataFrame:
    """Observations in the form of the state: null values have no order, so they never replace any."""
    def order(f: StructField) -> Column:
        n = F.size(f.name).cast("long") if _is_list(f) else F.lit(0).cast("long")
        return F.when(F.col(f.name).isNotNull(), F.struct(n.alias("n"), F.col(seq).cast("long").alias("seq"))).alias(f"_{f.name}")
    return rows.select(key, *(c for f in _values(record, key) for c in (F.col(f.name), order(f))))


def folded(rows: DataFrame, record: StructType, key: str) -> DataFrame:
    """One row per key of rows in the form of the state: of each scalar the latest value, of each list the longest, the latest of those."""
    return rows.groupBy(key).agg(*(c for f in _values(record, key) for c in (F.max_by(f.name, f"_{f.name}").alias(f.name), F.max(f"_{f.name}").alias(f"_{f.name}"))))
