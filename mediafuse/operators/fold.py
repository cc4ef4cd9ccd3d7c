"""Folding repeated observations of a record into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_value(c: Column, seq: Column) -> Column:
    """The latest value that is not null."""
    return F.max_by(c, F.when(c.isNotNull(), seq))


def longest_value(c: Column, seq: Column) -> Column:
    """The longest array that is not null, the latest of those."""
    return F.max_by(c, F.when(c.isNotNull(), F.struct(F.size(c), seq)))


def upsert_fold(observations: DataFrame, key: str | list[str], seq: str, scalars: list[str], arrays: list[str] = ()) -> DataFrame:
    """One row per key: scalars by last_value, arrays by longest_value. Combines map-side, in any arrival order."""
    keys = [key] if isinstance(key, str) else list(key)
    s = F.col(seq)
    return observations.groupBy(*keys).agg(*(last_value(F.col(c), s).alias(c) for c in scalars), *(longest_value(F.col(c), s).alias(c) for c in arrays))


def overwrite_fold(observations: DataFrame, key: str | list[str], seq: str, columns: list[str]) -> DataFrame:
    """One row per key: the latest observation as it is, nulls included."""
    keys = [key] if isinstance(key, str) else list(key)
    last = observations.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_row"))
    return last.select(*keys, *(F.col("_row")[c].alias(c) for c in columns))


def fold_by_label(observations: DataFrame, key: str, label: str, seq: str, columns: list[str], merging: dict[str, str]) -> DataFrame:
    """Observations of labels named in ``merging`` (label to policy) fold, those of other labels overwrite.

    Policies: "fold". A label with two policies is an error of the caller and cannot be expressed here.
    """
    unknown = {p for p in merging.values()} - {"fold"}
    if unknown:
        raise ValueError(f"unknown policy: {sorted(unknown)}")
    folds = F.col(label).isin(*merging)
    merged = upsert_fold(observations.where(folds), [key, label], seq, columns)
    replaced = overwrite_fold(observations.where(~F.coalesce(folds, F.lit(False))), [key, label], seq, columns)
    return merged.unionByName(replaced)
