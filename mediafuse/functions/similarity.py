"""Local alignment of titles: match 2, mismatch -1, gap -1, in code points.

The kernel is a dynamic programme in numpy over all pairs of an Arrow batch at once. Bounds in built-in
functions let callers drop hopeless pairs before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mediafuse.functions.text import strip_title

#: Pairs aligned at a time; memory is about this times the longest title times 24 bytes.
CHUNK = 2048


def align(a: list[str], b: list[str]) -> np.ndarray:
    """Best local score of each pair."""
    out = np.zeros(len(a))
    order = np.argsort([len(y) for y in b], kind="stable")
    for i in range(0, len(order), CHUNK):
        rows = order[i : i + CHUNK]
        la, lb = max(len(a[k]) for k in rows), max(len(b[k]) for k in rows)
        if not la or not lb:
            continue
        x, y = np.zeros((len(rows), la), np.uint32), np.zeros((len(rows), lb), np.uint32)
        for n, k in enumerate(rows):
            x[n, : len(a[k])] = np.frombuffer(a[k].encode("utf-32-le"), np.uint32)
            y[n, : len(b[k])] = np.frombuffer(b[k].encode("utf-32-le"), np.uint32)
        y[y == 0] = 0xFFFFFFFF
        row, best = np.zeros((len(rows), lb + 1), np.int32), np.zeros(len(rows), np.int32)
        place = np.arange(lb + 1, dtype=np.int32)
        for j in range(la):
            here = np.zeros_like(row)
            here[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + np.where(x[:, j : j + 1] == y, 2, -1), row[:, 1:] - 1))
            row = np.maximum(np.maximum.accumulate(here + place, axis=1) - place, 0)
            row[x[:, j] == 0] = 0
            best = np.maximum(best, row.max(axis=1))
        out[rows] = best
    return out


def _aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(align(a.fillna("").tolist(), b.fillna("").tolist()))


def alignment_score(a: Column, b: Column) -> Column:
    """Best local score of each row's pair; null counts as empty."""
    return pandas_udf(_aligned, "double")(a, b)


def title_similarity(a: Column, b: Column) -> Column:
    """Score over twice the longer stripped title; 0 if one is empty."""
    x, y = strip_title(a), strip_title(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).otherwise(alignment_score(x, y) / (2 * longest))


def search_score(query: Column, title: Column) -> Column:
    """Score over twice the stripped query, 1 at most: how far the title contains it."""
    q, t = strip_title(query), strip_title(title)
    return F.when((q == "") | (t == "") | q.isNull() | t.isNull(), 0.0).otherwise(F.least(F.lit(1.0), alignment_score(q, t) / (2 * F.length(q))))


def max_possible_similarity(a: Column, b: Column) -> Column:
    """A bound on the similarity of two stripped titles: letters in common over the longer length."""
    times = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    xs, ys = F.split(a, ""), F.split(b, "")
    common = F.aggregate(F.array_intersect(xs, ys), F.lit(0), lambda n, c: n + F.least(times(xs, c), times(ys, c)))
    return common / F.greatest(F.length(a), F.length(b))
