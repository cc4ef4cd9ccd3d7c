"""Columns by name, whatever characters the name holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def only(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*map(col, names))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
