"""Id crosswalk: merging two id databases, and reading the merged index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.functions import uris

CATALOGUES = ("mal", "anilist", "kitsu", "anidb")
#: Guards of a build. Fixed values.
MIN_ROWS, MIN_SEASONS, MIN_INPUT = 15_000, 3, 30_000


def single_id(urls: Column, host: str, pattern: str) -> Column:
    """The id in the one url of a host; null for none or several."""
    own = F.filter(urls, lambda u: F.contains(u, F.lit(host)))
    return F.when(F.size(own) == 1, F.nullif(F.regexp_extract(own[0], pattern, 1), F.lit("")).try_cast("long"))


def agreed_ids(databases: list[DataFrame], key: str = "mal", others: tuple[str, ...] = CATALOGUES[1:]) -> DataFrame:
    """One row per key: each other id that some database has, and ``conflicts``, the columns on which they disagree.

    0 counts as absent. Combines map-side: two extremes of the values tell whether there are several.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), databases)
    rows = rows.select(F.nullif(key, F.lit(0)).alias(key), *(F.nullif(c, F.lit(0)).alias(c) for c in others)).where(F.col(key).isNotNull())
    ends = rows.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in others for n, f in (("lo", F.min), ("hi", F.max))))
    differ = lambda c: F.col(f"lo_{c}") < F.col(f"hi_{c}")
    return ends.select(key, *(F.when(~differ(c), F.col(f"lo_{c}")).alias(c) for c in others),
                       reduce(Column.__add__, (F.coalesce(differ(c).cast("long"), F.lit(0)) for c in others)).alias("conflicts"))


def clear_ambiguous(rows: DataFrame, columns: tuple[str, ...] = CATALOGUES[1:], key: str = "mal") -> DataFrame:
    """(key, columns): clears values that several keys claim, on all of them and all judged before any is cleared; keys left with nothing go.

    A value's claims meet by (column, value) and are counted before they are shuffled; no table is joined to itself.
    """
    claims = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("long").alias("v")) for c in columns))).alias("_of")).select(key, "_of.c", "_of.v").where("v is not null")
    sole = claims.groupBy("c", "v").agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n = 1")
    return sole.groupBy(key).agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in columns))


def merge_ids(databases: list[DataFrame], key: str = "mal", others: tuple[str, ...] = CATALOGUES[1:]) -> DataFrame:
    """The union of the databases: a key on which they disagree goes, then every id that several keys claim."""
    return clear_ambiguous(agreed_ids(databases, key, others).where("conflicts = 0").drop("conflicts"), others, key)


def delta_encode(rows: DataFrame, segment: Column, column: str = "mal") -> DataFrame:
    """``delta`` of a sorted id to the one before it in its segment; absent (0 or null) is 0 and does not count.

    Segments (ranges of the id) are encoded on their own, so that an index is the work of many tasks.
    """
    part = Window.partitionBy(segment).orderBy(column)
    real = rows.where(F.coalesce(F.col(column), F.lit(0)) != 0)
    coded = real.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(part), F.lit(0)))
    return coded.unionByName(rows.where(F.coalesce(F.col(column), F.lit(0)) == 0).withColumn("delta", F.lit(0).cast("long")))


def delta_decode(rows: DataFrame, position: str, segment: Column, delta: str = "delta") -> DataFrame:
    """``decoded``: the running sum within a segment where delta is not 0, else 0."""
    part = Window.partitionBy(segment).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("decoded", F.when(F.col(delta) == 0, 0).otherwise(F.sum(delta).over(part)).cast("long"))


def catalogue_refs(references: DataFrame, uri: str = "uri", own_origin: str = "offline") -> DataFrame:
    """references with (catalogue, ref): the catalogue id a uri names, also through ``own:catalogue-id``."""
    parts = F.split(F.col(uri), ":", 3)  # origin and id; what follows a second colon is no part of the id
    # Generated rows are not inlined: a uri is taken apart once, and not again in each condition on its parts.
    split = references.select("*", F.explode(F.array(F.struct(parts[0].alias("origin"), F.get(parts, 1).alias("id")))).alias("_of"))
    own, ident = F.col("_of.origin") == own_origin, F.col("_of.id")
    at = F.when(own, F.instr(ident, "-")).otherwise(0)
    named = F.struct(F.when(own, F.substring(ident, F.lit(1), at - 1)).otherwise(F.col("_of.origin")).alias("catalogue"), F.substring(ident, at + 1, F.length(ident)).alias("ref"))
    out = split.select(*references.columns, F.explode(F.array(named)).alias("_of")).where(F.col("_of.catalogue").isin(*CATALOGUES) & F.col("_of.ref").rlike("^[0-9]+$"))
    return out.select(*references.columns, "_of.catalogue", F.col("_of.ref").try_cast("long").alias("ref")).where("ref > 0")


def unpivoted(index: DataFrame) -> DataFrame:
    """(row columns, catalogue, ref): one row per id that an index row carries."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("catalogue"), F.col(c).cast("long").alias("ref")) for c in CATALOGUES)))
    return index.select(*CATALOGUES, each.alias("e")).select(*CATALOGUES, "e.catalogue", "e.ref").where(F.coalesce("ref", F.lit(0)) != 0)


def lookup(references: DataFrame, index: DataFrame) -> DataFrame:
    """references (catalogue, ref) with the index row that holds the id."""
    return references.join(unpivoted(index), ["catalogue", "ref"])


def row_id() -> Column:
    """An index row's own id, borrowed from the first catalogue that it has."""
    return F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.concat(F.lit(f"{c}-"), F.col(c).cast("string"))) for c in CATALOGUES))


def carriers(index: DataFrame, origin: str = "offline") -> DataFrame:
    """(src_uri, dst_uri): a star of edges from each row of two ids or more."""
    handles = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in CATALOGUES)))
    rows = index.select(F.concat(F.lit(f"{origin}:"), row_id()).alias("src_uri"), handles.alias("h")).where(F.size("h") >= 2)
    return rows.select("src_uri", F.explode("h").alias("dst_uri"))


def guarded(rows: DataFrame, least: int, what: str) -> DataFrame:
    """rows, or an error if there are fewer than ``least``."""
    n = rows.count()
    if n < least:
        raise ValueError(f"{what}: {n} rows, at least {least} are expected")
    return rows
