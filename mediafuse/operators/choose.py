"""Choosing among seasons, hero candidates, sources, descriptions, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(rows: DataFrame, key: str, distance: Column, position: str, value: str, preferred: Column | None = None) -> DataFrame:
    """(key, value): the row of least distance, first on a tie; among preferred rows only where a key has any.

    A key's single row wins whatever its distance (null distances come last).
    """
    p = F.when(preferred, 0).otherwise(1) if preferred is not None else F.lit(0)
    order = F.struct(p.alias("p"), distance.isNull().alias("n"), distance.alias("d"), F.col(position).alias("o"))
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def season_by_count(seasons: DataFrame, key: str, target: str, number: str = "season_number", count: str = "episode_count", position: str = "pos") -> DataFrame:
    """(key, number): the season with about as many episodes as wanted; keys of one season have none."""
    best = seasons.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(number, F.struct(F.abs(F.col(count) - F.col(target)).alias("d"), position)).alias(number))
    return best.where("_n > 1").drop("_n")


def resolve_season(pinned: Column, only: Column, parsed: Column, counted: Column) -> Column:
    """A pinned season, else the only one, else the one its title names, else the one of like length."""
    return F.coalesce(pinned, only, parsed, counted)


def hero_candidates(media: DataFrame) -> DataFrame:
    """Media with a title and a short description; those with trailers only, if there are any."""
    usable = media.where((F.size("titles") > 0) & (F.size("short_descriptions") > 0))
    any_trailer = usable.agg(F.coalesce(F.max(F.size("trailers") > 0), F.lit(False)).alias("_any"))
    return usable.crossJoin(F.broadcast(any_trailer)).where(~F.col("_any") | (F.size("trailers") > 0)).drop("_any")


def hero_pool(candidates: DataFrame, banned: DataFrame, pool: int = 10) -> DataFrame:
    """The first ``pool`` candidates by popularity that are not banned."""
    return candidates.join(banned, "uri", "left_anti").orderBy(F.desc_nulls_last("popularity"), "uri").limit(pool)


def pick_hero(candidates: DataFrame, banned: DataFrame, seed: int, pool: int = 10) -> DataFrame:
    """One of the pool, by a seeded hash."""
    return hero_pool(candidates, banned, pool).orderBy(F.xxhash64("uri", F.lit(seed)), "uri").limit(1)


def top_sources(handles: DataFrame, key: str, external: Column, n: int = 5) -> DataFrame:
    """The first n origins of each key: own ones before external ones, by position; one row per origin."""
    first = handles.groupBy(key, "origin").agg(F.min(F.struct(external.alias("x"), F.col("pos"))).alias("o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("o", "origin"))).where(F.col("rank") <= n).drop("o")


def longest_description(rows: DataFrame, key: str, description: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(description, F.struct(F.length(description).alias("n"), F.col(description))).alias(description))


def newest_release(releases: DataFrame, tag: str, has_asset: Column) -> DataFrame:
    """The latest ``YYYY-WW`` release that carries the asset; other tags are no releases."""
    return releases.where(F.col(tag).rlike("^[0-9]{4}-[0-9]{2}$") & has_asset).orderBy(F.desc(tag)).limit(1)


def retry_delay(attempt: Column, base_ms: int = 1000, most_ms: int = 15000, header: Column | None = None, now: Column | None = None) -> Column:
    """Milliseconds before the next attempt: what the answer's header asks for (seconds or a date), else doubling; bounded."""
    doubling = F.lit(base_ms) * F.pow(F.lit(2.0), attempt)
    if header is None:
        return F.least(doubling, F.lit(float(most_ms))).cast("long")
    until = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    asked = F.coalesce(header.try_cast("double") * 1000, (F.unix_millis(until) - F.unix_millis(now)).cast("double") if now is not None else F.lit(None))
    return F.least(F.when(asked > 0, asked).otherwise(doubling), F.lit(float(most_ms))).cast("long")


#: Answers after which a request is tried again. Fixed values.
RETRYABLE = (408, 429, 502, 503, 504, 522, 524)


def canonical_address(address: Column) -> Column:
    """A plugin's address without outer space, version and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(address), "/+$", ""), "@[0-9][^@/]*$", "")


def canonical_links(links: DataFrame, address: str, position: str) -> DataFrame:
    """The different plugin addresses in canonical form, with the place where each comes first, sorted for writing."""
    rows = links.select(canonical_address(F.col(address)).alias(address), position).where(F.col(address) != "")
    return rows.groupBy(address).agg(F.min(position).alias(position)).orderBy(address)


def retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False))


def seasonal_or_carrier(refs: DataFrame, seasonal: DataFrame, index: DataFrame, key: str, position: str) -> DataFrame:
    """(key, record): of a request's catalogue refs, in order, the first that hits the season's records, else the first that hits the index.

    refs: key, position, ref; seasonal and index: ref, record.
    """
    hits = refs.join(seasonal.select("ref", F.col("record").alias("_s")), "ref", "left").join(index.select("ref", F.col("record").alias("_i")), "ref", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position)))
    return hits.groupBy(key).agg(F.coalesce(first("_s"), first("_i")).alias("record"))
