"""Seasons: numbers in titles, broadcast quarters, keys, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.functions.text import END, START

QUARTERS = ("winter", "spring", "summer", "fall")
_CJK = "〇一二三四五六七八九"
#: Spellings in the order in which they are tried. Fixed values.
PATTERNS = (
    rf"(?i){START}([0-9]{{1,3}})(?:st|nd|rd|th)(?U:\s+)(?:season|part|cour){END}",
    rf"(?i){START}(?:season|part|cour)(?U:\s*)([0-9]{{1,3}}){END}",
    r"シーズン(?U:\s*)([0-9]{1,3})",
    r"第(?U:\s*)([0-9〇零一二三四五六七八九十]{1,4})(?U:\s*)[期季]",
    r"([0-9]{1,3})(?U:\s*)[期기]",
    rf"{START}S([0-9]{{1,2}}){END}",
)


def cjk_number(x: Column) -> Column:
    """Digits, or Chinese digits around tens (十, one ten where no digit stands before it); null for 0 and other letters."""
    unit = lambda part: F.greatest(F.instr(F.lit(_CJK), F.right(F.translate(part, "零", "〇"), F.lit(1))) - 1, F.lit(0))
    around = F.split(x, "十", -1)
    tens = F.transform(F.slice(around, F.lit(1), F.size(around) - 1), lambda part: 10 * F.greatest(unit(part), F.lit(1)))
    written = F.aggregate(tens, unit(F.element_at(around, -1)), lambda n, ten: n + ten)
    number = F.when(x.rlike("^[0-9]+$"), x.try_cast("int")).when(x.rlike(f"^[十零{_CJK}]+$"), written)
    return F.when(number > 0, number)


def parse_season_number(t: Column) -> Column:
    """The season that a title names, by the first spelling that gives a number."""
    return F.coalesce(*(cjk_number(F.nullif(F.regexp_extract(t, p, 1), F.lit(""))) for p in PATTERNS))


def anime_season_of(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, QUARTERS)), F.quarter(d).cast("int"))


def season_key(d: Column) -> Column:
    """``2026-SUMMER``."""
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.upper(anime_season_of(d)))


def season_index(d: Column) -> Column:
    """Quarters since year 0."""
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("long")


def compact_date(t: Column) -> Column:
    """``YYYYMMDD`` as an ISO date; null where month or day is 00 or the form is another."""
    form = "^([0-9]{4})([0-9]{2})([0-9]{2})$"
    part = lambda i: F.regexp_extract(t, form, i)
    return F.when(t.rlike(form) & (part(2) != "00") & (part(3) != "00"), F.concat_ws("-", part(1), part(2), part(3)))


def year_of(t: Column) -> Column:
    """UTC year of an ISO date or time or an RFC 1123 time; null for anything else."""
    iso = F.try_to_timestamp(t)
    return F.year(F.coalesce(iso, F.try_to_timestamp(F.regexp_replace(t, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))))


def year_text(t: Column) -> Column:
    """The first year in a text as ``YYYY-01-01``."""
    y = F.regexp_extract(t, "([0-9]{4})", 1)
    return F.when(y != "", F.concat(y, F.lit("-01-01")))


def catalogue(rows: DataFrame, day: str) -> DataFrame:
    """(season_key, records): records of each broadcast season."""
    return rows.groupBy(season_key(F.col(day)).alias("season_key")).agg(F.count("*").alias("records"))


def of_season(rows: DataFrame, key: str, season: str) -> DataFrame:
    """Rows of one season by its key; the key is a partition column where the table is partitioned by it."""
    return rows.where(F.col(key) == season)
