"""Walks over the pages of an answer, on tables of pages that were fetched: which of them belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.operators.scratch import Scratch

#: Pages of a season that are fetched side by side, and pages beyond the first where an answer is read in part. Fixed values.
SEASON_PAGES, MORE_PAGES = 8, 2


def fixed_pages(pages: DataFrame, page: str = "page", n: int = SEASON_PAGES, failed: Column | None = None) -> DataFrame:
    """The first n pages of each answer, from 1; each stands for itself, so one that failed takes no other with it."""
    kept = pages.where(F.col(page).between(1, n))
    return kept if failed is None else kept.where(~F.coalesce(failed, F.lit(False)))


def until_short(pages: DataFrame, chain: str, page: str, records: str, size: int) -> DataFrame:
    """The pages of each answer, from 1, up to the first with fewer than ``size`` records, that one included.

    A walk goes from page to page: it ends before the first page that is not there. Where it ends is told by two
    aggregates; no answer is sorted as a whole.
    """
    rows = pages.where(F.col(page) >= 1)
    after = rows.select(chain, (F.col(page) + 1).alias(page)).unionByName(rows.select(chain).distinct().withColumn(page, F.lit(1).cast(rows.schema[page].dataType)))
    gap = after.join(rows.select(chain, page), [chain, page], "left_anti").groupBy(chain).agg(F.min(page).alias("_gap"))
    short = rows.where(F.col(records) < size).groupBy(chain).agg(F.min(page).alias("_short"))
    ends = gap.join(short, chain, "left")
    return rows.join(ends, chain).where((F.col(page) < F.col("_gap")) & (F.col(page) <= F.coalesce("_short", "_gap"))).drop("_gap", "_short")


def first_and_more(pages: DataFrame, chain: str, page: str, has_next: Column, more: int = MORE_PAGES) -> DataFrame:
    """The first page of each answer and up to ``more`` after it, as long as each says that another follows."""
    last = pages.where(F.col(page).between(1, more + 1))
    stop = last.where(~F.coalesce(has_next, F.lit(False))).groupBy(chain).agg(F.min(page).alias("_stop"))
    have = last.groupBy(chain).agg(F.collect_set(page).alias("_have"))  # more + 1 numbers at most
    walked = last.join(stop, chain, "left").join(have, chain)
    unbroken = F.forall(F.sequence(F.lit(1), F.col(page).cast("int")), lambda p: F.array_contains("_have", p.cast(pages.schema[page].dataType)))
    return walked.where((F.col(page) <= F.coalesce("_stop", F.lit(more + 1))) & unbroken).drop("_stop", "_have")


def following_links(pages: DataFrame, starts: DataFrame, scratch: Scratch, key: str = "key", following: str = "following") -> DataFrame:
    """(start, key, step): the pages that are reached from each start by next links, the start itself at step 0.

    Pointer jumping: each round doubles the links' length and the part of each walk that is known, so a walk of n
    pages takes log2(n) rounds. A link to a page that is not there ends a walk, as does one to a page that the walk
    has been to.
    """
    there = pages.select(key, F.col(following).alias("to")).dropDuplicates([key])
    jumps = scratch.write(there.join(there.select(F.col(key).alias("to")), "to", "left_semi").select(F.col(key).alias("at"), "to").where("at <> to"), "jumps")
    found = starts.select(F.col(key)).distinct().join(there.select(key), key, "left_semi")
    found = scratch.write(found.select(F.col(key).alias("start"), F.col(key).alias("at"), F.lit(0).cast("long").alias("step")), "walks")
    length = 1
    while True:
        ahead = found.join(jumps, "at").select("start", F.col("to").alias("at"), (F.col("step") + length).alias("step"))
        fresh = scratch.write(ahead.groupBy("start", "at").agg(F.min("step").alias("step")).join(found.select("start", "at"), ["start", "at"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return found.select("start", F.col("at").alias(key), "step")
        grown = scratch.write(found.unionByName(fresh), "walks")
        twice = jumps.join(jumps.select(F.col("at").alias("to"), F.col("to").alias("far")), "to").select("at", F.col("far").alias("to"))
        longer = scratch.write(twice, "jumps")
        scratch.drop(found, jumps, fresh)
        found, jumps, length = grown, longer, 2 * length


def numbered(pages: DataFrame, chain: str, order: str) -> DataFrame:
    """pages with ``page``, their number from 1 in their answer."""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy(chain).orderBy(order)).cast("long"))
