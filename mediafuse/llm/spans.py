"""Positions of regular-expression matches, and folds along arrays that stay linear, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fold's results are gathered in blocks of so many, so that appending one never copies all before it.
BLOCK = 256
SPAN = "struct<start:int,end:int,value:string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(items: Column, state: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind> of emit(state, item) for each item in order; advance(state, item) is the state of the next."""
    def fold(start: Column, block: Column) -> Column:
        step = lambda acc, x: F.struct(advance(acc.s, x).alias("s"), F.concat(acc.out, F.array(emit(acc.s, x).cast(kind))).alias("out"))
        return F.aggregate(block, F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), step)

    def whole(xs: Column) -> Column:
        blocks = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), lambda i: F.slice(xs, i, F.lit(BLOCK))))
        add = lambda acc, b: bound(fold(acc.s, b), lambda r: F.struct(r.s.alias("s"), F.concat(acc.out, F.array(r.out)).alias("out")))
        start = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.coalesce(F.aggregate(blocks, start, add, lambda acc: F.flatten(acc.out)), F.array().cast(f"array<{kind}>"))

    return bound(items, whole)


def occurrences(text: Column, pattern: Column | str, measure: Callable[[Column], Column], group: int = 0) -> Column:
    """array<struct<start int, end int, value string>> of the leftmost non-overlapping matches in order.

    Offsets count what ``measure`` gives for a string and must add up over its parts (characters, words).
    value is the group's text. The pattern must not match the empty string. Time grows with the text and
    its matches, not with their product.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.zip_with(gaps, matches, lambda g, m: F.struct(measure(g).alias("gap"), measure(m).alias("n"), m.alias("value")))
    if group:
        sized = F.zip_with(sized, F.regexp_extract_all(text, pattern, F.lit(group)), lambda z, v: F.struct(z.gap.alias("gap"), z.n.alias("n"), v.alias("value")))
    return running(
        F.filter(sized, lambda z: z.n.isNotNull()), F.lit(0), lambda at, z: at + z.gap + z.n,
        lambda at, z: F.struct((at + z.gap).alias("start"), (at + z.gap + z.n).alias("end"), z.value.alias("value")), SPAN)


def uncontained(spans: Column, kind: str) -> Column:
    """The spans (start, end, priority and more, of type ``kind``) that lie in no other of higher priority, by start.

    One sweep by start, the longer first: only spans that reach as far as the next one's start stay in view.
    """
    flag = f"struct<span:{kind},out:boolean>"
    order = F.array_sort(spans, lambda a, b: F.coalesce(*(F.when(x < y, -1).when(x > y, 1) for x, y in (
        (a.start, b.start), (b.end, a.end), (b.priority, a.priority), (a.label, b.label))), F.lit(0)))
    view = F.array().cast("array<struct<end:int,priority:int>>")
    advance = lambda seen, d: F.concat(F.filter(seen, lambda o: o.end > d.start), F.array(F.struct(d.end.alias("end"), d.priority.alias("priority"))))
    emit = lambda seen, d: F.struct(d.alias("span"), F.exists(seen, lambda o: (o.end >= d.end) & (o.priority > d.priority)).alias("out"))
    return F.transform(F.filter(running(order, view, advance, emit, flag), lambda f: ~f.out), lambda f: f.span)
