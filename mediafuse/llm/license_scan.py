"""Licence signatures in documents: ordered rules behind a keyword test, overlaps resolved by priority
and containment. DataFrame functions only; one pass over the texts without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.llm.columns import col, free
from mediafuse.llm.license_rules import gate, rules
from mediafuse.llm.spans import occurrences, uncontained

#: Fixed phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_SPAN = "struct<start:int,end:int,label:string,priority:int,confidence:int>"
_SPANS = f"array<{_SPAN}>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def word_line(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, each between single spaces."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))))


def _rule_spans(line: Column) -> Column:
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in r._asdict().items())) for r in rules()))
    applied = F.transform(
        F.filter(table, lambda r: F.contains(line, r.keyword)),
        lambda r: F.transform(occurrences(line, r.pattern, _spaces), lambda o: F.struct(
            o.start.alias("start"), o.end.alias("end"), r.label.alias("label"), r.priority.alias("priority"), r.confidence.alias("confidence"))))
    return F.flatten(applied)


def _base_places(line: Column, phrase: str, label: str) -> Column:
    places = F.transform(occurrences(line, f" {phrase}(?= )", _spaces), lambda o: F.struct(o.start.alias("start"), F.lit(label).alias("label")))
    return F.when(F.contains(line, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (without text_col) with n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A detection that lies inside another of higher priority goes; score is the highest confidence of those
    left, 0 without any. Null and empty texts have no words and no labels. Positions count words from 0.
    Whole texts are scanned; the time for a text grows with its length and its matches. Repeated rows give
    equal rows; columns of the new names are replaced, others pass.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    rest = [c for c in docs.columns if c != text_col and c not in new]
    line_col, base_col, spans_col, kept_col, n_col = free(docs, "line", "base", "spans", "kept", "n")
    line, base, spans, kept = map(F.col, (line_col, base_col, spans_col, kept_col))
    lined = docs.select(*map(col, rest), word_line(F.coalesce(col(text_col), F.lit(""))).alias(line_col))
    places = F.concat(*(_base_places(line, phrase, label) for phrase, label in BASE.items()))
    possible = F.rlike(line, F.lit(gate()))
    found = lined.select(
        *map(col, rest), places.alias(base_col), F.when(possible, _rule_spans(line).cast(_SPANS)).otherwise(F.array().cast(_SPANS)).alias(spans_col),
        F.when(line == " ", 0).otherwise(_spaces(line) - 1).cast("long").alias(n_col))
    found = found.select(*map(col, rest), n_col, base_col, F.when(F.size(spans) > 1, uncontained(spans, _SPAN)).otherwise(spans).alias(kept_col))
    starts, base_labels = F.transform(base, lambda b: b.start), F.transform(base, lambda b: b.label)
    made = (F.col(n_col), F.size(base).cast("long"), F.array_min(starts).cast("long"), F.array_max(starts).cast("long"), F.array_join(F.array_sort(F.array_distinct(base_labels)), ","),
            F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(kept, lambda d: d.label)))), ","),
            F.coalesce(F.array_max(F.transform(kept, lambda d: d.confidence)), F.lit(0)) / F.lit(100.0),
            F.array_join(F.transform(F.array_sort(kept), lambda d: F.concat_ws(":", d.label, d.start, d.end)), ","))
    return found.select(*map(col, rest), *(c.alias(n) for c, n in zip(made, new, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
