"""Boilerplate lines by site: a line goes if the share of its host's pages that hold it exceeds a ratio.

DataFrame functions only. Lines are counted by 64-bit hash, once a page. A host can have at most
(lines per page) / ratio lines above the ratio, so the lists that are joined back are bounded by the
host's mean page and not by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.llm.columns import col, free, only
from mediafuse.operators.scratch import Scratch

#: A line on more than this share of its host's pages, and on so many of them at least, is boilerplate.
RATIO, MIN_PAGES = 0.1, 3
#: So many listed hashes (8 bytes each) are sent to all tasks at most; more are joined by host.
BROADCAST_HASHES = 500_000
#: A page's lines are looked up in its host's list, which is split by hash into so many parts.
PARTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, scratch: Scratch) -> DataFrame:
    """(host, line_hash, pages, host_pages) of the lines above the ratio. Lines count trimmed; blank ones never."""
    hashes = F.transform(F.filter(F.transform(_lines(col(text)), F.trim), lambda s: s != ""), lambda s: F.xxhash64(s))
    hosted = docs.where(col(host).isNotNull())
    pages = (hosted.select(col(host).alias("host"), F.explode(F.array_distinct(hashes)).alias("line_hash"))
             .groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages))
    totals = hosted.groupBy(col(host).alias("host")).agg(F.count("*").alias("host_pages"))
    return scratch.write(pages, "pages").join(scratch.write(totals, "hosts"), "host").where(F.col("pages") > ratio * F.col("host_pages"))


def dedup_lines(docs: DataFrame, scratch: Scratch, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with text_col freed of boilerplate lines, and the columns n_lines and n_dropped.

    The same ratio holds for hosts of every size; ``min_pages`` pages of a host must hold a line before it can go,
    so that a host of a page or two loses nothing. Null text stays null (0 lines). A row without a host keeps all
    lines. Blank lines stay. A text whose every line goes is empty; no row goes. Repeated rows count as many pages.
    Texts of any length are read whole. Other columns pass unchanged, whatever their names; columns called n_lines
    or n_dropped are replaced.
    """
    docs = only(docs, [c for c in docs.columns if c not in ("n_lines", "n_dropped")])
    host, listed_col, kept_col = free(docs, "host", "listed", "kept")
    listed = boilerplate_lines(docs, host_col, text_col, ratio, min_pages, scratch).groupBy(
        F.col("host").alias(host), F.pmod("line_hash", F.lit(PARTS)).cast("int").alias("part")).agg(F.collect_list("line_hash").alias("hashes"))
    # One array of PARTS lists for each host: a line is looked for in the one that its hash names.
    listed = listed.groupBy(host).agg(F.collect_list(F.struct("part", "hashes")).alias("lists"), F.sum(F.size("hashes")).alias("n")).select(
        host, "n", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.flatten(F.transform(F.filter("lists", lambda e: e.part == i), lambda e: e.hashes))).alias(listed_col))
    listed = scratch.write(listed, "listed")
    total = listed.agg(F.sum("n")).first()[0] or 0
    listed = listed.select(host, listed_col)
    joined = docs.join(F.broadcast(listed) if total <= BROADCAST_HASHES else listed, col(host_col) == listed[host], "left")
    lines, text = _lines(col(text_col)), col(text_col)
    hashed = lambda s: F.xxhash64(F.trim(s))
    kept = F.filter(lines, lambda s: ~F.array_contains(F.get(F.col(listed_col), F.pmod(hashed(s), F.lit(PARTS)).cast("int")), hashed(s)))
    n = F.coalesce(F.size(lines), F.lit(0))
    out = joined.withColumn(kept_col, F.when(F.col(listed_col).isNull(), lines).otherwise(kept))
    new = {text_col: F.array_join(kept_col, "\n"), "n_lines": F.when(text.isNull(), 0).otherwise(n).cast("long"),
           "n_dropped": F.when(text.isNull(), 0).otherwise(n - F.size(kept_col)).cast("long")}
    return out.select(*(new[c].alias(c) if c == text_col else col(c) for c in docs.columns), *(new[c].alias(c) for c in ("n_lines", "n_dropped")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup_lines(docs, Scratch(spark, "line-dedup"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, u.pos AS pos, u.ln AS ln
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS ln, unnest(range(1, len(ls) + 1)) AS pos) u),
hosts AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
pages AS (SELECT source, trim(ln) AS ln, count(DISTINCT doc_id) AS pages FROM lines WHERE trim(ln) <> '' GROUP BY ALL),
boiler AS (SELECT source, ln FROM pages JOIN hosts USING (source)
           WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * host_pages),
marked AS (SELECT l.doc_id, l.pos, l.ln, b.ln IS NOT NULL AS drops
           FROM lines l LEFT JOIN boiler b ON l.source = b.source AND trim(l.ln) = b.ln),
kept AS (SELECT doc_id, coalesce(string_agg(ln, chr(10) ORDER BY pos) FILTER (WHERE NOT drops), '') AS text,
                count(*) AS n_lines, count(*) FILTER (WHERE drops) AS n_dropped FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
