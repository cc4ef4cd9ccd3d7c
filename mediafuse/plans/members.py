"""Clusters over the bound media relation, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafuse.operators import identity
from mediafuse.operators.scratch import Scratch
from mediafuse.plans import bindings as B

_TITLE = "struct<language:string,title:string,score:double>"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media relation in the nested schema of a record."""
    k = F.col("k")
    made = B.relation(spark, sf_dir, B.MEDIA)
    return made.select(
        "uri", "origin", "id", "score", "k", "year",
        F.when(k % 6 == 0, F.lit(None)).when(k % 4 == 1, F.lit("SPECIAL")).when(F.col("category") == "MOVIE", F.lit("MOVIE")).otherwise(F.lit("TV")).alias("type"),
        F.when(k % 3 == 0, F.array(F.lit("ANIME"), "category")).otherwise(F.array("category")).alias("categories"),
        F.when(k % 2 == 0, F.lit("FINISHED")).when(k % 7 == 0, F.lit("RELEASING")).alias("status"),
        F.array(F.struct(F.lit("en"), F.col("title"), F.col("score")).cast(_TITLE),
                F.struct(F.lit("alt"), F.concat("title", F.lit(" "), F.lower("kind")), F.when(k % 4 != 0, F.col("score") / 2)).cast(_TITLE)).alias("titles"),
        F.when(k % 2 == 1, F.array(F.struct(F.concat(F.lit("yt:"), (k % 5).cast("string")).alias("uri"), F.col("id").alias("label")))).otherwise(
            F.array().cast("array<struct<uri:string,label:string>>")).alias("trailers"),
        F.when(k % 5 != 0, F.col("popularity")).alias("popularity"),
        F.when(k % 9 != 0, F.concat(F.col("year").cast("string"), F.lit("-01-01"))).alias("start_date"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.clusters(media(spark, sf_dir), B.relation(spark, sf_dir, B.EDGES), Scratch(spark, "members"))


def closure(edges: str) -> str:
    """CTEs e, sym, reach and comp (uri, component) over an edge query."""
    return f"""e AS (SELECT * FROM {edges} AS x), sym AS (SELECT src_uri AS u, dst_uri AS v FROM e UNION SELECT dst_uri, src_uri FROM e),
reach(n, m) AS (SELECT u, u FROM sym UNION SELECT r.n, s.v FROM reach r JOIN sym s ON r.m = s.u),
comp AS (SELECT n AS uri, min(m) AS component FROM reach GROUP BY n)"""


MEMBERS_SQL = f"""WITH RECURSIVE {closure(B.text(B.EDGES))},
base AS (SELECT uri, origin, id, score, k, year,
  CASE WHEN k % 6 = 0 THEN NULL WHEN k % 4 = 1 THEN 'SPECIAL' WHEN category = 'MOVIE' THEN 'MOVIE' ELSE 'TV' END AS type, category, k % 3 = 0 AS anime,
  CASE WHEN k % 2 = 0 THEN 'FINISHED' WHEN k % 7 = 0 THEN 'RELEASING' END AS status, title, lower(kind) AS kind,
  CASE WHEN k % 5 <> 0 THEN popularity END AS popularity, CASE WHEN k % 9 <> 0 THEN concat(CAST(year AS VARCHAR), '-01-01') END AS start_date
  FROM {B.text(B.MEDIA)} AS m),
members AS (SELECT b.*, coalesce(c.component, b.uri) AS component, count(*) OVER (PARTITION BY coalesce(c.component, b.uri)) AS n
  FROM base b LEFT JOIN comp c ON b.uri = c.uri),
titles AS (SELECT component, n, uri, score, 0 AS p, title, score AS ts FROM members
  UNION ALL SELECT component, n, uri, score, 1, concat(title, ' ', kind), CASE WHEN k % 4 <> 0 THEN score / 2 END FROM members)
"""
