"""Derived relations that bind the operators to the driver's tables.

Each is one SQL text that Spark and the checking engine read alike; tables are named in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MEDIA = """SELECT concat('part:', CAST(p_partkey AS STRING)) AS uri, lower(replace(p_brand, '#', '')) AS origin,
  CAST(p_partkey AS STRING) AS id, p_name AS title, CAST(p_partkey % 10 AS DOUBLE) / 10 AS score, 1990 + p_size % 20 AS year,
  CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'MOVIE' ELSE 'SERIES' END AS category, CAST(floor(p_retailprice) AS BIGINT) AS popularity,
  p_partkey AS k, p_size AS size, p_type AS kind FROM {part}"""
#: Parts of consecutive lines of an order that come from one supplier are linked.
EDGES = """SELECT DISTINCT concat('part:', CAST(a AS STRING)) AS src_uri, concat('part:', CAST(b AS STRING)) AS dst_uri FROM (
  SELECT l_partkey AS a, l_suppkey AS s, lead(l_partkey) OVER w AS b, lead(l_suppkey) OVER w AS s2 FROM {lineitem}
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS t WHERE s = s2 AND a <> b"""
#: Orders and their customers, a graph of two kinds of nodes.
BIPARTITE = "SELECT DISTINCT concat('order:', CAST(o_orderkey AS STRING)) AS src_uri, concat('cust:', CAST(o_custkey AS STRING)) AS dst_uri FROM {orders}"
UPSERTS = """SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS scalar, event_id % 7 AS size FROM {events}"""
EPISODES = """SELECT concat('ep:', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS uri, role AS origin, conv_id, turn,
  concat('conv:', CAST(conv_id AS STRING)) AS media_uri, CASE WHEN turn = 0 THEN NULL ELSE turn END AS episode_number,
  CAST(floor(turn / 4) AS BIGINT) AS season, text AS title,
  CAST(CASE role WHEN 'system' THEN 0.9 WHEN 'user' THEN 0.5 ELSE 0.2 END AS DOUBLE) AS score FROM {conversations}"""
TITLES = "SELECT doc_id, lang, text AS title FROM {documents}"
#: Two id databases over the parts. Ids repeat at a rate that does not depend on the number of parts.
_PARTS = "(SELECT count(*) FROM {part})"
IDS_A = f"SELECT p_partkey + 1 AS mal, (p_partkey * 3) % ({_PARTS} - 1) AS anilist FROM {{part}}"
IDS_B = f"""SELECT p_partkey + 1 AS mal, CASE WHEN p_size % 10 = 0 THEN (p_partkey * 3 + 1) % ({_PARTS} - 1) ELSE (p_partkey * 3) % ({_PARTS} - 1) END AS anilist,
  p_partkey % CAST(floor({_PARTS} * 7 / 20.0) AS BIGINT) AS kitsu, p_partkey AS anidb FROM {{part}}"""
TABLES = ("part", "lineitem", "events", "conversations", "documents", "orders", "nation", "region", "supplier", "customer", "labels", "pages", "benchmark")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation over the tables of sf_dir."""
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def text(sql: str) -> str:
    """The relation's text over tables of their own names, in parentheses."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return f"({sql})"
