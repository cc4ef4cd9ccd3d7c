"""Queries on the id crosswalk and the offline catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.operators import choose, crosswalk, identity
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register

_UNION = f"(SELECT mal, nullif(anilist, 0) AS anilist, NULL AS kitsu, NULL AS anidb FROM {B.text(B.IDS_A)} AS a UNION ALL SELECT mal, nullif(anilist, 0), nullif(kitsu, 0), nullif(anidb, 0) FROM {B.text(B.IDS_B)} AS b)"
_AGREED = f"""agreed AS (SELECT mal, max(anilist) AS anilist, max(kitsu) AS kitsu, max(anidb) AS anidb, count(DISTINCT anilist) > 1 OR count(DISTINCT kitsu) > 1 OR count(DISTINCT anidb) > 1 AS bad FROM {_UNION} AS u GROUP BY mal)"""
_MERGED = f"""WITH {_AGREED}, kept AS (SELECT * FROM agreed WHERE NOT bad),
marked AS (SELECT mal, CASE WHEN count(*) OVER (PARTITION BY anilist) = 1 THEN anilist END AS anilist, CASE WHEN count(*) OVER (PARTITION BY kitsu) = 1 THEN kitsu END AS kitsu,
  CASE WHEN count(*) OVER (PARTITION BY anidb) = 1 THEN anidb END AS anidb FROM kept),
merged AS (SELECT * FROM marked WHERE coalesce(anilist, kitsu, anidb) IS NOT NULL)
"""


def _databases(spark, d):
    return [B.relation(spark, d, B.IDS_A), B.relation(spark, d, B.IDS_B)]


@register("idmerge_contradiction", f"WITH {_AGREED} SELECT mal FROM agreed WHERE bad")
def idmerge_contradiction(spark, d):
    return crosswalk.agreed_ids(_databases(spark, d)).where("conflicts > 0").select("mal")


@register("idmerge_ambiguity", _MERGED + "SELECT mal, anilist, kitsu, anidb FROM merged")
def idmerge_ambiguity(spark, d):
    return crosswalk.merge_ids(_databases(spark, d)).select("mal", "anilist", "kitsu", "anidb")


@register("idmerge_metrics", _MERGED + "SELECT (SELECT count(*) FROM merged) AS kept, (SELECT count(*) FROM agreed WHERE bad) AS conflicts")
def idmerge_metrics(spark, d):
    agreed = crosswalk.agreed_ids(_databases(spark, d))
    kept = crosswalk.clear_ambiguous(agreed.where("conflicts = 0").drop("conflicts")).agg(F.count("*").alias("kept"))
    return kept.crossJoin(F.broadcast(agreed.agg(F.count_if(F.col("conflicts") > 0).alias("conflicts"))))


_SORTED = "SELECT DISTINCT o_orderkey * 3 + 1 AS mal, CAST(floor(o_orderkey / 1000) AS BIGINT) AS segment FROM {orders}"


@register("crosswalk_delta_encode", f"SELECT segment, mal, mal - coalesce(lag(mal) OVER (PARTITION BY segment ORDER BY mal), 0) AS delta FROM {B.text(_SORTED)} AS s")
def crosswalk_delta_encode(spark, d):
    return crosswalk.delta_encode(B.relation(spark, d, _SORTED), segment=F.col("segment")).select("segment", "mal", "delta")


_DELTAS = "SELECT o_orderkey AS row, CAST(floor(o_orderkey / 1000) AS BIGINT) AS segment, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_custkey % 9 + 1 END AS delta FROM {orders}"


@register("crosswalk_delta_decode", f"SELECT row, CAST(CASE WHEN delta = 0 THEN 0 ELSE sum(delta) OVER (PARTITION BY segment ORDER BY row) END AS BIGINT) AS decoded FROM {B.text(_DELTAS)} AS s")
def crosswalk_delta_decode(spark, d):
    return crosswalk.delta_decode(B.relation(spark, d, _DELTAS), "row", segment=F.col("segment")).select("row", "decoded")


_REFS = "SELECT l_orderkey, concat(CASE l_suppkey % 4 WHEN 0 THEN 'mal:' WHEN 1 THEN 'offline:anidb-' WHEN 2 THEN 'nf:' ELSE 'anilist:' END, CAST(l_partkey AS STRING)) AS uri FROM {lineitem}"
_REFS_SQL = f"""refs AS (SELECT l_orderkey, uri, CASE WHEN uri LIKE 'offline:%' THEN 'anidb' ELSE split_part(uri, ':', 1) END AS catalogue, CAST(regexp_extract(uri, '([0-9]+)$', 1) AS BIGINT) AS ref
  FROM {B.text(_REFS)} AS r WHERE uri NOT LIKE 'nf:%' AND NOT regexp_matches(uri, '[:-]0$'))"""


@register("catalogue_refs", f"WITH {_REFS_SQL} SELECT DISTINCT l_orderkey, catalogue, ref FROM refs")
def catalogue_refs(spark, d):
    return crosswalk.catalogue_refs(B.relation(spark, d, _REFS)).select("l_orderkey", "catalogue", "ref").distinct()


@register("crosswalk_lookup", _MERGED.replace("WITH ", f"WITH {_REFS_SQL}, ", 1) + """SELECT r.l_orderkey, r.uri, m.mal, m.anilist, m.kitsu, m.anidb FROM refs r JOIN merged m
  ON (r.catalogue = 'mal' AND r.ref = m.mal) OR (r.catalogue = 'anilist' AND r.ref = m.anilist) OR (r.catalogue = 'anidb' AND r.ref = m.anidb)""")
def crosswalk_lookup(spark, d):
    refs = crosswalk.catalogue_refs(B.relation(spark, d, _REFS))
    return crosswalk.lookup(refs, crosswalk.merge_ids(_databases(spark, d))).select("l_orderkey", "uri", "mal", "anilist", "kitsu", "anidb")


@register("handle_carrier", _MERGED + """SELECT concat('offline:mal-', CAST(mal AS VARCHAR)) AS src_uri, unnest(list_filter([concat('mal:', CAST(mal AS VARCHAR)), CASE WHEN anilist IS NOT NULL THEN concat('anilist:', CAST(anilist AS VARCHAR)) END,
  CASE WHEN kitsu IS NOT NULL THEN concat('kitsu:', CAST(kitsu AS VARCHAR)) END, CASE WHEN anidb IS NOT NULL THEN concat('anidb:', CAST(anidb AS VARCHAR)) END], lambda x: x IS NOT NULL)) AS dst_uri FROM merged""")
def handle_carrier(spark, d):
    return crosswalk.carriers(crosswalk.merge_ids(_databases(spark, d)))


@register("single_source_id", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_partkey END AS mal FROM part""")
def single_source_id(spark, d):
    url = lambda s: F.concat(F.lit(f"https://myanimelist.net/{s}/"), F.col("p_partkey").cast("string"))
    urls = F.when(F.col("p_size") % 3 == 0, F.array(url("anime"), url("other"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("https://anidb.net/5"), url("anime"))).otherwise(F.array(F.lit("x")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", crosswalk.single_id(urls, "myanimelist.net", "([0-9]+)/?$").alias("mal"))


@register("seasonal_or_carrier", _MERGED + """SELECT p.p_partkey, CASE WHEN p.p_size % 5 = 0 THEN concat('season:', p.p_name) WHEN m.mal IS NOT NULL THEN concat('index:', CAST(m.mal AS VARCHAR)) END AS record
  FROM part p LEFT JOIN merged m ON m.mal = p.p_partkey + 1""")
def seasonal_or_carrier(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    season = part.where("p_size % 5 = 0").select((F.col("p_partkey") + 1).alias("ref"), F.concat(F.lit("season:"), "p_name").alias("record"))
    index = crosswalk.merge_ids(_databases(spark, d)).select(F.col("mal").alias("ref"), F.concat(F.lit("index:"), F.col("mal").cast("string")).alias("record"))
    refs = part.select("p_partkey", F.posexplode(F.array(F.lit(-1).cast("long"), F.col("p_partkey") + 1)).alias("pos", "ref"))
    return choose.seasonal_or_carrier(refs, season, index, "p_partkey", "pos")


@register("source_fallback_chain", "SELECT r_regionkey, coalesce(min(CASE WHEN n_nationkey % 7 = 0 THEN n_name END), min(n_name)) AS name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def source_fallback_chain(spark, d):
    """First type that answers: rows of the first choice, else of the second."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("r_regionkey"), "n_name", "n_nationkey")
    answered = identity.first_that_answers([nation.where("n_nationkey % 7 = 0"), nation], "r_regionkey")
    hits = answered.groupBy("r_regionkey").agg(F.min("n_name").alias("name"))
    return spark.read.parquet(f"{d}/region.parquet").select("r_regionkey").join(hits, "r_regionkey", "left")
