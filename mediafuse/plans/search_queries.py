"""Queries on search, matches, fuzzy merging and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.functions import season
from mediafuse.operators import choose, fuzzy, search
from mediafuse.operators.scratch import Scratch
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register
from mediafuse.plans.members import MEMBERS_SQL, members
from mediafuse.plans.text_queries import _NORM, alignment_sql

QUERY = "small ring"
_SEARCH = "(SELECT DISTINCT 'small ring' AS a, lower(title) AS b FROM titles)"


_HITS = MEMBERS_SQL + f""", {alignment_sql(_SEARCH)},
hits AS (SELECT t.component, max(least(1, s.score / 20)) AS relevance FROM titles t JOIN scores s ON s.b = lower(t.title) GROUP BY t.component)
"""


@register("search_relevance", _HITS + "SELECT component, round(relevance, 6) AS relevance FROM hits")
def search_relevance(spark, d):
    out = search.relevance(members(spark, d), QUERY)
    return out.select("component", F.round("relevance", 6).alias("relevance"))


@register("search_page", _HITS + "SELECT m.component AS component, round(relevance, 6) AS relevance, max(popularity) AS popularity FROM hits JOIN members m USING (component) WHERE relevance >= 0.7 GROUP BY m.component, relevance")
def search_page(spark, d):
    m = Scratch(spark, "search").write(members(spark, d).select("component", "uri", "titles", "popularity"))
    out = search.search_page(m, QUERY).groupBy("component", "relevance").agg(F.min("uri").alias("uri"), F.max("popularity").alias("popularity"))
    return out.orderBy(*search.search_order()).select("component", F.round("relevance", 6).alias("relevance"), "popularity")


_REQ = "SELECT p_partkey AS query_id, concat(p_name, ' movie') AS query, CASE WHEN p_partkey % 3 = 0 THEN 'MOVIE' WHEN p_partkey % 3 = 1 THEN 'SERIES' ELSE '' END AS want FROM {part} WHERE p_partkey % 10 = 0"
_CAND = "SELECT p_partkey - p_partkey % 10 AS query_id, p_partkey % 10 AS pos, p_partkey AS candidate_id, p_name AS title, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'MOVIE' ELSE 'SERIES' END AS have FROM {part}"
_MATCH = f"""WITH RECURSIVE both_sides AS (SELECT r.query_id, r.query, c.pos, c.candidate_id, c.title, r.want, c.have FROM {B.text(_REQ)} AS r JOIN {B.text(_CAND)} AS c USING (query_id)),
{alignment_sql("(SELECT DISTINCT query AS a, title AS b FROM both_sides)")},
scored AS (SELECT b.*, s.score / (2 * greatest(length(query), length(title))) AS sim FROM both_sides b JOIN scores s ON s.a = b.query AND s.b = b.title)
"""


def _requests(spark, d):
    as_list = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array(c)).alias("categories")
    return (B.relation(spark, d, _REQ).select("query_id", "query", as_list("want")), B.relation(spark, d, _CAND).select("query_id", "pos", "candidate_id", "title", as_list("have")))


@register("pick_title_match", _MATCH + """SELECT query_id, arg_min(candidate_id, (-sim, pos)) AS candidate_id, round(max(sim), 6) AS score FROM scored
  WHERE sim >= 0.5 AND (want = '' OR have = '' OR want = have) GROUP BY query_id""")
def pick_title_match(spark, d):
    out = search.pick_title_match(*_requests(spark, d))
    return out.withColumn("score", F.round("score", 6))


@register("first_acceptable_match", _MATCH + "SELECT query_id, arg_min(candidate_id, pos) AS candidate_id, round(arg_min(sim, pos), 6) AS score FROM scored WHERE sim >= 0.5 GROUP BY query_id")
def first_acceptable_match(spark, d):
    out = search.first_acceptable(*_requests(spark, d))
    return out.withColumn("score", F.round("score", 6))


_LADDER = """SELECT p_partkey AS query_id, p_name, concat('the ', p_name, ' Season ', CAST(p_size AS STRING), ': extra') AS query, concat(p_name, ' x') AS title,
  CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' : extra') ELSE concat('the ', p_name, ' : extra') END AS known_as FROM {part}"""


@register("ladder_match", f"""WITH RECURSIVE part_names AS (SELECT * FROM {B.text(_LADDER)} AS l),
rungs AS (SELECT query_id, 0 AS rung, query AS rung_query FROM part_names UNION ALL SELECT query_id, 1, concat('the ', p_name, ' : extra') FROM part_names
  UNION ALL SELECT query_id, 2, concat(p_name, ' : extra') FROM part_names UNION ALL SELECT query_id, 3, p_name FROM part_names),
known AS (SELECT known_as, title, min(query_id) AS candidate_id FROM part_names GROUP BY ALL),
{alignment_sql("(SELECT DISTINCT replace(known_as, ' :', '') AS a, title AS b FROM known)")},
scored AS (SELECT r.query_id, r.rung, k.candidate_id, s.score / (2 * greatest(length(s.a), length(s.b))) AS sim FROM rungs r JOIN known k ON r.rung_query = k.known_as JOIN scores s ON s.a = replace(k.known_as, ' :', '') AND s.b = k.title)
SELECT query_id, CAST(arg_min(rung, (rung, -sim, candidate_id)) AS INTEGER) AS rung, arg_min(candidate_id, (rung, -sim, candidate_id)) AS candidate_id, round(arg_min(sim, (rung, -sim, candidate_id)), 6) AS score FROM scored WHERE sim >= 0.5 GROUP BY query_id""")
def ladder_match(spark, d):
    made = B.relation(spark, d, _LADDER)
    known = made.groupBy(F.col("known_as").alias("rung_query"), "title").agg(F.min("query_id").alias("candidate_id")).withColumn("pos", F.col("candidate_id"))
    out = search.first_rung_match(made.select("query_id", "query"), known)
    return out.select("query_id", "rung", "candidate_id", F.round("score", 6).alias("score"))


_FUZZY = """SELECT concat('part:', CAST(p_partkey AS STRING)) AS uri, concat('part:', CAST(p_partkey AS STRING)) AS component, concat(p_name, CASE p_size % 6 WHEN 1 THEN ' Season 2' WHEN 2 THEN ' 3' WHEN 3 THEN 's' ELSE '' END, ' of the ', lower(p_type)) AS title,
  p_partkey % 10 AS score, CASE WHEN p_partkey % 13 <> 0 THEN concat(CAST(1990 + p_partkey % 17 AS STRING), '-04-01') END AS start_date, CASE p_size % 5 WHEN 0 THEN 'MOVIE' WHEN 1 THEN 'SPECIAL' WHEN 2 THEN NULL ELSE 'TV' END AS type FROM {part}"""


def _fuzzy(spark, d):
    rows = B.relation(spark, d, _FUZZY)
    return rows.select("uri", "component", F.array(F.struct("title", F.col("score").cast("double").alias("score"))).alias("titles"), "start_date", "type", F.array().cast("array<string>").alias("categories"))


_PROFILE = f"""prof AS (SELECT component, {_NORM} AS title, year(TRY_CAST(start_date AS DATE)) AS y, CASE type WHEN 'MOVIE' THEN 'M' WHEN 'TV' THEN 'S' END AS f,
  CASE WHEN title LIKE '% Season 2%' THEN 2 END AS s FROM {B.text(_FUZZY)} AS x)"""
_BLOCKED = "(SELECT DISTINCT p.title AS a, q.title AS b FROM prof p JOIN prof q ON p.y = q.y AND p.component < q.component AND p.title <> q.title)"
_STEM = lambda c: rf"regexp_replace({c}, '\s*[0-9]+$', '')"
_NUM = lambda c: f"nullif(regexp_extract({c}, '([0-9]+)$', 1), '')"
_LINKED = f"""WITH RECURSIVE {_PROFILE}, {alignment_sql(f"(SELECT a, b FROM {_BLOCKED} AS z WHERE least(length(a), length(b)) >= 0.9 * greatest(length(a), length(b)))")},
linked AS (SELECT p.component AS src_uri, q.component AS dst_uri FROM prof p JOIN prof q ON p.y = q.y AND p.component < q.component
  LEFT JOIN scores s ON s.a = p.title AND s.b = q.title
  WHERE (p.f IS NULL OR q.f IS NULL OR p.f = q.f) AND (p.s IS NULL OR q.s IS NULL OR p.s = q.s) AND (p.title = q.title OR (
    NOT ({_STEM('p.title')} = {_STEM('q.title')} AND {_NUM('p.title')} IS DISTINCT FROM {_NUM('q.title')}) AND s.score / (2 * greatest(length(p.title), length(q.title))) >= 0.9)))"""


@register("fuzzy_profiles", f"WITH {_PROFILE} SELECT component, title, CAST(y AS INTEGER) AS year FROM prof WHERE y IS NOT NULL")
def fuzzy_profiles(spark, d):
    made = fuzzy.profiles(_fuzzy(spark, d))
    return made["titles"].join(made["years"], "component").select("component", "title", "year")


@register("fuzzy_blocking_pairs", f"WITH {_PROFILE} SELECT p.component AS a, q.component AS b FROM prof p JOIN prof q ON p.y = q.y AND p.component < q.component")
def fuzzy_blocking_pairs(spark, d):
    return fuzzy.blocking_pairs(fuzzy.profiles(_fuzzy(spark, d)), Scratch(spark, "fuzzy"))


@register("fuzzy_decision", _LINKED + " SELECT src_uri AS a, dst_uri AS b FROM linked")
def fuzzy_decision(spark, d):
    return fuzzy.title_pairs(fuzzy.profiles(_fuzzy(spark, d)), Scratch(spark, "fuzzy"))


@register("fuzzy_merge_step", _LINKED + f""", sym AS (SELECT src_uri AS u, dst_uri AS v FROM linked UNION SELECT dst_uri, src_uri FROM linked),
reach(n, m) AS (SELECT u, u FROM sym UNION SELECT r.n, s.v FROM reach r JOIN sym s ON r.m = s.u), comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n)
SELECT uri, coalesce(c, uri) AS component FROM {B.text(_FUZZY)} AS f LEFT JOIN comp ON n = uri""")
def fuzzy_merge_step(spark, d):
    """Clusters after one round of links by title."""
    return fuzzy.merge_step(_fuzzy(spark, d), Scratch(spark, "fuzzy"))[0].select("uri", "component")


@register("fuzzy_merged_clusters")
def fuzzy_merged_clusters(spark, d):
    """To the fixed point: merged clusters may link further through guards that others of them do not state."""
    return fuzzy.fuzzy_merge(_fuzzy(spark, d), Scratch(spark, "fuzzy")).select("uri", "component")


_SEASONS = "SELECT o_custkey, o_orderkey AS pos, o_orderdate, CAST(o_orderkey % 40 AS BIGINT) AS episode_count FROM {orders}"


@register("nearest_date_season", f"""SELECT o_custkey, arg_min(pos, (pos % 3 <> 0, abs(date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE))), pos)) AS pos FROM {B.text(_SEASONS)} AS s GROUP BY o_custkey""")
def nearest_date_season(spark, d):
    rows = B.relation(spark, d, _SEASONS)
    gap = F.abs(F.datediff(F.col("o_orderdate"), F.lit("1998-06-01").cast("date")))
    return choose.nearest(
        rows.withColumn("place", F.col("pos")), "o_custkey", gap, "place", "pos", preferred=F.col("pos") % 3 == 0)


@register("nearest_count_season", f"SELECT o_custkey, arg_min(pos, (abs(episode_count - o_custkey % 30), pos)) AS pos FROM {B.text(_SEASONS)} AS s GROUP BY o_custkey HAVING count(*) > 1")
def nearest_count_season(spark, d):
    rows = B.relation(spark, d, _SEASONS).withColumns({"want": F.col("o_custkey") % 30, "place": F.col("pos")})
    return choose.season_by_count(rows, "o_custkey", "want", number="pos", position="place")


@register("season_cascade", """SELECT p_partkey, CAST(coalesce(CASE WHEN p_size % 5 = 0 THEN p_size END, CASE WHEN p_size % 7 = 0 THEN 1 END, CASE WHEN p_size % 2 = 0 AND p_size > 0 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN 9 END) AS INTEGER) AS season
  FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0 OR p_size % 2 = 0 OR p_size % 3 = 0""")
def season_cascade(spark, d):
    n = F.col("p_size")
    title = F.when(n % 2 == 0, F.concat("p_name", F.lit(" Season "), n.cast("string"))).otherwise(F.col("p_name"))
    found = choose.resolve_season(F.when(n % 5 == 0, n), F.when(n % 7 == 0, F.lit(1)), season.parse_season_number(title), F.when(n % 3 == 0, F.lit(9)))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", found.cast("int").alias("season")).where("season is not null")


_HERO = "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS titles, p_size % 3 AS descriptions, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS trailers FROM {part}"


@register("hero_candidates", f"SELECT p_partkey FROM {B.text(_HERO)} AS h WHERE titles > 0 AND descriptions > 0 AND (trailers > 0 OR NOT EXISTS (SELECT 1 FROM {B.text(_HERO)} AS g WHERE titles > 0 AND descriptions > 0 AND trailers > 0))")
def hero_candidates(spark, d):
    many = lambda c: F.array_repeat(F.lit("x"), F.col(c).cast("int"))
    rows = B.relation(spark, d, _HERO).select("p_partkey", many("titles").alias("titles"), many("descriptions").alias("short_descriptions"), many("trailers").alias("trailers"))
    return choose.hero_candidates(rows).select("p_partkey")


@register("hero_pool_unbanned", f"SELECT uri, popularity FROM {B.text(B.MEDIA)} AS m WHERE k % 4 <> 0 ORDER BY popularity DESC, uri LIMIT 10")
def hero_pool_unbanned(spark, d):
    rows = B.relation(spark, d, B.MEDIA)
    banned = rows.where("k % 4 = 0").select("uri")
    return choose.hero_pool(rows, banned).select("uri", "popularity")


@register("source_selector_top5", """SELECT l_orderkey, origin, CAST(rank AS INTEGER) AS rank FROM (SELECT l_orderkey, origin, row_number() OVER (PARTITION BY l_orderkey ORDER BY ext, pos, origin) AS rank FROM (
  SELECT l_orderkey, concat('s', CAST(l_suppkey % 9 AS VARCHAR)) AS origin, min((l_suppkey % 9 > 4, l_partkey)) AS o, min(l_suppkey % 9 > 4) AS ext, min(l_partkey) AS pos FROM lineitem GROUP BY ALL) AS x) AS y WHERE rank <= 5""")
def source_selector_top5(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.concat(F.lit("s"), (F.col("l_suppkey") % 9).cast("string")).alias("origin"), F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % 9 > 4).alias("ext"))
    return choose.top_sources(rows, "l_orderkey", F.col("ext")).select("l_orderkey", "origin", "rank")


@register("longest_description", "SELECT conv_id, arg_max(text, (length(text), text)) AS text FROM conversations GROUP BY conv_id")
def longest_description(spark, d):
    return choose.longest_description(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "text")


@register("release_tag_pick", "SELECT max(concat(CAST(year(o_orderdate) AS VARCHAR), '-', lpad(CAST(1 + month(o_orderdate) AS VARCHAR), 2, '0'))) AS tag FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderpriority = '2-HIGH'")
def release_tag_pick(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    tag = F.when(F.col("o_orderkey") % 9 == 0, F.lit("latest")).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad((1 + F.month("o_orderdate")).cast("string"), 2, "0")))
    return choose.newest_release(o.select(tag.alias("tag"), "o_orderpriority"), "tag", F.col("o_orderpriority") == "2-HIGH").select("tag")
