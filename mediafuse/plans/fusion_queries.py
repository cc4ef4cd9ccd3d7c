"""Queries on fused clusters, pages over them, and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.operators import fuse
from mediafuse.operators.scratch import Scratch
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register
from mediafuse.plans.members import MEMBERS_SQL, media, members

_FIRST = lambda c: f"arg_min({c}, (-coalesce(score, 0), uri)) FILTER (WHERE {c} IS NOT NULL)"


@register("fuse_scalars", MEMBERS_SQL + f"""SELECT component, count(*) AS members, max(coalesce(score, 0)) AS score, {_FIRST('type')} AS type, {_FIRST('status')} AS status,
  {_FIRST('popularity')} AS popularity, {_FIRST('start_date')} AS start_date FROM members GROUP BY component""")
def fuse_scalars(spark, d):
    return fuse.fuse_scalars(members(spark, d), fuse.MEDIA_SCALARS).select("component", "members", "score", "type", "status", "popularity", "start_date")


@register("fuse_identity", MEMBERS_SQL + """SELECT component, CASE WHEN count(*) = 1 THEN min(uri) ELSE concat('ag:(', string_agg(uri, ',' ORDER BY uri), ')') END AS uri,
  CASE WHEN count(*) = 1 THEN min(origin) ELSE 'ag' END AS origin, sha256(min(uri)) AS cluster_id FROM members GROUP BY component""")
def fuse_identity(spark, d):
    return fuse.fuse_scalars(members(spark, d), []).select("component", "uri", "origin", "cluster_id")


_TITLES = """, firsts AS (SELECT component, title, min((CASE WHEN n = 1 THEN 0 ELSE -coalesce(ts, -1) END, -coalesce(score, 0), uri, p)) AS o FROM titles GROUP BY component, title, CASE WHEN n = 1 THEN p END)
"""


@register("fuse_titles_dedupe", MEMBERS_SQL + _TITLES + "SELECT component, string_agg(title, '|' ORDER BY o) AS titles, count(*) AS n_titles FROM firsts GROUP BY component")
def fuse_titles_dedupe(spark, d):
    out = fuse.fuse_list(members(spark, d), "titles", unique="title")
    return out.select("component", F.array_join(F.transform("titles", lambda t: t.title), "|").alias("titles"), F.size("titles").cast("long").alias("n_titles"))


_CATEGORIES = """, cats AS (SELECT component, CASE WHEN n = 1 THEN CASE WHEN anime THEN concat('ANIME,', category) ELSE category END
  ELSE concat(CASE WHEN bool_or(anime) OVER (PARTITION BY component) THEN 'ANIME,' ELSE '' END, first_value(category) OVER (PARTITION BY component ORDER BY -coalesce(score, 0), uri)) END AS categories FROM members)
"""


@register("fuse_categories", MEMBERS_SQL + _CATEGORIES + "SELECT DISTINCT component, categories FROM cats")
def fuse_categories(spark, d):
    return fuse.reconcile_categories(members(spark, d)).select("component", F.array_join("categories", ",").alias("categories"))


@register("fuse_trailers", MEMBERS_SQL + """, tr AS (SELECT component, concat('yt:', CAST(k % 5 AS VARCHAR)) AS t, min((-coalesce(score, 0), uri)) AS o FROM members WHERE k % 2 = 1 GROUP BY ALL)
SELECT component, string_agg(t, ',' ORDER BY o) AS trailers FROM tr GROUP BY component""")
def fuse_trailers(spark, d):
    out = fuse.fuse_list(members(spark, d), "trailers", unique="uri", by_score=False)
    return out.select("component", F.array_join(F.transform("trailers", lambda t: t.uri), ",").alias("trailers"))


@register("singleton_passthrough", MEMBERS_SQL + "SELECT uri, origin, score, concat(title, '|', title, ' ', kind) AS titles FROM members WHERE n = 1")
def singleton_passthrough(spark, d):
    out = fuse.fuse_media(members(spark, d), Scratch(spark, "fuse")).where("members = 1")
    return out.select("uri", "origin", "score", F.array_join(F.transform("titles", lambda t: t.title), "|").alias("titles"))


_PAGE = MEMBERS_SQL + _TITLES + _CATEGORIES + f""", page AS (SELECT m.component, CASE WHEN count(*) = 1 THEN min(uri) ELSE concat('ag:(', string_agg(uri, ',' ORDER BY uri), ')') END AS uri,
  count(*) AS members, max(coalesce(score, 0)) AS score, {_FIRST('popularity')} AS popularity, {_FIRST('status')} AS status, {_FIRST('start_date')} AS start_date FROM members m GROUP BY m.component),
full_page AS (SELECT p.*, c.categories, t.titles FROM page p JOIN (SELECT DISTINCT * FROM cats) c USING (component)
  JOIN (SELECT component, string_agg(title, '|' ORDER BY o) AS titles FROM firsts GROUP BY component) t USING (component))
SELECT uri, members, score, popularity, status, categories, titles FROM full_page """


PAGE_SQL, TITLES_SQL, CATEGORIES_SQL, FIRST_SQL = _PAGE, _TITLES, _CATEGORIES, _FIRST


def page_columns(golden):
    """The columns of a page of golden records."""
    return golden.select("uri", "members", "score", "popularity", "status", F.array_join("categories", ",").alias("categories"), F.array_join(F.transform("titles", lambda t: t.title), "|").alias("titles"))


def _page(spark, d):
    out = fuse.fuse_media(members(spark, d).drop("trailers"), Scratch(spark, "fuse"))
    return out.select("uri", "members", "score", "popularity", "status", F.col("categories").alias("_categories"), F.array_join("categories", ",").alias("categories"),
                      F.array_join(F.transform("titles", lambda t: t.title), "|").alias("titles"))


def page_order(sorts: list[str]) -> list:
    """Sort keys of a page, given as the sources name them: POPULARITY sorts down, POPULARITY_DESC up, and the last of several decides first."""
    p = F.coalesce(F.col("popularity"), F.lit(0))
    return [p.desc() if s == "POPULARITY" else p.asc() for s in reversed(sorts)] + [F.asc("uri")]


@register("media_page_popular", _PAGE)
def media_page_popular(spark, d):
    """The flagship: observed records to clusters to golden media, most popular first."""
    return _page(spark, d).drop("_categories").orderBy(*page_order(["POPULARITY"]))


@register("media_page_category", _PAGE + "WHERE categories LIKE '%MOVIE%'")
def media_page_category(spark, d):
    return _page(spark, d).where(F.arrays_overlap("_categories", F.array(F.lit("MOVIE")))).drop("_categories").orderBy(*page_order(["POPULARITY"]))


@register("media_page_multisort", _PAGE + "ORDER BY coalesce(popularity, 0), uri LIMIT 25")
def media_page_multisort(spark, d):
    return _page(spark, d).drop("_categories").orderBy(*page_order(["POPULARITY", "POPULARITY_DESC"])).limit(25)


@register("movie_as_episode", f"""SELECT concat(uri, '-1') AS uri, concat(id, '-1') AS id, uri AS media_uri, CAST(1 AS BIGINT) AS episode_number, concat(title, '|', title, ' ', lower(kind)) AS titles
  FROM {B.text(B.MEDIA)} AS m WHERE category = 'MOVIE'""")
def movie_as_episode(spark, d):
    out = fuse.movie_episodes(media(spark, d))
    return out.select("uri", "id", "media_uri", "episode_number", F.array_join(F.transform("titles", lambda t: t.title), "|").alias("titles"))


_EP = f"(SELECT *, concat('g', CAST(conv_id - conv_id % 3 AS VARCHAR)) AS component FROM {B.text(B.EPISODES)} AS x)"


@register("episodes_by_number", f"""SELECT component, episode_number, count(*) AS members, max(coalesce(score, 0)) AS score, CASE WHEN count(*) = 1 THEN min(origin) ELSE 'ag' END AS origin,
  arg_min(season, (-coalesce(score, 0), uri)) AS season_number FROM {_EP} AS e WHERE episode_number IS NOT NULL GROUP BY component, episode_number""")
def episodes_by_number(spark, d):
    rows = B.relation(spark, d, B.EPISODES).withColumns({"component": F.concat(F.lit("g"), (F.col("conv_id") - F.col("conv_id") % 3).cast("string")), "season_number": F.col("season"), "score": F.col("score").cast("double")})
    return fuse.group_episodes(rows).select("component", "episode_number", "members", "score", "origin", "season_number")


@register("episode_dedupe_last", f"""SELECT conv_id, turn, number FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN NULL ELSE turn % 5 END AS number,
  row_number() OVER (PARTITION BY conv_id, turn % 5 ORDER BY turn DESC) AS r FROM {B.text(B.EPISODES)} AS e) AS f WHERE number IS NULL OR r = 1""")
def episode_dedupe_last(spark, d):
    rows = B.relation(spark, d, B.EPISODES).select("conv_id", "turn", F.when(F.col("turn") % 5 != 0, F.col("turn") % 5).alias("number"))
    return fuse.keep_last_per_number(rows, "conv_id", "number", "turn")


@register("episode_position_number", f"SELECT conv_id, season, turn, row_number() OVER (PARTITION BY conv_id, season ORDER BY turn) AS position FROM {B.text(B.EPISODES)} AS e")
def episode_position_number(spark, d):
    rows = B.relation(spark, d, B.EPISODES)
    return fuse.numbered_by_position(rows, ["conv_id", "season"], "turn").select("conv_id", "season", "turn", "position")


@register("episode_season_counts", f"SELECT conv_id, season, count(*) AS episodes FROM {B.text(B.EPISODES)} AS e GROUP BY conv_id, season")
def episode_season_counts(spark, d):
    return fuse.season_counts(B.relation(spark, d, B.EPISODES), "conv_id", "season")
