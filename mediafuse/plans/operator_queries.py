"""Queries on handles, episodes of clusters, merged records, builds and request rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.functions import season, text, uris
from mediafuse.operators import choose, fuse, identity, search
from mediafuse.operators.scratch import Scratch
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register
from mediafuse.plans.members import MEMBERS_SQL, closure, members
from mediafuse.plans.text_queries import ADDRESSES, alignment_sql
from mediafuse.sources import builds, records
from mediafuse.sources.catalogues import HANDLES_ONLY
from mediafuse.sources.registry import Registry, Source

_S = "CAST({} AS VARCHAR)"


@register("nested_handle_edges", """SELECT DISTINCT concat('order:', CAST(l_orderkey AS VARCHAR)) AS src_uri, unnest([concat('part:', CAST(l_partkey AS VARCHAR)), concat('supp:', CAST(l_suppkey AS VARCHAR))]) AS dst_uri FROM lineitem""")
def nested_handle_edges(spark, d):
    """An order's handles are parts, and theirs suppliers: all of them lead from the order."""
    part = F.struct(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("uri"), F.array(F.struct(F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string")).alias("uri"))).alias("handles"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(part).alias("handles"))
    return identity.nested_handles(rows.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("uri"), "handles"))


@register("missing_handles_added", """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN concat('mal:', CAST(p_partkey AS VARCHAR)) ELSE 'kitsu:1' END,
  CASE WHEN p_size % 3 <> 0 AND p_size % 2 <> 0 THEN 'mal:9' END, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'mal:9' END) AS handles FROM part""")
def missing_handles_added(spark, d):
    own = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("mal:"), F.col("p_partkey").cast("string"))).otherwise(F.lit("kitsu:1"))
    wanted = F.when(F.col("p_size") % 2 == 0, F.lit("ag:(mal:9,tmdb:4)")).otherwise(F.lit("ag:(mal:9)"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(identity.with_missing_handles(F.array(own), wanted, F.lit("tmdb")), ",").alias("handles"))


#: Three conversations share their episodes.
_EP_EDGES = """SELECT concat('ep:', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS src_uri, concat('ep:', CAST(conv_id - conv_id % 3 AS STRING), '-', CAST(turn AS STRING)) AS dst_uri FROM {conversations}"""


@register("episodes_of_clusters", f"""WITH RECURSIVE {closure(B.text(_EP_EDGES))}, eps AS (SELECT uri, media_uri FROM {B.text(B.EPISODES)} AS x), g AS (SELECT eps.uri, media_uri, coalesce(c.component, eps.uri) AS ec FROM eps LEFT JOIN comp c ON c.uri = eps.uri)
SELECT DISTINCT a.media_uri AS component, b.uri AS uri FROM g a JOIN g b USING (ec)""")
def episodes_of_clusters(spark, d):
    """Each conversation is a media; an episode that another media's episode is linked to belongs to both."""
    eps = B.relation(spark, d, B.EPISODES)
    owners = eps.select(F.col("media_uri").alias("uri"), F.col("media_uri").alias("component")).distinct()
    return identity.episodes_of_clusters(owners, eps, B.relation(spark, d, _EP_EDGES), Scratch(spark, "episodes"))


@register("episode_lists_fused", f"""SELECT component, episode_number, string_agg(title, '|' ORDER BY -score, uri) AS titles FROM (
  SELECT concat('g', CAST(conv_id - conv_id % 3 AS VARCHAR)) AS component, episode_number, title, score, uri, row_number() OVER (PARTITION BY conv_id - conv_id % 3, episode_number, title ORDER BY -score, uri) AS r FROM {B.text(B.EPISODES)} AS x WHERE episode_number IS NOT NULL) AS y WHERE r = 1 GROUP BY ALL""")
def episode_lists_fused(spark, d):
    rows = B.relation(spark, d, B.EPISODES).select("uri", "origin", F.concat(F.lit("g"), (F.col("conv_id") - F.col("conv_id") % 3).cast("string")).alias("component"), "episode_number", F.col("score").cast("double").alias("score"),
                                                   F.array(F.struct(F.lit("en").alias("language"), "title", F.col("score").cast("double").alias("score"))).alias("titles"))
    return fuse.group_episodes(rows).select("component", "episode_number", F.array_join(F.transform("titles", lambda t: t.title), "|").alias("titles"))


@register("deep_merge", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS depth, CASE WHEN p_size % 5 = 0 THEN 'a,b' ELSE 'a,b,c' END AS tags FROM part""")
def deep_merge(spark, d):
    kind = "struct<name:string,inner:struct<depth:int,kept:int>,tags:array<string>>"
    n = F.col("p_size")
    old = F.struct(F.col("p_name").alias("name"), F.struct(F.lit(1).alias("depth"), F.lit(7).alias("kept")).alias("inner"), F.array(F.lit("a"), F.lit("b")).alias("tags")).cast(kind)
    new = F.struct(F.when(n % 2 == 0, "new").alias("name"), F.struct(F.when(n % 3 != 0, 2).alias("depth"), F.lit(None).alias("kept")).alias("inner"), F.when(n % 5 != 0, F.array(F.lit("b"), F.lit("c"))).alias("tags")).cast(kind)
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", old.alias("old"), new.alias("new"))
    m = F.col("merged")
    return records.deep_merged(rows, "old", "new").where(m.inner.kept == 7).select("p_partkey", m["name"].alias("name"), m.inner.depth.alias("depth"), F.array_join(m.tags, ",").alias("tags"))


@register("stored_records", "SELECT uri, origin, id, 0 AS titles, true AS no_status FROM (SELECT concat('p:', CAST(p_partkey AS VARCHAR)) AS uri, 'p' AS origin, CAST(p_partkey AS VARCHAR) AS id FROM part) AS x")
def stored_records(spark, d):
    """What a source leaves out is null or an empty list."""
    k = F.col("p_partkey").cast("string")
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p:"), k).alias("uri"), F.lit("p").alias("origin"), k.alias("id"), F.lit(1).alias("other"))
    return records.stored(rows, records.MEDIA).select("uri", "origin", "id", F.size("titles").alias("titles"), F.col("status").isNull().alias("no_status"))


@register("descriptions_sliced", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 3 WHEN 3 THEN 3 ELSE p_size % 4 END AS n FROM part")
def descriptions_sliced(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.size(records.sliced(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("p_size") % 4)).alias("n"))


@register("plugin_links", f"SELECT address, min(n) AS n FROM (SELECT n, regexp_replace(regexp_replace(trim(address), '/+$', ''), '@[0-9][^@/]*$', '') AS address FROM {B.text(ADDRESSES)} AS v) AS x WHERE address <> '' GROUP BY address")
def plugin_links(spark, d):
    return choose.canonical_links(B.relation(spark, d, ADDRESSES), "address", "n")


@register("retry_after", """SELECT event_id, CAST(least(15000, CASE event_id % 6 WHEN 1 THEN 1000 * (1 + event_id % 20) WHEN 2 THEN CASE WHEN event_id % 25 > 9 THEN 1000 * (event_id % 25 - 9) ELSE 1000 * pow(2, event_id % 5) END ELSE 1000 * pow(2, event_id % 5) END) AS BIGINT) AS delay FROM events""")
def retry_after(spark, d):
    """What answers ask for: nothing, seconds, a time (which may have passed), a word, a number below 0, no number."""
    n = F.col("event_id")
    now = F.date_trunc("second", "ts")
    until = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + n % 25 - 9), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(n % 6 == 0, F.lit("")).when(n % 6 == 1, (1 + n % 20).cast("string")).when(n % 6 == 2, until).when(n % 6 == 3, F.lit("soon")).when(n % 6 == 4, F.lit("-1"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", choose.retry_delay(n % 5, header=header, now=now).alias("delay"))


@register("substring_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def substring_search(spark, d):
    return search.containing(spark.read.parquet(f"{d}/part.parquet"), "RING", "p_name").select("p_partkey", "p_name")


@register("season_equality", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND quarter(o_orderdate) = 3")
def season_equality(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", season.season_key(F.col("o_orderdate")).alias("season_key"))
    return season.of_season(rows, "season_key", "1996-SUMMER").select("o_orderkey")


@register("aggregated_id", "SELECT p_partkey, concat('%28a%3A', CAST(p_partkey AS VARCHAR), '%2Cb%3Ax%20y%29') AS id FROM part")
def aggregated_id(spark, d):
    u = F.array(F.lit("b:x y"), F.concat(F.lit("a:"), F.col("p_partkey").cast("string")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", uris.to_aggregated_id(u).alias("id"))


@register("source_fallback_table", "SELECT n_name FROM nation")
def source_fallback_table(spark, d):
    """The first source gives nothing at all, so the second one counts."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select("n_name")
    return identity.fallback(nation.where("false"), nation)


@register("dump_entries", "SELECT p_name AS title, CAST(p_size AS BIGINT) AS episodes, 2 AS n_sources FROM part")
def dump_entries(spark, d):
    """A dump of one document a line: what describes it and what does not parse is no entry."""
    part = spark.read.parquet(f"{d}/part.parquet")
    entry = F.to_json(F.struct(F.array(F.lit("https://a/1"), F.lit("https://b/2")).alias("sources"), F.col("p_name").alias("title"), F.col("p_size").alias("episodes")))
    lines = spark.range(1).select(F.lit('{"license": "x", "lastUpdate": "2024-01-05"}').alias("value")).unionByName(part.select(entry.alias("value"))).unionByName(spark.range(1).select(F.lit("{broken").alias("value")))
    return builds.dump_entries(lines, least=1).select("title", "episodes", F.size("sources").alias("n_sources"))


@register("id_pair_document", "SELECT p_partkey AS mal, CASE WHEN p_size % 2 = 0 THEN p_partkey + 1 END AS anilist FROM part WHERE p_size % 3 <> 0")
def id_pair_document(spark, d):
    pair = F.struct(F.when(F.col("p_size") % 3 != 0, F.col("p_partkey")).alias("mal_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey") + 1).alias("anilist_id"))
    made = spark.read.parquet(f"{d}/part.parquet").groupBy(F.floor(F.col("p_partkey") / 500)).agg(F.to_json(F.collect_list(pair)).alias("value"))
    return builds.id_pairs(made).select("mal", "anilist")


_ASKED = "SELECT p_partkey AS query_id, concat('the ', p_name, ' Season ', CAST(p_size AS STRING), ': extra') AS query, p_name, p_size FROM {part}"
_HITS = """SELECT p_partkey AS candidate_id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' : extra') ELSE concat('the ', p_name, ' : extra') END AS rung_query,
  CASE WHEN p_partkey % 4 = 0 THEN 'quite another thing' ELSE concat(p_name, ' season ', CAST(p_size AS STRING)) END AS title FROM {part}"""


@register("match_top_then_gate", f"""WITH RECURSIVE asked AS (SELECT * FROM {B.text(_ASKED)} AS a), hits AS (SELECT rung_query, arg_min(candidate_id, candidate_id) AS candidate_id, arg_min(title, candidate_id) AS title FROM {B.text(_HITS)} AS h GROUP BY rung_query),
rungs AS (SELECT query_id, 0 AS rung, query AS rung_query, query FROM asked UNION ALL SELECT query_id, 1, concat('the ', p_name, ' : extra'), query FROM asked UNION ALL SELECT query_id, 2, concat(p_name, ' : extra'), query FROM asked UNION ALL SELECT query_id, 3, p_name, query FROM asked),
met AS (SELECT query_id, rung, candidate_id, replace(lower(query), ':', '') AS a, title AS b FROM rungs JOIN hits USING (rung_query)), {alignment_sql("(SELECT DISTINCT a, b FROM met)")},
gated AS (SELECT query_id, rung, candidate_id, s.score / (2 * greatest(length(a), length(b))) AS sim FROM met JOIN scores s USING (a, b))
SELECT query_id, CAST(min(rung) AS INTEGER) AS rung, arg_min(candidate_id, rung) AS candidate_id, round(arg_min(sim, rung), 6) AS score FROM gated WHERE sim >= 0.5 GROUP BY query_id""")
def match_top_then_gate(spark, d):
    """The catalogue's first hit for a query, if it is like the title that was asked for; else the next shorter query."""
    hits = B.relation(spark, d, _HITS).withColumn("pos", F.col("candidate_id"))
    return search.top_then_gate(B.relation(spark, d, _ASKED).select("query_id", "query"), hits).withColumn("score", F.round("score", 6))


_ENTRIES = """, told AS (SELECT component, n, uri, score, 0 AS p, concat('about ', title) AS e, score AS ts FROM members UNION ALL SELECT component, n, uri, score, 1, concat(kind, ' ', CAST(k % 3 AS VARCHAR)), CASE WHEN k % 3 <> 0 THEN 0.05 END FROM members),
covers AS (SELECT component, n, uri, score, 0 AS p, concat('https://c/', CAST(k % 7 AS VARCHAR)) AS e, CASE WHEN k % 2 = 0 THEN score END AS ts FROM members)
"""
_ORDERED = "string_agg(e, '|' ORDER BY CASE WHEN n = 1 THEN 0 ELSE -coalesce(ts, -1) END, -coalesce(score, 0), uri, p)"


@register("fused_descriptions_and_covers", MEMBERS_SQL + _ENTRIES + f"SELECT component, d.descriptions AS descriptions, c.covers AS covers FROM (SELECT component, {_ORDERED} AS descriptions FROM told GROUP BY component) AS d JOIN (SELECT component, {_ORDERED} AS covers FROM covers GROUP BY component) AS c USING (component)")
def fused_descriptions_and_covers(spark, d):
    """Lists whose equal entries all stay, by their own scores."""
    k = F.col("k")
    told = lambda text, score: F.struct(F.lit("en").alias("language"), text.alias("description"), score.cast("double").alias("score"))
    title = F.col("titles")[0].title
    rows = members(spark, d).select(
        "component", "uri", "origin", "score", F.array(told(F.concat(F.lit("about "), title), F.col("score")), told(F.concat(F.substring(F.col("titles")[1].title, F.length(title) + 2, F.lit(99)), F.lit(" "), (k % 3).cast("string")), F.when(k % 3 != 0, 0.05))).alias("descriptions"),
        F.array(F.struct(F.concat(F.lit("https://c/"), (k % 7).cast("string")).alias("url"), F.when(k % 2 == 0, F.col("score")).alias("score"))).alias("covers"))
    out = fuse.fuse_media(rows, Scratch(spark, "lists"))
    return out.select("component", F.array_join(F.transform("descriptions", lambda x: x.description), "|").alias("descriptions"), F.array_join(F.transform("covers", lambda x: x.url), "|").alias("covers"))


@register("descriptions_rendered", "SELECT p_partkey, concat('About ', p_name, ' & co: see here or there. - no item') AS plain FROM part")
def descriptions_rendered(spark, d):
    """Plain text of descriptions in Markdown and HTML."""
    raw = F.concat(F.lit("## About **"), "p_name", F.lit("** &amp; co:\n\n- see [here](https://x.org/a) <i>or</i>\n> `there`. - no item"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.rendered_text(raw).alias("plain"))


@register("registered_sources", """SELECT origin, count(*) AS records, min(title) AS first_title FROM (SELECT 'parts' AS origin, p_name AS title FROM part UNION ALL SELECT 'suppliers', s_name FROM supplier) AS x GROUP BY origin""")
def registered_sources(spark, d):
    """The union of what the registered sources read; rows of another origin than the source's own, and sources that fail, give nothing."""
    table = lambda t, c, origin: lambda s, **_: s.read.parquet(f"{d}/{t}.parquet").select(origin.alias("origin"), F.col(c).alias("title"))
    known = Registry()
    known.register("tables", [Source("parts", "Parts", readers={"media": table("part", "p_name", F.lit("parts"))}), Source("suppliers", "Suppliers", readers={"media": table("supplier", "s_name", F.lit("suppliers"))}),
                              Source("liar", "Another's rows", readers={"media": table("nation", "n_name", F.lit("parts"))}), Source("absent", "No table", readers={"media": table("no_such_table", "x", F.lit("absent"))})])
    known.register("handles", [Source(o, n) for o, n in HANDLES_ONLY.items()])
    rows = known.read(spark, "media")
    return rows.groupBy("origin").agg(F.count("*").alias("records"), F.min("title").alias("first_title"))


@register("source_origins", "SELECT DISTINCT CASE origin_no WHEN 0 THEN 'disney' WHEN 1 THEN 'amazon' WHEN 2 THEN 'hulu' WHEN 3 THEN 'peacock' WHEN 4 THEN 'hbo' ELSE 'fubo' END AS origin, CASE origin_no WHEN 0 THEN 'Disney+' WHEN 1 THEN 'Prime Video' WHEN 2 THEN 'Hulu' WHEN 3 THEN 'Peacock' WHEN 4 THEN 'HBO Max' ELSE 'Fubo' END AS name FROM (SELECT l_suppkey % 6 AS origin_no FROM lineitem) AS x")
def source_origins(spark, d):
    """Origins of handles that no source reads: they are looked up by the uris that name them."""
    handles = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.element_at(F.array(*map(F.lit, HANDLES_ONLY)), (F.col("l_suppkey") % 6 + 1).cast("int")), F.lit(":"), F.col("l_partkey").cast("string")).alias("uri"))
    named = spark.createDataFrame(list(HANDLES_ONLY.items()), "origin string, name string")
    return handles.select(uris.origin_of(F.col("uri")).alias("origin")).distinct().join(named, "origin")


@register("episodes_in_order", f"SELECT uri, episode_number FROM {B.text(B.EPISODES)} AS e ORDER BY episode_number NULLS LAST, uri LIMIT 40")
def episodes_in_order(spark, d):
    return fuse.episode_order(B.relation(spark, d, B.EPISODES)).select("uri", "episode_number").limit(40)


@register("movies_and_first_titles", MEMBERS_SQL + "SELECT uri, category = 'MOVIE' AS movie, title FROM members")
def movies_and_first_titles(spark, d):
    return members(spark, d).select("uri", records.is_movie(F.col("categories")).alias("movie"), records.first_title(F.col("titles")).alias("title"))
