"""Queries on pages, urls and payloads as sources give them."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.functions import text, uris
from mediafuse.operators.fold import upsert_fold
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register
from mediafuse.sources import html, providers


@register("html_card_scrape", r"""SELECT page_id, id, title FROM (SELECT page_id, id, title, row_number() OVER (PARTITION BY page_id, id ORDER BY p) AS r FROM (
  SELECT page_id, regexp_extract(card, '<a href="/([^"]+)"', 1) AS id, nullif(trim(replace(replace(regexp_extract(card, '<a [^>]*>([^<]*)</a>', 1), '&quot;', '"'), '&amp;', '&')), '') AS title, p FROM (
    SELECT page_id, unnest(string_split(html, '<li>')) AS card, unnest(range(len(string_split(html, '<li>')))) AS p FROM pages) AS x) AS y WHERE id <> '') AS z WHERE r = 1""")
def html_card_scrape(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    return html.cards(pages, "page_id", "html", "<li>", '<a href="/([^"]+)"', {"title": "<a [^>]*>([^<]*)</a>"}, heading="<h9>([^<]*)<").select("page_id", "id", "title")


@register("html_sections", r"""SELECT page_id, section, letters FROM (SELECT page_id, trim(replace(replace(regexp_extract(b, '^>([^<]*)<', 1), '&quot;', '"'), '&amp;', '&')) AS section, length(b) + 3 AS letters, p FROM (
  SELECT page_id, unnest(string_split(html, '<h1')) AS b, unnest(range(len(string_split(html, '<h1')))) AS p FROM pages) AS x) AS y WHERE p > 0""")
def html_sections(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.explode(html.sections(F.col("html"), "<h1>([^<]*)<")).alias("s")).select("page_id", "s.section", F.length("s.body").cast("long").alias("letters"))


@register("html_entities", """SELECT p_partkey, concat('<', p_name, '> & &lt; ', chr(CAST(160 + p_size AS INTEGER)), chr(CAST(12353 + p_partkey % 80 AS INTEGER)), ' café &unknown; &#0;', chr(39)) AS decoded FROM part""")
def html_entities(spark, d):
    """Named references, decimal and hexadecimal ones, one that decodes to another, and what is none."""
    n = F.col("p_size")
    raw = F.concat(F.lit("&lt;"), "p_name", F.lit("&gt; &amp; &amp;lt; &#"), (160 + n).cast("string"), F.lit(";&#x"), F.hex(12353 + F.col("p_partkey") % 80), F.lit("; caf&eacute; &unknown; &#0;&#39;"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.decode_entities(raw).alias("decoded"))


@register("page_text_clean", r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""")
def page_text_clean(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.clean_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@register("url_host_mapping", r"""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\.', '') AS host, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) AS parts FROM pages""")
def url_host_mapping(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", providers.host_of(F.col("url")).alias("host"), F.size(providers.path_parts(F.col("url"))).cast("long").alias("parts"))


_UUID = "concat('0f8fad5b-d9cb-469f-a165-', lpad(CAST(l_partkey AS STRING), 12, '0'))"
_WATCHED = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 11 AS kind, CASE l_suppkey % 11 WHEN 0 THEN concat('https://www.netflix.com/title/', CAST(l_partkey AS STRING)) WHEN 1 THEN concat('https://www.crunchyroll.com/series/G', CAST(l_partkey AS STRING), '/slug')
  WHEN 2 THEN concat('https://www.crunchyroll.com/watch/G', CAST(l_partkey AS STRING)) WHEN 3 THEN concat('https://www.amazon.com/dp/B', CAST(l_partkey AS STRING)) WHEN 4 THEN concat('https://www.hulu.com/series/x-', {_UUID}) WHEN 5 THEN concat('https://www.disneyplus.com/en/series/', CAST(l_partkey AS STRING))
  WHEN 6 THEN concat('https://tv.apple.com/us/show/', CAST(l_partkey AS STRING)) WHEN 7 THEN concat('https://www.peacocktv.com/a/b/', CAST(l_partkey AS STRING), '/') WHEN 8 THEN concat('https://www.paramountplus.com/shows/', CAST(l_partkey AS STRING)) WHEN 9 THEN concat('https://example.org/', CAST(l_partkey AS STRING)) ELSE 'not a url' END AS url FROM {{lineitem}}"""


@register("provider_content_id", f"""SELECT DISTINCT url, CASE kind WHEN 1 THEN concat('G', CAST(l_partkey AS VARCHAR)) WHEN 3 THEN concat('B', CAST(l_partkey AS VARCHAR)) WHEN 4 THEN {_UUID.replace('STRING', 'VARCHAR')} WHEN 2 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS content_id,
  ['nf', 'cr', 'cr', 'amazon', 'hulu', 'disney', NULL, NULL, NULL, NULL, NULL][kind + 1] AS origin FROM {B.text(_WATCHED)} AS w""")
def provider_content_id(spark, d):
    return B.relation(spark, d, _WATCHED).select("url").distinct().select("url", providers.content_id(F.col("url")).alias("content_id"), providers.stream_origin(F.col("url")).alias("origin"))


@register("provider_season_id", f"""SELECT l_orderkey, l_linenumber, CASE WHEN kind IN (9, 10, 2) THEN NULL WHEN l_linenumber = 7 THEN id WHEN kind = 1 THEN NULL ELSE concat(id, '-', CAST(l_linenumber AS VARCHAR)) END AS scoped FROM (
  SELECT *, CASE kind WHEN 1 THEN concat('G', CAST(l_partkey AS VARCHAR)) WHEN 3 THEN concat('B', CAST(l_partkey AS VARCHAR)) WHEN 4 THEN {_UUID.replace('STRING', 'VARCHAR')} ELSE CAST(l_partkey AS VARCHAR) END AS id FROM {B.text(_WATCHED)} AS w) AS x""")
def provider_season_id(spark, d):
    """A provider's id of one season; without a season the id is the show's, and one provider scopes ids its own way."""
    url, number = F.col("url"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber"))
    return B.relation(spark, d, _WATCHED).select("l_orderkey", "l_linenumber", uris.season_part(providers.content_id(url), number, F.coalesce(providers.stream_origin(url), F.lit(""))).alias("scoped"))


@register("affiliate_url", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 < 2 THEN concat('https://x.org/t?id=', CAST(l_partkey AS VARCHAR), '&s=1') END AS url FROM lineitem")
def affiliate_url(spark, d):
    """Where an affiliate's link leads, as one of two parameters says."""
    to = F.url_encode(F.concat(F.lit("https://x.org/t?id="), F.col("l_partkey").cast("string"), F.lit("&s=1")))
    link = F.concat(F.lit("https://click.example/r?a=1&"), F.when(F.col("l_suppkey") % 3 == 0, F.lit("u=")).when(F.col("l_suppkey") % 3 == 1, F.lit("r=")).otherwise(F.lit("q=")), to)
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", providers.real_url(link).alias("url"))


_SHOW = """concat('<html><meta property="og:title" content="', p_name, ' &amp; co"><meta property="og:description" content="', if(p_size % 3 = 0, '', concat('about ', p_name)), '"><meta property="og:image" content="https://i/', p_partkey, '.jpg"><div style="url(/t/p/w1920_x/',
  p_partkey, '.jpg)"></div>', if(p_size % 4 = 0, '', concat('<div class="user_score_chart" id="s" data-percent="', p_size * 2, '.4">')), '<a href="/tv/', p_partkey, '/season/2"></a><a href="/tv/', p_partkey, '/season/0"></a><a href="/tv/', p_partkey, '/season/1"></a>')"""


@register("tmdb_shows", """SELECT concat('tmdb:', CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN concat('-s', CAST(p_size AS VARCHAR)) ELSE '' END) AS uri, concat('https://www.themoviedb.org/tv/', CAST(p_partkey AS VARCHAR)) AS url, concat(p_name, ' & co') AS title, CASE WHEN p_size % 3 <> 0 THEN concat('about ', p_name) END AS description,
  concat('https://i/', CAST(p_partkey AS VARCHAR), '.jpg') AS cover, concat('https://media.themoviedb.org/t/p/w1920_x/', CAST(p_partkey AS VARCHAR), '.jpg') AS banner, CASE WHEN p_size % 4 <> 0 THEN p_size * 2 / 10.0 END AS average_score FROM part""")
def tmdb_shows(spark, d):
    pages = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", F.expr(_SHOW).alias("page"))
    made = pages.select(*html.show_records(pages, "p_partkey", "page", F.when(F.col("p_size") % 2 == 0, F.col("p_size"))))
    return made.select("uri", "url", F.col("titles")[0].title.alias("title"), F.get("descriptions", 0).description.alias("description"), F.col("covers")[0].url.alias("cover"), F.col("banners")[0].url.alias("banner"), "average_score")


_SEASON = """concat('<div class="card"><p>none</p></div>', array_join(transform(sequence(1, 1 + p_size % 3), e -> concat('<div class="card x"><div data-episode-number="', e, '">', if(e = 2, concat('<img alt="E', e, ' &quot;', p_name, '&quot;">'), concat('<h3><a href="/x">E', e, '</a></h3>')),
  if(e = 1, concat('<div class="overview"><p>told <b>', p_name, '</b></p></div>'), ''), '<img src="https://media.themoviedb.org/t/p/', e, '.jpg"></div>')), ''))"""


@register("tmdb_season_episodes", """SELECT concat('tmdb:', CAST(p_partkey AS VARCHAR), '-s', CAST(p_size AS VARCHAR), 'e', CAST(e AS VARCHAR)) AS uri, concat('tmdb:', CAST(p_partkey AS VARCHAR)) AS media_uri, CASE WHEN e = 2 THEN concat('E2 "', p_name, '"') ELSE concat('E', CAST(e AS VARCHAR)) END AS title,
  CASE WHEN e = 1 THEN concat('told ', p_name) END AS description, concat('https://media.themoviedb.org/t/p/', CAST(e AS VARCHAR), '.jpg') AS thumbnail, CAST(p_size AS BIGINT) AS season_number, e AS episode_number FROM (SELECT *, unnest(range(1, p_size % 3 + 2)) AS e FROM part) AS x""")
def tmdb_season_episodes(spark, d):
    pages = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", F.expr(_SEASON).alias("page"))
    made = html.season_episodes(pages, "p_partkey", "p_size", "page", F.concat(F.lit("tmdb:"), F.col("p_partkey").cast("string")))
    return made.select("uri", "media_uri", F.col("titles")[0].title.alias("title"), F.get("descriptions", 0).description.alias("description"), F.col("thumbnails")[0].url.alias("thumbnail"), "season_number", "episode_number")


_FOUND = """concat('<ul>', array_join(transform(items, i -> concat('<li data-media-type="tv"><a href="/tv/', i.p_partkey % 90, '-x"><img alt="', i.p_name, '" class="p" src="https://i/', i.p_partkey, '.jpg"></a><h2>t</h2><span class="release_date n">May 3, ', 1990 + i.p_size % 30, '</span></li>')), ''), '<li data-media-type="movie"><a href="/movie/1">')"""


@register("tmdb_search", """SELECT g, id, title, poster, start_date FROM (SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS g, CAST(p_partkey % 90 AS VARCHAR) AS id, p_name AS title, concat('https://i/', CAST(p_partkey AS VARCHAR), '.jpg') AS poster, concat(CAST(1990 + p_size % 30 AS VARCHAR), '-01-01') AS start_date,
  row_number() OVER (PARTITION BY floor(p_partkey / 100), p_partkey % 90 ORDER BY p_partkey) AS r FROM part) AS x WHERE r = 1""")
def tmdb_search(spark, d):
    items = spark.read.parquet(f"{d}/part.parquet").groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("items"))
    return html.found_shows(items.select("g", F.expr(_FOUND).alias("page")), "g", "page").select("g", "id", "title", "poster", "start_date")


_GRID = """concat('<p>x</p>', array_join(transform(array(0, 1), h -> concat('<div class="anime-header">', if(h = 0, 'TV (New)', 'TV (Continuing)'), '</div>', array_join(transform(filter(items, i -> i.p_size % 2 = h), i -> concat('<div class="js-anime-category-producer js-anime-type-', 1 + i.p_size % 5,
  '"><a href="https://myanimelist.net/anime/', i.p_partkey, '/x" class="link-title">', i.p_name, ' &amp; co</a><h3 class="h3_anime_subtitle">', if(i.p_size % 3 = 0, upper(i.p_name), ''), '</h3><span class="js-members">1,', lpad(i.p_size, 3, '0'), '</span><span class="js-score">', if(i.p_size % 4 = 0, 'N/A', '7.5'),
  '</span><span class="js-start_date">202404', if(i.p_size % 5 = 0, '00', '09'), '</span><span> ', i.p_size, ' eps </span></div>')), ''))), ''))"""


@register("season_grid_media", """SELECT concat('mal:', CAST(p_partkey AS VARCHAR)) AS uri, ['TV', 'OVA', 'MOVIE', 'SPECIAL', 'ONA'][CAST(1 + p_size % 5 AS INTEGER)] AS type, CASE WHEN p_size % 5 = 2 THEN 'ANIME,MOVIE' ELSE 'ANIME,SERIES' END AS categories, concat(CASE WHEN p_size % 3 = 0 THEN concat('en=', upper(p_name), '|') ELSE '' END, 'jp-en=', p_name, ' & co') AS titles,
  CASE WHEN p_size % 4 <> 0 THEN CAST(7.5 AS DOUBLE) END AS average_score, CAST(1000 + p_size AS BIGINT) AS popularity, CAST(p_size AS BIGINT) AS episode_count, CASE WHEN p_size % 5 <> 0 THEN '2024-04-09' END AS start_date FROM part WHERE p_size % 2 = 0""")
def season_grid_media(spark, d):
    """Media of seasonal grids; the section of those that were carried over from an earlier season is left out."""
    items = spark.read.parquet(f"{d}/part.parquet").groupBy(F.floor(F.col("p_partkey") / 50).alias("g")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("items"))
    entries = html.current_only(html.season_cards(items.select("g", F.expr(_GRID).alias("page")), "g", "page"))
    return entries.select(*html.grid_media(entries)).select("uri", "type", F.array_join("categories", ",").alias("categories"), F.array_join(F.transform("titles", lambda t: F.concat_ws("=", t.language, t.title)), "|").alias("titles"), "average_score", "popularity", "episode_count", "start_date")


@register("offer_whitelist", """SELECT l_orderkey, l_suppkey, l_partkey, origin FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, package ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS r FROM (
  SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'cru' WHEN 1 THEN 'nfx' WHEN 2 THEN 'hlu' ELSE 'zzz' END AS package, CASE l_suppkey % 4 WHEN 0 THEN 'cr' WHEN 1 THEN 'nf' WHEN 2 THEN 'hulu' END AS origin FROM lineitem WHERE l_returnflag <> 'R') AS x WHERE origin IS NOT NULL) AS y WHERE r = 1""")
def offer_whitelist(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_suppkey", "l_partkey", F.when(F.col("l_returnflag") == "R", F.lit("RENT")).otherwise(F.lit("FREE")).alias("monetization"),
        F.element_at(F.array(*map(F.lit, ("cru", "nfx", "hlu", "zzz"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("package"), F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("pos"))
    return providers.usable_offers(rows, "l_orderkey").select("l_orderkey", "l_suppkey", "l_partkey", "origin")


@register("jsonapi_sideload", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, n_name FROM events JOIN nation ON n_nationkey = CAST(json_extract_string(props, '$.k') AS BIGINT)""")
def jsonapi_sideload(spark, d):
    """Relationship ids in a JSON document, joined to the included resources."""
    refs = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    included = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return refs.join(included, "k").select("event_id", "k", "n_name")


@register("record_error_isolation", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL")
def record_error_isolation(spark, d):
    """A record that does not parse goes; its siblings stay."""
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("props"))
    parsed = raw.withColumn("p", F.from_json("props", "k bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("p._bad is null and p.k is not null").select("event_id", "p.k")


@register("origins_by_name", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name")
def origins_by_name(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").orderBy(F.collate("n_name", "UNICODE")).select("n_name", "n_nationkey")


@register("upsert_origins", "SELECT role AS origin, arg_max(text, conv_id * 1000 + turn) AS name FROM conversations WHERE length(text) > 20 GROUP BY role")
def upsert_origins(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("role").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when(F.length("text") > 20, F.col("text")).alias("name"))
    return upsert_fold(rows, "origin", "seq", ["name"])
