"""Queries on uris, titles and seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.functions import season, similarity, text, uris
from mediafuse.operators.choose import canonical_address, retry_delay
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register


_URIS = "SELECT p_partkey, concat(CASE WHEN p_partkey % 11 = 0 THEN '' ELSE lower(p_brand) END, ':', CAST(p_partkey AS STRING), CASE p_partkey % 7 WHEN 0 THEN ':x' WHEN 1 THEN '/y' WHEN 2 THEN '(z)' ELSE '' END) AS uri FROM {part}"


@register("uri_parse", f"""SELECT p_partkey, string_split(uri, ':')[1] AS origin, string_split(uri, ':')[2] AS id, len(list_filter(string_split(uri, ':'), lambda x: x <> '')) = 2 AS is_uri FROM {B.text(_URIS)} AS u""")
def uri_parse(spark, d):
    u = F.col("uri")
    return B.relation(spark, d, _URIS).select("p_partkey", uris.origin_of(u).alias("origin"), uris.id_of(u).alias("id"), uris.is_uri(u).alias("is_uri"))


@register("uri_routable", f"SELECT p_partkey, position(':' IN uri) > 1 AND NOT regexp_matches(substr(uri, position(':' IN uri) + 1), '[,/()]') AS routable FROM {B.text(_URIS)} AS u")
def uri_routable(spark, d):
    return B.relation(spark, d, _URIS).select("p_partkey", uris.is_routable(F.col("uri")).alias("routable"))


_ORDER_URIS = "SELECT l_orderkey, l_suppkey % 5 AS o, l_partkey FROM {lineitem}"


def _aggregated(spark, d):
    rows = B.relation(spark, d, _ORDER_URIS).select("l_orderkey", F.concat(F.lit("o"), F.col("o").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")).alias("u")).distinct()
    return rows.groupBy("l_orderkey").agg(uris.to_aggregated_uri(F.collect_list("u")).alias("aggregated_uri"))


_AGGREGATED = f"""(SELECT l_orderkey, concat('ag:(', string_agg(concat('o', CAST(o AS VARCHAR), ':', i), ',' ORDER BY o, i), ')') AS aggregated_uri
  FROM (SELECT DISTINCT l_orderkey, o, CAST(l_partkey AS VARCHAR) AS i FROM {B.text(_ORDER_URIS)} AS x) AS y GROUP BY l_orderkey)"""


@register("aggregated_uri_build", f"SELECT * FROM {_AGGREGATED} AS z")
def aggregated_uri_build(spark, d):
    return _aggregated(spark, d)


@register("aggregated_uri_parse", f"""SELECT l_orderkey, count(*) AS handles, min(CASE WHEN o = 2 THEN concat('o2:', i) END) AS first_o2 FROM (
  SELECT DISTINCT l_orderkey, o, CAST(l_partkey AS VARCHAR) AS i FROM {B.text(_ORDER_URIS)} AS x) AS y GROUP BY l_orderkey""")
def aggregated_uri_parse(spark, d):
    u = F.col("aggregated_uri")
    return _aggregated(spark, d).where(uris.is_aggregated(u)).select("l_orderkey", F.size(uris.handles_of(u)).cast("long").alias("handles"), uris.handle_from(u, "o2").alias("first_o2"))


@register("aggregated_uri_overlap", f"""SELECT a.l_orderkey, len(list_intersect(string_split(trim(a.aggregated_uri, 'ag:()'), ','), string_split(trim(b.aggregated_uri, 'ag:()'), ','))) > 0 AS shares
  FROM {_AGGREGATED} AS a JOIN {_AGGREGATED} AS b ON a.l_orderkey + 1 = b.l_orderkey""")
def aggregated_uri_overlap(spark, d):
    a = _aggregated(spark, d)
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("aggregated_uri").alias("other"))
    return a.join(b, "l_orderkey").select("l_orderkey", uris.overlap(F.col("aggregated_uri"), F.col("other")).alias("shares"))


@register("aggregated_uri_merge", """SELECT l_orderkey, concat('ag:(', string_agg(concat('o', CAST(o AS VARCHAR), ':', CAST(i AS VARCHAR)), ',' ORDER BY o), ')') AS merged FROM (
  SELECT l_orderkey, l_suppkey % 5 AS o, min(l_partkey) AS i FROM lineitem GROUP BY ALL) AS x GROUP BY l_orderkey""")
def aggregated_uri_merge(spark, d):
    return _aggregated(spark, d).select("l_orderkey", uris.merge_aggregated(F.array("aggregated_uri")).alias("merged"))


@register("episode_suffix", f"SELECT uri, regexp_extract(uri, '^(.*)-[^-]*$', 1) AS base, regexp_extract(uri, '-([^-]*)$', 1) AS episode_id FROM {B.text(B.EPISODES)} AS e")
def episode_suffix(spark, d):
    parts = uris.without_episode(F.col("uri"))
    return B.relation(spark, d, B.EPISODES).select("uri", parts.uri.alias("base"), parts.episode_id.alias("episode_id"))


_SCOPED = "SELECT p_partkey, concat(CAST(p_partkey AS STRING), CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '-s3e1' ELSE concat('-s', CAST(p_size AS STRING)) END) AS id FROM {part}"


@register("season_scoped_id", f"""SELECT p_partkey, CASE WHEN regexp_matches(id, '^.+-s[0-9]{{1,3}}$') THEN regexp_extract(id, '^(.+)-s[0-9]{{1,3}}$', 1) ELSE id END AS show_id,
  CASE WHEN regexp_matches(id, '^.+-s[0-9]{{1,3}}$') THEN CAST(regexp_extract(id, '-s([0-9]{{1,3}})$', 1) AS INTEGER) END AS season FROM {B.text(_SCOPED)} AS s""")
def season_scoped_id(spark, d):
    parts = uris.split_season_scoped(F.col("id"))
    return B.relation(spark, d, _SCOPED).select("p_partkey", parts.show_id.alias("show_id"), parts.season.alias("season"))


_STRIP = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))"
_NORM = rf"trim(regexp_replace(regexp_replace({_STRIP}, '\b(?:the|an?)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@register("strip_title", f"SELECT doc_id, {_STRIP} AS stripped FROM {B.text(B.TITLES)} AS t")
def strip_title(spark, d):
    return B.relation(spark, d, B.TITLES).select("doc_id", text.strip_title(F.col("title")).alias("stripped"))


@register("normalize_title", f"SELECT doc_id, {_NORM} AS normalized FROM {B.text(B.TITLES)} AS t")
def normalize_title(spark, d):
    return B.relation(spark, d, B.TITLES).select("doc_id", text.normalize_title(F.col("title")).alias("normalized"))


@register("has_letter", rf"SELECT doc_id, regexp_matches(title, '\p{{L}}') AS has_letter, length(title) AS letters FROM {B.text(B.TITLES)} AS t")
def has_letter(spark, d):
    return B.relation(spark, d, B.TITLES).select("doc_id", text.has_letter(F.col("title")).alias("has_letter"), F.length("title").cast("long").alias("letters"))


_CHINESE = """concat(CASE WHEN p_size >= 20 THEN substr('〇一二三四五六七八九', CAST(floor(p_size / 10) AS INTEGER) + 1, 1) ELSE '' END, CASE WHEN p_size >= 10 THEN '十' ELSE '' END, CASE WHEN p_size % 10 > 0 THEN substr('〇一二三四五六七八九', CAST(p_size % 10 AS INTEGER) + 1, 1) ELSE '' END)"""
_N = "CAST(p_size AS STRING)"
#: Names of parts with a season in one spelling or another, or with something that only looks like one.
SEASONED = f"""SELECT p_partkey AS n, CASE p_partkey % 16 WHEN 0 THEN concat(p_name, ' Season ', {_N}) WHEN 1 THEN concat(p_name, ' ', {_N}, 'th Season') WHEN 2 THEN concat('第', {_CHINESE}, '季 ', p_name)
  WHEN 3 THEN concat(p_name, ' 第', {_CHINESE}, '期') WHEN 4 THEN concat('シーズン', {_N}, ' ', p_name) WHEN 5 THEN concat(p_name, ' ', {_N}, '기') WHEN 6 THEN concat(p_name, ' S', {_N})
  WHEN 7 THEN concat(p_name, ' XS', {_N}) WHEN 8 THEN concat(p_name, ' Part ', {_N}) WHEN 9 THEN concat('Cour ', {_N}, ' ', p_name) WHEN 10 THEN concat(p_name, ' 第', {_N}, '話') WHEN 11 THEN concat(p_name, ' 20', {_N})
  WHEN 12 THEN concat(p_name, ' season 00', {_N}) WHEN 13 THEN concat(p_name, ' 第零季') WHEN 14 THEN concat(p_name, ' ', {_N}, 'rd cour S7') ELSE concat('Seasons ', {_N}, ' ', p_name) END AS title FROM {{part}}"""
_LAST = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE coalesce(instr('〇一二三四五六七八九', right(replace({x}, '零', '〇'), 1)) - 1, 0) END)"
_CJK = lambda x: f"""(CASE WHEN {x} = '' THEN NULL WHEN regexp_matches({x}, '^[0-9]+$') THEN nullif(CAST({x} AS INTEGER), 0) ELSE nullif(
  CASE WHEN instr({x}, '十') > 0 THEN greatest({_LAST(f"split_part({x}, '十', 1)")}, 1) * 10 + {_LAST(f"split_part({x}, '十', 2)")} ELSE {_LAST(x)} END, 0) END)"""  # noqa: E731
_FORMS = [r"(?i)\b([0-9]{1,3})(?:st|nd|rd|th)\s+(?:season|part|cour)\b", r"(?i)\b(?:season|part|cour)\s*([0-9]{1,3})\b", r"シーズン\s*([0-9]{1,3})",
          r"第\s*([0-9〇零一二三四五六七八九十]{1,4})\s*[期季]", r"([0-9]{1,3})\s*[期기]", r"\bS([0-9]{1,2})\b"]
_FOUND = ", ".join(f"regexp_extract(title, '{f}', 1) AS f{i}" for i, f in enumerate(_FORMS))


@register("season_parse", f"SELECT n, title, CAST(coalesce({', '.join(_CJK(f'f{i}') for i in range(len(_FORMS)))}) AS INTEGER) AS season FROM (SELECT n, title, {_FOUND} FROM {B.text(SEASONED)} AS t) AS u")
def season_parse(spark, d):
    return B.relation(spark, d, SEASONED).select("n", "title", season.parse_season_number(F.col("title")).cast("int").alias("season"))


@register("season_parse_corpus", f"""SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size = 0 THEN NULL ELSE p_size END AS INTEGER) AS season FROM part""")
def season_parse_corpus(spark, d):
    size = F.col("p_size").cast("string")
    title = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" Season "), size)).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" 第"), size, F.lit("期"))).otherwise(F.concat("p_name", F.lit(" "), size))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", season.parse_season_number(title).cast("int").alias("season"))


@register("anime_season_of", """SELECT o_orderkey, concat(CAST(year(o_orderdate) AS VARCHAR), '-', ['WINTER', 'SPRING', 'SUMMER', 'FALL'][quarter(o_orderdate)]) AS season_key,
  CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS season_index FROM orders""")
def anime_season_of(spark, d):
    day = F.col("o_orderdate")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", season.season_key(day).alias("season_key"), season.season_index(day).alias("season_index"))


@register("season_window", """SELECT o_orderkey FROM orders, (SELECT max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) - 6 AS anchor FROM orders) AS a
  WHERE year(o_orderdate) * 4 + quarter(o_orderdate) - 1 BETWEEN anchor - 1 AND anchor + 4""")
def season_window(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    at = season.season_index(F.col("o_orderdate"))
    anchor = orders.agg((F.max(at) - 6).alias("anchor"))
    return orders.crossJoin(F.broadcast(anchor)).where(at.between(F.col("anchor") - 1, F.col("anchor") + 4)).select("o_orderkey")


@register("season_catalogue", """SELECT concat(CAST(year(o_orderdate) AS VARCHAR), '-', ['WINTER', 'SPRING', 'SUMMER', 'FALL'][quarter(o_orderdate)]) AS season_key, count(*) AS records FROM orders GROUP BY season_key""")
def season_catalogue(spark, d):
    return season.catalogue(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate")


@register("year_of_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders")
def year_of_date(spark, d):
    """Dates, times and RFC 1123 times of orders; other texts have no year."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 3, F.concat(F.lit("in "), F.date_format(day, "yyyy"))).otherwise(F.lit(""))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", season.year_of(raw).alias("year"))


@register("compact_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def compact_date(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.left(day, F.lit(6)), F.lit("00"))).when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(day)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", season.compact_date(raw).alias("day"))


LADDER = """SELECT p_partkey AS n, CASE p_partkey % 10 WHEN 0 THEN concat(p_name, ' Season ', CAST(p_size AS STRING), ' -', lower(p_type), ' tale-') WHEN 1 THEN concat('The ', p_name, ' of an ', p_type, ' -Second Season-')
  WHEN 2 THEN concat('Ab: ', p_name) WHEN 3 THEN concat(p_name, ': ', p_type) WHEN 4 THEN p_name WHEN 5 THEN concat('A ', p_name, ' Part 2 Season 3') WHEN 6 THEN concat(p_name, ' 第二季') WHEN 7 THEN concat(p_name, ' ~', p_type, '~')
  WHEN 8 THEN 'An X' ELSE concat('The ', CAST(p_size AS STRING), 'th Season: ', p_name) END AS title FROM {part}"""
_SQUASH = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_SUFFIX = "|".join(rf"(?:^|\s){c}\s*[^\-–—~～〜]{{2,}}\s*{c}\s*" for c in (r"\-", "–", "—", "~", "～", "〜"))
_WORDS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth"
_R1 = f"CASE WHEN regexp_matches(title, '(?:{_SUFFIX})$') THEN " + _SQUASH(f"regexp_replace(title, '(?:{_SUFFIX})$', '')") + " ELSE title END"
_R2 = _SQUASH(rf"regexp_replace(regexp_replace(r1, '(?i)\s*\b(?:(?:season|part|cour)\s*[0-9]{{1,3}}|[0-9]{{1,3}}(?:st|nd|rd|th)\s+(?:season|part|cour)|(?:{_WORDS})\s+(?:season|part|cour))\b', ' ', 'g'), '\s*(?:シーズン\s*[0-9]{{1,3}}|第\s*[0-9〇零一二三四五六七八九十]{{1,4}}\s*[期季])', ' ', 'g')")
_R3 = _SQUASH(r"regexp_replace(r2, '(?i)\b(?:the|an?)\b', ' ', 'g')")
_R4 = "CASE WHEN instr(r3, ':') > 3 THEN trim(split_part(r3, ':', 1)) ELSE r3 END"


@register("simplify_ladder", f"""SELECT n, title, array_to_string(list_filter([r1, CASE WHEN r2 <> r1 THEN r2 END, CASE WHEN r3 NOT IN (r1, r2) THEN r3 END, CASE WHEN r4 NOT IN (r1, r2, r3) THEN r4 END],
  lambda r: r IS NOT NULL AND length(r) >= 3 AND r <> title), '|') AS rungs FROM (SELECT *, {_R4} AS r4 FROM (SELECT *, {_R3} AS r3 FROM (SELECT *, {_R2} AS r2 FROM (SELECT n, title, {_R1} AS r1 FROM {B.text(LADDER)} AS t) AS u) AS v) AS w) AS x""")
def simplify_ladder(spark, d):
    return B.relation(spark, d, LADDER).select("n", "title", F.array_join(text.simplify_title(F.col("title")), "|").alias("rungs"))


_NUMBERED = "SELECT p_partkey, concat(p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(' ', CAST(p_size % 5 AS STRING)) END) AS a, concat(p_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size % 7 AS STRING) END) AS b FROM {part}"


@register("trailing_number_guard", f"""SELECT p_partkey, regexp_replace(a, '\\s*[0-9]+$', '') = regexp_replace(b, '\\s*[0-9]+$', '') AND
  nullif(regexp_extract(a, '([0-9]+)$', 1), '') IS DISTINCT FROM nullif(regexp_extract(b, '([0-9]+)$', 1), '') AS differ FROM {B.text(_NUMBERED)} AS x""")
def trailing_number_guard(spark, d):
    return B.relation(spark, d, _NUMBERED).select("p_partkey", text.differ_only_by_trailing_number(F.col("a"), F.col("b")).alias("differ"))


def alignment_sql(pairs: str) -> str:
    """CTEs that give ``scores`` (a, b, score) for the distinct pairs of a query with stripped a and b."""
    return rf"""pairs AS (SELECT DISTINCT a, b FROM {pairs} AS x WHERE a <> '' AND b <> ''),
steps AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0) AS h, 0 AS best FROM pairs
  UNION ALL SELECT a, b, i + 1, nh, greatest(best, list_max(nh)) FROM (
    SELECT a, b, i, best, list_transform(range(1, len(t) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: t[k] - (j - k)))) AS nh FROM (
      SELECT a, b, i, best, list_transform(range(1, length(b) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(0, h[j - 1] + CASE WHEN substr(a, i + 1, 1) = substr(b, j - 1, 1) THEN 2 ELSE -1 END, h[j] - 1) END) AS t
      FROM steps WHERE i < length(a)) AS y) AS z),
scores AS (SELECT a, b, max(best) AS score FROM steps GROUP BY a, b)"""


PAIRS = """SELECT p_partkey AS n, p_name AS l, CASE p_size % 7 WHEN 0 THEN replace(p_name, 'o', '0') WHEN 1 THEN concat(p_name, ': ', p_type) WHEN 2 THEN '' WHEN 3 THEN reverse(p_name) WHEN 4 THEN concat('日本', p_name, '!')
  WHEN 5 THEN concat(upper(p_name), ' ', CAST(p_partkey % 3 AS STRING)) ELSE substr(p_name, 3) END AS r FROM {part}"""
_PAIRS = f"(SELECT n, {_STRIP.replace('title', 'l')} AS a, {_STRIP.replace('title', 'r')} AS b FROM {B.text(PAIRS)} AS t)"


@register("title_similarity", f"WITH RECURSIVE {alignment_sql(_PAIRS)} SELECT n, round(coalesce(s.score / (2 * greatest(length(p.a), length(p.b))), 0), 6) AS similarity FROM {_PAIRS} AS p LEFT JOIN scores s USING (a, b)")
def title_similarity(spark, d):
    return B.relation(spark, d, PAIRS).select("n", F.round(similarity.title_similarity(F.col("l"), F.col("r")), 6).alias("similarity"))


@register("search_score", f"WITH RECURSIVE {alignment_sql(_PAIRS)} SELECT n, round(CASE WHEN s.score IS NULL THEN 0 ELSE least(1, s.score / (2 * length(p.a))) END, 6) AS score FROM {_PAIRS} AS p LEFT JOIN scores s USING (a, b)")
def search_score(spark, d):
    return B.relation(spark, d, PAIRS).select("n", F.round(similarity.search_score(F.col("l"), F.col("r")), 6).alias("score"))


ADDRESSES = """SELECT s_suppkey AS n, concat(CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE '' END, CASE s_suppkey % 4 WHEN 0 THEN 'https://x.org/' WHEN 1 THEN '@scope/' ELSE '' END, 'p', CAST(s_nationkey AS STRING),
  CASE s_suppkey % 6 WHEN 0 THEN '@1.2.3' WHEN 1 THEN '@latest/' WHEN 2 THEN '/' WHEN 3 THEN '@2//' ELSE '' END, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE '' END) AS address FROM {supplier}"""


@register("plugin_link_canonical", rf"SELECT n, regexp_replace(regexp_replace(trim(address), '/+$', ''), '@[0-9][^@/]*$', '') AS canonical FROM {B.text(ADDRESSES)} AS t")
def plugin_link_canonical(spark, d):
    return B.relation(spark, d, ADDRESSES).select("n", canonical_address(F.col("address")).alias("canonical"))


@register("backoff_schedule", "SELECT event_id, CAST(least(1000 * pow(2, event_id % 8), 15000) AS BIGINT) AS delay_ms FROM events")
def backoff_schedule(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", retry_delay(F.col("event_id") % 8).alias("delay_ms"))
