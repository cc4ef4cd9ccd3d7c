"""Queries that read the answers of JSON catalogues: answers are made from the table part, one in ten does not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafuse.operators.spread import spread
from mediafuse.plans.catalog import register
from mediafuse.sources.catalogues import CATALOGUES

#: Columns of a media record as text, in the order of ``_MEDIA_NAMES``; those of an episode likewise.
_MEDIA_NAMES = {"uri": "VARCHAR", "url": "VARCHAR", "score": "DOUBLE", "type": "VARCHAR", "categories": "VARCHAR", "status": "VARCHAR", "titles": "VARCHAR", "description": "VARCHAR", "covers": "VARCHAR", "banners": "VARCHAR",
                "trailers": "VARCHAR", "average_score": "DOUBLE", "popularity": "BIGINT", "start_date": "VARCHAR", "end_date": "VARCHAR", "episode_count": "BIGINT", "handles": "VARCHAR"}
_EPISODE_NAMES = {"uri": "VARCHAR", "media_uri": "VARCHAR", "url": "VARCHAR", "score": "DOUBLE", "titles": "VARCHAR", "description": "VARCHAR", "thumbnails": "VARCHAR", "release_date": "VARCHAR",
                  "season_number": "BIGINT", "episode_number": "BIGINT", "absolute_episode_number": "BIGINT", "runtime": "DOUBLE"}


def flat(rows: DataFrame, episodes: bool = False) -> DataFrame:
    """Records with their lists as texts."""
    joined = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws("=", *(x[p] for p in parts))), "|").alias(c)
    text = F.get("descriptions", 0).description.alias("description")
    if episodes:
        return rows.select("uri", "media_uri", "url", "score", joined("titles", "language", "title"), text, joined("thumbnails", "url"), "release_date", "season_number", "episode_number", "absolute_episode_number", "runtime")
    return rows.select("uri", "url", "score", "type", F.array_join("categories", ",").alias("categories"), "status", joined("titles", "language", "title"), text, joined("covers", "url"), joined("banners", "url"),
                       joined("trailers", "uri", "thumbnail"), "average_score", "popularity", "start_date", "end_date", "episode_count", joined("handles", "uri", "url"))


def _expected(source: str, episodes: bool = False, **columns: str) -> str:
    names = _EPISODE_NAMES if episodes else _MEDIA_NAMES
    lists = {"categories", "titles", "covers", "banners", "trailers", "handles", "thumbnails"}
    if unknown := set(columns) - set(names):
        raise ValueError(unknown)
    return "SELECT " + ", ".join(f"CAST({columns.get(n, repr('') if n in lists else 'NULL')} AS {kind}) AS {n}" for n, kind in names.items()) + f" FROM {source}"


def answers(name: str, origin: str, kind: str, payload: str, expected: str, table: str = "part", columns: str = "CAST(p_partkey AS STRING) AS media_id", group: str | None = None) -> None:
    """Registers a query that reads answers made by ``payload`` (over ``table``; with ``group``, over the list ``items`` of each group)."""
    def query(spark, d):
        rows = spread(spark.read.parquet(f"{d}/{table}.parquet"))
        if group:
            rows = rows.groupBy(F.expr(group).alias("g")).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("items"))
            made = rows.selectExpr("g", f"CASE WHEN g % 10 = 0 THEN '{{broken' ELSE to_json({payload}) END AS payload")
        else:
            made = rows.selectExpr(columns, f"CASE WHEN p_partkey % 10 = 0 THEN '{{broken' ELSE to_json({payload}) END AS payload")
        return flat(CATALOGUES[origin].read(made, kind), kind == "episodes")

    register(name, expected)(query)


_OK = "part WHERE p_partkey % 10 <> 0"
_K = "CAST(p_partkey AS VARCHAR)"
_YT = f"CASE WHEN p_size % 4 = 0 THEN concat('yt:v', {_K}, '=https://t/', {_K}) ELSE '' END"
_FORMAT = "CASE p_size % 7 WHEN 0 THEN 'TV' WHEN 1 THEN 'TV_SHORT' WHEN 2 THEN 'MOVIE' WHEN 3 THEN 'SPECIAL' WHEN 4 THEN 'OVA' WHEN 5 THEN 'ONA' ELSE 'MUSIC' END"
_SERIES = "CASE WHEN {} THEN 'ANIME,MOVIE' ELSE 'ANIME,SERIES' END"
_TEXT = "CASE WHEN p_size % 3 <> 0 THEN concat('about ', p_name) END"

answers("anilist_media", "anilist", "media", f"""named_struct('data', named_struct('Page', named_struct('media', transform(items, i -> named_struct('id', i.p_partkey, 'idMal', if(i.p_size % 2 = 0, i.p_partkey + 1, null),
  'siteUrl', concat('https://a/', i.p_partkey), 'format', {_FORMAT.replace('p_size', 'i.p_size')}, 'status', CASE i.p_size % 3 WHEN 0 THEN 'RELEASING' WHEN 1 THEN 'FINISHED' ELSE 'CANCELLED' END, 'averageScore', i.p_size, 'popularity', i.p_partkey * 2,
  'episodes', i.p_size, 'description', if(i.p_size % 3 <> 0, concat('about ', i.p_name), ''), 'title', named_struct('english', if(i.p_size % 2 = 0, i.p_name, null), 'romaji', upper(i.p_name), 'native', ''),
  'coverImage', named_struct('extraLarge', if(i.p_size % 5 = 0, null, concat('https://c/', i.p_partkey))), 'airingSchedule', named_struct('edges', if(i.p_size % 2 = 0, array(named_struct('node', named_struct('airingAt', 86400 * i.p_size)), named_struct('node', named_struct('airingAt', 86400 * (i.p_size + 7)))), array())),
  'trailer', if(i.p_size % 4 = 0, named_struct('id', concat('v', i.p_partkey), 'site', 'youtube', 'thumbnail', concat('https://t/', i.p_partkey)), named_struct('id', 'x', 'site', 'dailymotion', 'thumbnail', 'y')))))))""",
        _expected("part WHERE CAST(floor(p_partkey / 7) AS BIGINT) % 10 <> 0", uri=f"concat('anilist:', {_K})", url=f"concat('https://a/', {_K})", score="0.8", type=f"CASE {_FORMAT} WHEN 'TV_SHORT' THEN 'TV' WHEN 'MUSIC' THEN NULL ELSE {_FORMAT} END",
                  categories=_SERIES.format("p_size % 7 = 2"), status="CASE p_size % 3 WHEN 0 THEN 'RELEASING' WHEN 1 THEN 'FINISHED' END", titles="concat(CASE WHEN p_size % 2 = 0 THEN concat('en=', p_name, '|') ELSE '' END, 'jp-en=', upper(p_name))",
                  description=_TEXT, covers=f"CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('https://c/', {_K}) END", trailers=_YT, average_score="p_size", popularity="p_partkey * 2", episode_count="p_size",
                  start_date="CASE WHEN p_size % 2 = 0 THEN strftime(TIMESTAMP '1970-01-01' + to_days(p_size), '%a, %d %b %Y %H:%M:%S GMT') END", end_date="CASE WHEN p_size % 2 = 0 THEN strftime(TIMESTAMP '1970-01-01' + to_days(p_size + 7), '%a, %d %b %Y %H:%M:%S GMT') END",
                  handles="CASE WHEN p_size % 2 = 0 THEN concat('mal:', CAST(p_partkey + 1 AS VARCHAR), '=https://myanimelist.net/anime/', CAST(p_partkey + 1 AS VARCHAR)) ELSE '' END"), group="floor(p_partkey / 7)")

answers("jikan_media", "mal", "media", """named_struct('pagination', named_struct('last_visible_page', 1), 'data', transform(items, i -> named_struct('mal_id', if(i.p_size % 9 = 8, null, i.p_partkey), 'url', concat('https://m/', i.p_partkey), 'type', CASE i.p_size % 4 WHEN 0 THEN 'TV' WHEN 1 THEN 'Movie' WHEN 2 THEN 'OVA' ELSE 'Music' END,
  'status', CASE i.p_size % 3 WHEN 0 THEN 'Currently Airing' WHEN 1 THEN 'Finished Airing' ELSE 'Not yet aired' END, 'score', i.p_retailprice, 'synopsis', if(i.p_size % 3 <> 0, concat('about ', i.p_name), null), 'title', i.p_name, 'title_english', if(i.p_size % 2 = 0, upper(i.p_name), ''), 'members', i.p_partkey, 'episodes', i.p_size,
  'aired', named_struct('from', '2024-04-05T00:00:00+00:00', 'to', null), 'images', named_struct('webp', named_struct('large_image_url', concat('https://c/', i.p_partkey))),
  'trailer', CASE WHEN i.p_size % 4 = 0 THEN named_struct('youtube_id', concat('v', i.p_partkey), 'embed_url', null, 'images', named_struct('image_url', concat('https://t/', i.p_partkey))) WHEN i.p_size % 4 = 1 THEN named_struct('youtube_id', null, 'embed_url', 'https://www.youtube.com/embed/abcdefghijk?x=1', 'images', named_struct('image_url', 't')) END,
  'external', array(named_struct('name', 'Site', 'url', 'https://x/'), named_struct('name', if(i.p_size % 5 = 0, 'AniDB', 'Other'), 'url', if(i.p_size % 10 = 0, concat('https://anidb.net/perl-bin/animedb.pl?show=anime&aid=', i.p_partkey), concat('https://anidb.net/anime/', i.p_partkey))))))) """,
        _expected("part WHERE CAST(floor(p_partkey / 7) AS BIGINT) % 10 <> 0 AND p_size % 9 <> 8", uri=f"concat('mal:', {_K})", url=f"concat('https://m/', {_K})", score="0.9", type="CASE p_size % 4 WHEN 0 THEN 'TV' WHEN 1 THEN 'MOVIE' WHEN 2 THEN 'OVA' END",
                  categories=_SERIES.format("p_size % 4 = 1"), status="CASE p_size % 3 WHEN 0 THEN 'RELEASING' WHEN 1 THEN 'FINISHED' ELSE 'NOT_YET_RELEASED' END", titles="concat(CASE WHEN p_size % 2 = 0 THEN concat('en=', upper(p_name), '|') ELSE '' END, 'jp-en=', p_name)",
                  description=_TEXT, covers=f"concat('https://c/', {_K})", trailers=f"CASE WHEN p_size % 4 = 1 THEN 'yt:abcdefghijk=t' ELSE {_YT} END", average_score="p_retailprice", popularity="p_partkey", episode_count="p_size", start_date="'2024-04-05T00:00:00+00:00'",
                  handles=f"CASE WHEN p_size % 5 = 0 THEN concat('anidb:', {_K}, CASE WHEN p_size % 10 = 0 THEN '=https://anidb.net/perl-bin/animedb.pl?show=anime&aid=' ELSE '=https://anidb.net/anime/' END, {_K}, '|anizip:', {_K}, '=https://api.ani.zip/mappings?anidb_id=', {_K}) ELSE '' END"), group="floor(p_partkey / 7)")

answers("kitsu_media", "kitsu", "media", """named_struct('data', transform(items, i -> named_struct('id', cast(i.p_partkey as string), 'attributes', named_struct('subtype', if(i.p_size % 4 = 1, 'movie', 'TV'), 'canonicalTitle', i.p_name, 'titles', named_struct('en', if(i.p_size % 2 = 0, i.p_name, upper(i.p_name)), 'ja_jp', 'x'), 'synopsis', if(i.p_size % 3 <> 0, concat('about ', i.p_name), ''),
  'startDate', if(i.p_size % 2 = 0, '2020-01-02', ''), 'episodeCount', i.p_size, 'userCount', i.p_partkey, 'status', CASE i.p_size % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'finished' ELSE 'tba' END, 'averageRating', if(i.p_size % 2 = 0, '71.25', null), 'posterImage', if(i.p_size % 2 = 0, named_struct('original', null, 'large', 'l', 'medium', 'm'), null), 'coverImage', named_struct('original', 'o', 'large', 'l')),
  'relationships', named_struct('mappings', named_struct('data', array(named_struct('id', concat('a', i.p_partkey)), named_struct('id', 'missing'), named_struct('id', concat('m', i.p_partkey)), named_struct('id', concat('z', i.p_partkey))))))),
  'included', flatten(transform(items, i -> array(named_struct('id', concat('m', i.p_partkey), 'attributes', named_struct('externalSite', 'myanimelist/anime', 'externalId', cast(i.p_partkey + 5 as string))), named_struct('id', concat('a', i.p_partkey), 'attributes', named_struct('externalSite', 'anilist/anime', 'externalId', if(i.p_size % 2 = 0, cast(i.p_partkey as string), ''))), named_struct('id', concat('z', i.p_partkey), 'attributes', named_struct('externalSite', 'other', 'externalId', '1'))))))""",
        _expected("part WHERE CAST(floor(p_partkey / 7) AS BIGINT) % 10 <> 0", uri=f"concat('kitsu:', {_K})", url=f"concat('https://kitsu.io/anime/', {_K})", score="0.3", type="CASE WHEN p_size % 4 = 1 THEN 'MOVIE' ELSE 'TV' END", categories=_SERIES.format("p_size % 4 = 1"),
                  status="CASE p_size % 3 WHEN 0 THEN 'RELEASING' WHEN 1 THEN 'FINISHED' END", titles="concat(CASE WHEN p_size % 2 = 0 OR p_name = upper(p_name) THEN '' ELSE concat('en=', upper(p_name), '|') END, 'en=', p_name, '|ja=x')", description=_TEXT, covers="CASE WHEN p_size % 2 = 0 THEN 'l' ELSE '' END", banners="'o'",
                  average_score="CASE WHEN p_size % 2 = 0 THEN 71.25 END", popularity="p_partkey", start_date="CASE WHEN p_size % 2 = 0 THEN '2020-01-02' END", episode_count="p_size",
                  handles=f"concat(CASE WHEN p_size % 2 = 0 THEN concat('anilist:', {_K}, '=https://anilist.co/anime/', {_K}, '|') ELSE '' END, 'mal:', CAST(p_partkey + 5 AS VARCHAR), '=https://myanimelist.net/anime/', CAST(p_partkey + 5 AS VARCHAR))"), group="floor(p_partkey / 7)")

_TVMAZE = """named_struct('id', p_partkey, 'name', p_name, 'url', if(p_size % 2 = 0, concat('https://z/', p_partkey), null), 'summary', if(p_size % 3 <> 0, concat('<p>about <b>', p_name, '</b></p>'), '<p></p>'), 'premiered', '2001-02-03', 'rating', named_struct('average', p_retailprice), 'externals', named_struct('imdb', if(p_size % 2 = 0, concat('tt', p_partkey), null)),
  'image', named_struct('original', null, 'medium', 'm'), '_embedded', named_struct('episodes', transform(sequence(1, p_size % 4 + 1), e -> named_struct('id', p_partkey * 10 + e, 'name', concat('E', e), 'season', 1, 'number', if(e = 3, null, e), 'summary', '', 'image', named_struct('original', 'o', 'medium', 'm')))))"""
answers("tvmaze_media", "tvmaze", "media", _TVMAZE, _expected(_OK, uri=f"concat('tvmaze:', {_K})", url=f"CASE WHEN p_size % 2 = 0 THEN concat('https://z/', {_K}) ELSE concat('https://www.tvmaze.com/shows/', {_K}) END", score="0.3", categories="'SERIES'", titles="concat('en=', p_name)", description=_TEXT,
        covers="'m'", average_score="p_retailprice", start_date="'2001-02-03'", handles=f"CASE WHEN p_size % 2 = 0 THEN concat('imdb:tt', {_K}, '=https://www.imdb.com/title/tt', {_K}) ELSE '' END"))
answers("tvmaze_episodes", "tvmaze", "episodes", _TVMAZE, _expected("(SELECT *, unnest(range(1, p_size % 4 + 2)) AS e FROM part) AS x WHERE p_partkey % 10 <> 0", True, uri="concat('tvmaze:', CAST(p_partkey * 10 + e AS VARCHAR))", media_uri=f"concat('tvmaze:', {_K})", score="0.3",
        titles="concat('en=E', CAST(e AS VARCHAR))", thumbnails="'o'", season_number="1", episode_number="CASE WHEN e <> 3 THEN e END"))

answers("anizip_media", "anizip", "media", """named_struct('mappings', named_struct('anidb_id', if(p_size % 9 = 8, null, p_partkey), 'mal_id', if(p_size % 2 = 0, p_partkey + 1, null), 'anilist_id', p_partkey + 2), 'titles', named_struct('en', p_name, 'ja', if(p_size % 2 = 0, 'j', '')),
  'images', array(named_struct('coverType', 'Poster', 'url', 'p'), named_struct('coverType', 'Banner', 'url', 'b'), named_struct('coverType', 'Poster', 'url', 'q')), 'episodeCount', p_size, 'episodes', map('1', named_struct('overview', 'o')))""",
        _expected(f"{_OK} AND p_size % 9 <> 8", uri=f"concat('anizip:', {_K})", url=f"concat('https://api.ani.zip/mappings?anidb_id=', {_K})", categories="'ANIME,SERIES'", titles="concat('en=', p_name, CASE WHEN p_size % 2 = 0 THEN '|ja=j' ELSE '' END)", covers="'p|q'", banners="'b'", episode_count="p_size",
                  handles="concat(CASE WHEN p_size % 2 = 0 THEN concat('mal:', CAST(p_partkey + 1 AS VARCHAR), '=https://myanimelist.net/anime/', CAST(p_partkey + 1 AS VARCHAR), '|') ELSE '' END, 'anilist:', CAST(p_partkey + 2 AS VARCHAR), '=https://anilist.co/anime/', CAST(p_partkey + 2 AS VARCHAR))"))

answers("omdb_media", "omdb", "media", "named_struct('Title', p_name, 'Year', CASE p_size % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN '2011–2019' ELSE concat(1980 + p_size) END, 'imdbID', if(p_size % 9 = 8, '', concat('tt', p_partkey)), 'Poster', if(p_size % 2 = 0, 'N/A', 'p'), 'Plot', if(p_size % 3 <> 0, concat('about ', p_name), 'N/A'), 'imdbRating', if(p_size % 4 = 0, 'N/A', '7.5'), 'Type', if(p_size % 4 = 1, 'movie', 'series'))",
        _expected(f"{_OK} AND p_size % 9 <> 8", uri=f"concat('omdb:tt', {_K})", url=f"concat('https://www.imdb.com/title/tt', {_K})", score="0.3", categories="CASE WHEN p_size % 4 = 1 THEN 'MOVIE' ELSE 'SERIES' END", titles="concat('en=', p_name)", description=_TEXT, covers="CASE WHEN p_size % 2 = 0 THEN '' ELSE 'p' END",
                  average_score="CASE WHEN p_size % 4 <> 0 THEN 7.5 END", start_date="CASE p_size % 3 WHEN 1 THEN '2011-01-01' WHEN 2 THEN concat(CAST(1980 + p_size AS VARCHAR), '-01-01') END", handles=f"concat('imdb:tt', {_K}, '=https://www.imdb.com/title/tt', {_K})"))

answers("trakt_media", "trakt", "media", "named_struct('title', p_name, 'overview', if(p_size % 3 <> 0, concat('about ', p_name), ''), 'first_aired', if(p_size % 2 = 0, '2013-09-24T02:30:00.000Z', null), 'rating', p_size / 5.0, 'ids', named_struct('slug', if(p_size % 2 = 0, concat('s', p_partkey), null), 'trakt', if(p_size % 9 = 7, null, p_partkey), 'imdb', if(p_size % 3 = 0, concat('tt', p_partkey), null), 'tmdb', p_partkey))",
        _expected(f"{_OK} AND (p_size % 2 = 0 OR p_size % 9 <> 7)", uri=f"concat('trakt:', CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END, {_K})", url=f"concat('https://trakt.tv/shows/', CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END, {_K})", score="0.3", categories="'SERIES'", titles="concat('en=', p_name)", description=_TEXT,
                  average_score="p_size * 2", start_date="CASE WHEN p_size % 2 = 0 THEN '2013-09-24T02:30:00.000Z' END", handles=f"concat(CASE WHEN p_size % 3 = 0 THEN concat('imdb:tt', {_K}, '=https://www.imdb.com/title/tt', {_K}, '|') ELSE '' END, 'tmdb:', {_K}, '=https://www.themoviedb.org/tv/', {_K})"))
answers("trakt_episodes", "trakt", "episodes", "named_struct('number', p_size % 3, 'episodes', transform(sequence(1, p_size % 2 + 1), e -> named_struct('title', concat('E', e), 'overview', 'o', 'number', e, 'ids', named_struct('trakt', if(e = 1, p_partkey, null)))))",
        _expected("(SELECT *, unnest(range(1, p_size % 2 + 2)) AS e FROM part) AS x WHERE p_partkey % 10 <> 0 AND p_size % 3 > 0", True, uri=f"concat('trakt:', {_K}, CASE WHEN e = 1 THEN '' ELSE concat('-s', CAST(p_size % 3 AS VARCHAR), 'e', CAST(e AS VARCHAR)) END)", media_uri=f"concat('trakt:', {_K})", score="0.3", titles="concat('en=E', CAST(e AS VARCHAR))", description="'o'",
                  season_number="p_size % 3", episode_number="e"))

answers("simkl_media", "simkl", "media", "named_struct('title', if(p_size % 9 = 8, '', p_name), 'en_title', if(p_size % 2 = 0, p_name, upper(p_name)), 'poster', if(p_size % 2 = 0, 'ab/c', ''), 'fanart', 'f', 'overview', if(p_size % 3 <> 0, concat('about ', p_name), null), 'first_aired', '', 'endpoint_type', CASE p_size % 3 WHEN 0 THEN 'anime' WHEN 1 THEN 'movies' END, 'ids', named_struct('simkl_id', p_partkey, 'mal', cast(p_partkey as string), 'imdb', ''), 'ratings', named_struct('imdb', named_struct('rating', if(p_size % 2 = 0, 6.5, null)), 'mal', named_struct('rating', 8.25)))",
        _expected(f"{_OK} AND p_size % 9 <> 8", uri=f"concat('simkl:', {_K})", url=f"concat('https://simkl.com/', CASE p_size % 3 WHEN 0 THEN 'anime' WHEN 1 THEN 'movies' ELSE 'tv' END, '/', {_K})", score="0.3", categories="CASE p_size % 3 WHEN 0 THEN 'ANIME,SERIES' WHEN 1 THEN 'MOVIE' ELSE 'SERIES' END",
                  titles="concat('en=', p_name, CASE WHEN p_size % 2 = 0 OR p_name = upper(p_name) THEN '' ELSE concat('|en=', upper(p_name)) END)", description=_TEXT, covers="CASE WHEN p_size % 2 = 0 THEN 'https://simkl.in/posters/ab/c_m.jpg' ELSE '' END", banners="'https://simkl.in/fanart/f_w.jpg'", average_score="CASE WHEN p_size % 2 = 0 THEN 6.5 ELSE 8.25 END",
                  handles=f"concat('mal:', {_K}, '=https://myanimelist.net/anime/', {_K})"))
answers("simkl_episodes", "simkl", "episodes", "named_struct('episodes', array(named_struct('title', 'A', 'season', 2, 'episode', 1, 'type', 'episode'), named_struct('title', if(p_size % 2 = 0, 'S', ''), 'season', null, 'episode', null, 'type', 'special'), named_struct('title', '', 'season', null, 'episode', 3, 'type', 'special')))",
        _expected("(SELECT *, unnest([0, 1, 2]) AS e FROM part) AS x WHERE p_partkey % 10 <> 0 AND (e <> 1 OR p_size % 2 = 0)", True, uri=f"concat('simkl:', {_K}, CASE e WHEN 0 THEN '-s2e1' WHEN 1 THEN '-i1' ELSE '-s1e3' END)", media_uri=f"concat('simkl:', {_K})", score="0.3", titles="CASE e WHEN 0 THEN 'en=A' WHEN 1 THEN 'en=S' ELSE '' END",
                  season_number="CASE WHEN e = 0 THEN 2 END", episode_number="CASE e WHEN 0 THEN 1 WHEN 2 THEN 3 END"))

_REMOTE = "array(named_struct('id', concat('tt', p_partkey), 'sourceName', 'IMDB'), named_struct('id', if(p_size % 2 = 0, '', 'm'), 'sourceName', 'TheMovieDB'), named_struct('id', 'x', 'sourceName', 'Other'))"
_REMOTE_SQL = f"concat('imdb:tt', {_K}, '=https://www.imdb.com/title/tt', {_K}, CASE WHEN p_size % 2 = 0 THEN '' ELSE '|tmdb:m=https://www.themoviedb.org/tv/m' END)"
answers("tvdb_media", "tvdb", "media", f"named_struct('data', named_struct('id', p_partkey, 'name', p_name, 'overview', if(p_size % 3 <> 0, concat('about ', p_name), ''), 'image', CASE p_size % 3 WHEN 0 THEN 'http://i' WHEN 1 THEN '/i' ELSE 'i' END, 'firstAired', '2001-01-01', 'score', p_retailprice, 'remoteIds', {_REMOTE}))",
        _expected(_OK, uri=f"concat('tvdb:', {_K})", url=f"concat('https://www.thetvdb.com/series/', {_K})", score="0.3", categories="'SERIES'", titles="concat('en=', p_name)", description=_TEXT, covers="CASE p_size % 3 WHEN 0 THEN 'http://i' ELSE 'https://artworks.thetvdb.com/i' END", average_score="p_retailprice", start_date="'2001-01-01'", handles=_REMOTE_SQL))
answers("tvdb_search", "tvdb", "search", f"named_struct('data', array(named_struct('tvdb_id', cast(p_partkey as string), 'name', p_name, 'overview', '', 'image_url', '/i', 'year', if(p_size % 2 = 0, '1999', ''), 'remote_ids', {_REMOTE}), named_struct('tvdb_id', '', 'name', 'x', 'overview', '', 'image_url', '/i', 'year', '', 'remote_ids', {_REMOTE})))",
        _expected(_OK, uri=f"concat('tvdb:', {_K})", url=f"concat('https://www.thetvdb.com/series/', {_K})", score="0.3", categories="'SERIES'", titles="concat('en=', p_name)", covers="'https://artworks.thetvdb.com/i'", start_date="CASE WHEN p_size % 2 = 0 THEN '1999-01-01' END", handles=_REMOTE_SQL))

answers("watchmode_media", "watchmode", "media", "named_struct('id', p_partkey, 'title', p_name, 'type', CASE p_size % 3 WHEN 0 THEN 'tv_movie' WHEN 1 THEN 'short_film' ELSE 'tv_series' END, 'plot_overview', if(p_size % 3 <> 0, concat('about ', p_name), null), 'poster', 'p', 'user_rating', p_size / 5.0, 'imdb_id', if(p_size % 2 = 0, concat('tt', p_partkey), null), 'tmdb_id', p_partkey, 'tmdb_type', if(p_size % 2 = 0, 'movie', 'tv'), 'sources', array(named_struct('web_url', concat('https://www.netflix.com/title/', p_partkey)), named_struct('web_url', concat('https://www.netflix.com/watch/', p_partkey)), named_struct('web_url', 'https://x.org/1'), named_struct('web_url', null)))",
        _expected(_OK, uri=f"concat('watchmode:', {_K})", url=f"concat('https://www.watchmode.com/title/', {_K}, '/')", score="0.25", categories="CASE WHEN p_size % 3 = 2 THEN 'SERIES' ELSE 'MOVIE' END", titles="concat('en=', p_name)", description=_TEXT, covers="'p'", average_score="p_size * 2",
                  handles=f"concat(CASE WHEN p_size % 2 = 0 THEN concat('imdb:tt', {_K}, '=https://www.imdb.com/title/tt', {_K}, '|') ELSE '' END, 'tmdb:', {_K}, '=https://www.themoviedb.org/', CASE WHEN p_size % 2 = 0 THEN 'movie' ELSE 'tv' END, '/', {_K}, '|nf:', {_K}, '=https://www.netflix.com/title/', {_K})"))

_APPLE_IMAGES = "'images', named_struct('coverArt', named_struct('url', 'https://a/{w}x{h}{c}.{f}'), 'coverArt16X9', named_struct('url', 'https://b/{w}x{h}.{f}'), 'previewFrame', if(p_size % 2 = 0, named_struct('url', 'https://p/{w}.{f}'), null))"
answers("appletv_search", "appletv", "search", f"named_struct('data', named_struct('canvas', named_struct('shelves', array(named_struct('items', array(named_struct('id', concat('a', p_partkey), 'type', CASE p_size % 3 WHEN 0 THEN 'Movie' WHEN 1 THEN 'Show' ELSE 'Sports' END, 'title', p_name, 'url', 'u', 'description', 'd', 'releaseDate', if(p_size % 2 = 0, 0, 86400000L * p_size), {_APPLE_IMAGES})))))))",
        _expected(f"{_OK} AND p_size % 3 <> 2", uri=f"concat('appletv:a', {_K})", url="'u'", score="0.2", categories="CASE WHEN p_size % 3 = 0 THEN 'MOVIE' ELSE 'SERIES' END", titles="concat('en=', p_name)", description="'d'", covers="'https://a/600x900.jpg'", banners="'https://b/1920x1080.jpg'",
                  start_date="CASE WHEN p_size % 2 <> 0 THEN strftime(TIMESTAMP '1970-01-01' + to_days(p_size), '%Y-%m-%dT00:00:00.000Z') END"))
answers("appletv_episodes", "appletv", "episodes", f"named_struct('data', named_struct('episodes', array(named_struct('id', concat('e', p_partkey), 'title', p_name, 'url', 'u', 'description', '', 'seasonNumber', 1, 'episodeNumber', p_size, {_APPLE_IMAGES}))))",
        _expected(_OK, True, uri=f"concat('appletv:e', {_K})", media_uri=f"concat('appletv:', {_K})", url="'u'", score="0.2", titles="concat('en=', p_name)", thumbnails="CASE WHEN p_size % 2 = 0 THEN 'https://p/1280.jpg' ELSE 'https://b/1280x720.jpg' END", season_number="1", episode_number="p_size"))

_SIZES = "array(array(named_struct('source', 's')), array(named_struct('source', 'm'), named_struct('source', concat('l', p_partkey))))"
answers("crunchyroll_media", "cr", "media", f"named_struct('data', array(named_struct('id', concat('G', p_partkey), 'title', p_name, 'slug_title', 'slug', 'description', if(p_size % 3 <> 0, concat('about ', p_name), ''), 'images', named_struct('poster_tall', {_SIZES}, 'poster_wide', array()), 'series_metadata', named_struct('episode_count', p_size, 'series_launch_year', if(p_size % 2 = 0, 2000 + p_size, null)))))",
        _expected(_OK, uri=f"concat('cr:G', {_K})", url=f"concat('https://www.crunchyroll.com/series/G', {_K}, '/slug')", score="0.5", categories="'ANIME,SERIES'", titles="concat('en=', p_name)", description=_TEXT, covers=f"concat('l', {_K})", start_date="CASE WHEN p_size % 2 = 0 THEN concat(CAST(2000 + p_size AS VARCHAR), '-01-01') END", episode_count="p_size"))
answers("crunchyroll_episodes", "cr", "episodes", f"named_struct('data', array(named_struct('id', concat('E', p_partkey), 'title', p_name, 'description', '', 'episode_number', p_size, 'season_number', 2, 'season_id', if(p_size % 2 = 0, 'S1JAJP', 'S2'), 'series_id', concat('G', p_partkey), 'episode_air_date', '2020-01-01', 'images', named_struct('thumbnail', {_SIZES}))))",
        _expected(_OK, True, uri=f"concat('cr:G', {_K}, CASE WHEN p_size % 2 = 0 THEN '-S1-E' ELSE '-S2-E' END, {_K})", media_uri=f"concat('cr:', {_K})", url=f"concat('https://www.crunchyroll.com/watch/E', {_K})", score="0.5", titles="concat('en=', p_name)", thumbnails=f"concat('l', {_K})", release_date="'2020-01-01'", season_number="2", episode_number="p_size"))

answers("paramount_episodes", "paramount", "episodes", "named_struct('result', named_struct('data', array(named_struct('content_id', concat('c', p_partkey), 'url', if(p_size % 2 = 0, '/v', null), 'title', p_name, 'episode_num', cast(p_size as string), 'season_num', if(p_size % 3 = 0, '', '2'), 'thumbnail', 't'))))",
        _expected(_OK, True, uri=f"concat('paramount:c', {_K})", media_uri=f"concat('paramount:', {_K})", url="CASE WHEN p_size % 2 = 0 THEN 'https://www.paramountplus.com/v' END", score="0.2", titles="concat('en=', p_name)", thumbnails="'t'", season_number="CASE WHEN p_size % 3 <> 0 THEN 2 END", episode_number="p_size"))

answers("netflix_search", "nf", "search", "named_struct('results', array(named_struct('nfid', p_partkey, 'title', concat(p_name, ' &amp; x'), 'vtype', if(p_size % 4 = 1, 'movie', 'series'), 'synopsis', if(p_size % 3 <> 0, concat('about ', p_name), ''), 'img', 'http://i', 'year', if(p_size % 2 = 0, '2004', ''))))",
        _expected(_OK, uri=f"concat('nf:', {_K})", url=f"concat('https://www.netflix.com/title/', {_K})", score="0.2", categories="CASE WHEN p_size % 4 = 1 THEN 'MOVIE' ELSE 'SERIES' END", titles="concat('en=', p_name, ' & x')", description=_TEXT, covers="'https://i'", start_date="CASE WHEN p_size % 2 = 0 THEN '2004-01-01' END"))
answers("netflix_episodes", "nf", "episodes", "named_struct('episodes', array(named_struct('epid', p_partkey, 'title', p_name, 'synopsis', if(p_size % 2 = 0, ' THIS EPISODE\\\\\\'S SYNOPSIS IS COMING SOON ', ' told '), 'img', 't', 'seasnum', 1, 'epnum', p_size)))".replace("\\\\\\'", "\\'"),
        _expected(_OK, True, uri=f"concat('nf:', {_K})", media_uri=f"concat('nf:', {_K})", score="0.2", titles="concat('en=', p_name)", description="CASE WHEN p_size % 2 <> 0 THEN 'told' END", thumbnails="'t'", season_number="1", episode_number="p_size"))

answers("justwatch_released_episodes", "jw", "episodes", "named_struct('episodes', array(named_struct('id', concat('a', p_partkey), 'content', named_struct('title', p_name, 'shortDescription', 'd', 'episodeNumber', 1, 'seasonNumber', 1, 'isReleased', p_size % 2 = 0)), named_struct('id', concat('b', p_partkey), 'content', named_struct('title', p_name, 'shortDescription', 'd', 'episodeNumber', 2, 'seasonNumber', 1, 'isReleased', null))))",
        _expected(f"{_OK} AND p_size % 2 = 0", True, uri=f"concat('jw:a', {_K})", media_uri=f"concat('jw:', {_K})", score="0.2", titles="concat('en=', p_name)", description="'d'", season_number="1", episode_number="1"))

answers("offline_media", "offline", "media", "named_struct('t', p_name, 'ty', CASE p_size % 4 WHEN 0 THEN 'TV' WHEN 1 THEN 'MOVIE' WHEN 2 THEN 'ONA' ELSE 'UNKNOWN' END, 'p', if(p_size % 2 = 0, 'a.jpg', ''), 'ep', p_size % 3, 'ml', if(p_size % 2 = 0, p_partkey, 0), 'al', if(p_size % 3 = 0, p_partkey, null), 'ku', if(p_size % 5 = 0, p_partkey, 0), 'sc', p_size % 2 * 7.26)",
        _expected(f"{_OK} AND (p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0)", uri=f"concat('offline:', CASE WHEN p_size % 2 = 0 THEN 'mal-' WHEN p_size % 3 = 0 THEN 'anilist-' ELSE 'kitsu-' END, {_K})", score="0.2", type="CASE p_size % 4 WHEN 0 THEN 'TV' WHEN 1 THEN 'MOVIE' WHEN 2 THEN 'ONA' END", categories=_SERIES.format("p_size % 4 = 1"),
                  titles="concat('en=', p_name)", covers="CASE WHEN p_size % 2 = 0 THEN 'https://cdn.myanimelist.net/images/anime/a.jpg' ELSE '' END", average_score="CASE WHEN p_size % 2 = 1 THEN 73 END", episode_count="nullif(p_size % 3, 0)",
                  handles=f"array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN concat('mal:', {_K}, '=https://myanimelist.net/anime/', {_K}) END, CASE WHEN p_size % 3 = 0 THEN concat('anilist:', {_K}, '=https://anilist.co/anime/', {_K}) END, CASE WHEN p_size % 5 = 0 THEN concat('kitsu:', {_K}, '=https://kitsu.app/anime/', {_K}) END], lambda x: x IS NOT NULL), '|')"))
