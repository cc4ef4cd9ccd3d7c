"""Catalogues whose answers are JSON: the schema of an answer, where its records lie, and the fields of a record.

An answer is a row's text. ``Catalogue.media`` and ``.episodes`` read answers of either kind; one that does not
parse gives nothing, and a record without an id or whatever else it must have goes alone, its page stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from mediafuse.functions import text
from mediafuse.sources import providers
from mediafuse.sources import records as R

_R = lambda path: F.col(f"r.{path}")
Fields = Callable[[], dict[str, Column]]


@dataclass(frozen=True)
class Part:
    """One kind of answer: its schema, the list of its records (empty: the answer is the record), the id and the fields."""

    schema: str
    records: str
    ident: Callable[[], Column]
    fields: Fields
    media_uri: Callable[[], Column] | None = None
    keep: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Catalogue:
    origin: str
    score: float
    parts: dict[str, Part]

    def _records(self, answers: DataFrame, part: Part, payload: str) -> DataFrame:
        """Columns of answers, with ``a`` the answer, ``r`` a record and ``pos`` its place."""
        parsed = answers.withColumn("a", F.from_json(payload, f"struct<{part.schema},_bad:string>", {"columnNameOfCorruptRecord": "_bad"})).where("a is not null and a._bad is null")
        found = F.col(f"a.{part.records}") if part.records else F.col("a")
        kind = parsed.select(found.alias("r")).schema["r"].dataType
        if not isinstance(kind, ArrayType):
            return parsed.withColumns({"r": found, "pos": F.lit(0)}).where("r is not null")
        found = F.flatten(found) if isinstance(kind.elementType, ArrayType) else found
        return parsed.select("*", F.posexplode(found).alias("pos", "r")).where("r is not null")

    def read(self, answers: DataFrame, kind: str = "media", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
        """Records of the kind (``media``, ``search``, ``episodes``), behind the columns ``keep`` of answers."""
        part = self.parts[kind]
        rows = self._records(answers, part, payload)
        if part.keep:
            rows = rows.where(part.keep())
        ident = part.ident()
        fields = {"score": F.lit(self.score), **part.fields()}
        made = R.episode(self.origin, ident, part.media_uri(), **fields) if part.media_uri else R.media(self.origin, ident, **fields)
        return rows.select(*keep, *made).where("id is not null and id <> ''")

    def files(self, spark: SparkSession, path: str, kind: str = "media") -> DataFrame:
        """The records in files of one answer each."""
        return self.read(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"), kind)


#: Names of types and states, by catalogue. Fixed values.
FORMATS = {"TV": "TV", "MOVIE": "MOVIE", "SPECIAL": "SPECIAL", "OVA": "OVA", "ONA": "ONA"}
STATES_ANILIST = {"NOT_YET_RELEASED": "NOT_YET_RELEASED", "RELEASING": "RELEASING", "FINISHED": "FINISHED"}
STATES_JIKAN = {"Not yet aired": "NOT_YET_RELEASED", "Currently Airing": "RELEASING", "Finished Airing": "FINISHED"}
STATES_KITSU = {"current": "RELEASING", "upcoming": "NOT_YET_RELEASED", "finished": "FINISHED"}


def _kinds(is_film: Column, *before: str) -> Column:
    first = [F.lit(b) for b in before]
    return F.when(F.coalesce(is_film, F.lit(False)), F.array(*first, F.lit("MOVIE"))).otherwise(F.array(*first, F.lit("SERIES")))


def _aired(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def _iso(milliseconds: Column) -> Column:
    return F.date_format(F.timestamp_millis(milliseconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Fields of each catalogue's answers, as they come. Fixed values.
ANILIST = """id:long,idMal:long,siteUrl:string,format:string,status:string,averageScore:double,popularity:long,episodes:long,description:string,title:struct<english:string,romaji:string,native:string>,
coverImage:struct<extraLarge:string>,airingSchedule:struct<edges:array<struct<node:struct<airingAt:long>>>>,trailer:struct<id:string,site:string,thumbnail:string>"""
JIKAN = """mal_id:long,url:string,type:string,status:string,score:double,synopsis:string,title:string,title_english:string,title_japanese:string,members:long,episodes:long,aired:struct<from:string,to:string>,
images:struct<webp:struct<large_image_url:string>>,trailer:struct<youtube_id:string,embed_url:string,images:struct<image_url:string>>,external:array<struct<name:string,url:string>>"""
KITSU_MEDIA = """subtype:string,canonicalTitle:string,titles:struct<en:string,ja_jp:string>,synopsis:string,startDate:string,endDate:string,episodeCount:long,userCount:long,status:string,youtubeVideoId:string,averageRating:string,
posterImage:struct<original:string,large:string,medium:string>,coverImage:struct<original:string,large:string>"""
KITSU_EPISODE = "canonicalTitle:string,synopsis:string,seasonNumber:long,number:long,thumbnail:struct<original:string,large:string,medium:string>"
KITSU_REFS = "relationships:struct<mappings:struct<data:array<struct<id:string>>>>"
KITSU_INCLUDED = "included:array<struct<id:string,attributes:struct<externalSite:string,externalId:string>>>"
KITSU_SITES = {"anilist/anime": "anilist", "myanimelist/anime": "mal"}
TVMAZE_IMAGE = "image:struct<original:string,medium:string>"
TVMAZE_EPISODE = f"id:long,name:string,season:long,number:long,summary:string,{TVMAZE_IMAGE}"
TVMAZE = f"id:long,name:string,url:string,summary:string,premiered:string,rating:struct<average:double>,externals:struct<imdb:string>,{TVMAZE_IMAGE},_embedded:struct<episodes:array<struct<{TVMAZE_EPISODE}>>>"
ANIZIP_EPISODE = "title:struct<en:string,ja:string>,overview:string,summary:string,image:string,seasonNumber:long,episodeNumber:long,absoluteEpisodeNumber:long,runtime:double,length:double,airDateUtc:string,airdate:string"
ANIZIP = f"mappings:struct<anidb_id:long,mal_id:long,anilist_id:long>,titles:struct<en:string,ja:string>,images:array<struct<coverType:string,url:string>>,episodeCount:long,episodes:map<string,struct<{ANIZIP_EPISODE}>>"
OMDB = "Title:string,Year:string,imdbID:string,Poster:string,Plot:string,imdbRating:string,Type:string"
TRAKT_IDS = "ids:struct<slug:string,trakt:long,imdb:string,tmdb:long>"
TRAKT = f"title:string,overview:string,first_aired:string,rating:double,{TRAKT_IDS}"
TRAKT_EPISODE = f"title:string,overview:string,number:long,{TRAKT_IDS}"
SIMKL = """title:string,en_title:string,poster:string,fanart:string,overview:string,first_aired:string,endpoint_type:string,ids:struct<simkl:long,simkl_id:long,imdb:string,tmdb:string,mal:string,anilist:string,kitsu:string>,
ratings:struct<simkl:struct<rating:double>,imdb:struct<rating:double>,mal:struct<rating:double>>"""
SIMKL_EPISODE = "title:string,description:string,season:long,episode:long,type:string,img:string"
TVDB_REMOTE = "array<struct<id:string,sourceName:string>>"
TVDB = f"id:long,name:string,overview:string,image:string,firstAired:string,score:double,remoteIds:{TVDB_REMOTE}"
TVDB_FOUND = f"tvdb_id:string,name:string,overview:string,image_url:string,year:string,remote_ids:{TVDB_REMOTE}"
TVDB_EPISODE = "id:long,name:string,overview:string,image:string,seasonNumber:long,number:long"
WATCHMODE = "id:long,title:string,name:string,type:string,plot_overview:string,poster:string,user_rating:double,imdb_id:string,tmdb_id:long,tmdb_type:string,sources:array<struct<web_url:string>>"
APPLE_IMAGES = "images:struct<coverArt:struct<url:string>,coverArt16X9:struct<url:string>,previewFrame:struct<url:string>>"
APPLE = f"id:string,type:string,title:string,url:string,description:string,releaseDate:long,{APPLE_IMAGES}"
APPLE_EPISODE = f"id:string,title:string,url:string,description:string,seasonNumber:long,episodeNumber:long,{APPLE_IMAGES}"
SIZES = "array<array<struct<source:string>>>"
CRUNCHYROLL = f"id:string,title:string,slug_title:string,description:string,images:struct<poster_tall:{SIZES},poster_wide:{SIZES}>,series_metadata:struct<episode_count:long,series_launch_year:long>"
CRUNCHYROLL_EPISODE = f"id:string,title:string,description:string,episode_number:long,season_number:long,season_id:string,series_id:string,episode_air_date:string,images:struct<thumbnail:{SIZES}>"
PARAMOUNT = "content_id:string,url:string,title:string,episode_num:string,season_num:string,thumbnail:string"
NETFLIX = "netflixid:long,nfid:long,title:string,vtype:string,synopsis:string,img:string,lgimg:string,year:string,imdbrating:double"
NETFLIX_EPISODE = "epid:long,title:string,synopsis:string,img:string,seasnum:long,epnum:long"
JUSTWATCH_EPISODE = "id:string,content:struct<title:string,shortDescription:string,episodeNumber:long,seasonNumber:long,isReleased:boolean>"
OFFLINE = "t:string,ty:string,p:string,ep:long,ml:long,al:long,ku:long,sc:double"
#: Parts of addresses. Fixed values.
SIMKL_IMAGES = "https://simkl.in"
TVDB_ARTWORKS = "https://artworks.thetvdb.com"
OFFLINE_COVERS = "https://cdn.myanimelist.net/images/anime/"
PARAMOUNT_SITE = "https://www.paramountplus.com"
#: How a source without a text yet says so. Fixed value.
COMING_SOON = "THIS EPISODE'S SYNOPSIS IS COMING SOON"


def _anilist() -> dict[str, Column]:
    at = lambda place: _aired(F.try_element_at(_R("airingSchedule.edges"), F.lit(place)).node.airingAt)
    return {
        "url": _R("siteUrl"), "categories": _kinds(_R("format") == "MOVIE", "ANIME"), "type": R.named(_R("format"), {**FORMATS, "TV_SHORT": "TV"}),
        "status": R.named(_R("status"), STATES_ANILIST), "average_score": _R("averageScore"), "popularity": _R("popularity"), "episode_count": _R("episodes"),
        "titles": R.titles(0.8, ("en", _R("title.english")), ("jp-en", _R("title.romaji")), ("jp", _R("title.native"))), **R.described(_R("description"), 0.8),
        "covers": R.images(_R("coverImage.extraLarge"), 0.8, "jp"), "start_date": at(1), "end_date": at(-1),
        "trailers": R.trailer(F.when(_R("trailer.site") == "youtube", _R("trailer.id")), _R("trailer.thumbnail")), "handles": R.handles(R.handle("mal", _R("idMal")))}


def _jikan() -> dict[str, Column]:
    site = F.get(F.filter(_R("external"), lambda e: e["name"] == "AniDB"), 0).url
    anidb = F.coalesce(F.try_parse_url(site, F.lit("QUERY"), F.lit("aid")), F.get(providers.path_parts(site), 1))
    return {
        "url": _R("url"), "categories": _kinds(_R("type") == "Movie", "ANIME"), "type": R.named(_R("type"), {"TV": "TV", "Movie": "MOVIE", "Special": "SPECIAL", "OVA": "OVA", "ONA": "ONA"}),
        "status": R.named(_R("status"), STATES_JIKAN), "average_score": _R("score"), "popularity": _R("members"), "episode_count": _R("episodes"),
        "titles": R.titles(0.9, ("en", _R("title_english")), ("jp-en", _R("title")), ("jp", _R("title_japanese"))), **R.described(_R("synopsis"), 0.9),
        "covers": R.images(_R("images.webp.large_image_url"), 0.9, "en"), "start_date": _R("aired.from"), "end_date": _R("aired.to"),
        "trailers": R.trailer(F.coalesce(R.some(_R("trailer.youtube_id")), R.embedded_video(_R("trailer.embed_url"))), _R("trailer.images.image_url")),
        "handles": R.handles(R.handle("anidb", anidb, site), R.handle("anizip", anidb))}


def sideloaded(refs: Column, included: Column) -> Column:
    """The included resources that relationship ids name, in the order of the ids; unknown ids are left out."""
    by_id = F.map_from_entries(F.transform(F.array_distinct(included), lambda i: F.struct(i.id, i.attributes)))
    return F.filter(F.transform(refs, lambda ref: F.try_element_at(by_id, ref.id)), lambda x: x.isNotNull())


def _kitsu() -> dict[str, Column]:
    at = lambda path: _R(f"attributes.{path}")
    mappings = sideloaded(_R("relationships.mappings.data"), F.col("a.included"))
    linked = F.transform(mappings, lambda m: F.coalesce(*(F.when(m.externalSite == site, R.handle(o, m.externalId)) for site, o in KITSU_SITES.items())))
    return {
        "url": F.concat(F.lit("https://kitsu.io/anime/"), _R("id")), "categories": _kinds(at("subtype") == "movie", "ANIME"),
        "type": R.named(at("subtype"), {"TV": "TV", "movie": "MOVIE", "special": "SPECIAL", "OVA": "OVA", "ONA": "ONA"}), "status": R.named(at("status"), STATES_KITSU),
        "titles": R.titles(0.3, ("en", at("titles.en")), ("en", at("canonicalTitle")), ("ja", at("titles.ja_jp")), once=True), **R.described(at("synopsis"), 0.3),
        "covers": R.images(F.coalesce(at("posterImage.original"), at("posterImage.large"), at("posterImage.medium")), 0.3), "banners": R.images(F.coalesce(at("coverImage.original"), at("coverImage.large")), 0.3),
        "start_date": R.some(at("startDate")), "end_date": R.some(at("endDate")), "episode_count": at("episodeCount"), "popularity": at("userCount"),
        "trailers": R.trailer(at("youtubeVideoId")), "average_score": R.rated(R.some(at("averageRating")).try_cast("double")), "handles": R.distinct_handles(F.array_compact(linked))}


def _kitsu_episode() -> dict[str, Column]:
    at = lambda path: _R(f"attributes.{path}")
    return {"titles": R.titles(0.3, ("en", at("canonicalTitle"))), **R.described(at("synopsis"), 0.3), "season_number": at("seasonNumber"), "episode_number": at("number"),
            "thumbnails": R.images(F.coalesce(at("thumbnail.original"), at("thumbnail.large"), at("thumbnail.medium")), 0.3)}


def _tvmaze() -> dict[str, Column]:
    return {"url": F.coalesce(_R("url"), F.concat(F.lit("https://www.tvmaze.com/shows/"), _R("id").cast("string"))), "categories": F.array(F.lit("SERIES")),
            "titles": R.titles(0.3, ("en", _R("name"))), **R.described(text.clean_text(_R("summary")), 0.3), "covers": R.images(F.coalesce(_R("image.original"), _R("image.medium")), 0.3),
            "start_date": R.some(_R("premiered")), "average_score": _R("rating.average"), "handles": R.handles(R.handle("imdb", _R("externals.imdb")))}


def _tvmaze_episode() -> dict[str, Column]:
    return {"titles": R.titles(0.3, ("en", _R("name"))), **R.described(text.clean_text(_R("summary")), 0.3), "season_number": _R("season"), "episode_number": _R("number"),
            "thumbnails": R.images(F.coalesce(_R("image.original"), _R("image.medium")), 0.3)}


def _anizip() -> dict[str, Column]:
    of = lambda kind: R.image_list(F.transform(F.filter(_R("images"), lambda i: i.coverType == kind), lambda i: i.url), 0.9)
    return {"url": F.concat(F.lit(R.PLACES["anizip"].format("")), _R("mappings.anidb_id").cast("string")), "categories": _kinds(F.lit(False), "ANIME"), "score": F.lit(None),
            "titles": R.titles(0.9, ("en", _R("titles.en")), ("ja", _R("titles.ja"))), "covers": of("Poster"), "banners": of("Banner"), "episode_count": _R("episodeCount"),
            "handles": R.handles(R.handle("mal", _R("mappings.mal_id")), R.handle("anilist", _R("mappings.anilist_id")))}


def _omdb() -> dict[str, Column]:
    known = lambda c: text.na(R.some(_R(c)))
    year = R.some(F.regexp_extract(known("Year"), "([0-9]{4})", 1))
    return {"url": F.concat(F.lit("https://www.imdb.com/title/"), _R("imdbID")), "categories": _kinds(_R("Type") == "movie"), "titles": R.titles(0.3, ("en", _R("Title"))),
            **R.described(known("Plot"), 0.3), "covers": R.images(known("Poster"), 0.3), "average_score": R.rated(known("imdbRating").try_cast("double")), "start_date": R.year_start(year),
            "handles": R.handles(R.handle("imdb", _R("imdbID")))}


def _trakt() -> dict[str, Column]:
    ident = F.coalesce(_R("ids.slug"), _R("ids.trakt").cast("string"))
    return {"url": F.concat(F.lit("https://trakt.tv/shows/"), ident), "categories": F.array(F.lit("SERIES")), "titles": R.titles(0.3, ("en", _R("title"))), **R.described(_R("overview"), 0.3),
            "start_date": F.date_format(F.try_to_timestamp(_R("first_aired")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "average_score": R.rated(_R("rating"), times=10, whole=True),
            "handles": R.handles(R.handle("imdb", _R("ids.imdb")), R.handle("tmdb", _R("ids.tmdb")))}


def _simkl() -> dict[str, Column]:
    kind = R.named(_R("endpoint_type"), {"anime": "anime", "movies": "movies"}, "tv")
    at = lambda path, folder, size: F.when(R.some(path).isNotNull(), F.concat(F.lit(f"{SIMKL_IMAGES}/{folder}/"), path, F.lit(f"_{size}.jpg")))
    ident = F.coalesce(_R("ids.simkl"), _R("ids.simkl_id")).cast("string")
    return {"url": F.concat(F.lit("https://simkl.com/"), kind, F.lit("/"), ident),
            "categories": F.when(kind == "movies", F.array(F.lit("MOVIE"))).when(kind == "anime", F.array(F.lit("ANIME"), F.lit("SERIES"))).otherwise(F.array(F.lit("SERIES"))),
            "titles": R.titles(0.3, ("en", _R("title")), ("en", _R("en_title")), once=True), **R.described(_R("overview"), 0.3), "covers": R.images(at(_R("poster"), "posters", "m"), 0.3),
            "banners": R.images(at(_R("fanart"), "fanart", "w"), 0.3), "start_date": R.some(_R("first_aired")), "average_score": R.rated(_R("ratings.simkl.rating"), _R("ratings.imdb.rating"), _R("ratings.mal.rating")),
            "handles": R.handles(*(R.handle(o, _R(f"ids.{o}")) for o in ("imdb", "tmdb", "mal", "anilist", "kitsu")))}


def _tvdb_fields(image: str, remote: str, **more: Column) -> dict[str, Column]:
    path = R.some(_R(image))
    where = F.when(path.startswith("http"), path).when(path.startswith("/"), F.concat(F.lit(TVDB_ARTWORKS), path)).otherwise(F.concat(F.lit(f"{TVDB_ARTWORKS}/"), path))
    linked = F.transform(_R(remote), lambda x: F.coalesce(F.when(F.lower(x.sourceName) == "imdb", R.handle("imdb", x.id)), F.when(F.lower(x.sourceName).isin("themoviedb", "tmdb"), R.handle("tmdb", x.id))))
    return {"categories": F.array(F.lit("SERIES")), "titles": R.titles(0.3, ("en", _R("name"))), **R.described(_R("overview"), 0.3), "covers": R.images(where, 0.3), "handles": R.distinct_handles(F.array_compact(linked)), **more}


def _watchmode() -> dict[str, Column]:
    ident, kind = _R("id").cast("string"), _R("type")
    film = F.contains(kind, F.lit("movie")) | F.contains(kind, F.lit("short_film"))
    tmdb = R.handle("tmdb", _R("tmdb_id"), F.concat(F.lit("https://www.themoviedb.org/"), F.when(_R("tmdb_type") == "movie", "movie").otherwise("tv"), F.lit("/"), _R("tmdb_id").cast("string")))
    streams = F.transform(_R("sources"), lambda x: R.handle(providers.stream_origin(x.web_url), F.coalesce(F.try_element_at(providers.path_parts(x.web_url), F.lit(-1)), ident), x.web_url))
    return {"url": F.concat(F.lit("https://www.watchmode.com/title/"), ident, F.lit("/")), "categories": _kinds(film), "titles": R.titles(0.25, ("en", F.coalesce(_R("title"), _R("name")))),
            **R.described(_R("plot_overview"), 0.25), "covers": R.images(_R("poster"), 0.25), "average_score": R.rated(_R("user_rating"), times=10, whole=True),
            "handles": R.distinct_handles(F.concat(R.handles(R.handle("imdb", _R("imdb_id")), tmdb), F.array_compact(F.coalesce(streams, F.array().cast(f"array<{R.HANDLE}>")))))}


def _sized(path: str, width: int, height: int) -> Column:
    return R.filled(_R(path), w=str(width), h=str(height), c="", f="jpg")


def _apple() -> dict[str, Column]:
    return {"url": _R("url"), "categories": _kinds(_R("type") == "Movie"), "titles": R.titles(0.2, ("en", _R("title"))), **R.described(_R("description"), 0.2),
            "covers": R.images(_sized("images.coverArt.url", 600, 900), 0.2), "banners": R.images(_sized("images.coverArt16X9.url", 1920, 1080), 0.2), "start_date": _iso(F.nullif(_R("releaseDate"), F.lit(0)))}


def _apple_episode() -> dict[str, Column]:
    still = F.coalesce(_sized("images.previewFrame.url", 1280, 720), _sized("images.coverArt16X9.url", 1280, 720))
    return {"url": _R("url"), "titles": R.titles(0.2, ("en", _R("title"))), **R.described(_R("description"), 0.2), "thumbnails": R.images(still, 0.2), "season_number": _R("seasonNumber"), "episode_number": _R("episodeNumber")}


def _crunchyroll() -> dict[str, Column]:
    image = lambda kind: R.images(R.best_image(_R(f"images.{kind}")).source, 0.5)
    return {"url": F.concat(F.lit("https://www.crunchyroll.com/series/"), _R("id"), F.lit("/"), _R("slug_title")), "categories": _kinds(F.lit(False), "ANIME"), "titles": R.titles(0.5, ("en", _R("title"))),
            **R.described(_R("description"), 0.5), "covers": image("poster_tall"), "banners": image("poster_wide"), "start_date": R.year_start(_R("series_metadata.series_launch_year")), "episode_count": _R("series_metadata.episode_count")}


def _crunchyroll_episode() -> dict[str, Column]:
    return {"url": F.concat(F.lit("https://www.crunchyroll.com/watch/"), _R("id")), "titles": R.titles(0.5, ("en", _R("title"))), **R.described(_R("description"), 0.5),
            "thumbnails": R.images(R.best_image(_R("images.thumbnail")).source, 0.5), "release_date": _R("episode_air_date"), "season_number": _R("season_number"), "episode_number": _R("episode_number")}


def _paramount_episode() -> dict[str, Column]:
    return {"url": F.concat(F.lit(PARAMOUNT_SITE), R.some(_R("url"))), "titles": R.titles(0.2, ("en", _R("title"))), "thumbnails": R.images(_R("thumbnail"), 0.2),
            "season_number": _R("season_num").try_cast("long"), "episode_number": _R("episode_num").try_cast("long")}


def _netflix() -> dict[str, Column]:
    secure = lambda u: F.regexp_replace(u, "^http://", "https://")
    ident = F.coalesce(_R("netflixid"), _R("nfid")).cast("string")
    return {"url": F.concat(F.lit("https://www.netflix.com/title/"), ident), "categories": _kinds(_R("vtype") == "movie"), "titles": R.titles(0.2, ("en", text.decode_entities(_R("title")))),
            **R.described(text.decode_entities(_R("synopsis")), 0.2), "covers": R.images(secure(_R("img")), 0.2), "banners": R.images(_R("lgimg"), 0.2), "start_date": R.year_start(_R("year")), "average_score": _R("imdbrating")}


def _netflix_episode() -> dict[str, Column]:
    told = F.trim(_R("synopsis"))
    return {"titles": R.titles(0.2, ("en", text.decode_entities(_R("title")))), **R.described(text.decode_entities(F.when(~told.startswith(COMING_SOON), told)), 0.2),
            "thumbnails": R.images(_R("img"), 0.2), "season_number": _R("seasnum"), "episode_number": _R("epnum")}


def _justwatch_episode() -> dict[str, Column]:
    at = lambda path: _R(f"content.{path}")
    return {"titles": R.titles(0.2, ("en", at("title"))), **R.described(at("shortDescription"), 0.2), "season_number": at("seasonNumber"), "episode_number": at("episodeNumber")}


def _offline_ident() -> Column:
    return F.coalesce(*(F.when(_R(c) > 0, F.concat(F.lit(f"{o}-"), _R(c).cast("string"))) for o, c in (("mal", "ml"), ("anilist", "al"), ("kitsu", "ku"))))


def _offline() -> dict[str, Column]:
    linked = (R.handle(o, F.when(_R(c) > 0, _R(c)), u) for o, c, u in (("mal", "ml", None), ("anilist", "al", None), ("kitsu", "ku", "https://kitsu.app/anime/{}")))
    return {"categories": _kinds(_R("ty") == "MOVIE", "ANIME"), "type": R.named(_R("ty"), FORMATS), "titles": R.titles(0.2, ("en", _R("t"))), "covers": R.images(F.concat(F.lit(OFFLINE_COVERS), R.some(_R("p"))), 0.2),
            "episode_count": F.nullif(_R("ep"), F.lit(0)), "average_score": R.rated(F.nullif(_R("sc"), F.lit(0.0)), times=10, whole=True), "handles": R.handles(*linked)}


def _show(origin: str, path: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(f"{origin}:"), F.col(path).cast("string"))


def _numbered(own: Column, media: Column, season: Column, number: Column) -> Column:
    """An episode's own id, else one of its media, season and number."""
    return F.coalesce(own.cast("string"), F.concat(media, F.lit("-s"), F.coalesce(season, F.lit(0)).cast("string"), F.lit("e"), F.coalesce(number, F.lit(0)).cast("string")))


def _catalogues() -> list[Catalogue]:
    """The catalogues. Answers of episodes name the media they belong to in a column ``media_id``."""
    of = _show
    text_id = lambda path: lambda: _R(path).cast("string")
    return [
        Catalogue("anilist", 0.8, {"media": Part(f"data:struct<Page:struct<media:array<struct<{ANILIST}>>>>", "data.Page.media", text_id("id"), _anilist)}),
        Catalogue("mal", 0.9, {"media": Part(f"data:array<struct<{JIKAN}>>", "data", text_id("mal_id"), _jikan)}),
        Catalogue("kitsu", 0.3, {"media": Part(f"data:array<struct<id:string,attributes:struct<{KITSU_MEDIA}>,{KITSU_REFS}>>,{KITSU_INCLUDED}", "data", text_id("id"), _kitsu),
                                 "episodes": Part(f"data:array<struct<id:string,attributes:struct<{KITSU_EPISODE}>>>", "data", text_id("id"), _kitsu_episode, of("kitsu", "media_id"))}),
        Catalogue("tvmaze", 0.3, {"media": Part(TVMAZE, "", text_id("id"), _tvmaze), "episodes": Part(TVMAZE, "_embedded.episodes", text_id("id"), _tvmaze_episode, of("tvmaze", "a.id"))}),
        Catalogue("anizip", 0.9, {"media": Part(ANIZIP, "", text_id("mappings.anidb_id"), _anizip)}),
        Catalogue("omdb", 0.3, {"media": Part(OMDB, "", text_id("imdbID"), _omdb)}),
        Catalogue("trakt", 0.3, {"media": Part(TRAKT, "", lambda: F.coalesce(_R("ids.slug"), _R("ids.trakt").cast("string")), _trakt),
                                 "episodes": Part(f"number:long,episodes:array<struct<{TRAKT_EPISODE}>>", "episodes", lambda: _numbered(_R("ids.trakt"), F.col("media_id"), F.col("a.number"), _R("number")), lambda: {
                                     "titles": R.titles(0.3, ("en", _R("title"))), **R.described(_R("overview"), 0.3), "season_number": F.col("a.number"), "episode_number": _R("number")}, of("trakt", "media_id"), lambda: F.col("a.number") > 0)}),
        Catalogue("simkl", 0.3, {"media": Part(SIMKL, "", lambda: F.coalesce(_R("ids.simkl"), _R("ids.simkl_id")).cast("string"), _simkl, keep=lambda: R.some(_R("title")).isNotNull()),
                                 "episodes": Part(f"episodes:array<struct<{SIMKL_EPISODE}>>", "episodes", lambda: F.coalesce(F.concat(F.col("media_id"), F.lit("-s"), F.coalesce(_R("season"), F.lit(1)).cast("string"), F.lit("e"), _R("episode").cast("string")), F.concat(F.col("media_id"), F.lit("-i"), F.col("pos").cast("string"))), lambda: {
                                     "titles": R.titles(0.3, ("en", _R("title"))), **R.described(_R("description"), 0.3), "season_number": _R("season"), "episode_number": _R("episode")}, of("simkl", "media_id"),
                                     lambda: ~_R("type").eqNullSafe("special") | _R("episode").isNotNull() | R.some(_R("title")).isNotNull())}),
        Catalogue("tvdb", 0.3, {"media": Part(f"data:struct<{TVDB}>", "", lambda: _R("data.id").cast("string"), lambda: _tvdb_fields("data.image", "data.remoteIds") | {
                                    "titles": R.titles(0.3, ("en", _R("data.name"))), **R.described(_R("data.overview"), 0.3), "start_date": R.some(_R("data.firstAired")), "average_score": _R("data.score"),
                                    "url": F.concat(F.lit("https://www.thetvdb.com/series/"), _R("data.id").cast("string"))}),
                                "search": Part(f"data:array<struct<{TVDB_FOUND}>>", "data", text_id("tvdb_id"), lambda: _tvdb_fields("image_url", "remote_ids", start_date=R.year_start(_R("year")), url=F.concat(F.lit("https://www.thetvdb.com/series/"), _R("tvdb_id")))),
                                "episodes": Part(f"data:struct<episodes:array<struct<{TVDB_EPISODE}>>>", "data.episodes", lambda: _numbered(_R("id"), F.col("media_id"), _R("seasonNumber"), _R("number")), lambda: {
                                    "titles": R.titles(0.3, ("en", _R("name"))), **R.described(_R("overview"), 0.3), "season_number": _R("seasonNumber"), "episode_number": _R("number")}, of("tvdb", "media_id"))}),
        Catalogue("watchmode", 0.25, {"media": Part(WATCHMODE, "", text_id("id"), _watchmode)}),
        Catalogue("appletv", 0.2, {"media": Part(f"data:struct<content:struct<{APPLE}>>", "data.content", text_id("id"), _apple),
                                   "search": Part(f"data:struct<canvas:struct<shelves:array<struct<items:array<struct<{APPLE}>>>>>>", "data.canvas.shelves.items", text_id("id"), _apple, keep=lambda: _R("type").isin("Show", "Movie")),
                                   "episodes": Part(f"data:struct<episodes:array<struct<{APPLE_EPISODE}>>>", "data.episodes", text_id("id"), _apple_episode, of("appletv", "media_id"))}),
        Catalogue("cr", 0.5, {"media": Part(f"data:array<struct<{CRUNCHYROLL}>>", "data", text_id("id"), _crunchyroll),
                              "episodes": Part(f"data:array<struct<{CRUNCHYROLL_EPISODE}>>", "data", lambda: R.series_id(_R("series_id"), _R("season_id"), _R("id")), _crunchyroll_episode, of("cr", "media_id"))}),
        Catalogue("paramount", 0.2, {"episodes": Part(f"result:struct<data:array<struct<{PARAMOUNT}>>>", "result.data", text_id("content_id"), _paramount_episode, of("paramount", "media_id"))}),
        Catalogue("nf", 0.2, {"media": Part(NETFLIX, "", lambda: F.coalesce(_R("netflixid"), _R("nfid")).cast("string"), _netflix),
                              "search": Part(f"results:array<struct<{NETFLIX}>>", "results", lambda: F.coalesce(_R("netflixid"), _R("nfid")).cast("string"), _netflix),
                              "episodes": Part(f"episodes:array<struct<{NETFLIX_EPISODE}>>", "episodes", text_id("epid"), _netflix_episode, of("nf", "media_id"))}),
        Catalogue("jw", 0.2, {"episodes": Part(f"episodes:array<struct<{JUSTWATCH_EPISODE}>>", "episodes", text_id("id"), _justwatch_episode, of("jw", "media_id"), lambda: F.coalesce(_R("content.isReleased"), F.lit(False)))}),
        Catalogue("offline", 0.2, {"media": Part(OFFLINE, "", _offline_ident, _offline)}),
    ]


CATALOGUES = {c.origin: c for c in _catalogues()}
#: Origins that exist for the handles of others: they read nothing. Name and colour are what pages show. Fixed values.
HANDLES_ONLY = {"disney": "Disney+", "amazon": "Prime Video", "hulu": "Hulu", "peacock": "Peacock", "hbo": "HBO Max", "fubo": "Fubo"}
