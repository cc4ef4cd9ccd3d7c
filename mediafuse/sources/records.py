"""Records as the store holds them: one schema for media and one for episodes, and the small pieces sources build them from.

Everything is Column functions. A field that a source does not have is null, or an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE = "struct<language:string,title:string,score:double>"
DESCRIPTION = "struct<language:string,description:string,score:double>"
SHORT = "struct<language:string,short_description:string,score:double>"
IMAGE = "struct<language:string,url:string,score:double>"
TRAILER = "struct<uri:string,origin:string,id:string,url:string,language:string,thumbnail:string>"
HANDLE = "struct<uri:string,origin:string,id:string,url:string>"
MEDIA = {
    "uri": "string", "origin": "string", "id": "string", "url": "string", "score": "double", "type": "string", "categories": "array<string>", "status": "string",
    "titles": f"array<{TITLE}>", "descriptions": f"array<{DESCRIPTION}>", "short_descriptions": f"array<{SHORT}>", "trailers": f"array<{TRAILER}>",
    "covers": f"array<{IMAGE}>", "banners": f"array<{IMAGE}>", "external_links": "string", "average_score": "double", "popularity": "long",
    "start_date": "string", "end_date": "string", "is_adult": "boolean", "episode_count": "long", "handles": f"array<{HANDLE}>",
}
EPISODE = {
    "uri": "string", "origin": "string", "id": "string", "url": "string", "embed_url": "string", "media_uri": "string", "score": "double",
    "titles": f"array<{TITLE}>", "descriptions": f"array<{DESCRIPTION}>", "short_descriptions": f"array<{SHORT}>", "thumbnails": f"array<{IMAGE}>",
    "release_date": "string", "season_number": "long", "episode_number": "long", "absolute_episode_number": "long", "runtime": "double",
}


def _filled(schema: dict[str, str], fields: dict[str, Column]) -> list[Column]:
    if unknown := set(fields) - set(schema):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    return [(F.coalesce(fields[n].cast(kind), empty(kind)) if n in fields else empty(kind)).alias(n) for n, kind in schema.items()]


def media(origin: str | Column, ident: Column, **fields: Column) -> list[Column]:
    """The columns of a media record: its uri from origin and id, the given fields, and defaults for all others."""
    o = F.lit(origin) if isinstance(origin, str) else origin
    return _filled(MEDIA, {"uri": F.concat(o, F.lit(":"), ident.cast("string")), "origin": o, "id": ident, **fields})


def episode(origin: str | Column, ident: Column, media_uri: Column, **fields: Column) -> list[Column]:
    """The columns of an episode record."""
    o = F.lit(origin) if isinstance(origin, str) else origin
    return _filled(EPISODE, {"uri": F.concat(o, F.lit(":"), ident.cast("string")), "origin": o, "id": ident, "media_uri": media_uri, **fields})


def stored(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """rows with exactly the schema's columns: missing ones added, absent lists empty, everything else left out."""
    have = {c: F.col(c) for c in rows.columns if c in schema}
    return rows.select(*_filled(schema, have))


def some(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def _one(value: Column, kind: str, **parts: Column) -> Column:
    made = F.array(F.struct(*(p.alias(n) for n, p in parts.items())).cast(kind))
    return F.when(value.isNotNull(), made).otherwise(F.array().cast(f"array<{kind}>"))


def titles(score: float, *spoken: tuple[str, Column], once: bool = False) -> Column:
    """Titles in the given order of (language, text); empty ones are left out, and with ``once`` repeated texts too."""
    made = F.array_compact(F.array(*(F.when(some(t).isNotNull(), F.struct(F.lit(g).alias("language"), t.alias("title"), F.lit(score).alias("score"))) for g, t in spoken)))
    if once:
        texts = F.transform(made, lambda x: x.title)
        made = F.filter(made, lambda x, i: F.array_position(texts, x.title) == i + 1)
    return made.cast(f"array<{TITLE}>")


def described(text: Column, score: float, short: Column | None = None) -> dict[str, Column]:
    """A description as both lists of a record; ``short`` takes the place of the text in the second where it is there."""
    long, brief = some(text), some(F.coalesce(some(short), text)) if short is not None else some(text)
    return {"descriptions": _one(long, DESCRIPTION, language=F.lit("en"), description=long, score=F.lit(score)),
            "short_descriptions": _one(brief, SHORT, language=F.lit("en"), short_description=brief, score=F.lit(score))}


def images(url: Column, score: float, language: str | None = None) -> Column:
    return _one(some(url), IMAGE, language=F.lit(language).cast("string"), url=url, score=F.lit(score))


def image_list(urls: Column, score: float) -> Column:
    """One image for each different url of an array, in order."""
    real = F.array_distinct(F.filter(urls, lambda u: some(u).isNotNull()))
    return F.transform(real, lambda u: F.struct(F.lit(None).cast("string").alias("language"), u.alias("url"), F.lit(score).alias("score"))).cast(f"array<{IMAGE}>")


def trailer(ident: Column, thumbnail: Column | None = None, language: str | None = "en") -> Column:
    """A video on the usual platform, by its id."""
    return _one(some(ident), TRAILER, uri=F.concat(F.lit("yt:"), ident), origin=F.lit("yt"), id=ident, url=F.concat(F.lit("https://www.youtube.com/watch?v="), ident),
                language=F.lit(language), thumbnail=thumbnail if thumbnail is not None else F.lit(None).cast("string"))


def embedded_video(url: Column) -> Column:
    """The video id in an embedding url, null if there is none."""
    return some(F.regexp_extract(url, "/embed/([A-Za-z0-9_-]{11})", 1))


#: Where a handle of each catalogue leads to. Fixed values.
PLACES = {
    "mal": "https://myanimelist.net/anime/{}", "anilist": "https://anilist.co/anime/{}", "imdb": "https://www.imdb.com/title/{}", "tmdb": "https://www.themoviedb.org/tv/{}",
    "kitsu": "https://kitsu.io/anime/{}", "anizip": "https://api.ani.zip/mappings?anidb_id={}", "tvdb": "https://www.thetvdb.com/series/{}",
}


def filled(template: str | Column, **values: str | Column) -> Column:
    """A template with each ``{name}`` replaced."""
    out = F.lit(template) if isinstance(template, str) else template
    for n, v in values.items():
        out = F.replace(out, F.lit("{" + n + "}"), v.cast("string") if isinstance(v, Column) else F.lit(v))
    return out


def handle(origin: str | Column, ident: Column, url: Column | str | None = None) -> Column:
    """A handle, null without an id. Without a url it gets its catalogue's, if that has one."""
    o, ident = F.lit(origin) if isinstance(origin, str) else origin, some(ident.cast("string"))
    if url is None and isinstance(origin, str):
        url = PLACES.get(origin)
    where = F.lit(None).cast("string") if url is None else F.replace(F.lit(url), F.lit("{}"), ident) if isinstance(url, str) else url
    return F.when(ident.isNotNull() & o.isNotNull(), F.struct(F.concat(o, F.lit(":"), ident).alias("uri"), o.alias("origin"), ident.alias("id"), where.alias("url")))


def handles(*given: Column) -> Column:
    """The handles that are there, once each, in order."""
    made = F.array_compact(F.array(*given)).cast(f"array<{HANDLE}>")
    return distinct_handles(made)


def distinct_handles(made: Column) -> Column:
    """The first of the handles of each uri; ``made`` is evaluated once, where a filter by its own places would do so for every handle."""
    new = lambda so_far, h: h.uri.isNotNull() & ~F.exists(so_far, lambda x: x.uri == h.uri)
    return F.aggregate(made, F.array().cast(f"array<{HANDLE}>"), lambda so_far, h: F.when(new(so_far, h), F.concat(so_far, F.array(h))).otherwise(so_far))


def named(value: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    """The name that a vocabulary gives a value; ``otherwise`` for any other, null values included."""
    known = F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in names.items())) if names else F.lit(None)
    return known if otherwise is None else F.coalesce(known, F.lit(otherwise))


def rated(*ratings: Column, times: float = 1.0, whole: bool = False) -> Column:
    """The first rating that is there, rescaled and, if asked for, rounded half up."""
    value = F.coalesce(*(r.cast("double") for r in ratings)) * times
    return F.floor(value + 0.5).cast("double") if whole else value


def is_movie(categories: Column) -> Column:
    return F.coalesce(F.array_contains(categories, "MOVIE"), F.lit(False))


def first_title(made: Column) -> Column:
    return F.get(made, 0).title


def year_start(year: Column) -> Column:
    return F.when(year.isNotNull() & (year.cast("string") != ""), F.concat(year.cast("string"), F.lit("-01-01")))


def best_image(sizes: Column) -> Column:
    """The last of the last list of an array of arrays: sources list sizes upwards."""
    return F.try_element_at(F.try_element_at(sizes, F.lit(-1)), F.lit(-1))


def series_id(series: Column, season: Column | None = None, episode_id: Column | None = None) -> Column:
    """Ids of a series, one of its seasons and an episode as one id, without the marks of a season's dub."""
    season = F.regexp_replace(season, "JAJP$", "") if season is not None else None
    return F.concat_ws("-", *(some(p) for p in (series, season, episode_id) if p is not None))


def original_season(ident: Column, versions: Column) -> Column:
    """The id of a season's Japanese version, else of the original one, else its own without the dub's mark."""
    guid = lambda keep: F.get(F.filter(versions, keep), 0).guid
    return F.coalesce(guid(lambda v: v.audio_locale == "ja-JP"), guid(lambda v: v.original), F.regexp_replace(ident, "JAJP$", ""))


def deep_merge(a: Column, b: Column, kind) -> Column:
    """b over a by type: lists joined without repeats, structs and maps merged, and of other values b's where it has one."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    if isinstance(kind, StructType):
        whole = F.struct(*(deep_merge(a[f.name], b[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(whole)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_union(a, b), b, a)
    if isinstance(kind, MapType):
        return F.coalesce(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), b, a)
    return F.coalesce(b, a)


def deep_merged(rows: DataFrame, left: str, right: str, name: str = "merged") -> DataFrame:
    """rows with ``name``: the struct column ``right`` merged over ``left``, which must be of one type."""
    return rows.withColumn(name, deep_merge(F.col(left), F.col(right), rows.schema[left].dataType))


def sliced(descriptions: Column, count: Column | int | None) -> Column:
    """The first ``count`` entries; 0 or null gives all."""
    n = F.lit(count).cast("int") if not isinstance(count, Column) else count.cast("int")
    return F.when(F.coalesce(n, F.lit(0)) <= 0, descriptions).otherwise(F.slice(descriptions, F.lit(1), F.greatest(n, F.lit(1))))


def released(episodes: DataFrame, flag: str) -> DataFrame:
    """Episodes that their source says are out."""
    return episodes.where(F.coalesce(F.col(flag), F.lit(False)))


def regular(episodes: DataFrame, kind: str = "type", number: str = "episode_number", title: str = "title") -> DataFrame:
    """All episodes but specials that have neither a number nor a title."""
    return episodes.where(~F.col(kind).eqNullSafe("special") | F.col(number).isNotNull() | some(F.col(title)).isNotNull())
