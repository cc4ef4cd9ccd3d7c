"""Readers of HTML catalogue pages, as Column and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.functions import season, text, uris
from mediafuse.sources import records as R


def sections(page: Column, heading: str) -> Column:
    """array<struct<section, body>>: the page cut at its headings; without any, one section without a name.

    heading: an expression whose group is the name. What stands before the first heading is left out.
    """
    parts = F.split(page, f"(?={heading})", -1)
    named = F.transform(parts, lambda p: F.struct(F.coalesce(text.clean_text(F.regexp_extract(p, f"^{heading}", 1)), F.lit("")).alias("section"), p.alias("body")))
    return F.when(page.rlike(heading), F.filter(named, lambda p: p.body.rlike(f"^{heading}"))).otherwise(F.array(F.struct(F.lit("").alias("section"), page.alias("body"))))


def cards(pages: DataFrame, key: str, page: str, card: str, ident: Column | str, fields: dict[str, Column | str], heading: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One row per card and first place of its id: key, section, id and the fields.

    card: expression at which a card begins; what stands before the first is none. ident and fields: a pattern
    with one group each, or a Column over ``body``. Cards without an id or a required field are left out.
    """
    value = lambda f: text.clean_text(F.regexp_extract("body", f, 1)) if isinstance(f, str) else f
    each = pages.select(key, F.posexplode(sections(F.col(page), heading)).alias("_s", "p")).select(
        key, "_s", "p.section", F.posexplode(F.split("p.body", rf"(?={card})", -1)).alias("_c", "body")).where(F.col("body").rlike(rf"^(?:{card})"))
    rows = each.select(key, "section", "_s", "_c", value(ident).alias("id"), *(value(f).alias(n) for n, f in fields.items()))
    for c in ("id", *required):
        rows = rows.where(F.col(c).isNotNull())
    first = F.row_number().over(Window.partitionBy(key, "id").orderBy("_s", "_c"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r", "_s", "_c")


#: Markup of a seasonal grid's page: where headings and cards begin, and what holds each field of a card. Fixed values.
GRID_HEADING, GRID_CARD = 'class="anime-header">([^<]*)<', "js-anime-category-producer"
GRID_IDS = (r"myanimelist\.net/anime/([0-9]+)", r'class="genres js-genre" id="([0-9]+)"')
GRID_COVERS = tuple(rf'<img[^>]*\b{a}="(https://cdn\.myanimelist\.net/images/anime/[^"]+)"' for a in ("data-src", "src"))
GRID_TEXTS = {"title": 'class="link-title">([^<]+)<', "english_title": 'class="h3_anime_subtitle">([^<]*)<', "synopsis": r'(?s)class="preline">(.*?)</p>'}
GRID_NUMBERS = {"score": ('class="js-score">([0-9.]+)<', "double"), "members": ('class="js-members">([0-9,]+)<', "long"),
                "episodes": (r"<span>\s*([0-9]+)\s*eps?\s*</span>", "long"), "type_id": ("js-anime-type-([0-9]+)", "int")}
GRID_START = 'class="js-start_date">([0-9]+)<'
GRID_TYPES = {1: "TV", 2: "OVA", 3: "MOVIE", 4: "SPECIAL", 5: "ONA"}


def season_cards(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Entries of a seasonal grid: id, titles, synopsis, cover, score, members, episodes, type, start date and section. Cards without a title are none."""
    found = lambda p: F.nullif(F.regexp_extract("body", p, 1), F.lit(""))
    first = lambda patterns: F.coalesce(*map(found, patterns))
    numbers = {n: text.number(found(p)).cast(kind) for n, (p, kind) in GRID_NUMBERS.items()}
    return cards(pages, key, page, GRID_CARD, first(GRID_IDS), {**GRID_TEXTS, "cover": first(GRID_COVERS), **numbers, "start_date": season.compact_date(found(GRID_START))},
                 heading=GRID_HEADING, required=("title",))


#: Section of shows that were carried over from an earlier season. Fixed value.
CARRIED_OVER = "TV (Continuing)"


def current_only(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("section") != CARRIED_OVER)


#: Markup of a film catalogue's pages: what holds each field. Fixed values.
SHOW_META = {"title": "og:title", "overview": "og:description", "poster": "og:image"}
SHOW_BACKDROP, SHOW_PERCENT = r"/t/p/w1920[^\"']+\.(?:jpg|png)", r'class="user_score_chart"[^>]*data-percent="([0-9.]+)"'
MEDIA_HOST, SHOW_SITE = "https://media.themoviedb.org", "https://www.themoviedb.org/tv/"
EPISODE_CARD, EPISODE_NUMBER = '<div class="card', 'data-episode-number="([0-9]+)"'
EPISODE_TITLES = ("<h3><a[^>]*>([^<]+)</a></h3>", r'<img[^>]*\balt="([^"]*)"')
EPISODE_TEXT, EPISODE_STILL = r'(?s)class="overview"[^>]*>\s*<p>(.*?)</p>', rf'src="({MEDIA_HOST}/t/p/[^"]+)"'
FOUND_CARD, FOUND_ID, FOUND_TITLE = '(?=data-media-type="tv")', '(?s)^data-media-type="tv".{0,200}?href="/tv/([0-9]+)', r'(?s)<img\s+alt="([^"]*)"'
FOUND_POSTER, FOUND_YEAR = '(?s)<img\\s+alt="[^"]*".{0,300}?(?:src|data-src)="(https://[^"]+)"', r'class="release_date[^"]*">[^<]*\b((?:19|20)[0-9]{2})\b'
SHOW_SCORE = 0.3


def _first(text_of: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text_of, pattern, 1), F.lit(""))


def show_records(pages: DataFrame, ident: str, page: str, season_number: Column | None = None) -> list[Column]:
    """Columns of a media record from a show's page: of the show, or of one of its seasons, whose id then names the season."""
    p = F.col(page)
    meta = {n: _first(p, f'<meta property="{v}" content="([^"]*)"') for n, v in SHOW_META.items()}
    own = F.col(ident).cast("string")
    scoped = own if season_number is None else F.when(season_number.isNull(), own).otherwise(uris.season_scoped(own, season_number))
    backdrop = F.nullif(F.regexp_extract(p, SHOW_BACKDROP, 0), F.lit(""))
    return R.media("tmdb", scoped, url=F.concat(F.lit(SHOW_SITE), own), score=F.lit(SHOW_SCORE), categories=F.array(F.lit("SERIES")), titles=R.titles(SHOW_SCORE, ("en", text.clean_text(meta["title"]))),
                   **R.described(text.clean_text(meta["overview"]), SHOW_SCORE), covers=R.images(meta["poster"], SHOW_SCORE), banners=R.images(F.concat(F.lit(MEDIA_HOST), backdrop), SHOW_SCORE),
                   average_score=F.round(_first(p, SHOW_PERCENT).try_cast("double")) / 10)


def season_episodes(pages: DataFrame, show: str, season_number: str, page: str, media_uri: Column) -> DataFrame:
    """Episodes of a season's page, one for each card that has a number."""
    each = pages.select("*", F.explode(F.split(F.col(page), EPISODE_CARD, -1)).alias("_card")).withColumn("_number", _first(F.col("_card"), EPISODE_NUMBER).try_cast("long")).where("_number is not null")
    card = F.col("_card")
    ident = F.concat(uris.season_scoped(F.col(show), F.col(season_number)), F.lit("e"), F.col("_number").cast("string"))
    title = text.clean_text(F.coalesce(*(_first(card, t) for t in EPISODE_TITLES)))
    return each.select(*R.episode("tmdb", ident, media_uri, score=F.lit(SHOW_SCORE), titles=R.titles(SHOW_SCORE, ("en", title)), **R.described(text.clean_text(_first(card, EPISODE_TEXT)), SHOW_SCORE),
                                  thumbnails=R.images(_first(card, EPISODE_STILL), SHOW_SCORE), season_number=F.col(season_number).cast("long"), episode_number=F.col("_number")))


def found_shows(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, pos, id, title, poster, start_date) of a search page's results, each show once, where it comes first."""
    each = pages.select(key, F.posexplode(F.split(F.col(page), FOUND_CARD, -1)).alias("pos", "_card")).withColumn("id", _first(F.col("_card"), FOUND_ID)).where("id is not null")
    first = F.row_number().over(Window.partitionBy(key, "id").orderBy("pos"))
    card = F.col("_card")
    return each.withColumn("_r", first).where("_r = 1").select(key, "pos", "id", text.clean_text(_first(card, FOUND_TITLE)).alias("title"), _first(card, FOUND_POSTER).alias("poster"), season.year_text(_first(card, FOUND_YEAR)).alias("start_date"))


def grid_media(entries: DataFrame) -> list[Column]:
    """Columns of a media record from the entries of a seasonal grid."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in GRID_TYPES.items() for x in kv)), F.col("type_id"))
    return R.media("mal", F.col("id"), score=F.lit(0.9), url=F.concat(F.lit("https://myanimelist.net/anime/"), "id"), type=kind, categories=F.array(F.lit("ANIME"), F.when(kind == "MOVIE", F.lit("MOVIE")).otherwise(F.lit("SERIES"))),
                   titles=R.titles(0.9, ("en", F.col("english_title")), ("jp-en", F.col("title"))), **R.described(F.col("synopsis"), 0.9), covers=R.images(F.col("cover"), 0.9),
                   average_score=F.col("score"), popularity=F.col("members"), episode_count=F.col("episodes"), start_date=F.col("start_date"))


def search_results(page: Column, kind: str) -> Column:
    """Ids of a search page's result links of a kind (``tv`` or ``movie``), in order and once each."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(rf'href="/{kind}/([0-9]+)'), F.lit(1)))


def season_numbers(page: Column) -> Column:
    """Numbers of the seasons that a show's page links, ascending."""
    found = F.regexp_extract_all(page, F.lit(r"/season/([0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))
