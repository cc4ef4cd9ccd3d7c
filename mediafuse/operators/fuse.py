"""Golden records: the members of a cluster fused by source confidence.

Members are ranked by (score descending, null as 0, then uri). Scalars are the first value in that order
that is not null; they combine map-side. Lists are built from exploded rows, so no cluster is held as a
whole outside its own result. Clusters of one pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.functions import uris
from mediafuse.operators.scratch import Scratch

MEDIA_SCALARS = ["type", "status", "external_links", "average_score", "popularity", "start_date", "end_date", "is_adult", "episode_count"]
EPISODE_SCALARS = ["embed_url", "release_date", "season_number", "episode_number", "absolute_episode_number", "runtime"]


def member_rank() -> Column:
    return F.struct((-F.coalesce(F.col("score"), F.lit(0.0))).alias("s"), F.col("uri").alias("u"))


def first_by_score(c: str) -> Column:
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), member_rank()))


def fuse_scalars(members: DataFrame, scalars: list[str], group: str | list[str] = "component") -> DataFrame:
    """One row per group: identity, score and scalars. Only columns that members have are fused."""
    groups = [group] if isinstance(group, str) else list(group)
    have = [c for c in scalars if c in members.columns]
    single = F.count("*") == 1
    fused = members.groupBy(*groups).agg(
        F.count("*").alias("members"), F.min("uri").alias("first_uri"),
        F.when(single, F.min("origin")).otherwise(F.lit("ag")).alias("origin"),
        F.when(single, F.min("uri")).otherwise(F.concat(F.lit("ag:"), uris.cluster_identity(F.collect_set("uri")))).alias("uri"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("score"), *(first_by_score(c).alias(c) for c in have))
    return fused.withColumn("cluster_id", F.sha2("first_uri", 256)).drop("first_uri")


def _exploded(members: DataFrame, column: str, group: list[str]) -> DataFrame:
    """One row per entry; ``_single`` where the group has one member (``members`` counts them, if it is there)."""
    if "members" not in members.columns:
        members = members.join(members.groupBy(*group).agg(F.count("*").alias("members")), group)
    return members.select(
        *group, (F.col("members") == 1).alias("_single"), (-F.coalesce(F.col("score"), F.lit(0.0))).alias("_s"), F.col("uri").alias("_u"), F.posexplode(column).alias("_p", "_e"))


def fuse_list(members: DataFrame, column: str, group: str | list[str] = "component", unique: str | None = None, by_score: bool = True) -> DataFrame:
    """(group, column): all entries of the members' lists.

    by_score orders entries by their own score, null last, then by member rank and place; else by member
    rank and place. unique keeps the first entry of each value of that field. Both leave single members alone.
    """
    groups = [group] if isinstance(group, str) else list(group)
    rows = _exploded(members, column, groups)
    order = F.struct(*([F.when(F.col("_single"), 0.0).otherwise(-F.coalesce(F.col("_e.score"), F.lit(-1.0))).alias("a")] if by_score else []), F.col("_s"), F.col("_u"), F.col("_p"))
    rows = rows.withColumn("_o", order)
    if unique:
        place = F.when(F.col("_single"), F.col("_p")).alias("_place")
        rows = rows.groupBy(*groups, place, F.col(f"_e.{unique}").alias("_same")).agg(F.min_by(F.struct("_o", "_e"), "_o").alias("_r")).select(
            *groups, F.col("_r._o").alias("_o"), F.col("_r._e").alias("_e"))
    return rows.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_e"))), lambda r: r["_e"]).alias(column))


def reconcile_categories(members: DataFrame, group: str = "component") -> DataFrame:
    """ANIME if any member has it, then MOVIE or SERIES, whichever comes first; single members unchanged."""
    rows = _exploded(members, "categories", [group])
    place = F.struct("_s", "_u", "_p")
    fmt = F.col("_e").isin("MOVIE", "SERIES")
    fused = rows.groupBy(group).agg(
        F.first("_single").alias("_single"), F.max(F.col("_e") == "ANIME").alias("_anime"), F.min_by(F.when(fmt, F.col("_e")), F.when(fmt, place)).alias("_format"),
        F.array_sort(F.collect_list(F.when(F.col("_single"), F.struct("_p", "_e")))).alias("_all"))
    return fused.select(group, F.when(F.col("_single"), F.transform("_all", lambda r: r["_e"])).otherwise(
        F.array_compact(F.array(F.when(F.col("_anime"), F.lit("ANIME")), F.col("_format")))).alias("categories"))


LISTS = {"titles": ("title", True), "descriptions": (None, True), "short_descriptions": (None, True), "covers": (None, True), "banners": (None, True), "thumbnails": (None, True), "trailers": ("uri", False)}


def _with_lists(scalars: DataFrame, members: DataFrame, group: list[str], extra: list[DataFrame] = ()) -> DataFrame:
    out = scalars
    for part in [*extra, *(fuse_list(members, c, group, unique, by_score) for c, (unique, by_score) in LISTS.items() if c in members.columns)]:
        out = out.join(part, group, "left")
    return out


def fuse_media(members: DataFrame, scratch: Scratch | None = None, fields: list[str] | None = None) -> DataFrame:
    """Golden media per component: scalars, categories and all list columns that members have.

    fields: what a request selects; a list or scalar that it leaves out is neither read, exploded nor joined.
    With scratch the members are written once, by component, and every part reads that table.
    """
    if fields is not None:
        fusible = {*MEDIA_SCALARS, *LISTS, "categories"}
        members = members.select(*(c for c in members.columns if c in fields or c not in fusible))
    sized = members.join(members.groupBy("component").agg(F.count("*").alias("members")), "component")
    sized = scratch.write(sized, "sized") if scratch else sized
    extra = [reconcile_categories(sized)] if "categories" in members.columns else []
    return _with_lists(fuse_scalars(sized.drop("members"), MEDIA_SCALARS), sized, ["component"], extra)


def group_episodes(episodes: DataFrame, season_aware: bool = False) -> DataFrame:
    """Fused episodes per component and episode_number, lists too where episodes have them; rows without a number are left out.

    Seasons are not told apart unless season_aware. media_uri is the fused episode's own uri (as sources of
    this kind expect); media_component is the cluster it belongs to.
    """
    numbered = episodes.where(F.col("episode_number").isNotNull())
    group = ["component", "episode_number"] + (["season_number"] if season_aware else [])
    out = _with_lists(fuse_scalars(numbered, [c for c in EPISODE_SCALARS if c not in group], group), numbered, group)
    return out.withColumns({"media_uri": F.col("uri"), "media_component": F.col("component")})


def detail(members: DataFrame, episodes: DataFrame, fields: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Golden media with the fields that a request selects; ``episodes`` (number and uri, in order) are fused only if it selects them."""
    media = fuse_media(members, scratch, fields)
    if "episodes" not in fields:
        return media
    rows = group_episodes(episodes.select("component", "uri", "origin", "score", "episode_number"))
    listed = rows.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("episode_number", "uri"))).alias("episodes"))
    return media.join(listed, "component", "left").withColumn("episodes", F.coalesce("episodes", F.array().cast(listed.schema["episodes"].dataType)))


def movie_episodes(media: DataFrame) -> DataFrame:
    """A movie as a series of one episode: id ``<id>-1``, number 1."""
    return media.where(F.array_contains("categories", "MOVIE")).select(
        F.concat("uri", F.lit("-1")).alias("uri"), "origin", F.concat("id", F.lit("-1")).alias("id"), F.col("uri").alias("media_uri"), "score",
        *(c for c in ("titles", "descriptions", "short_descriptions") if c in media.columns),
        *([F.transform("covers", lambda c: F.struct(c.url.alias("url"), c.score.alias("score"))).alias("thumbnails")] if "covers" in media.columns else []),
        F.lit(1).cast("long").alias("episode_number"))


def keep_last_per_number(episodes: DataFrame, media: str, number: str, position: str) -> DataFrame:
    """The last row of each number within a media; rows without a number all stay."""
    last = F.row_number().over(Window.partitionBy(media, number).orderBy(F.desc(position)))
    return episodes.withColumn("_last", last).where(F.col(number).isNull() | (F.col("_last") == 1)).drop("_last")


def season_counts(episodes: DataFrame, media: str, season: str) -> DataFrame:
    """(media, season, episodes): how many episodes a media's seasons have; episodes of no season are left out."""
    return episodes.where(F.col(season).isNotNull()).groupBy(media, season).agg(F.count("*").alias("episodes"))


def numbered_by_position(episodes: DataFrame, media: list[str], order: str) -> DataFrame:
    """Episodes with ``position``, their place within the media from 1."""
    return episodes.withColumn("position", F.row_number().over(Window.partitionBy(*media).orderBy(order)).cast("long"))


def episode_order(rows: DataFrame) -> DataFrame:
    """Episodes by number, then uri."""
    return rows.orderBy(F.asc_nulls_last("episode_number"), "uri")
