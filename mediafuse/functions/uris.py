"""Uri algebra as Column functions.

A uri is ``origin:id``; several joined by commas form a list; ``ag:(list)`` names a cluster and may carry
``-episode`` behind it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATED = r"^ag:\((.*)\)(?:-(.*))?$"


def to_uri(origin: Column, ident: Column) -> Column:
    return F.concat(origin, F.lit(":"), ident.cast("string"))


def origin_of(uri: Column) -> Column:
    return F.split(uri, ":", -1)[0]


def id_of(uri: Column) -> Column:
    """The second part only: an id that holds a colon is cut there."""
    return F.get(F.split(uri, ":", -1), 1)


def is_uri(uri: Column) -> Column:
    """Exactly two non-empty parts; null where the id holds a comma, which no uri may."""
    parts = F.filter(F.split(uri, ":", -1), lambda p: p != "")
    return F.when(F.contains(F.coalesce(F.get(parts, 1), F.lit("")), F.lit(",")), F.lit(None)).otherwise(F.size(parts) == 2)


def is_routable(uri: Column) -> Column:
    return uri.rlike(r"^[^:]+:[^,/()]*$")


def split_uris(uris: Column) -> Column:
    return F.filter(F.split(uris, ",", -1), lambda u: u != "")


def ordered(uris: Column) -> Column:
    """The array's well-formed uris by origin and then id."""
    pairs = F.transform(uris, lambda u: F.struct(origin_of(u).alias("origin"), id_of(u).alias("id")))
    whole = F.filter(pairs, lambda p: (p.origin != "") & p.id.isNotNull() & (p.id != ""))
    return F.transform(F.array_sort(whole), lambda p: to_uri(p.origin, p.id))


def to_aggregated_uri(uris: Column, episode: Column | None = None) -> Column:
    out = F.concat(F.lit("ag:("), F.array_join(ordered(uris), ","), F.lit(")"))
    return out if episode is None else F.when(F.coalesce(episode, F.lit("")) == "", out).otherwise(F.concat(out, F.lit("-"), episode))


def is_aggregated(uri: Column) -> Column:
    inner = F.regexp_extract(uri, AGGREGATED, 1)
    return uri.rlike(AGGREGATED) & ((inner == "") | F.forall(F.split(inner, ",", -1), lambda u: F.coalesce(is_uri(u), F.lit(False))))


def handles_of(uri: Column) -> Column:
    """The handles of an aggregated uri in order, or the uri itself."""
    return F.when(uri.rlike(AGGREGATED), ordered(split_uris(F.regexp_extract(uri, AGGREGATED, 1)))).otherwise(F.array(uri))


def episode_of(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, AGGREGATED, 2), F.lit(""))


def handle_from(uri: Column, origin: str) -> Column:
    """The first handle of an origin, null if there is none."""
    return F.get(F.filter(handles_of(uri), lambda u: origin_of(u) == origin), 0)


def overlap(a: Column, b: Column) -> Column:
    """Whether two aggregated uris share a handle."""
    return F.arrays_overlap(handles_of(a), handles_of(b))


def merge_aggregated(uris: Column) -> Column:
    """One handle per origin over an array of aggregated uris, the numerically smallest id of each."""
    pairs = F.transform(F.flatten(F.transform(uris, handles_of)), lambda u: F.struct(
        origin_of(u).alias("origin"), F.expr("cast(null as long)").alias("n"), id_of(u).alias("id")))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.struct(p.origin.alias("origin"), p.id.try_cast("long").alias("n"), p.id.alias("id"))))
    firsts = F.filter(pairs, lambda p, i: (i == 0) | (p.origin != F.get(pairs, F.greatest(i - 1, F.lit(0))).origin))
    return to_aggregated_uri(F.transform(firsts, lambda p: to_uri(p.origin, p.id)))


def cluster_identity(uris: Column) -> Column:
    """The sorted routable uris in parentheses, or all of them if none is routable."""
    routable = F.filter(uris, is_routable)
    return F.concat(F.lit("("), F.array_join(F.array_sort(F.when(F.size(routable) > 0, routable).otherwise(uris)), ","), F.lit(")"))


def with_episode(uri: Column, episode: Column) -> Column:
    return F.concat(uri, F.lit("-"), episode.cast("string"))


def without_episode(uri: Column) -> Column:
    """(uri, episode_id) split at the last dash; without a dash the uri is empty."""
    has = F.contains(uri, F.lit("-"))
    return F.struct(F.when(has, F.regexp_extract(uri, r"^(.*)-[^-]*$", 1)).otherwise("").alias("uri"),
                    F.when(has, F.regexp_extract(uri, r"-([^-]*)$", 1)).otherwise(uri).alias("episode_id"))


def season_scoped(show: Column, season: Column) -> Column:
    return F.concat(show.cast("string"), F.lit("-s"), season.cast("string"))


def split_season_scoped(ident: Column) -> Column:
    """(show_id, season); season is null for an id that is not scoped."""
    scoped = r"^(.+)-s([0-9]{1,3})$"
    yes = ident.rlike(scoped)
    return F.struct(F.when(yes, F.regexp_extract(ident, scoped, 1)).otherwise(ident).alias("show_id"),
                    F.when(yes, F.regexp_extract(ident, scoped, 2).cast("int")).alias("season"))


def season_part(raw: Column, season: Column, provider: Column) -> Column:
    """A provider's content id for one season, ``raw-season``; none for the provider (cr) that scopes ids its own way."""
    return F.when(season.isNull(), raw).when(provider != "cr", F.concat(raw, F.lit("-"), season.cast("string")))


def catalogue_node(ident: Column) -> Column:
    """(object_id, season_object_id) of ``123-456``; the second is null for a node that is not scoped."""
    form = "^([0-9]+)-([0-9]+)$"
    yes = ident.rlike(form)
    return F.struct(F.when(yes, F.regexp_extract(ident, form, 1)).otherwise(ident).alias("object_id"),
                    F.when(yes, F.regexp_extract(ident, form, 2).cast("long")).alias("season_object_id"))


def to_aggregated_id(uris: Column) -> Column:
    """The list of an aggregated uri, encoded so that it can stand in an address."""
    return F.replace(F.url_encode(F.concat(F.lit("("), F.array_join(ordered(uris), ","), F.lit(")"))), F.lit("+"), F.lit("%20"))
