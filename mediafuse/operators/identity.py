"""Identity: edges from handles, clusters of records, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.functions import uris
from mediafuse.operators.components import connected_components, with_component
from mediafuse.operators.scratch import Scratch
from mediafuse.operators.spread import spread

#: Origins that identify a show and not a season: a handle of theirs links nothing. Fixed value.
SHOW_LEVEL = ("imdb",)


def handle_edges(records: DataFrame, uri: str = "uri", handles: str = "handles") -> DataFrame:
    """(src_uri, dst_uri), once each, from the array of handle uris of each record."""
    return records.select(F.col(uri).alias("src_uri"), F.explode(handles).alias("dst_uri")).distinct()


def bare_handles(edges: DataFrame) -> DataFrame:
    """The handles as records of their own: uri, origin and id only."""
    return edges.select(F.col("dst_uri").alias("uri")).distinct().select("uri", uris.origin_of(F.col("uri")).alias("origin"), uris.id_of(F.col("uri")).alias("id"))


def linking(edges: DataFrame, excluded: tuple[str, ...] = SHOW_LEVEL) -> DataFrame:
    """Edges whose target may link; the source's origin is not looked at."""
    return edges.where(~F.split("dst_uri", ":", -1)[0].isin(*excluded))


def clusters(records: DataFrame, edges: DataFrame, scratch: Scratch, uri: str = "uri") -> DataFrame:
    """records with ``component``, the smallest uri linked to them. Ids without a record link too but give no row."""
    return with_component(records, connected_components(linking(edges), scratch, "src_uri", "dst_uri"), uri)


def resolve_alias(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """names with ``uri``: the alias' target, or the name itself."""
    return names.join(aliases, F.col(column) == F.col("alias"), "left").withColumn("uri", F.coalesce("uri", column)).drop("alias")


def known(names: DataFrame, records: DataFrame, aliases: DataFrame, column: str = "name", uri: str = "uri") -> DataFrame:
    """names with ``known``: whether a record or an alias goes by the name, whatever the alias points at."""
    taken = records.select(F.col(uri).alias("_n")).unionByName(aliases.select(F.col("alias").alias("_n"))).distinct().withColumn("known", F.lit(True))
    return names.join(taken, F.col(column) == F.col("_n"), "left").drop("_n").withColumn("known", F.coalesce("known", F.lit(False)))


def looked_up(names: DataFrame, records: DataFrame, aliases: DataFrame, column: str = "name", uri: str = "uri") -> DataFrame:
    """The records that go by the names: a record of that uri, else the one that an alias of that name points at."""
    own = records.select(F.col(uri).alias("_n"), F.struct(*records.columns).alias("_r"))
    to = aliases.select(F.col("alias").alias("_n"), F.col("uri").alias("_to")).join(own.select(F.col("_n").alias("_to"), F.col("_r").alias("_a")), "_to").drop("_to")
    found = names.join(own, F.col(column) == F.col("_n"), "left").drop("_n").join(to, F.col(column) == F.col("_n"), "left").drop("_n")
    return found.withColumn("_r", F.coalesce("_r", "_a")).where("_r is not null").select(*names.columns, *(F.col(f"_r.{c}").alias(c) for c in records.columns if c not in names.columns))


def targets(edges: DataFrame, sources: DataFrame, label: str, column: str = "uri") -> DataFrame:
    """(src_uri, dst_uri) of the directed edges of a label that lead from the sources, one step far, once each."""
    return edges.where(F.col("kind") == label).join(sources.select(F.col(column).alias("src_uri")).distinct(), "src_uri", "left_semi").select("src_uri", "dst_uri").distinct()


def first_live_handle(requests: DataFrame, members: DataFrame, aggregated: str = "aggregated_uri") -> DataFrame:
    """requests with ``component``: the cluster of the first handle, in uri order, that has a record."""
    asked = spread(requests.select(aggregated), aggregated)
    each = asked.select(aggregated, F.posexplode_outer(uris.handles_of(F.col(aggregated))).alias("_pos", "_handle"))
    hit = each.join(members.select(F.col("uri").alias("_handle"), "component"), "_handle")
    first = hit.groupBy(aggregated).agg(F.min_by("component", "_pos").alias("component"))
    return requests.join(first, aggregated, "left")


def positional_lookup(requests: DataFrame, table: DataFrame, ids: str, key: str) -> DataFrame:
    """Rows of table by an array of ids: request order, misses left out, repeated ids repeated."""
    return requests.select("*", F.posexplode(ids).alias("pos", key)).drop(ids).join(table, key)


def only_origin(records: DataFrame, declared: Column | str, origin: str = "origin") -> DataFrame:
    """Rows of the origin that their source declared."""
    return records.where(F.col(origin) == (F.col(declared) if isinstance(declared, str) else declared))


def nested_handles(records: DataFrame, uri: str = "uri", handles: str = "handles") -> DataFrame:
    """(src_uri, dst_uri), once each: every handle of a record, those of its handles too, as deep as the schema nests them."""
    from pyspark.sql.types import ArrayType, StructType

    level = records.select(F.col(uri).alias("src_uri"), F.explode(handles).alias("h"))
    found = level.select("src_uri", F.col("h.uri").alias("dst_uri"))
    while isinstance(inner := level.schema["h"].dataType, StructType) and "handles" in inner.names and isinstance(inner["handles"].dataType, ArrayType):
        level = level.select("src_uri", F.explode("h.handles").alias("h"))
        found = found.unionByName(level.select("src_uri", F.col("h.uri").alias("dst_uri")))
    return found.where("dst_uri is not null and dst_uri <> src_uri").distinct()


def with_missing_handles(handles: Column, aggregated: Column, origin: Column) -> Column:
    """A record's handles (array of uris) and those of an aggregated uri whose origins the record lacks, its own included."""
    have = F.concat(F.transform(handles, uris.origin_of), F.array(origin))
    return F.concat(handles, F.filter(uris.handles_of(aggregated), lambda u: ~F.array_contains(have, uris.origin_of(u))))


def episodes_of_clusters(members: DataFrame, episodes: DataFrame, episode_edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, uri), once each: the episodes of a cluster's media, and all that episode links join to them."""
    linked = connected_components(linking(episode_edges), scratch, "src_uri", "dst_uri")
    grouped = with_component(episodes.select("uri", "media_uri"), linked, "uri").withColumnRenamed("component", "episode_component")
    grouped = scratch.write(grouped, "episodes")
    owners = grouped.join(members.select(F.col("uri").alias("media_uri"), "component"), "media_uri").select("component", "episode_component").distinct()
    return owners.join(grouped.select("episode_component", "uri").distinct(), "episode_component").select("component", "uri")


def seeded(members: DataFrame, seeds: DataFrame, uri: str = "uri") -> DataFrame:
    """members of the clusters that hold a seed; without any seed, all of them."""
    s = seeds.select(F.col(uri).alias("_seed")).distinct()
    touched = members.join(s, F.col("uri") == F.col("_seed"), "left_semi").select(F.col("component").alias("_c")).distinct().withColumn("_hit", F.lit(True))
    none = s.agg((F.count("*") == 0).alias("_none"))  # one row
    return members.join(touched, F.col("component") == F.col("_c"), "left").crossJoin(F.broadcast(none)).where("_none or _hit").drop("_c", "_hit", "_none")


def filtered_origins(origins: DataFrame, filters: list[str], api_only: str = "is_api_only") -> DataFrame:
    """Origins that pass all filters of a request, by name."""
    tests = {"IS_API_ONLY": F.col(api_only), "IS_NOT_API_ONLY": ~F.col(api_only)}
    for f in filters:
        origins = origins.where(tests[f])
    return origins


def first_that_answers(answers: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first of the tables that has any."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, (a.withColumn("_place", F.lit(i)) for i, a in enumerate(answers)))
    least = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_least"))
    return rows.join(least, (F.col(key) == F.col("_key")) & (F.col("_place") == F.col("_least"))).drop("_key", "_least", "_place")


def fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary, or secondary if primary has no rows at all."""
    none = primary.limit(1).agg((F.count("*") == 0).alias("_none"))
    return primary.unionByName(secondary.crossJoin(F.broadcast(none)).where("_none").drop("_none"))
