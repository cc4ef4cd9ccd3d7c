"""Queries on edges, components, aliases and folded observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.operators import fold, identity
from mediafuse.operators.components import connected_components
from mediafuse.operators.scratch import Scratch
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register
from mediafuse.plans.members import MEMBERS_SQL, closure, members


@register("upsert_fold_scalar", f"SELECT user_id, arg_max(scalar, event_id) AS scalar, arg_max(event_type, event_id) AS event_type FROM {B.text(B.UPSERTS)} AS u GROUP BY user_id")
def upsert_fold_scalar(spark, d):
    return fold.upsert_fold(B.relation(spark, d, B.UPSERTS), "user_id", "event_id", ["scalar", "event_type"])


@register("upsert_fold_array", f"""SELECT user_id, event_id % 7 AS length, event_id FROM (
  SELECT user_id, arg_max(event_id, (size, event_id)) AS event_id FROM {B.text(B.UPSERTS)} AS u GROUP BY user_id) AS f""")
def upsert_fold_array(spark, d):
    rows = B.relation(spark, d, B.UPSERTS).withColumn("items", F.array_repeat("event_id", F.col("size").cast("int")))
    out = fold.upsert_fold(rows, "user_id", "event_id", [], ["items"])
    return out.select("user_id", F.size("items").cast("long").alias("length"), F.col("items")[0].alias("event_id"))


@register("label_conditional_merge", f"""SELECT user_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN arg_max(scalar, event_id) ELSE last(scalar ORDER BY event_id) END AS scalar
  FROM (SELECT *  REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL ELSE scalar END AS scalar) FROM {B.text(B.UPSERTS)} AS u) AS v GROUP BY user_id, event_type""")
def label_conditional_merge(spark, d):
    rows = B.relation(spark, d, B.UPSERTS).withColumn("scalar", F.when(F.col("event_id") % 3 != 0, F.col("scalar")))
    return fold.fold_by_label(rows, "user_id", "event_type", "event_id", ["scalar"], {"click": "fold", "view": "fold"})


_SHOW = f"SELECT src_uri, CASE WHEN length(dst_uri) % 2 = 0 THEN replace(dst_uri, 'part:', 'imdb:') ELSE dst_uri END AS dst_uri FROM {B.text(B.EDGES)} AS x"


@register("show_level_edge_filter", f"SELECT src_uri, dst_uri FROM ({_SHOW}) AS y WHERE dst_uri NOT LIKE 'imdb:%'")
def show_level_edge_filter(spark, d):
    edges = B.relation(spark, d, B.EDGES)
    return identity.linking(edges.withColumn("dst_uri", F.when(F.length("dst_uri") % 2 == 0, F.replace("dst_uri", F.lit("part:"), F.lit("imdb:"))).otherwise(F.col("dst_uri"))))


@register("handle_edge_extraction", f"""SELECT DISTINCT concat('supp:', CAST(l_suppkey AS VARCHAR)) AS src_uri, concat('part:', CAST(l_partkey AS VARCHAR)) AS dst_uri FROM lineitem""")
def handle_edge_extraction(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_suppkey").agg(
        F.collect_list(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("handles"))
    return identity.handle_edges(rows.withColumn("uri", F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string"))))


@register("bare_handle_nodes", """SELECT DISTINCT concat('part:', CAST(l_partkey AS VARCHAR)) AS uri, 'part' AS origin, CAST(l_partkey AS VARCHAR) AS id FROM lineitem""")
def bare_handle_nodes(spark, d):
    return identity.bare_handles(handle_edge_extraction(spark, d))


@register("components_edges", f"WITH RECURSIVE {closure(B.text(B.EDGES))} SELECT uri, component FROM comp")
def components_edges(spark, d):
    out = connected_components(B.relation(spark, d, B.EDGES), Scratch(spark, "components"), "src_uri", "dst_uri")
    return out.withColumnRenamed("node", "uri")


@register("components_bipartite", f"WITH RECURSIVE {closure(B.text(B.BIPARTITE))} SELECT uri, component FROM comp")
def components_bipartite(spark, d):
    out = connected_components(B.relation(spark, d, B.BIPARTITE), Scratch(spark, "components"), "src_uri", "dst_uri")
    return out.withColumnRenamed("node", "uri")


@register("cluster_members", MEMBERS_SQL + "SELECT component, uri, n AS members FROM members")
def cluster_members(spark, d):
    m = members(spark, d).select("component", "uri")
    return m.join(m.groupBy("component").agg(F.count("*").alias("members")), "component")


@register("cluster_seeds", MEMBERS_SQL + "SELECT m.component, m.uri FROM members m WHERE m.component IN (SELECT component FROM members WHERE k % 97 = 0)")
def cluster_seeds(spark, d):
    m = Scratch(spark, "seeds").write(members(spark, d).select("component", "uri", "k"))
    return identity.seeded(m, m.where("k % 97 = 0").select("uri")).select("component", "uri")


@register("cluster_no_seeds", MEMBERS_SQL + "SELECT component, uri FROM members")
def cluster_no_seeds(spark, d):
    """An empty set of seeds asks for everything."""
    m = Scratch(spark, "seeds").write(members(spark, d).select("component", "uri"))
    return identity.seeded(m, m.where("false").select("uri")).select("component", "uri")


_ALIAS = "SELECT concat('alias-', CAST(p_partkey AS {s})) AS alias, concat('part:', CAST((p_partkey * 7) % (SELECT count(*) FROM {{part}}) AS {s})) AS uri FROM {{part}} WHERE p_partkey % 3 = 0"
_NAMES = "SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN 'alias-' ELSE 'part:' END, CAST(p_partkey AS STRING)) AS name FROM {part}"


@register("alias_resolve", f"SELECT name, coalesce(a.uri, name) AS uri FROM {B.text(_NAMES)} AS n LEFT JOIN {B.text(_ALIAS.format(s='STRING'))} AS a ON n.name = a.alias")
def alias_resolve(spark, d):
    return identity.resolve_alias(B.relation(spark, d, _NAMES), B.relation(spark, d, _ALIAS.format(s="STRING")))


@register("graph_known", f"SELECT name, name LIKE 'part:%' OR name IN (SELECT alias FROM {B.text(_ALIAS.format(s='STRING'))} AS a) AS known FROM {B.text(_NAMES)} AS n")
def graph_known(spark, d):
    """Whether a record or an alias goes by a name."""
    return identity.known(B.relation(spark, d, _NAMES), B.relation(spark, d, B.MEDIA).select("uri"), B.relation(spark, d, _ALIAS.format(s="STRING")))


@register("graph_lookup", f"SELECT name, m.uri, m.title FROM {B.text(_NAMES)} AS n LEFT JOIN {B.text(_ALIAS.format(s='STRING'))} AS a ON n.name = a.alias JOIN {B.text(B.MEDIA)} AS m ON m.uri = coalesce(a.uri, n.name)")
def graph_lookup(spark, d):
    """The record of a name, through an alias where no record goes by it."""
    return identity.looked_up(B.relation(spark, d, _NAMES), B.relation(spark, d, B.MEDIA).select("uri", "title"), B.relation(spark, d, _ALIAS.format(s="STRING")))


@register("graph_targets", """SELECT DISTINCT concat('cust:', CAST(o_custkey AS VARCHAR)) AS src_uri, concat('order:', CAST(o_orderkey AS VARCHAR)) AS dst_uri FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def graph_targets(spark, d):
    """Customers of a positive balance lead to their orders, one step along edges of one label."""
    edges = B.relation(spark, d, B.BIPARTITE).select(F.col("dst_uri").alias("src_uri"), F.col("src_uri").alias("dst_uri"), F.lit("has_order").alias("kind"))
    sources = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("uri"))
    return identity.targets(edges.unionByName(edges.withColumn("kind", F.lit("other"))), sources, "has_order")


@register("live_handle_fallback", MEMBERS_SQL + """, req AS (SELECT k, concat('ag:(a:', CAST(k AS VARCHAR), ',part:', CAST(k * 3 AS VARCHAR), ',part:', CAST(k AS VARCHAR), ')') AS aggregated_uri FROM members),
h AS (SELECT aggregated_uri, concat('part:', CAST(k * 3 AS VARCHAR)) AS uri, CAST(k * 3 AS VARCHAR) AS i FROM req UNION SELECT aggregated_uri, concat('part:', CAST(k AS VARCHAR)), CAST(k AS VARCHAR) FROM req)
SELECT r.aggregated_uri, (SELECT arg_min(m.component, h.i) FROM h JOIN members m ON m.uri = h.uri WHERE h.aggregated_uri = r.aggregated_uri) AS component FROM req r""")
def live_handle_fallback(spark, d):
    m = Scratch(spark, "fallback").write(members(spark, d).select("component", "uri", "k"))
    k = F.col("k")
    s = lambda c: c.cast("string")
    requests = m.select(F.concat(F.lit("ag:(a:"), s(k), F.lit(",part:"), s(k * 3), F.lit(",part:"), s(k), F.lit(")")).alias("aggregated_uri"))
    return identity.first_live_handle(requests, m)


@register("origin_page_positional", """SELECT r_regionkey, pos, n_nationkey, n_name FROM (
  SELECT r_regionkey, unnest([r_regionkey, 24 - r_regionkey, 99, r_regionkey]) AS n_nationkey, unnest(range(4))::INTEGER AS pos FROM region) AS q JOIN nation USING (n_nationkey)""")
def origin_page_positional(spark, d):
    key = F.col("r_regionkey")
    requests = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", F.array(key, 24 - key, F.lit(99), key).alias("ids"))
    return identity.positional_lookup(requests, spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), "ids", "n_nationkey")


@register("origin_filters", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2) ORDER BY n_name")
def origin_filters(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").withColumn("is_api_only", F.col("n_regionkey").isin(1, 2))
    return identity.filtered_origins(rows, ["IS_API_ONLY"]).orderBy("n_name").select("n_nationkey", "n_name")


@register("plugin_origin_enforced", f"SELECT uri, origin FROM {B.text(B.MEDIA)} AS m WHERE origin = concat('brand', CAST(k % 25 + 1 AS VARCHAR))")
def plugin_origin_enforced(spark, d):
    rows = B.relation(spark, d, B.MEDIA)
    return identity.only_origin(rows, F.concat(F.lit("brand"), (F.col("k") % 25 + 1).cast("string"))).select("uri", "origin")
