"""Queries on live requests: keyed state, bursts, sources that join late, page walks, labels, plug-ins, selections and many searches at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediafuse.operators import fuse, labels, search
from mediafuse.operators.scratch import Scratch
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register
from mediafuse.plans.fusion_queries import FIRST_SQL, TITLES_SQL
from mediafuse.plans.members import MEMBERS_SQL, members
from mediafuse.plans.stream_queries import ARRIVALS, arriving
from mediafuse.plans.text_queries import alignment_sql
from mediafuse.sources import builds, paging, plugin_source
from mediafuse.streaming import keyed_state
from mediafuse.streaming.fanout import Fanout
from mediafuse.streaming.upserts import observations


def _emitted(rows, arrival, root, make):
    """All that a stream over rows emits as they arrive, from its checkpoint on; ``make`` gives the stream's result."""
    out = f"{root}/emitted"
    keep = lambda batch, i: batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}")
    start = lambda s: make(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    arriving(rows, arrival, f"{root}/arrived", start)
    return rows.sparkSession.read.parquet(out).drop("batch")


@register("stream_keyed_fold", f"""SELECT user_id, arg_max(scalar, event_id) AS scalar, arg_max(event_type, event_id) AS event_type, CAST(max(size) AS BIGINT) AS longest FROM {B.text(B.UPSERTS)} AS u GROUP BY user_id""")
def stream_keyed_fold(spark, d):
    """The fold of records in Spark's own state by key; the last row of a key counts."""
    rows = B.relation(spark, d, B.UPSERTS).select("user_id", "event_id", "event_type", "scalar", F.array_repeat("event_id", F.col("size").cast("int")).alias("items"))
    out = _emitted(rows, F.col("event_id") % ARRIVALS, Scratch(spark, "keyed").root, lambda s: keyed_state.folded_stream(s, "user_id", "event_id"))
    last = out.groupBy("user_id").agg(F.max_by(F.struct("scalar", "event_type", "items"), "_batch").alias("r"))
    return last.select("user_id", "r.scalar", "r.event_type", F.size("r.items").cast("long").alias("longest"))


QUIET, LONGEST = 6 * 3600_000, 15 * 3600_000


@register("stream_bursts", f"""WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000), event_id) AS r FROM events),
walk AS (SELECT user_id, r, ms AS first, ms AS last, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS burst FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.r, CASE WHEN late THEN e.ms ELSE w.first END, e.ms, CASE WHEN late THEN 1 ELSE w.n + 1 END, w.burst + CASE WHEN late THEN 1 ELSE 0 END FROM walk w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1,
    LATERAL (SELECT e.ms >= least(w.last + {QUIET}, w.first + {LONGEST}) AS late) AS l),
bursts AS (SELECT user_id, burst, min(first) AS first, max(n) AS n, least(max(last) + {QUIET}, min(first) + {LONGEST}) AS due FROM walk GROUP BY user_id, burst)
SELECT user_id, make_timestamp(first * 1000) AS first, make_timestamp(due * 1000) AS due, n AS changes FROM bursts""")
def stream_bursts(spark, d):
    """Changes of a user, held back until six hours pass without one, fifteen at most, by the clock of the events."""
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    far = events.agg(F.max("ts").alias("m")).select(F.lit(None).cast("long").alias("user_id"), F.posexplode(F.array(F.expr("m + interval 30 days"), F.expr("m + interval 60 days"))).alias("arrival", "ts"), F.lit(None).cast("long").alias("event_id"))
    far = far.withColumn("arrival", F.col("arrival").cast("long") + ARRIVALS - 2)
    # The events arrive by quarters of their time; at the end two that belong to nobody move the clock past all bursts.
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    part = F.least(F.lit(ARRIVALS - 3), F.floor((F.unix_millis("ts") - F.unix_millis("low")) * (ARRIVALS - 2) / (F.unix_millis("high") - F.unix_millis("low"))))
    rows = events.crossJoin(F.broadcast(span)).withColumn("arrival", part).drop("low", "high")
    rows = rows.unionByName(far)
    make = lambda s: keyed_state.debounced(s.withWatermark("ts", "1 second"), "user_id", QUIET, LONGEST, "ts")
    out = _emitted(rows, F.col("arrival"), Scratch(spark, "bursts").root, make)
    return out.where("user_id is not null").select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "due")), "changes")


@register("stream_late_sources", """WITH p AS (SELECT p_partkey AS k, p_size AS s, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 4 AS o FROM part)
SELECT concat('size:', CAST(s AS VARCHAR)) AS request, concat('brand', CAST(o AS VARCHAR)) AS origin, count(*) AS answers FROM p
WHERE o IN (1, 3) OR k % 2 = 0 OR (o = 2 AND s % 5 <> 0) GROUP BY ALL""")
def stream_late_sources(spark, d):
    """Requests for sizes, and brands that join before and after them; one leaves before its second half comes, and some requests are closed by then."""
    part = spark.read.parquet(f"{d}/part.parquet")
    origin = F.concat(F.lit("brand"), (F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 4).cast("string"))
    rows = part.select(origin.alias("origin"), F.col("p_size").cast("string").alias("key"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("uri"), (F.col("p_partkey") % 2).alias("half"))
    asked = part.select("p_size").distinct().select(F.concat(F.lit("size:"), F.col("p_size").cast("string")).alias("request"), F.col("p_size").cast("string").alias("key"), F.lit(True).alias("open"), F.lit(1).cast("long").alias("seq"), "p_size")
    root = Scratch(spark, "late").root
    fan = Fanout(spark, f"{root}/store", buckets=8)

    def came(name, frame):
        """What arrives in a stream's folder is drained."""
        folder = f"{root}/in/{name}"
        frame.write.mode("append").parquet(folder)
        stream, at = observations(spark, frame.schema, [folder], "*.parquet"), f"{root}/checkpoint/{name}"
        query = fan.serve(stream, at, availableNow=True) if name == "requests" else fan.join(name, stream, at, availableNow=True)
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    own = lambda o, half=None: rows.where((F.col("origin") == o) & (F.lit(True) if half is None else F.col("half") == half)).select("key", "uri")
    for o in ("brand0", "brand2"):
        came(o, own(o, 0))
    came("requests", asked.drop("p_size"))
    for o in ("brand1", "brand3"):
        came(o, own(o))
    came("requests", asked.where("p_size % 5 = 0").select("request", "key", F.lit(False).alias("open"), F.lit(2).cast("long").alias("seq")))
    fan.leave("brand0")
    came("brand2", own("brand2", 1))
    return fan.answers().groupBy("request", "origin").agg(F.count("*").alias("answers"))


_PAGES = "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS page, count(l_orderkey) AS records FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey"


@register("pages_until_short", f"""WITH pages AS ({B.text(_PAGES)[1:-1]}) SELECT o_custkey, page, records FROM (
  SELECT *, coalesce(min(CASE WHEN records < 3 THEN page END) OVER (PARTITION BY o_custkey), page) AS stop FROM pages) AS x WHERE page <= stop""")
def pages_until_short(spark, d):
    """A customer's orders are the pages of an answer: it is read up to the first of fewer than three lines."""
    return paging.until_short(B.relation(spark, d, _PAGES), "o_custkey", "page", "records", 3).select("o_custkey", "page", "records")


@register("pages_fixed", f"SELECT o_custkey, page FROM {B.text(_PAGES)} AS p WHERE page <= 8 AND records <> 4")
def pages_fixed(spark, d):
    """Eight pages side by side; those that failed (here of four lines) are left out alone."""
    return paging.fixed_pages(B.relation(spark, d, _PAGES), failed=F.col("records") == 4).select("o_custkey", "page")


@register("pages_first_and_more", f"""SELECT o_custkey, page FROM (SELECT *, min(CASE WHEN records >= 5 THEN page END) OVER (PARTITION BY o_custkey) AS stop FROM {B.text(_PAGES)} AS p WHERE page <= 3) AS x WHERE page <= coalesce(stop, 3)""")
def pages_first_and_more(spark, d):
    """The first page and up to two more, as long as each says that another follows (here: has fewer than five lines)."""
    return paging.first_and_more(B.relation(spark, d, _PAGES), "o_custkey", "page", F.col("records") < 5).select("o_custkey", "page")


_LINKED = "SELECT o_custkey, o_orderkey AS key, CASE WHEN o_orderkey % 7 <> 0 THEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS following FROM {orders}"


@register("pages_by_next_link", f"""WITH RECURSIVE pages AS ({B.text(_LINKED)[1:-1]}), walk AS (SELECT min(key) AS start, min(key) AS key, CAST(0 AS BIGINT) AS step FROM pages GROUP BY o_custkey
  UNION ALL SELECT w.start, p.following, w.step + 1 FROM walk w JOIN pages p ON p.key = w.key WHERE p.following IS NOT NULL) SELECT start, key, step FROM walk""")
def pages_by_next_link(spark, d):
    """Each order names the customer's next one, but for some that end the walk."""
    pages = Scratch(spark, "links").write(B.relation(spark, d, _LINKED))
    starts = pages.groupBy("o_custkey").agg(F.min("key").alias("key")).select("key")
    return paging.following_links(pages, starts, Scratch(spark, "walk"))


_CHANGES = """SELECT user_id AS node, event_id AS seq, CASE WHEN event_id % 4 = 3 THEN 'label' ELSE 'set' END AS op, event_type AS added, CASE WHEN event_id % 3 = 0 THEN 'click' WHEN event_id % 5 = 0 THEN 'view' END AS removed, value FROM {events}"""


def _changes(spark, d):
    return B.relation(spark, d, _CHANGES).select("node", "seq", "op", F.array("added").alias("add"), F.when(F.col("removed").isNotNull(), F.array("removed")).alias("remove"), F.when(F.col("seq") % 6 != 0, F.col("value")).alias("value"))


@register("label_sets", f"""WITH c AS (SELECT *, min(CASE WHEN op = 'set' THEN seq END) OVER (PARTITION BY node) AS made FROM {B.text(_CHANGES)} AS x),
named AS (SELECT node, seq, added AS label, true AS on_, 0 AS o FROM c WHERE op = 'set' OR seq > made UNION ALL SELECT node, seq, removed, false, 1 FROM c WHERE op = 'set' AND removed IS NOT NULL)
SELECT node, label FROM (SELECT node, label, arg_max(on_, (seq, o)) AS on_ FROM named GROUP BY node, label) AS l WHERE on_""")
def label_sets(spark, d):
    """Labels of users after all changes: the last one that names a label decides."""
    return labels.labels_of(_changes(spark, d))


@register("label_policy_fold", f"""WITH c AS (SELECT node, seq, CASE WHEN seq % 6 <> 0 THEN value END AS value, CASE WHEN removed = 'click' THEN false WHEN added = 'click' THEN true END AS named FROM {B.text(_CHANGES)} AS x WHERE op = 'set'),
f AS (SELECT *, coalesce(last_value(named IGNORE NULLS) OVER (PARTITION BY node ORDER BY seq), false) AS folds FROM c), s AS (SELECT node, max(CASE WHEN NOT folds THEN seq END) AS start FROM f GROUP BY node)
SELECT node, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM f JOIN s USING (node) WHERE start IS NULL OR seq >= start GROUP BY node""")
def label_policy_fold(spark, d):
    """A change of a user that has the label click is folded into the value, any other replaces it."""
    return labels.fold_by_labels(_changes(spark, d).where("op = 'set'"), {"click": "fold"}, ["value"])


def _parts(page):
    for item in page["parts"]:
        yield {"id": str(item["k"]), "title": item["name"].upper(), "size": item["size"]}


#: The plug-in of the query below: a page holds parts, and one without a name makes the rest of it fail.
PARTS = plugin_source.Plugin("parts", "id string, title string, size int", _parts)


@register("plugin_records", """SELECT CAST(p_partkey AS VARCHAR) AS id, upper(p_name) AS title, CAST(p_size AS INTEGER) AS size FROM part AS p
WHERE p_partkey < (SELECT coalesce(min(p_partkey), 999999999) FROM part AS q WHERE q.p_partkey % 100 = 99 AND CAST(floor(q.p_partkey / 50) AS BIGINT) = CAST(floor(p.p_partkey / 50) AS BIGINT)) AND p_size > 10""")
def plugin_records(spark, d):
    """Records that a plug-in source makes of pages in its tasks; filters on what it knows reach it, and a page's failure is its own."""
    part = spark.read.parquet(f"{d}/part.parquet")
    item = F.struct(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 100 != 99, F.col("p_name")).alias("name"), F.col("p_size").alias("size"))
    # A null name is no field of the document; its page fails there.
    pages = part.groupBy(F.floor(F.col("p_partkey") / 50)).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("parts"))).alias("value")).select("value")
    folder = f"{Scratch(spark, 'plugin').root}/pages"
    pages.write.text(folder, compression="none")
    rows = plugin_source.read(spark, "mediafuse.plans.live_queries:PARTS", folder)
    return plugin_source.records(rows.where("origin = 'parts' and size > 10")).select("id", "title", "size")


@register("media_selected_fields", MEMBERS_SQL + TITLES_SQL + f"""SELECT component, count(*) AS members, {FIRST_SQL('popularity')} AS popularity, any_value(t.titles) AS titles FROM members m
  JOIN (SELECT component, string_agg(title, '|' ORDER BY o) AS titles FROM firsts GROUP BY component) t USING (component) GROUP BY component""")
def media_selected_fields(spark, d):
    """A request for titles and popularity: no other list is exploded or joined."""
    out = fuse.detail(members(spark, d), None, ["titles", "popularity"], Scratch(spark, "fields"))
    return out.select("component", "members", "popularity", F.array_join(F.transform("titles", lambda t: t.title), "|").alias("titles"))


_NAMES = "(SELECT DISTINCT lower(p_name) AS a FROM part)"
_MANY = f"(SELECT q.a, lower(t.title) AS b FROM {_NAMES} AS q, (SELECT DISTINCT title FROM titles) AS t)"


@register("search_many", MEMBERS_SQL + f""", {alignment_sql(_MANY)}, hits AS (SELECT a, b, least(1, score / (2 * length(a))) AS relevance FROM scores WHERE score / (2 * length(a)) >= 0.7)
SELECT h.a AS query_id, t.component, round(max(h.relevance), 6) AS relevance FROM hits h JOIN titles t ON lower(t.title) = h.b GROUP BY h.a, t.component""")
def search_many(spark, d):
    """Every name of a part, searched in all titles at once."""
    scratch = Scratch(spark, "search-many")
    titles = scratch.write(members(spark, d).select("component", F.explode("titles").alias("t")).select("component", "t.title"))
    queries = spark.read.parquet(f"{d}/part.parquet").select(F.lower("p_name").alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    return search.search_many(titles, queries, scratch).select("query_id", "component", F.round("relevance", 6).alias("relevance"))


@register("artifact_metrics", """SELECT 'parts' AS name, count(*) AS rows, CAST(count(*) FILTER (WHERE p_size > 25) AS VARCHAR) AS large, CAST(max(p_partkey) AS VARCHAR) AS last FROM part""")
def artifact_metrics(spark, d):
    """An artefact whose rows are counted, guarded and measured by the job that writes them."""
    part = spark.read.parquet(f"{d}/part.parquet")
    about = builds.write_artifact(part, f"{Scratch(spark, 'artifact').root}/parts", {"part": "table"}, 1, "parts", {"large": F.count_if(F.col("p_size") > 25), "last": F.max("p_partkey")})
    return about.select("name", "rows", F.col("metrics")["large"].alias("large"), F.col("metrics")["last"].alias("last"))
