"""Streaming queries, drained and returned as their final state. Observations arrive in several batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediafuse.operators.scratch import Scratch
from mediafuse.operators.spread import spread
from mediafuse.plans import bindings as B
from mediafuse.plans.catalog import register
from mediafuse.plans.fusion_queries import PAGE_SQL, page_columns
from mediafuse.plans.members import media
from mediafuse.streaming.merging import HAS_EPISODE, MergingSink
from mediafuse.streaming.upserts import FoldedState, observations

ARRIVALS = 4


def arriving(rows: DataFrame, arrival: Column, folder: str, start: Callable, n: int = ARRIVALS) -> None:
    """Lets rows arrive in a folder in n parts, each drained by the stream that ``start`` starts on it, from where the one before ended."""
    spark = rows.sparkSession
    made = Scratch(spark, "arriving")
    rows = made.write(spread(rows.withColumn("_arrival", arrival)))  # once, not once for each part
    schema = StructType([f for f in rows.schema if f.name != "_arrival"])
    for i in range(n):
        rows.where(F.col("_arrival") == i).drop("_arrival").write.mode("append").parquet(folder)
        query = start(observations(spark, schema, [folder], "*.parquet"))
        query.awaitTermination()
        if query.exception():
            raise query.exception()


def _drained(spark: SparkSession, rows: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    root = Scratch(spark, "stream").root
    state = FoldedState(spark, f"{root}/state", key, seq, columns)
    arriving(rows, F.col(seq) % ARRIVALS, f"{root}/arrived", lambda s: state.start(s, f"{root}/checkpoint", availableNow=True))
    return state.current()


@register("stream_upsert_final_state", f"SELECT user_id, arg_max(scalar, event_id) AS scalar, arg_max(event_type, event_id) AS event_type FROM {B.text(B.UPSERTS)} AS u GROUP BY user_id")
def stream_upsert_final_state(spark, d):
    return _drained(spark, B.relation(spark, d, B.UPSERTS).select("user_id", "event_id", "event_type", "scalar"), "user_id", "event_id", ["scalar", "event_type"])


@register("stream_page_final", """SELECT user_id, popularity FROM (SELECT user_id, arg_max(floor(value), event_id) FILTER (WHERE event_type <> 'error') AS popularity FROM events GROUP BY user_id) AS x WHERE popularity >= 10""")
def stream_page_final(spark, d):
    """The page over the state that the last batch leaves."""
    rows = B.relation(spark, d, B.UPSERTS).select("user_id", "event_id", F.floor("scalar").cast("double").alias("popularity"))
    return _drained(spark, rows, "user_id", "event_id", ["popularity"]).where("popularity >= 10").orderBy(F.desc("popularity"), "user_id")


def media_observations(spark: SparkSession, d: str) -> DataFrame:
    """Media records, early and poorer versions of some, and handles that come apart from their records; ``media``, ``episode`` and ``arrival``."""
    k, whole = F.col("k"), media(spark, d)
    own = [c for c in whole.columns if c not in ("k", "year", "uri")]
    full = whole.select("uri", *own, F.lit(2).alias("seq"), F.array().cast("array<string>").alias("handles"), (k % ARRIVALS).alias("arrival"))
    poorer = {"titles": F.slice("titles", 1, 1), "popularity": F.when(F.col("popularity").isNotNull(), F.lit(1).cast("long")), "score": F.col("score") / 2}
    early = whole.where(k % 3 == 0).select("uri", *(poorer.get(c, F.col(c)).alias(c) for c in own), F.lit(1).alias("seq"), F.array().cast("array<string>").alias("handles"), ((k + 3) % ARRIVALS).alias("arrival"))
    edges = B.relation(spark, d, B.EDGES)
    types = dict(whole.dtypes)
    linked = edges.select(F.col("src_uri").alias("uri"), *(F.lit(None).cast(types[c]).alias(c) for c in own), F.lit(3).alias("seq"),
                          F.array("dst_uri").alias("handles"), F.pmod(F.xxhash64("src_uri", "dst_uri"), F.lit(ARRIVALS)).alias("arrival"))
    rows = full.unionByName(early).unionByName(linked)
    return rows.select(F.struct(*(c for c in rows.columns if c != "arrival")).alias("media"), F.lit(None).cast("struct<uri:string>").alias("episode"), "arrival")


def record_of(rows: DataFrame, column: str):
    """The schema of the records in a struct column of observations."""
    return StructType([f for f in rows.schema[column].dataType if f.name not in ("seq", "handles")])


@register("stream_cluster_page", PAGE_SQL)
def stream_cluster_page(spark, d):
    """The page of all clusters, kept up to date batch by batch: each fuses only the clusters that it touches."""
    rows = media_observations(spark, d)
    root = Scratch(spark, "cluster-page").root
    sink = MergingSink(spark, f"{root}/store", record_of(rows, "media"), buckets=max(8, 2 * spark.sparkContext.defaultParallelism))
    arriving(rows, F.col("arrival"), f"{root}/arrived", lambda s: sink.start(s, f"{root}/checkpoint", availableNow=True))
    return page_columns(sink.view())


@register("stream_episode_store", f"""SELECT e.uri, e.media_uri, e.episode_number, e.score, CAST(1 + (e.turn % 2) AS INTEGER) AS n_titles, CAST(least(e.turn % {ARRIVALS}, CASE WHEN e.turn % 2 = 1 THEN (e.turn + 1) % {ARRIVALS} ELSE 9 END) AS BIGINT) AS since
  FROM {B.text(B.EPISODES)} AS e""")
def stream_episode_store(spark, d):
    """Episodes and their media, folded; ``since`` is the batch in which the link from a media to its episode was new."""
    e = B.relation(spark, d, B.EPISODES)
    title = lambda n: F.array_repeat(F.struct(F.col("title"), F.col("score").alias("score")), n)
    one = lambda n, seq, arrival, number: e.select(
        "turn", "uri", "origin", "media_uri", number.alias("episode_number"), F.col("score").cast("double").alias("score"), title(n).alias("titles"), F.lit(seq).alias("seq"), (arrival % ARRIVALS).alias("arrival"))
    seen = one(1, 2, F.col("turn"), F.col("episode_number")).unionByName(one(2, 1, F.col("turn") + 1, F.lit(None).cast("long")).where("turn % 2 = 1"))
    episode = F.struct("uri", "origin", "media_uri", "episode_number", "score", "titles", "seq", F.array().cast("array<string>").alias("handles"))
    work = F.struct(F.col("media_uri").alias("uri"), F.lit("conv").alias("origin"), F.lit(0.5).alias("score"), F.lit(1).alias("seq"), F.array().cast("array<string>").alias("handles"))
    rows = seen.select(work.alias("media"), episode.alias("episode"), "arrival")
    root = Scratch(spark, "episode-store").root
    sink = MergingSink(spark, f"{root}/store", record_of(rows, "media"), record_of(rows, "episode"), buckets=8)
    arriving(rows, F.col("arrival"), f"{root}/arrived", lambda s: sink.start(s, f"{root}/checkpoint", availableNow=True))
    links = sink.links(HAS_EPISODE).select(F.col("dst_uri").alias("uri"), "since")
    return sink.records("episodes").join(links, "uri").select("uri", "media_uri", "episode_number", "score", F.size("titles").alias("n_titles"), "since")
