"""The merging sink of a stream: observations of media and episodes are folded into a bucketed store, links are added
once, and the clusters that a batch touches are fused anew. All of a batch is one version of the store.

What is kept: media and episodes (each column with the order of the value it holds), links with the batch in which
they were new, the component of every linked uri, the uris of every component, and the golden record of every
cluster. A batch reads and rewrites the buckets of its own keys, of the components that its new links join, and of
the members of the clusters that it changes; the rest of the store is neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mediafuse.operators import fuse
from mediafuse.operators.components import connected_components
from mediafuse.operators.identity import linking
from mediafuse.operators.scratch import Scratch
from mediafuse.streaming.folding import folded, observed, state_schema
from mediafuse.streaming.store import Store, Table

#: Kinds of links: between media, between episodes, and from a media to its episodes.
SAME_MEDIA, SAME_EPISODE, HAS_EPISODE = "media:same_as", "episode:same_as", "has_episode"
_LINK = StructType([StructField("src_uri", StringType()), StructField("dst_uri", StringType()), StructField("kind", StringType()), StructField("since", LongType())])
_OF = StructType([StructField("node", StringType()), StructField("component", StringType())])


@dataclass(frozen=True)
class Change:
    """What a batch did: links that were new, golden records made or changed, and components that are no cluster any more."""

    version: int
    new_links: DataFrame
    upserts: DataFrame
    retracted: DataFrame


class MergingSink:
    """media and episodes: schemas of the records, ``uri`` and, for episodes, ``media_uri`` among their columns."""

    def __init__(self, spark: SparkSession, folder: str, media: StructType, episodes: StructType | None = None, buckets: int = 64, after: Callable[[Change], None] | None = None):
        self.spark, self.media, self.episodes, self.after = spark, media, episodes, after
        golden = fuse.fuse_media(self._clustered(spark.createDataFrame([], media), "uri")).schema
        tables = {"media": Table(state_schema(media, "uri"), "uri"), "links": Table(_LINK, "src_uri"), "nodes": Table(_OF, "node"), "clusters": Table(_OF, "component"), "golden": Table(golden, "component")}
        if episodes is not None:
            tables["episodes"] = Table(state_schema(episodes, "uri"), "uri")
        self.store = Store(spark, folder, tables, buckets)

    @staticmethod
    def _clustered(rows: DataFrame, component: str) -> DataFrame:
        return rows.withColumn("component", F.col(component))

    # -- what the store holds

    def records(self, table: str = "media") -> DataFrame:
        """The folded records of a table, without the orders of their values."""
        record = self.media if table == "media" else self.episodes
        return self.store.read(table).select(*record.names)

    def links(self, kind: str | None = None) -> DataFrame:
        rows = self.store.read("links")
        return rows.where(F.col("kind") == kind) if kind else rows

    def members(self) -> DataFrame:
        """The media records with their component."""
        return self.records().join(self.store.read("nodes").withColumnRenamed("node", "uri"), "uri", "left").withColumn("component", F.coalesce("component", "uri"))

    def view(self) -> DataFrame:
        """The golden record of every cluster."""
        return self.store.read("golden")

    # -- a batch

    def _upsert(self, version: int, table: str, rows: DataFrame, record: StructType, scratch: Scratch) -> DataFrame | None:
        """Folds rows into the table and returns the uris they are about; None where there are none."""
        fresh = scratch.write(folded(observed(rows.where("uri is not null"), record, "uri"), record, "uri"), table)
        own = self.store.touched(fresh, "uri")
        if not own:
            return None
        self.store.replace(version, table, folded(self.store.read(table, own).unionByName(fresh), record, "uri"), own)
        return fresh.select("uri")

    def _new_links(self, version: int, links: DataFrame, scratch: Scratch) -> DataFrame:
        """The links that the store does not hold yet; the same_as kinds have no direction and are held with the smaller uri first."""
        a, b = F.col("src_uri"), F.col("dst_uri")
        turned = (F.col("kind") != HAS_EPISODE) & (a > b)
        rows = links.where((a != b) & F.col("kind").isNotNull()).select(F.when(turned, b).otherwise(a).alias("src_uri"), F.when(turned, a).otherwise(b).alias("dst_uri"), "kind").distinct()
        rows = scratch.write(rows, "links")
        own = self.store.touched(rows, "src_uri")
        held = self.store.read("links", own).select("src_uri", "dst_uri", "kind")
        fresh = scratch.write(rows.join(held, ["src_uri", "dst_uri", "kind"], "left_anti").withColumn("since", F.lit(version).cast("long")), "new-links")
        self.store.append(version, "links", fresh, self.store.touched(fresh, "src_uri"))
        return fresh

    def _lookup(self, uris: DataFrame, scratch: Scratch) -> DataFrame:
        """uris (column node) with their component as the store holds it, null for those that were never linked."""
        return uris.join(self.store.read("nodes", self.store.touched(uris, "node")), "node", "left")

    def _relink(self, version: int, fresh: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """Brings the components up to date with new media links.

        Returns (node, component) of all nodes that have another component than before, and of the links' ends.
        Only the graph of components that the links touch is contracted.
        """
        ends = fresh.select(F.col("src_uri").alias("node")).unionByName(fresh.select(F.col("dst_uri").alias("node"))).distinct()
        ends = scratch.write(self._lookup(ends, scratch), "ends")
        at = lambda x: ends.select(F.col("node").alias(x), F.coalesce("component", "node").alias(f"c_{x}"))
        between = fresh.join(at("src_uri"), "src_uri").join(at("dst_uri"), "dst_uri").select(F.col("c_src_uri").alias("a"), F.col("c_dst_uri").alias("b"))
        to = connected_components(between, scratch).select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = scratch.write(to.where("component <> to"), "moved")
        grown = self.store.read("clusters", self.store.touched(moved, "component")).join(moved, "component").select("node", F.col("to").alias("component"))
        first = ends.where("component is null").select("node", F.col("node").alias("c")).join(to.withColumnRenamed("component", "c"), "c", "left").select("node", F.coalesce("to", "c").alias("component"))
        changed = scratch.write(grown.unionByName(first), "changed")

        own = self.store.touched(changed, "node")
        self.store.replace(version, "nodes", self.store.read("nodes", own).join(changed, "node", "left_anti").unionByName(changed), own)
        own = self.store.touched(changed.select("component").unionByName(moved.select("component")), "component")
        kept = self.store.read("clusters", own).join(moved, "component", "left_anti")
        self.store.replace(version, "clusters", scratch.write(kept.unionByName(changed.select("node", "component")), "clusters"), own)
        return changed, moved

    def _refuse(self, version: int, uris: DataFrame | None, changed: DataFrame | None, moved: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """Fuses the clusters anew that hold a changed record or a changed node. Returns their golden records and the components that are gone."""
        none = self.spark.createDataFrame([], _OF)
        changed = none if changed is None else changed
        about = changed.select("node") if uris is None else changed.select("node").unionByName(uris.select(F.col("uri").alias("node"))).distinct()
        dirty = about.join(self._pending("nodes")(about, "node"), "node", "left").select(F.coalesce("component", "node").alias("component")).distinct()
        dirty = scratch.write(dirty, "dirty")
        gone = changed.where("node <> component").select(F.col("node").alias("component"))  # nodes that were clusters of their own
        gone = gone if moved is None else gone.unionByName(moved.select("component"))
        gone = scratch.write(gone.join(dirty, "component", "left_anti").distinct(), "gone")
        nodes = self._pending("clusters")(dirty, "component").join(dirty, "component", "left_semi").select("node", "component")
        nodes = nodes.unionByName(dirty.join(nodes.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), "component"))
        nodes = scratch.write(nodes, "dirty-nodes")
        records = self._pending("media")(nodes, "node").select(*self.media.names)
        members = scratch.write(records.join(nodes.withColumnRenamed("node", "uri"), "uri"), "dirty-members")
        golden = scratch.write(fuse.fuse_media(members, scratch), "golden")

        own = self.store.touched(dirty.unionByName(gone), "component")
        old = self.store.read("golden", own).join(dirty.unionByName(gone), "component", "left_anti")
        self.store.replace(version, "golden", old.unionByName(golden), own)
        return golden, gone

    def _pending(self, table: str) -> Callable[[DataFrame, str], DataFrame]:
        """Reads the buckets of some keys as they will be after this batch."""
        return lambda rows, key: self.store.read_staged(table, self.store.touched(rows, key))

    def apply(self, batch: DataFrame, version: int) -> None:
        """A batch of rows ``media``, ``episode`` and ``link``: structs of which one is not null. media and episodes have a sequence and an array ``handles``.

        A version that the store holds already is a batch that is repeated, and does nothing.
        """
        if version <= self.store.version():
            return
        self.store.begin()
        scratch = Scratch(self.spark, f"merge-{version}")
        batch = scratch.write(batch, "batch")
        media = batch.where("media is not null").select("media.*")
        uris = self._upsert(version, "media", media, self.media, scratch)
        links = media.select(F.col("uri").alias("src_uri"), F.explode("handles").alias("dst_uri"), F.lit(SAME_MEDIA).alias("kind"))
        if self.episodes is not None:
            episodes = batch.where("episode is not null").select("episode.*")
            self._upsert(version, "episodes", episodes, self.episodes, scratch)
            links = links.unionByName(episodes.select(F.col("uri").alias("src_uri"), F.explode("handles").alias("dst_uri"), F.lit(SAME_EPISODE).alias("kind"))).unionByName(
                episodes.where("media_uri is not null").select(F.col("media_uri").alias("src_uri"), F.col("uri").alias("dst_uri"), F.lit(HAS_EPISODE).alias("kind")))
        fresh = self._new_links(version, links, scratch)
        joins = linking(fresh.where(F.col("kind") == SAME_MEDIA))
        changed, moved = self._relink(version, joins, scratch) if not joins.isEmpty() else (None, None)
        golden, gone = self._refuse(version, uris, changed, moved, scratch)
        self.store.commit(version)
        if self.after:
            self.after(Change(version, fresh, golden, gone))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """trigger: as of ``DataStreamWriter.trigger``; processingTime bounds the delay, availableNow drains and ends."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()
