"""Connected components of an undirected graph by repeated contraction.

Each round points every node at the smallest of its closed neighbourhood, then replaces the edges by
edges between the nodes pointed at. The order of nodes is their own in the first round (a star around
its smallest node contracts at once) and a fresh hash in later rounds, so that the number of nodes
falls by a constant factor and long paths need O(log n) rounds. Nothing is collected; only counts
reach the driver, and every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafuse.operators.scratch import Scratch


def _contract(edges: DataFrame, order) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min(F.struct(order(F.col("v")).alias("o"), F.col("v"))).alias("m"))
    mine = F.struct(order(F.col("u")).alias("o"), F.col("u").alias("v"))
    return least.select("u", F.least(mine, F.col("m"))["v"].alias("p"))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached, the node itself included.

    Covers the nodes that occur in ``edges``; null ends and self-loops are ignored, so a node without a
    link has no row (callers coalesce to the node itself).
    """
    now = scratch.write(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    parents: list[DataFrame] = []
    while not now.isEmpty():
        seed = len(parents)
        order = (lambda c: c) if seed == 0 else (lambda c, s=seed: F.xxhash64(c, F.lit(s)))
        p = scratch.write(_contract(now, order), "parents")
        parents.append(p)
        to = lambda end: p.select(F.col("u").alias(end), F.col("p").alias(f"{end}p"))
        nxt = scratch.write(
            now.join(to("a"), "a").join(to("b"), "b").where("ap <> bp")
            .select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b")).distinct(), "edges")
        scratch.drop(now)
        now = nxt
    if not parents:
        return now.select(F.col("a").alias("node"), F.col("a").alias("component"))
    label = parents[-1].select("u", "p")
    for p in reversed(parents[:-1]):
        up = label.select(F.col("u").alias("p"), F.col("p").alias("root"))
        label = p.join(up, "p", "left").select("u", F.coalesce("root", "p").alias("p"))
    if len(parents) > 1:  # in the first round the order is the nodes' own
        label = scratch.write(label, "labels")
        least = label.groupBy("p").agg(F.min("u").alias("lu")).select("p", F.least("lu", "p").alias("component"))
        label = label.join(least, "p").select("u", F.col("component").alias("p"))
    nodes = scratch.write(label.select(F.col("u").alias("node"), F.col("p").alias("component")), "nodes")
    scratch.drop(label, *parents, now)
    return nodes


def extended_components(parts: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of ``parts`` (a result of connected_components) with further edges (a, b).

    Only the graph of the components that the new edges touch is contracted.
    """
    at = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(between, scratch)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = parts.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = scratch.write(old.unionByName(moved.join(parts, "node", "left_anti")), "parts")
    scratch.drop(parts, moved)
    return out


def with_component(nodes: DataFrame, components: DataFrame, key: str | Column) -> DataFrame:
    """nodes with a column ``component``; a node without a link is its own component."""
    k = F.col(key) if isinstance(key, str) else key
    return nodes.join(components, k == F.col("node"), "left").withColumn("component", F.coalesce("component", k)).drop("node")
