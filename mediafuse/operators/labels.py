"""Labels of nodes as a fold of changes, and values whose merging depends on the labels in force."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafuse.operators.fold import upsert_fold

#: Changes of one span of sequence numbers are ordered among themselves; spans meet by their last changes.
SPAN = 100_000
POLICIES = ("fold", "latest")


def labels_of(changes: DataFrame, node: str = "node", seq: str = "seq", op: str = "op", add: str = "add", remove: str = "remove") -> DataFrame:
    """(node, label) after all changes, in any order of arrival.

    ``set`` makes a node if need be, adds labels and then removes some; ``label`` adds labels to a node that a ``set``
    before it has made, and else does nothing. The last change that names a label decides.
    """
    made = changes.where(F.col(op) == "set").groupBy(F.col(node).alias("_node")).agg(F.min(seq).alias("_made"))
    known = changes.join(made, F.col(node) == F.col("_node")).where((F.col(op) == "set") | (F.col(seq) > F.col("_made")))
    one = lambda labels, on: F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda l: F.struct(l.alias("label"), F.lit(on).alias("on")))
    removed = F.when(F.col(op) == "set", F.col(remove))
    named = known.select(F.col(node).alias("node"), F.col(seq).alias("seq"), F.explode(F.concat(one(F.col(add), True), one(removed, False))).alias("c"))
    last = named.groupBy("node", F.col("c.label").alias("label")).agg(F.max_by("c.on", F.struct("seq", ~F.col("c.on"))).alias("on"))  # in one change the removal comes last
    return last.where("on").select("node", "label")


def labeled(labels: DataFrame, label: str) -> DataFrame:
    """The nodes of a label; none for a label that no node has."""
    return labels.where(F.col("label") == label).select("node")


def clusters_labeled(nodes: DataFrame, components: DataFrame, labels: DataFrame, label: str | None = None, node: str = "node") -> DataFrame:
    """(component, node): the members of the clusters, those of a label only if one is given."""
    kept = nodes.select(F.col(node).alias("node")) if label is None else nodes.select(F.col(node).alias("node")).join(labeled(labels, label), "node", "left_semi")
    return kept.join(components.select("node", "component"), "node", "left").select(F.coalesce("component", "node").alias("component"), "node")


def in_force(changes: DataFrame, labels: list[str], node: str, seq: str, add: str, remove: str) -> DataFrame:
    """changes with a column of each label: whether the node has it once the change is made.

    A node's changes are ordered within spans of the sequence only, and each span starts from the last changes of
    those before it, so a node that holds most of the changes is the work of many tasks.
    """
    span = F.floor(F.col(seq) / SPAN)
    named = lambda l: F.when(F.array_contains(remove, l), False).when(F.array_contains(add, l), True)
    rows = changes.withColumns({"_span": span, **{f"_n_{l}": named(l) for l in labels}})
    lasts = rows.groupBy(node, "_span").agg(*(F.max_by(f"_n_{l}", F.when(F.col(f"_n_{l}").isNotNull(), F.col(seq))).alias(f"_l_{l}") for l in labels))
    before = Window.partitionBy(node).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(node, "_span", *(F.last(f"_l_{l}", ignorenulls=True).over(before).alias(f"_c_{l}") for l in labels))
    here = Window.partitionBy(node, "_span").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_h_{l}": F.last(f"_n_{l}", ignorenulls=True).over(here) for l in labels}).join(carried, [node, "_span"])
    return out.select(*changes.columns, *(F.coalesce(f"_h_{l}", f"_c_{l}", F.lit(False)).alias(l) for l in labels))


def fold_by_labels(changes: DataFrame, merging: dict[str, str], scalars: list[str], arrays: list[str] = (), node: str = "node", seq: str = "seq", add: str = "add", remove: str = "remove") -> DataFrame:
    """One row per node: a change of a node whose label merges is folded into its value, any other replaces it.

    merging: label to policy; "fold" keeps the latest scalars that are not null and the longest arrays, "latest" takes
    the change as it is. A node with two merging labels in force is an error of the data, raised where it is met.
    """
    if unknown := sorted(set(merging.values()) - set(POLICIES)):
        raise ValueError(f"unknown policy: {unknown}")
    own = {l: f"_on_{i}" for i, l in enumerate(merging)}
    rows = in_force(changes, list(merging), node, seq, add, remove)
    rows = rows.select(*changes.columns, *(F.col(f"`{l}`").alias(c) for l, c in own.items()))
    several = reduce(Column.__add__, (F.col(c).cast("int") for c in own.values()), F.lit(0)) > 1
    checked = F.when(several, F.raise_error(F.concat(F.lit("several labels of a node merge: "), F.col(node).cast("string"))).cast("boolean")).otherwise(
        reduce(Column.__or__, (F.col(c) for l, c in own.items() if merging[l] == "fold"), F.lit(False)))
    rows = rows.withColumn("_folds", checked)
    start = rows.groupBy(F.col(node).alias("_node")).agg(F.max(F.when(~F.col("_folds"), F.col(seq))).alias("_start"))
    rows = rows.join(start, F.col(node) == F.col("_node")).where(F.col("_start").isNull() | (F.col(seq) >= F.col("_start")))
    return upsert_fold(rows, node, seq, scalars, list(arrays))
