"""Project a change set onto a map: changed nodes, dependents, review order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.operators.cycles import dependency_order_keys
from archtrail.operators.edges import edges_among
from archtrail.operators.hierarchy import nearest_visible
from archtrail.operators.ranking import with_position

# Status names by one-letter code.
STATUS_BY_CODE = {
    "A": "added",
    "M": "modified",
    "D": "deleted",
    "R": "renamed",
    "C": "copied",
    "T": "type_changed",
}


def changed_nodes(changes: DataFrame, file_nodes: DataFrame) -> DataFrame:
    """Changes (path, status, old_path) with the node each path maps to, or null.

    ``file_nodes``: id, path, one row per file."""
    index = file_nodes.select("path", F.col("id").alias("node_id"))
    return changes.join(index, "path", "left").select("path", "old_path", "status", "node_id")


def direct_dependents(mapped: DataFrame, edges: DataFrame, file_nodes: DataFrame) -> DataFrame:
    """Distinct (changed_node_id, dependent_node_id): unchanged files with an edge
    into a changed one."""
    changed = mapped.where(F.col("node_id").isNotNull()).select("node_id").distinct()
    into = edges.join(changed.withColumnRenamed("node_id", "target"), "target", "left_semi")
    known = into.join(file_nodes.select(F.col("id").alias("source")), "source", "left_semi")
    unchanged = known.join(changed.withColumnRenamed("node_id", "source"), "source", "left_anti")
    return unchanged.select(
        F.col("target").alias("changed_node_id"), F.col("source").alias("dependent_node_id")
    ).distinct()


def impact_summary(mapped: DataFrame, dependents: DataFrame) -> DataFrame:
    """One row: changed paths, mapped paths, distinct dependents."""
    rows = mapped.select("path", "node_id", F.lit(None).cast("string").alias("dependent")).unionByName(
        dependents.select(
            F.lit(None).cast("string").alias("path"),
            F.lit(None).cast("string").alias("node_id"),
            F.col("dependent_node_id").alias("dependent"),
        ).distinct()
    )
    return rows.agg(
        F.count("path").alias("changed_files"),
        F.count("node_id").alias("mapped_files"),
        F.count("dependent").alias("direct_dependents"),
    )


def review_order(mapped: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, path): dependencies before dependents, smallest id first among
    equals, members of one cycle together; paths without a node follow sorted."""
    with_node = mapped.where(F.col("node_id").isNotNull())
    nodes = with_node.select(F.col("node_id").alias("id")).distinct()
    keyed = dependency_order_keys(nodes, edges_among(edges, nodes))
    paths = with_node.groupBy(F.col("node_id").alias("node")).agg(F.max("path").alias("path"))
    ordered = keyed.join(paths.hint("merge"), "node").select(  # keys are long: not for a broadcast
        F.lit(0).alias("_tail"), "key", F.col("node").alias("_by"), "path"
    )
    rest = mapped.where(F.col("node_id").isNull()).select(
        F.lit(1).alias("_tail"),
        F.array().cast("array<string>").alias("key"),
        F.col("path").alias("_by"),
        "path",
    )
    placed = with_position(ordered.unionByName(rest), F.col("_tail"), F.col("key"), F.col("_by"))
    return placed.select("position", "path")


def status_overlay(mapped: DataFrame, membership: DataFrame, visible: DataFrame) -> DataFrame:
    """(id, status) per visible node; several different statuses show as ``mixed``."""
    with_node = mapped.where(F.col("node_id").isNotNull()).withColumnRenamed("node_id", "node")
    shown = nearest_visible(with_node, membership, visible)
    return (
        with_node.join(shown, "node")
        .groupBy(F.col("shown").alias("id"))
        .agg(F.min("status").alias("_low"), F.max("status").alias("_high"))
        .select(
            "id",
            F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("mixed").alias("status"),
        )
    )


def risk_overlay(
    dependents: DataFrame, statuses: DataFrame, membership: DataFrame, visible: DataFrame
) -> DataFrame:
    """Visible nodes with a dependent below them that are not changed themselves."""
    shown = nearest_visible(
        dependents.select(F.col("dependent_node_id").alias("node")), membership, visible
    )
    ids = shown.select(F.col("shown").alias("id")).distinct()
    return ids.join(statuses, "id", "left_anti")


def trace_coverage(mapped: DataFrame, events: DataFrame) -> DataFrame:
    """(path, edited, read, unobserved) per changed node: was it touched by the
    activity in ``events`` (node_id, tool)?"""
    changed = mapped.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(
        F.max("path").alias("path")
    )
    touched = events.groupBy("node_id").agg(
        F.bool_or(F.col("tool").isin("Edit", "Write")).alias("edited"),
        F.bool_or(F.col("tool").isin("Read", "Grep")).alias("read"),
    )
    joined = changed.join(touched, "node_id", "left").na.fill(False, ["edited", "read"])
    return joined.select(
        "path", "edited", "read", (~F.col("edited") & ~F.col("read")).alias("unobserved")
    )
