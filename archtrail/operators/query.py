"""Read-only questions about a finished map: hotspots and node explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_churn(descendants: DataFrame, churn: DataFrame) -> DataFrame:
    """Commits touching any file at or below a node. ``churn``: file, commits."""
    return descendants.join(churn, "file").groupBy(F.col("node").alias("id")).agg(
        F.sum("commits").cast("bigint").alias("churn")
    )


def hotspots(metrics: DataFrame, churn: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes ranked by fan-in times churn. ``metrics``: id, fan_in; ``churn``: id, churn.

    The sort and the limit plan as one top-k, which keeps ``limit`` rows per task."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    ranked = (
        metrics.select("id", "fan_in")
        .join(churn, "id", "left")
        .withColumn("churn", F.coalesce("churn", F.lit(0)).cast("bigint"))
        .withColumn("score", (F.col("fan_in") * F.col("churn")).cast("bigint"))
    )
    return (
        ranked.select("score", "fan_in", "churn", "id")
        .orderBy(F.desc("score"), F.desc("fan_in"), F.desc("churn"), F.asc("id"))
        .limit(limit)
    )


def relationships(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Edges at one node seen from that node; an end that is not a known node
    shows as kind ``unknown`` and label ``Unknown``."""
    outgoing = F.col("source") == node_id
    at_node = edges.where(outgoing | (F.col("target") == node_id)).select(
        F.when(outgoing, F.lit("depends_on")).otherwise(F.lit("used_by")).alias("direction"),
        F.when(outgoing, F.col("target")).otherwise(F.col("source")).alias("other_id"),
        "weight",
        "label",
    )
    others = nodes.select(
        F.col("id").alias("other_id"),
        F.col("kind").alias("other_kind"),
        F.col("label").alias("other_label"),
    )
    return at_node.join(others, "other_id", "left").select(
        "direction",
        "other_id",
        F.coalesce("other_kind", F.lit("unknown")).alias("other_kind"),
        F.coalesce("other_label", F.lit("Unknown")).alias("other_label"),
        "weight",
        "label",
    )


def lineage_of(above: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """The chain of parents of one node, outermost first at place 1."""
    chain = above.where((F.col("node") == node_id) & (F.col("distance") > 0))
    named = chain.join(nodes.select(F.col("id").alias("ancestor"), "kind", "label"), "ancestor")
    height = F.max("distance").over(Window.partitionBy("node"))  # one node: its few levels
    return named.select(
        (height - F.col("distance") + 1).alias("place"),
        F.col("ancestor").alias("id"),
        "kind",
        "label",
    )


def explain_node(
    nodes: DataFrame, edges: DataFrame, above: DataFrame, findings: DataFrame, node_id: str
) -> dict[str, DataFrame]:
    """Everything known about one node, each part a DataFrame of its own."""
    node = nodes.where(F.col("id") == node_id)
    if node.isEmpty():
        raise KeyError(node_id)
    return {
        "node": node,
        "hierarchy": lineage_of(above, nodes, node_id).orderBy("place"),
        "relationships": relationships(edges, nodes, node_id).orderBy("direction", "other_id"),
        "findings": findings_for(findings, node_id),
    }


def findings_for(findings: DataFrame, node_id: str) -> DataFrame:
    return findings.where(F.array_contains("node_ids", node_id))
