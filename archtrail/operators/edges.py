"""Weighted, evidence-backed edges built from import sites.

A *site* is one reference: ``source, target, file, line, symbols``. Evidence and
symbols stay normalised (one row each), so a heavy edge is many short rows and
never one huge array. Arrays appear only where an artifact is exported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.functions.text import overflow_label
from archtrail.operators.ranking import first_n

PAIR = ["source", "target"]


def _between_different(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("source") != F.col("target"))


def evidence(sites: DataFrame) -> DataFrame:
    """Distinct (source, target, file, line)."""
    return _between_different(sites).select(*PAIR, "file", "line").distinct()


def edge_symbols(sites: DataFrame) -> DataFrame:
    """Distinct (source, target, symbol)."""
    exploded = _between_different(sites).select(*PAIR, F.explode("symbols").alias("symbol"))
    return exploded.distinct()


def edge_weights(sites: DataFrame) -> DataFrame:
    """One row per edge with the number of distinct sites behind it.

    ``count_distinct`` first reduces to distinct sites keyed by the full site and
    only then counts per edge, so a hot edge is spread over all tasks."""
    return (
        _between_different(sites)
        .groupBy(*PAIR)
        .agg(F.count_distinct("file", "line").alias("weight"))
    )


def full_labels(symbols: DataFrame) -> DataFrame:
    """All symbols of an edge, sorted and joined."""
    return symbols.groupBy(*PAIR).agg(
        F.array_join(F.array_sort(F.collect_set("symbol")), ", ").alias("label")
    )


def short_labels(symbols: DataFrame, shown: int = 5) -> DataFrame:
    """First ``shown`` symbols and how many more there are, ``*`` left out."""
    named = symbols.where(F.col("symbol") != "*")
    totals = named.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_total"))
    leading = (
        first_n(named, PAIR, [F.col("symbol")], shown)
        .groupBy(*PAIR)
        .agg(F.array_sort(F.collect_list("symbol")).alias("_first"))
    )
    return totals.join(leading, PAIR).select(
        *PAIR, overflow_label(F.col("_first"), F.col("_total"), shown).alias("label")
    )


def build_edges(sites: DataFrame, labels: str = "full") -> DataFrame:
    """Edges with weight and label (null when a site names no symbol)."""
    render = full_labels if labels == "full" else short_labels
    return edge_weights(sites).join(render(edge_symbols(sites)), PAIR, "left")


def roll_sites(sites: DataFrame, parents: DataFrame) -> DataFrame:
    """Move both ends of each site to their parent and drop what stays inside
    one parent. ``parents`` has one row per ``child``; sites with an end outside
    it disappear, as ends without a parent take no part at the higher level."""
    sources = parents.select(F.col("child").alias("source"), F.col("parent").alias("_source"))
    targets = parents.select(F.col("child").alias("target"), F.col("parent").alias("_target"))
    rest = [name for name in sites.columns if name not in PAIR]
    return (
        sites.join(sources, "source")
        .join(targets, "target")
        .where(F.col("_source") != F.col("_target"))
        .select(F.col("_source").alias("source"), F.col("_target").alias("target"), *rest)
    )


def undirected_weights(edges: DataFrame) -> DataFrame:
    """Weight of each unordered pair, summed over both directions."""
    low, high = F.least("source", "target"), F.greatest("source", "target")
    return (
        edges.where(F.col("source") != F.col("target"))
        .groupBy(low.alias("low"), high.alias("high"))
        .agg(F.sum("weight").alias("weight"))
    )


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours in each direction for every node, zero when none.

    Both directions come out of one aggregation over tagged edge ends instead of
    two aggregations and two joins."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("target").alias("id"), F.lit(1).alias("_in"), F.lit(0).alias("_out")),
                F.struct(F.col("source").alias("id"), F.lit(0).alias("_in"), F.lit(1).alias("_out")),
            )
        )
    )
    counted = ends.groupBy("id").agg(
        F.sum("_in").cast("bigint").alias("fan_in"), F.sum("_out").cast("bigint").alias("fan_out")
    )
    return nodes.select("id").join(counted, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def edges_among(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges with both ends in ``visible(id)``."""
    ids = visible.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def neighbours(edges: DataFrame, nodes: DataFrame, node_id: str, reverse: bool = False) -> DataFrame:
    """Sorted distinct direct dependencies (or dependents) of one node."""
    if nodes.where(F.col("id") == node_id).isEmpty():
        raise KeyError(node_id)
    here, there = ("target", "source") if reverse else ("source", "target")
    return (
        edges.where(F.col(here) == node_id).select(F.col(there).alias("id")).distinct().orderBy("id")
    )


def export_evidence(sites: DataFrame) -> DataFrame:
    """Evidence as one sorted array per edge, for the JSON artifact only."""
    rows = evidence(sites)
    site: Column = F.struct("file", "line")
    return rows.groupBy(*PAIR).agg(F.array_sort(F.collect_list(site)).alias("evidence"))
