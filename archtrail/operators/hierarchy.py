"""Levels: membership, ancestors, descendants, roll-ups and drill-down.

Membership is a table ``child, parent``; each child has at most one parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.operators.nesting import nearest_stop
from archtrail.session import cut_lineage


def ancestors(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, ancestor, distance) including the node itself at distance 0.

    One join per level while the last level still found rows, so maps nested
    deeper than file/module/component work too. A node met twice on its own
    path (a cyclic hierarchy) stops there."""
    up = membership.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
    level = nodes.select(
        F.col("id").alias("node"),
        F.col("id").alias("ancestor"),
        F.lit(0).cast("bigint").alias("distance"),
        F.array("id").alias("_seen"),
    )
    result = level
    while True:
        level = cut_lineage(
            level.join(up, "ancestor")
            .where(~F.array_contains("_seen", F.col("_next")))
            .select(
                "node",
                F.col("_next").alias("ancestor"),
                (F.col("distance") + 1).alias("distance"),
                F.concat("_seen", F.array("_next")).alias("_seen"),
            )
        )
        if level.isEmpty():
            return result.drop("_seen")
        result = result.unionByName(level)


def descendant_files(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, file): every file at or below a node."""
    files = nodes.where(F.col("kind") == "file")
    above = ancestors(files, membership)
    return above.select(F.col("ancestor").alias("node"), F.col("node").alias("file")).distinct()


def members(membership: DataFrame, parent: str) -> DataFrame:
    """Children of one node, for drilling down."""
    return membership.where(F.col("parent") == parent).select(F.col("child").alias("id"))


def top_level(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "component").select("id")


def level_map(membership: DataFrame) -> DataFrame:
    """parent → sorted children, as arrays for export."""
    return membership.groupBy("parent").agg(
        F.array_sort(F.collect_set("child")).alias("children")
    )


def roll_up(values: DataFrame, membership: DataFrame, column: str) -> DataFrame:
    """Sum ``column`` of the children (``values: id, column``) into the parents."""
    keyed = membership.join(values.select(F.col("id").alias("child"), column), "child")
    return keyed.groupBy(F.col("parent").alias("id")).agg(F.sum(column).alias(column))


def nearest_visible(ids: DataFrame, membership: DataFrame, visible: DataFrame) -> DataFrame:
    """(node, shown): the closest visible node at or above each of ``ids(node)``.

    Nodes without a visible ancestor disappear. No ancestors are listed for it."""
    return nearest_stop(ids, membership, visible).withColumnRenamed("stop", "shown")


def non_source_buckets(files: DataFrame) -> DataFrame:
    """One synthetic component per top directory holding files that are not
    production source. ``files``: id, path, role, loc."""
    other = files.where((F.coalesce("role", F.lit("source")) != "source"))
    first = F.substring_index("path", "/", 1)
    directory = F.when(first == "", F.lit(".")).otherwise(first)
    noun = F.when(F.col("members") == 1, F.lit("file")).otherwise(F.lit("files"))
    return (
        other.groupBy(directory.alias("directory"))
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum("loc").cast("bigint").alias("loc"),
            F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("roles"),
        )
        .select(
            F.concat(F.lit("nonsource:"), "directory").alias("id"),
            F.concat("directory", F.lit(" · non-source")).alias("label"),
            F.concat(
                F.col("members").cast("string"), F.lit(" non-source "), noun, F.lit(" ("), "roles",
                F.lit(")."),
            ).alias("summary"),
            "members",
            "loc",
        )
    )


def non_source_members(files: DataFrame) -> DataFrame:
    """(child, parent) rows that put non-source files below their bucket."""
    first = F.substring_index("path", "/", 1)
    directory = F.when(first == "", F.lit(".")).otherwise(first)
    return files.where(F.coalesce("role", F.lit("source")) != "source").select(
        F.col("id").alias("child"), F.concat(F.lit("nonsource:"), directory).alias("parent")
    )
