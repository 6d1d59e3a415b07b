"""Analyse again, parsing only what changed.

Change is decided by content, comparing two snapshots of the files themselves.
Only changed files are parsed; resolution, a set of joins, runs over all facts,
so an edit that takes a symbol away from an unchanged importer is seen too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.operators.facts import extract
from archtrail.session import cut_lineage


def fingerprint(files: DataFrame) -> DataFrame:
    """path, digest: what to keep of a snapshot."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) for added, modified and deleted files."""
    old = before.select("path", F.col("digest").alias("_old"))
    new = after.select("path", F.col("digest").alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    )
    differs = ~F.col("_old").eqNullSafe(F.col("_new"))
    return old.join(new, "path", "full").where(differs).select("path", status.alias("status"))


def refresh_facts(files: DataFrame, before: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of the new snapshot, changes). Facts of unchanged files are reused."""
    return take_over(files, cut_lineage(snapshot_changes(before, fingerprint(files))), facts)


def take_over(files: DataFrame, changes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for ``changes`` that are known. Only new facts are written; the others stay where they are."""
    stale = changes.select("path")
    fresh = cut_lineage(extract(files.join(stale, "path", "left_semi")))
    return facts.join(stale, "path", "left_anti").unionByName(fresh), changes


def structural_difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that occur on one side only, with ``side``; duplicates count.

    One aggregation over both tables instead of two set differences."""
    tagged = before.select(*columns, F.lit(1).alias("_n")).unionByName(
        after.select(*columns, F.lit(-1).alias("_n"))
    )
    counted = tagged.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return counted.withColumn("side", F.when(F.col("_n") > 0, "before").otherwise("after")).drop("_n")


def same_structure(before: DataFrame, after: DataFrame, columns: list[str]) -> bool:
    return structural_difference(before, after, columns).isEmpty()


def report(files: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: changed, parsed and reused files."""
    tagged = files.select(F.lit("file").alias("tag")).unionByName(changes.select(F.col("status").alias("tag")))
    return tagged.agg(
        F.count_if(F.col("tag") != "file").alias("changed_files"),
        F.count_if(F.col("tag").isin("added", "modified")).alias("parsed_files"),
        (F.count_if(F.col("tag") == "file") - F.count_if(F.col("tag").isin("added", "modified"))).alias(
            "reused_files"
        ),
    )
