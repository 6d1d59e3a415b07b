"""JSON artifacts: read them as tables, check them, write them.

Tables are the primary form of a map (``save_map``, parquet). JSON is for exchange
with viewers: one document, so it is assembled row by row on the way out.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.functions.text import mermaid_id, mermaid_label
from archtrail.operators import edges as edge_ops
from archtrail.plans.analyze import Map

MAP_TYPE = """
schema_version string, repo struct<root:string,commit:string,generated_at:string>,
nodes array<struct<id:string,kind:string,role:string,label:string,summary:string,prose_source:string,
  children:array<string>,files:array<string>,metrics:struct<loc:bigint,fan_in:bigint,fan_out:bigint>>>,
edges array<struct<source:string,target:string,kind:string,
  evidence:array<struct<file:string,line:bigint>>,weight:bigint,label:string>>,
levels struct<system:array<string>,component:map<string,array<string>>,module:map<string,array<string>>>,
capabilities struct<supported_edge_kinds:array<string>>
"""
# ---------------------------------------------------------------------------
# Fixed values of the artifact contract.
SCHEMA_VERSION = "1.0"
RULESET = "1"
EDGE_KIND = "imports"
KINDS = ("component", "module", "file")
ROLES = ("source", "test", "fixture", "generated", "vendored")
PROSE_SOURCES = ("heuristic", "llm")
EDGE_KINDS = ("imports", "calls", "inherits")
SEVERITIES = ("warning", "notice")
TOOLS = ("Read", "Edit", "Write", "Bash", "Grep", "Test")
STATUSES = ("added", "modified", "deleted", "renamed", "copied", "type_changed")
EPOCH = "1970-01-01T00:00:00Z"
# ---------------------------------------------------------------------------
TABLES = ("nodes", "edges", "evidence", "membership", "findings", "facts")


def save_map(result: Map, folder: str) -> None:
    for name in TABLES:
        getattr(result, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_map(spark: SparkSession, folder: str) -> Map:
    return Map(**{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES})


def read_map_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence, membership) of a map document. The explicit schema
    keeps open maps as maps."""
    document = spark.read.schema(MAP_TYPE).option("multiLine", True).json(path)
    node = document.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = node.select(
        "id", "kind", F.coalesce("role", F.lit("source")).alias("role"), "label", "summary",
        F.coalesce("prose_source", F.lit("heuristic")).alias("prose_source"),
        F.try_element_at("files", F.lit(1)).alias("path"), "files", "metrics.loc", "metrics.fan_in", "metrics.fan_out",
    )
    membership = node.select(F.explode("children").alias("child"), F.col("id").alias("parent"))
    link = document.select(F.explode("edges").alias("e")).select("e.*")
    weight = F.coalesce("weight", F.size("evidence").cast("bigint"))
    edges = link.select("source", "target", "kind", weight.alias("weight"), "label")
    evidence = link.select("source", "target", F.inline("evidence"))
    return nodes, edges, evidence, membership


def _broken(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, subject) for every rule a row does not keep; null counts as broken."""
    failed = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.select(key.alias("subject"), F.explode(F.array_compact(failed)).alias("rule"))


def _filled(name: str) -> Column:
    return F.length(name) > 0


def map_violations(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows that break the map contract; empty when it is kept."""
    pair = F.concat_ws(" -> ", "source", "target")
    node_rules = {
        "node id is filled": _filled("id"),
        "node kind is known": F.col("kind").isin(*KINDS),
        "node role is known": F.col("role").isin(*ROLES),
        "node label is filled": _filled("label"),
        "metrics are not negative": (F.col("loc") >= 0) & (F.col("fan_in") >= 0) & (F.col("fan_out") >= 0),
    }
    edge_rules = {
        "edge ends are filled": _filled("source") & _filled("target"),
        "edge weight is at least 1": F.col("weight") >= 1,
    }
    if "kind" in edges.columns:
        edge_rules["edge kind is known"] = F.col("kind").isin(*EDGE_KINDS)
    twice = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bare = edges.join(evidence.select("source", "target"), ["source", "target"], "left_anti")
    return (
        _broken(nodes, F.col("id"), node_rules)
        .unionByName(_broken(edges, pair, edge_rules))
        .unionByName(_broken(evidence, pair, {"evidence line is at least 1": F.col("line") >= 1}))
        .unionByName(twice.select(F.col("id").alias("subject"), F.lit("node id is unique").alias("rule")))
        .unionByName(bare.select(pair.alias("subject"), F.lit("edge has evidence").alias("rule")))
    )


def trace_violations(events: DataFrame) -> DataFrame:
    rules = {
        "time is not negative": F.col("t") >= 0,
        "tool is known": F.col("tool").isin(*TOOLS),
        "turn is not negative": F.col("turn") >= 0,
    }
    return _broken(events, F.col("sequence").cast("string"), rules)


def impact_violations(mapped: DataFrame) -> DataFrame:
    rules = {"path is filled": _filled("path"), "status is known": F.col("status").isin(*STATUSES)}
    return _broken(mapped, F.col("path"), rules)


def write_atomically(lines: Iterable[str], path: str | Path) -> None:
    """Write beside the target and rename, so readers never see half a file."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.writelines(lines)
        os.replace(beside, target)
    except BaseException:
        Path(beside).unlink(missing_ok=True)
        raise


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(row) for row in df.toJSON().toLocalIterator()]


def map_document(result: Map, commit: str, generated_at: str = EPOCH) -> dict:
    """The map as one document with the contract's fields, sorted."""
    children = result.membership.groupBy(F.col("parent").alias("id")).agg(
        F.array_sort(F.collect_set("child")).alias("children")
    )
    nothing = F.array().cast("array<string>")
    rank = F.when(F.col("kind") == "component", 0).when(F.col("kind") == "module", 1).otherwise(2)
    nodes = (
        result.nodes.join(children, "id", "left")
        .orderBy(rank, "id")
        .select(
            F.coalesce("children", nothing).alias("children"),
            F.when(F.col("kind") == "file", F.array("path")).otherwise(nothing).alias("files"),
            "id", "kind", "label", F.struct("fan_in", "fan_out", "loc").alias("metrics"),
            F.lit("heuristic").alias("prose_source") if "prose_source" not in result.nodes.columns
            else F.col("prose_source"),
            "role", "summary",
        )
    )
    proof = result.evidence.groupBy(*edge_ops.PAIR).agg(
        F.array_sort(F.collect_list(F.struct("file", "line"))).alias("evidence")
    )
    edges = result.edges.join(proof, edge_ops.PAIR).withColumn("kind", F.lit(EDGE_KIND)).orderBy(
        "source", "target", "kind"
    )
    node_rows = _rows(nodes)
    finding_rank = F.when(F.col("severity") == SEVERITIES[0], 0).otherwise(1)
    findings = _rows(result.findings.orderBy(finding_rank, "code", "id"))
    edge_rows = _rows(edges)

    def number(kind: str) -> int:
        return sum(row["kind"] == kind for row in node_rows)

    return {
        "schema_version": SCHEMA_VERSION,
        "repo": {"root": ".", "commit": commit, "generated_at": generated_at},
        "nodes": node_rows,
        "edges": edge_rows,
        "levels": {
            "system": [row["id"] for row in node_rows if row["kind"] == "component"],
            "component": {r["id"]: r["children"] for r in node_rows if r["kind"] == "component"},
            "module": {r["id"]: r["children"] for r in node_rows if r["kind"] == "module"},
        },
        "capabilities": {"supported_edge_kinds": [EDGE_KIND]},
        "audit": {
            "ruleset": RULESET,
            "summary": {
                "files": number("file"), "modules": number("module"), "components": number("component"),
                "edges": len(edge_rows),
                "warnings": sum(f["severity"] == "warning" for f in findings),
                "notices": sum(f["severity"] == "notice" for f in findings),
            },
            "findings": findings,
        },
    }


def write_json(document: dict, path: str | Path) -> None:
    write_atomically([json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False), "\n"], path)


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, at, line): a flowchart as ordered lines, nodes before edges."""
    shown = edges.withColumn("_label", mermaid_label(F.col("label")))
    arrow = F.when(F.length("_label") > 0, F.concat(F.lit('|"'), "_label", F.lit('"|'))).otherwise("")
    node_lines = nodes.select(
        F.lit(1).alias("part"), F.col("id").alias("at"),
        F.concat(F.lit("  "), mermaid_id(F.col("id")), F.lit('["'), mermaid_label(F.col("label")), F.lit('"]')).alias("line"),
    )
    edge_lines = shown.select(
        F.lit(2).alias("part"), F.concat_ws("\0", "source", "target").alias("at"),
        F.concat(F.lit("  "), mermaid_id(F.col("source")), F.lit(" -->"), arrow, F.lit(" "),
                 mermaid_id(F.col("target"))).alias("line"),
    )
    return node_lines.unionByName(edge_lines)


def write_mermaid(nodes: DataFrame, edges: DataFrame, path: str | Path) -> None:
    ordered = mermaid_lines(nodes, edges).orderBy("part", "at").toLocalIterator()
    write_atomically(["flowchart LR\n", *(row.line + "\n" for row in ordered)], path)
