"""Map-health rules as aggregates over nodes and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.functions.text import thousands
from archtrail.operators.edges import edges_among

# ---------------------------------------------------------------------------
# Fixed values of rule set 1.
LARGE_FILE_LOC = 800
LARGE_MODULE_FILES = 15
LARGE_MODULE_LOC = 2500
THIN_MODULE_LOC = 25
SEVERITY_ORDER = ("warning", "notice")
# ---------------------------------------------------------------------------


def _text(*parts):
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _finding(code: str, severity: str, message, evidence) -> list:
    return [
        F.concat(F.lit(f"{code}:"), "id").alias("id"),
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.array("id").alias("node_ids"),
        F.array(*evidence).alias("evidence"),
    ]


def large_files(nodes: DataFrame) -> DataFrame:
    """Source files at or above the line limit. ``nodes``: id, kind, role, label, loc."""
    hit = nodes.where(
        (F.col("kind") == "file") & (F.col("role") == "source") & (F.col("loc") >= LARGE_FILE_LOC)
    )
    message = _text(
        F.col("label"), " has ", thousands(F.col("loc")),
        " LOC; inspect it for multiple responsibilities.",
    )
    evidence = [_text("loc=", F.col("loc").cast("string")), F.lit(f"warning threshold={LARGE_FILE_LOC}")]
    return hit.select(*_finding("large-file", "warning", message, evidence))


def module_sizes(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Modules with the number of source files directly in them."""
    files = nodes.where((F.col("kind") == "file") & (F.col("role") == "source"))
    counted = (
        membership.join(files.select(F.col("id").alias("child")), "child", "left_semi")
        .groupBy(F.col("parent").alias("id"))
        .agg(F.count(F.lit(1)).alias("source_files"))
    )
    modules = nodes.where(F.col("kind") == "module").select("id", "label", "loc")
    return modules.join(counted, "id", "left").na.fill(0, ["source_files"])


def large_modules(sizes: DataFrame) -> DataFrame:
    hit = sizes.where(
        (F.col("source_files") >= LARGE_MODULE_FILES) | (F.col("loc") >= LARGE_MODULE_LOC)
    )
    files = F.col("source_files").cast("string")
    message = _text(
        F.col("label"), " contains ", files, " source files and ", thousands(F.col("loc")),
        " LOC; inspect this boundary for hidden submodules.",
    )
    evidence = [
        _text("source files=", files),
        _text("loc=", F.col("loc").cast("string")),
        F.lit(f"warning thresholds={LARGE_MODULE_FILES} files or {LARGE_MODULE_LOC} LOC"),
    ]
    return hit.select(*_finding("large-module", "warning", message, evidence))


def thin_modules(sizes: DataFrame) -> DataFrame:
    hit = sizes.where((F.col("source_files") == 1) & (F.col("loc") <= THIN_MODULE_LOC))
    loc = F.col("loc").cast("string")
    message = _text(
        F.col("label"), " is a ", loc, "-LOC singleton module; it may be architectural noise."
    )
    evidence = [
        F.lit("source files=1"),
        _text("loc=", loc),
        F.lit(f"notice threshold={THIN_MODULE_LOC} LOC"),
    ]
    return hit.select(*_finding("thin-module", "notice", message, evidence))


def module_cycle_members(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, id) for modules on a cycle; a self-dependency counts.

    ``components``: node, component as computed for the module level."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    loops = (
        edges.where(F.col("source") == F.col("target"))
        .select(F.col("source").alias("node"))
        .distinct()
        .withColumn("_loop", F.lit(True))
    )
    return (
        components.join(sizes, "component")
        .join(loops, "node", "left")
        .where((F.col("_size") > 1) | F.col("_loop"))
        .select("component", F.col("node").alias("id"))
    )


def module_cycles(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One finding per module cycle. Its text lists every module of the cycle, so
    the row is as wide as the finding itself; nothing else is gathered."""
    labels = nodes.select("id", F.col("label").alias("_label"))
    named = members.join(labels, "id")
    regions = named.groupBy("component").agg(
        F.array_sort(F.collect_list(F.struct("id", "_label"))).alias("_members")
    )
    source = named.select(
        F.col("id").alias("source"), "component", F.col("_label").alias("_from")
    )
    target = named.select(
        F.col("id").alias("target"), F.col("component").alias("_other"), F.col("_label").alias("_to")
    )
    inside = (
        edges.join(source, "source").join(target, "target").where(F.col("component") == F.col("_other"))
    )
    line = _text(
        F.col("_from"), " -> ", F.col("_to"), ": ", F.col("weight").cast("string"), " imports site(s)"
    )
    proof = inside.groupBy("component").agg(
        F.array_sort(F.collect_list(F.struct("source", "target", line.alias("_line")))).alias("_proof")
    )
    names = F.transform("_members", lambda member: member["_label"])
    leading = F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", ")
    last = F.element_at(names, -1)
    listed = F.when(F.size(names) == 1, last).otherwise(F.concat(leading, F.lit(" and "), last))
    return regions.join(proof, "component", "left").select(
        F.concat(F.lit("module-cycle:"), F.col("_members")[0]["id"]).alias("id"),
        F.lit("module-cycle").alias("code"),
        F.lit("warning").alias("severity"),
        F.concat(listed, F.lit(" participate in a module dependency cycle.")).alias("message"),
        F.transform("_members", lambda member: member["id"]).alias("node_ids"),
        F.transform("_proof", lambda row: row["_line"]).alias("evidence"),
    )


def audit(nodes: DataFrame, membership: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """All findings, warnings first, then by code and id."""
    sizes = module_sizes(nodes, membership)
    modules = nodes.where(F.col("kind") == "module")
    module_edges = edges_among(edges, modules)
    members = module_cycle_members(components, module_edges)
    findings = (
        large_files(nodes)
        .unionByName(large_modules(sizes))
        .unionByName(thin_modules(sizes))
        .unionByName(module_cycles(members, nodes, module_edges))
    )
    return ordered(findings)


def ordered(findings: DataFrame) -> DataFrame:
    """Warnings first, then by code and id."""
    severity = F.when(F.col("severity") == SEVERITY_ORDER[0], 0).otherwise(1)
    return findings.orderBy(severity, "code", "id")


def audit_summary(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counts from one pass over the tagged rows of all three tables."""
    tagged = (
        nodes.select(F.col("kind").alias("tag"))
        .unionByName(edges.select(F.lit("edge").alias("tag")))
        .unionByName(findings.select(F.col("severity").alias("tag")))
    )
    counted = {
        "files": "file",
        "modules": "module",
        "components": "component",
        "edges": "edge",
        "warnings": "warning",
        "notices": "notice",
    }
    return tagged.agg(*[F.count_if(F.col("tag") == tag).alias(name) for name, tag in counted.items()])
