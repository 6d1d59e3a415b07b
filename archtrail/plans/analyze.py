"""The whole analysis: source files in, layered map out.

A map is a handful of tables (``Map``). Nothing is collected; writing JSON is a
separate, explicit step (``archtrail.sources.artifacts``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.functions import paths
from archtrail.operators import audit, communities, cycles, edges, ignore, incremental, naming, resolve
from archtrail.operators.facts import extract, import_sites
from archtrail.session import cut_lineage
from archtrail.sources import tree


@dataclass(frozen=True)
class Sources:
    """What an analysis reads."""

    files: DataFrame  # path, content
    markers: DataFrame  # directory
    configs: DataFrame  # directory, base, pattern, target, ordinal
    headings: DataFrame  # directory, heading


@dataclass(frozen=True)
class Map:
    """A finished map."""

    nodes: DataFrame  # id, kind, role, label, summary, path, loc, fan_in, fan_out
    edges: DataFrame  # source, target, weight, label
    evidence: DataFrame  # source, target, file, line
    membership: DataFrame  # child, parent
    findings: DataFrame  # id, code, severity, message, node_ids, evidence
    facts: DataFrame  # per file, kept so that a later run parses only what changed


def tree_sources(spark: SparkSession, root: str | Path) -> Sources:
    """Sources of a directory tree."""
    listing = cut_lineage(tree.list_tree(spark, root))

    def of_kind(kind: str) -> DataFrame:
        return listing.where(F.col("kind") == kind).select("path")

    markers = of_kind("marker").select(paths.parent(F.col("path")).alias("directory")).distinct()
    return Sources(
        files=tree.read_contents(of_kind("source"), root),
        markers=markers,
        configs=tree.parse_configs(tree.read_contents(of_kind("config"), root)),
        headings=naming.readme_headings(tree.read_contents(of_kind("readme"), root)),
    )


def table_sources(files: DataFrame) -> Sources:
    """Sources from rows that already hold path and content; special files, ignore files
    among them, are found by name."""
    kinds = cut_lineage(tree.kinds_of(files.select("path"), ignore.rule_sets(files)))

    def of_kind(kind: str) -> DataFrame:
        return files.join(kinds.where(F.col("kind") == kind).select("path"), "path", "left_semi").select("path", "content")

    return Sources(
        files=of_kind("source"),
        markers=of_kind("marker").select(paths.parent(F.col("path")).alias("directory")).distinct(),
        configs=tree.parse_configs(of_kind("config")),
        headings=naming.readme_headings(of_kind("readme")),
    )


def described(facts: DataFrame, generated: Sequence[str] = (), vendored: Sequence[str] = ()) -> DataFrame:
    """File nodes without their metrics."""
    return facts.select(
        F.concat(F.lit("file:"), "path").alias("id"),
        F.lit("file").alias("kind"),
        paths.role(
            F.col("path"), [tree.path_pattern(p) for p in generated], [tree.path_pattern(p) for p in vendored]
        ).alias("role"),
        paths.basename(F.col("path")).alias("label"),
        F.lit("").alias("summary"),
        "path",
        "loc",
    )


def file_nodes(facts: DataFrame, sites: DataFrame, generated: Sequence[str] = (), vendored: Sequence[str] = ()) -> DataFrame:
    files = described(facts, generated, vendored)
    return cut_lineage(files.join(edges.fan_metrics(files, edges.edge_weights(sites)), "id"))


def file_graph(
    facts: DataFrame, sources: Sources, generated: Sequence[str] = (), vendored: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(file nodes, edge sites)."""
    sites = cut_lineage(
        resolve.resolve_sites(import_sites(facts), facts, sources.markers, sources.configs)
    )
    return file_nodes(facts, sites, generated, vendored), sites


def layers(files: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file → module group, module group → component group), groups named by
    their smallest member."""
    source_files = files.where(F.col("role") == "source").select(
        "id", "path", paths.module_anchor(F.col("path")).alias("anchor")
    )
    weights = cut_lineage(edges.undirected_weights(edges.edge_weights(sites)))
    groups = communities.anchored_groups(source_files, weights).withColumnRenamed("node", "id")
    located = groups.join(source_files.select("id", "path"), "id")
    directories = located.groupBy("group").agg(paths.common_directory(F.col("path")).alias("key"))
    modules = cut_lineage(
        communities.merge_groups(groups.withColumnRenamed("id", "node"), directories)
    )
    parents = modules.select(F.col("node").alias("child"), F.col("group").alias("parent"))
    upper = edges.undirected_weights(edges.edge_weights(edges.roll_sites(sites, parents)))
    first_path = modules.join(source_files.withColumnRenamed("id", "node"), "node").groupBy("group").agg(
        F.min("path").alias("path")
    )
    anchors = first_path.select(
        F.col("group").alias("id"), paths.component_anchor(F.col("path")).alias("anchor")
    )
    components = cut_lineage(communities.anchored_groups(anchors, cut_lineage(upper)))
    return modules, components


def name_layers(
    files: DataFrame, modules: DataFrame, components: DataFrame, facts: DataFrame, headings: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(module nodes, component nodes, membership) with labels, ids, summaries."""
    by_file = modules.join(files.select(F.col("id").alias("node"), "path", "loc", "fan_in"), "node")
    members = cut_lineage(by_file.select("node", "group", "path", "loc", "fan_in"))
    profiles = naming.group_profiles(members)
    named = naming.group_ids(
        "mod", naming.unique_labels(profiles), members.select("group", F.col("node").alias("child"))
    )
    texts = naming.summaries(profiles, members.select("group", "path"), facts, headings)
    module_nodes = cut_lineage(named.join(texts, "group"))

    upper = components.select(F.col("node").alias("_module"), F.col("group").alias("_component"))
    outer = cut_lineage(
        members.join(upper, members["group"] == upper["_module"]).select(
            F.col("_component").alias("group"), "_module", "path", "loc", "fan_in"
        )
    )
    module_labels = module_nodes.select(
        F.col("group").alias("_module"), F.col("label").alias("_label"), F.col("id").alias("_id")
    )
    single = (
        outer.select("group", "_module").distinct().join(module_labels, "_module")
        .groupBy("group").agg(F.count(F.lit(1)).alias("_modules"), F.min("_label").alias("_only"))
    )
    outer_profiles = (
        naming.group_profiles(outer)
        .join(single, "group")
        .withColumn("label", F.when(F.col("_modules") == 1, F.col("_only")).otherwise(F.col("label")))
        .drop("_modules", "_only")
    )
    children = outer.select("group", "_module").distinct().join(module_labels, "_module").select(
        "group", F.col("_id").alias("child")
    )
    # Groups are ordered by the id of their first child, as their labels are.
    outer_named = naming.group_ids("comp", naming.unique_labels(outer_profiles), children)
    outer_texts = naming.summaries(outer_profiles, outer.select("group", "path"), facts, headings)
    component_nodes = cut_lineage(outer_named.join(outer_texts, "group"))

    files_in = members.join(module_nodes.select("group", "id"), "group").select(
        F.col("node").alias("child"), F.col("id").alias("parent")
    )
    modules_in = children.join(component_nodes.select("group", "id"), "group").select(
        "child", F.col("id").alias("parent")
    )
    return module_nodes, component_nodes, cut_lineage(files_in.unionByName(modules_in))


def assemble(
    files: DataFrame, sites: DataFrame, module_nodes: DataFrame, component_nodes: DataFrame,
    membership: DataFrame, facts: DataFrame,
) -> Map:
    """Put the levels together: rolled edges, metrics, findings."""
    to_module = membership.join(files.select(F.col("id").alias("child")), "child", "left_semi")
    outer = membership.select(F.col("child").alias("_module"), F.col("parent").alias("_component"))
    to_component = to_module.join(outer, F.col("parent") == F.col("_module")).select(
        "child", F.col("_component").alias("parent")
    )
    # Component edges come from file sites too, so their symbols are complete.
    module_sites = edges.roll_sites(sites, to_module)
    component_sites = edges.roll_sites(sites, to_component)
    rolled = edges.build_edges(module_sites, "short").unionByName(
        edges.build_edges(component_sites, "short")
    )
    all_edges = cut_lineage(edges.build_edges(sites).unionByName(rolled))
    evidence = edges.evidence(sites).unionByName(edges.evidence(module_sites)).unionByName(
        edges.evidence(component_sites)
    )
    upper = [
        named.select(
            "id", F.lit(kind).alias("kind"), F.lit("source").alias("role"), "label", "summary",
            F.lit(None).cast("string").alias("path"), "loc",
        )
        for kind, named in (("module", module_nodes), ("component", component_nodes))
    ]
    grouped = upper[0].unionByName(upper[1])
    measured = grouped.join(edges.fan_metrics(grouped, rolled), "id")
    nodes = cut_lineage(files.unionByName(measured))
    modules = nodes.where(F.col("kind") == "module")
    regions = cycles.strong_components(modules, edges.edges_among(all_edges, modules))
    findings = audit.audit(nodes, membership, all_edges, regions)
    return Map(nodes, all_edges, evidence, membership, findings, facts)


def keeps_layers(files: DataFrame, sites: DataFrame, previous: Map) -> bool:
    """Whether files, roles and edge weights are those of an earlier map, so that
    its membership still holds."""
    known = previous.nodes.where(F.col("kind") == "file")
    if not incremental.same_structure(known, files, ["id", "role"]):
        return False
    old = previous.edges.join(known.select(F.col("id").alias("source")), "source", "left_semi")
    return incremental.same_structure(old, edges.edge_weights(sites), ["source", "target", "weight"])


def kept_layers(previous: Map) -> tuple[DataFrame, DataFrame]:
    """Layers of an earlier map in the form ``layers`` gives them."""
    files = previous.nodes.where(F.col("kind") == "file").select(F.col("id").alias("child"))
    of_files = previous.membership.join(files, "child", "left_semi")
    of_modules = previous.membership.join(files, "child", "left_anti")
    names = of_files.groupBy("parent").agg(F.min("child").alias("group"))
    modules = of_files.join(names, "parent").select(F.col("child").alias("node"), "group")
    inside = of_modules.join(
        names.select(F.col("parent").alias("child"), F.col("group").alias("node")), "child"
    )
    outer = inside.groupBy("parent").agg(F.min("node").alias("group"))
    return modules, inside.join(outer, "parent").select("node", "group")


def analyze(
    sources: Sources,
    generated: Sequence[str] = (),
    vendored: Sequence[str] = (),
    facts: DataFrame | None = None,
    previous: Map | None = None,
) -> Map:
    """Analyse ``sources``. ``facts`` of an earlier step are taken as they are, and
    the membership of a ``previous`` map is kept while it still holds."""
    facts = cut_lineage(extract(sources.files)) if facts is None else facts
    files, sites = file_graph(facts, sources, generated, vendored)
    if previous is not None and keeps_layers(files, sites, previous):
        modules, components = kept_layers(previous)
    else:
        modules, components = layers(files, sites)
    named = name_layers(files, modules, components, facts, sources.headings)
    return assemble(files, sites, *named, facts)
