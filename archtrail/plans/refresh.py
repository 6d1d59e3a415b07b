"""Bring a map up to date after a change of files, touching only what the change reaches.

A *snapshot* keeps, next to the map, the resolution with its inverse index and two counted
views over edge sites of all levels: how many sites stand behind (edge, file, line) and
behind (edge, symbol). A change becomes signed rows of edge sites; these go up through
membership and are added to the views, so an edge is made anew only where a row of it came
or went. While edge weights, files and roles are those of before, membership holds, and of
modules and components only those with a changed file get new totals, prose and findings.
Otherwise the layers are formed again, from sites that were still resolved incrementally.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.operators import audit, edges, incremental, lookups, naming
from archtrail.operators.facts import extract
from archtrail.plans import analyze as plan
from archtrail.session import cut_lineage

PAIR = edges.PAIR
SITE = ["source", "target", "file", "line", "symbols"]


@dataclass(frozen=True)
class Snapshot:
    """A map and what the next refresh needs."""

    digests: DataFrame  # path, digest
    headings: DataFrame
    resolution: lookups.Resolution
    map: plan.Map
    lines: DataFrame  # source, target, file, line, n: sites of all levels behind each line
    symbols: DataFrame  # source, target, symbol, n


@dataclass(frozen=True)
class Report:
    """What a refresh did."""

    layers: str  # reused | touched groups | formed again
    changes: DataFrame | None  # path, status
    again: DataFrame | None  # site, importer
    touched: DataFrame | None  # id of groups made anew


def _lines(sites: DataFrame) -> DataFrame:
    """Signed sites as counted lines."""
    return sites.groupBy(*PAIR, "file", "line").agg(F.sum("sign").alias("n"))


def _symbols(sites: DataFrame) -> DataFrame:
    return sites.select(*PAIR, F.explode("symbols").alias("symbol"), "sign").groupBy(*PAIR, "symbol").agg(F.sum("sign").alias("n"))


def _levels(sites: DataFrame, membership: DataFrame) -> DataFrame:
    """Sites between files, and the same between their modules and components."""
    of_files = membership.where("left(child, 5) = 'file:'")
    outer = membership.select(F.col("child").alias("_module"), F.col("parent").alias("_component"))
    to_component = of_files.join(outer, F.col("parent") == F.col("_module")).select("child", F.col("_component").alias("parent"))
    return sites.unionByName(edges.roll_sites(sites, of_files)).unionByName(edges.roll_sites(sites, to_component))


def _views(resolution: lookups.Resolution, built: plan.Map) -> tuple[DataFrame, DataFrame]:
    every = _levels(resolution.resolved.select(*SITE, F.lit(1).cast("long").alias("sign")), built.membership)
    return cut_lineage(_lines(every)), cut_lineage(_symbols(every))


def _layered(resolution: lookups.Resolution, sources: plan.Sources, generated: Sequence[str], vendored: Sequence[str]) -> plan.Map:
    sites = resolution.resolved.select(*SITE)
    files = plan.file_nodes(resolution.facts, sites, generated, vendored)
    modules, components = plan.layers(files, sites)
    named = plan.name_layers(files, modules, components, resolution.facts, sources.headings)
    return plan.assemble(files, sites, *named, resolution.facts)


def first(sources: plan.Sources, generated: Sequence[str] = (), vendored: Sequence[str] = ()) -> Snapshot:
    """Analyse everything and keep what a refresh needs."""
    facts = cut_lineage(extract(sources.files))
    resolution = lookups.resolve_all(facts, sources.markers, sources.configs)
    built = _layered(resolution, sources, generated, vendored)
    return Snapshot(facts.select("path", "digest"), cut_lineage(sources.headings), resolution, built, *_views(resolution, built))


def refresh(before: Snapshot, sources: plan.Sources, generated: Sequence[str] = (), vendored: Sequence[str] = ()) -> tuple[Snapshot, Report]:
    """The snapshot of ``sources``; equal to ``first(sources)``.

    Without a change the old snapshot comes back and no table of sites is read."""
    changes = cut_lineage(incremental.snapshot_changes(before.digests, incremental.fingerprint(sources.files)))
    old = before.resolution
    same_prose = incremental.same_structure(before.headings, sources.headings, ["directory", "heading"])
    same_settings = incremental.same_structure(old.markers, sources.markers, ["directory"]) and incremental.same_structure(old.configs, sources.configs, old.configs.columns)
    if changes.isEmpty() and same_prose and same_settings:
        return before, Report("reused", changes, None, None)
    facts, _ = incremental.take_over(sources.files, changes, old.facts)
    resolution, change = lookups.resolve_changed(old, facts, changes.select("path"), sources.markers, sources.configs)
    plain = replace(before, digests=facts.select("path", "digest"), headings=cut_lineage(sources.headings), resolution=resolution)

    # Files: only changed ones are described again; who imports whom did not change their fans unless an edge came or went.
    known = before.map.nodes.where("kind = 'file'")
    fresh = cut_lineage(plan.described(facts.join(changes.select("path"), "path", "left_semi"), generated, vendored))
    replaced = changes.select(F.concat(F.lit("file:"), "path").alias("id"))
    kept_roles = incremental.same_structure(known.join(replaced, "id", "left_semi"), fresh, ["id", "role"])
    signed = change.delta.select(*SITE, F.col("sign").cast("long").alias("sign"))
    if not kept_roles or not _same_weights(before, signed):
        built = _layered(resolution, sources, generated, vendored)
        lines, symbols = _views(resolution, built)
        return replace(plain, map=built, lines=lines, symbols=symbols), Report("formed again", changes, change.again, None)
    built, lines, symbols, touched = _touched(before, facts, fresh, replaced, signed, sources.headings, same_prose)
    return replace(plain, map=built, lines=lines, symbols=symbols), Report("touched groups", changes, change.again, touched)


def _added(view: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the counted view for the pairs of ``delta``, with the delta added."""
    pairs = delta.select(*PAIR).distinct()
    summed = view.join(pairs, PAIR, "left_semi").unionByName(delta).groupBy(*keys).agg(F.sum("n").alias("n"))
    return cut_lineage(summed.where("n > 0"))


def _same_weights(before: Snapshot, signed: DataFrame) -> bool:
    delta = _lines(signed).where("n <> 0")
    now = _added(before.lines, delta, [*PAIR, "file", "line"]).groupBy(*PAIR).agg(F.count("*").alias("weight"))
    was = before.map.edges.join(delta.select(*PAIR).distinct(), PAIR, "left_semi")
    return incremental.same_structure(was, now, [*PAIR, "weight"])


def _replace_pairs(view: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return view.join(pairs, PAIR, "left_anti").unionByName(rows.select(*view.columns))


def _touched(
    before: Snapshot, facts: DataFrame, fresh: DataFrame, replaced: DataFrame, signed: DataFrame, headings: DataFrame, same_prose: bool
) -> tuple[plan.Map, DataFrame, DataFrame, DataFrame]:
    """(map, lines, symbols, touched groups) where membership holds."""
    old = before.map
    delta = cut_lineage(_levels(signed, old.membership))
    line_delta, symbol_delta = _lines(delta).where("n <> 0"), _symbols(delta).where("n <> 0")
    new_lines = _added(before.lines, line_delta, [*PAIR, "file", "line"])
    new_symbols = _added(before.symbols, symbol_delta, [*PAIR, "symbol"])
    line_pairs, symbol_pairs = cut_lineage(line_delta.select(*PAIR).distinct()), cut_lineage(symbol_delta.select(*PAIR).distinct())
    lines, symbols = _replace_pairs(before.lines, new_lines, line_pairs), _replace_pairs(before.symbols, new_symbols, symbol_pairs)

    # Edges keep their weights; labels are made anew where a symbol came or went.
    between_files = F.col("source").startswith("file:")
    labels = edges.full_labels(new_symbols.where(between_files)).unionByName(edges.short_labels(new_symbols.where(~between_files)))
    relabelled = old.edges.join(symbol_pairs, PAIR, "left_semi").drop("label").join(labels, PAIR, "left")
    all_edges = cut_lineage(_replace_pairs(old.edges, relabelled, symbol_pairs))
    evidence = _replace_pairs(old.evidence, new_lines, line_pairs)

    fans = old.nodes.select("id", "fan_in", "fan_out")
    file_nodes = cut_lineage(fresh.join(fans, "id"))
    up = old.membership.select(F.col("child").alias("id"), "parent")
    modules = up.join(replaced, "id", "left_semi").select(F.col("parent").alias("id"))
    if not same_prose:  # which directories a heading speaks for is known to the groups only
        modules = old.nodes.where("kind = 'module'").select("id")
    modules = cut_lineage(modules.distinct())
    components = up.join(modules, "id", "left_semi").select(F.col("parent").alias("id")).distinct()
    touched = cut_lineage(modules.unionByName(components))

    changed_files = old.nodes.where("kind = 'file'").join(replaced, "id", "left_anti").unionByName(file_nodes.select(*old.nodes.columns))
    in_module = changed_files.join(up, "id").select("id", "path", "loc", "fan_in", F.col("parent").alias("group"))
    in_component = in_module.join(up.select(F.col("id").alias("group"), F.col("parent").alias("_outer")), "group").select("id", "path", "loc", "fan_in", F.col("_outer").alias("group"))
    members = cut_lineage(in_module.unionByName(in_component).join(touched.select(F.col("id").alias("group")), "group", "left_semi"))
    profiles = naming.group_profiles(members)
    texts = naming.summaries(profiles, members.select("group", "path"), facts.join(members.select("path").distinct(), "path", "left_semi"), headings)
    renewed = profiles.select(F.col("group").alias("id"), F.col("loc").alias("_loc")).join(texts.select(F.col("group").alias("id"), F.col("summary").alias("_summary")), "id")
    groups = old.nodes.join(renewed, "id").withColumn("loc", F.col("_loc")).withColumn("summary", F.col("_summary")).select(*old.nodes.columns)
    anew = cut_lineage(file_nodes.select(*old.nodes.columns).unionByName(groups))
    nodes = cut_lineage(old.nodes.join(anew.select("id"), "id", "left_anti").unionByName(anew))

    # Rules of one node are judged again for these nodes; cycles depend on edges that are as they were.
    sizes = audit.module_sizes(nodes.join(modules, "id", "left_semi").unionByName(nodes.where("kind = 'file'")), old.membership.join(modules.select(F.col("id").alias("parent")), "parent", "left_semi"))
    judged = audit.large_files(anew).unionByName(audit.large_modules(sizes)).unionByName(audit.thin_modules(sizes))
    own_rules = F.col("code") != "module-cycle"
    about = anew.select(F.col("id").alias("_about"))
    stays = old.findings.where(~own_rules).unionByName(old.findings.where(own_rules).join(about, F.col("node_ids")[0] == F.col("_about"), "left_anti"))
    findings = audit.ordered(stays.unionByName(judged))
    return plan.Map(nodes, all_edges, evidence, old.membership, findings, facts), lines, symbols, touched
