"""Optional prose: bounded prompts, checked answers, guarded write-back.

Prompts are one row per component, answers come back as tables and are checked as
such. Who answers them, and under what budget, is not this package's business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archtrail.operators.incremental import same_structure
from archtrail.operators.ranking import first_n

# ---------------------------------------------------------------------------
# Limits of prompts and answers.
MAX_PROMPT = 30_000
MAX_OUTPUT = 8_000
LEAST_OUTPUT = 600
OUTPUT_PER_ITEM = 120
LABEL_LIMIT, SUMMARY_LIMIT, EDGE_LABEL_LIMIT = 80, 400, 120
FILES_SHOWN = 12
# ---------------------------------------------------------------------------


def output_limit(items: int, limit: int = MAX_OUTPUT) -> int:
    return min(limit, max(LEAST_OUTPUT, OUTPUT_PER_ITEM * items))


def module_context(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(component, at, item): what a prompt may tell about each component, module
    rows before edges, each item as JSON."""
    modules = nodes.where(F.col("kind") == "module")
    homes = membership.join(modules.select(F.col("id").alias("child")), "child", "left_semi")
    files = nodes.where(F.col("kind") == "file").select(F.col("id").alias("child"), "path")
    listed = membership.join(files, "child")
    first = Window.partitionBy("parent").orderBy("child")
    shown = (
        listed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= FILES_SHOWN)
        .groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    )
    owner = homes.select(F.col("child").alias("id"), F.col("parent").alias("component"))
    rows = modules.join(owner, "id").join(shown, "id", "left")
    told = rows.select(
        "component", F.concat(F.lit("0"), "id").alias("at"),
        F.to_json(F.struct(
            F.coalesce("files", F.array().cast("array<string>")).alias("files"), "id",
            F.lit("module").alias("kind"), F.struct("fan_in", "fan_out", "loc").alias("metrics"), "summary",
        )).alias("item"),
    )
    source = owner.select(F.col("id").alias("source"), "component")
    target = owner.select(F.col("id").alias("target"), F.col("component").alias("_other"))
    inside = edges.join(source, "source").join(target, "target").where("component = _other")
    linked = inside.select(
        "component", F.concat(F.lit("1"), "source", F.lit("\0"), "target").alias("at"),
        F.to_json(F.struct(F.coalesce("label", F.lit("")).alias("identifiers"), F.lit("edge").alias("kind"),
                           "source", "target")).alias("item"),
    )
    return told.unionByName(linked)


def bounded_prompts(context: DataFrame, required: DataFrame, instruction: str, limit: int = MAX_PROMPT) -> DataFrame:
    """(component, prompt, items, omitted): as many context items, in order, as fit.

    ``required``: component, head (JSON that must be in). The length of a prompt
    with its first n items is head and frame plus a running sum, so the cut is a
    filter on that sum, and only what fits is gathered."""
    # An item is at least two characters, so no more than half the limit can fit.
    # Cutting to that many per component first happens in the map tasks.
    totals = context.groupBy("component").agg(F.count(F.lit(1)).alias("_all"))
    context = first_n(context, ["component"], [F.col("at")], limit // 2)
    ordered = Window.partitionBy("component").orderBy("at")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = len('{"context":[],"omitted_context":,"required":}') + len(instruction) + 1
    sized = (
        context.withColumn("_n", F.row_number().over(ordered))
        .withColumn("_sum", F.sum(F.length("item")).over(running) + F.col("_n") - 1)
        .join(totals, "component")
        .join(required, "component")
    )
    omitted: Column = (F.col("_all") - F.col("_n")).cast("string")
    fits = F.col("_sum") + F.length("head") + F.length(omitted) + F.lit(frame) <= limit
    # The first item that does not fit ends the list.
    first_out = F.min(F.when(~fits, F.col("_n"))).over(Window.partitionBy("component"))
    kept = sized.withColumn("_out", first_out).where(F.col("_out").isNull() | (F.col("_n") < F.col("_out")))
    gathered = kept.groupBy("component").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "item"))), lambda row: row["item"]).alias("items")
    )
    joined = required.join(gathered, "component", "left").join(totals, "component", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    left_out = F.coalesce("_all", F.lit(0)) - F.size(items)
    prompt = F.concat(
        F.lit(instruction + '\n{"context":['), F.array_join(items, ","), F.lit('],"omitted_context":'),
        left_out.cast("string"), F.lit(',"required":'), "head", F.lit("}"),
    )
    return joined.select("component", prompt.alias("prompt"), items.alias("items"), left_out.alias("omitted"))


def answer_violations(prompts: DataFrame, expected: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(component, subject, rule) for every answer row that may not be written back.

    ``prompts``: component, items (what was shown). ``expected``: component, id. ``nodes``:
    component, id, label, summary. ``links``: component, source, target, label. Every
    expected id is named exactly once; links are among those shown, once each; texts
    are neither empty nor overlong. All of it is joins and counts."""
    wanted = expected.groupBy("component", "id").agg(F.lit(1).alias("_asked"))
    named = nodes.groupBy("component", "id").agg(F.count(F.lit(1)).alias("_named"))
    ids = wanted.join(named, ["component", "id"], "full").where("_asked IS NULL OR _named IS NULL OR _named > 1")
    item = F.from_json("item", "kind string, source string, target string")
    offered = prompts.select("component", F.explode("items").alias("item")).select("component", item.alias("_i"))
    offered = offered.where("_i.kind = 'edge'").select("component", "_i.source", "_i.target", F.lit(1).alias("_offered")).distinct()
    pairs = links.groupBy("component", "source", "target").agg(F.count(F.lit(1)).alias("_times"))
    pairs = pairs.join(offered, ["component", "source", "target"], "left").where("_offered IS NULL OR _times > 1")
    bad = lambda name, most: F.coalesce(F.length(name), F.lit(0)).between(1, most) == F.lit(False)
    arrow = F.concat("source", F.lit(" -> "), "target")
    return (
        ids.select("component", F.col("id").alias("subject"), F.lit("every id is named exactly once").alias("rule"))
        .unionByName(pairs.select("component", arrow.alias("subject"), F.lit("links are those shown, once each").alias("rule")))
        .unionByName(nodes.where(bad("label", LABEL_LIMIT) | bad("summary", SUMMARY_LIMIT)).select("component", F.col("id").alias("subject"), F.lit("texts fit").alias("rule")))
        .unionByName(links.where(bad("label", EDGE_LABEL_LIMIT)).select("component", arrow.alias("subject"), F.lit("texts fit").alias("rule")))
    )


def write_back(
    nodes: DataFrame, edges: DataFrame, node_prose: DataFrame, edge_prose: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Put new prose in place; everything else must stay as it was."""
    new = node_prose.select("id", F.col("label").alias("_label"), F.col("summary").alias("_summary"))
    told = nodes.join(new, "id", "left")
    old_source = F.col("prose_source") if "prose_source" in nodes.columns else F.lit("heuristic")
    prose_source = F.when(F.col("_label").isNotNull(), "llm").otherwise(old_source)
    enriched_nodes = (
        told.withColumn("prose_source", prose_source)
        .withColumn("label", F.coalesce("_label", "label"))
        .withColumn("summary", F.coalesce("_summary", "summary"))
        .drop("_label", "_summary")
    )
    labels = edge_prose.select("source", "target", F.col("label").alias("_label"))
    enriched_edges = (
        edges.join(labels, ["source", "target"], "left")
        .withColumn("label", F.coalesce("_label", "label"))
        .drop("_label")
    )
    prose = {"label", "summary", "prose_source"}
    kept = [name for name in nodes.columns if name not in prose]
    if not same_structure(nodes, enriched_nodes, kept):
        raise ValueError("enrichment changed more than prose")
    kept_edges = [name for name in edges.columns if name not in prose]
    if not same_structure(edges, enriched_edges, kept_edges):
        raise ValueError("enrichment changed the edges")
    return enriched_nodes, enriched_edges


def call_costs(records: DataFrame) -> DataFrame:
    """Calls (call, purpose, cost, cached) per purpose with their total cost."""
    return records.groupBy("purpose").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"), F.sum("cost").alias("cost")
    )
