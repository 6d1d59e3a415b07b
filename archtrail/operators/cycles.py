"""Strongly connected components, one cycle per component, dependency order.

Every round joins the links with a per-node table, lets each task run its links
to a local fixpoint and merges the results by node. Neither the graph nor one
component is ever gathered in a task, and lineage is cut once per round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.operators import blocks
from archtrail.session import cut_lineage


def _distinct_links(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("source") != F.col("target")).select("source", "target").distinct()
    )


def _trim_fully(links: DataFrame) -> tuple[DataFrame, int]:
    """Drop links that cannot lie on a cycle, until none is left to drop."""
    links = cut_lineage(links)
    count = links.count()
    while count:
        into = links.groupBy(F.col("target").alias("source")).agg(F.count(F.lit(1)).alias("way_in"))
        out = links.groupBy(F.col("source").alias("target")).agg(F.count(F.lit(1)).alias("way_out"))
        counted = links.join(into, "source", "left").join(out, "target", "left")
        links = cut_lineage(
            counted.select(
                "source", "target", F.coalesce("way_in", F.lit(0)).alias("way_in"),
                F.coalesce("way_out", F.lit(0)).alias("way_out"),
            ).mapInArrow(
                blocks.peel, "source string, target string"
            )
        )
        left = links.count()
        if left == count:
            break
        count = left
    return links, count


def _contract_chains(links: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Replace chains by single links: (links left, chain nodes, ring nodes).

    A node with one link in and one out only passes on what comes along. Pointers
    over such nodes double in every round, so a chain of any length takes a
    logarithmic number. Chain nodes come as (node, behind, ahead) with the nearest
    nodes that are none; a ring of nothing but such nodes as (node, color)."""
    forth = links.select(F.col("source").alias("node"), F.col("target").alias("ahead"), F.lit(None).cast("string").alias("behind"))
    back = links.select(F.col("target").alias("node"), F.lit(None).cast("string").alias("ahead"), F.col("source").alias("behind"))
    ends = forth.unionByName(back).groupBy("node").agg(
        F.count("ahead").alias("_out"), F.count("behind").alias("_in"), F.min("ahead").alias("ahead"), F.min("behind").alias("behind")
    )
    inner = cut_lineage(ends.where("_out = 1 AND _in = 1").select("node", "ahead", "behind"))
    count = inner.count()
    if not count:
        return links, None, None
    state, covered = inner.withColumn("low", F.col("node")), 1
    while True:
        onward = state.select(F.col("node").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("low").alias("_low"))
        rearward = state.select(F.col("node").alias("behind"), F.col("behind").alias("_behind"))
        state = cut_lineage(state.join(onward, "ahead", "left").join(rearward, "behind", "left").select(
            "node", F.coalesce("_ahead", "ahead").alias("ahead"), F.coalesce("_behind", "behind").alias("behind"),
            F.least("low", F.coalesce("_low", "low")).alias("low"),
            (F.col("_ahead").isNotNull() | F.col("_behind").isNotNull()).alias("_going"),
        ))
        covered *= 2
        going = state.where("_going")
        if covered > count or going.isEmpty():  # longer than all chain nodes: only rings still go on
            break
    names = inner.select(F.col("node").alias("ahead"))
    rings = state.join(names, "ahead", "left_semi").select("node", F.col("low").alias("color"))
    chains = cut_lineage(state.join(names, "ahead", "left_anti").select("node", "behind", "ahead"))
    first = inner.join(names.withColumnRenamed("ahead", "behind"), "behind", "left_anti").select("node")
    through = chains.join(first, "node", "left_semi").select(F.col("behind").alias("source"), F.col("ahead").alias("target"))
    outside = links.join(inner.select(F.col("node").alias("source")), "source", "left_anti").join(
        inner.select(F.col("node").alias("target")), "target", "left_anti"
    )
    return cut_lineage(_distinct_links(outside.select("source", "target").unionByName(through))), chains, cut_lineage(rings)


def _with_chains(settled: DataFrame, chains: DataFrame) -> DataFrame:
    """Add chain nodes to (node, color): one whose ends are of one component is of it too."""
    behind = settled.select(F.col("node").alias("behind"), F.col("color").alias("_from"))
    ahead = settled.select(F.col("node").alias("ahead"), F.col("color").alias("_to"))
    joined = chains.join(behind, "behind", "left").join(ahead, "ahead", "left").select(
        "node", F.coalesce("_from", "behind").alias("color"), F.coalesce("_to", "ahead").alias("_to")
    )
    inside = cut_lineage(joined.where(F.col("color") == F.col("_to")).select("node", "color"))
    # The end of a chain that closes over one node may not have been settled itself.
    closing = inside.select(F.col("color").alias("node"), "color").distinct().join(settled.select("node"), "node", "left_anti")
    return cut_lineage(settled.unionByName(inside).unionByName(closing))


def _spread(
    links: DataFrame,
    state: DataFrame,
    kernel: Callable,
    value_type: str,
    better: Callable[[Column, Column], Column],
    best: Callable[[str], Column],
    missing: Column | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Run ``kernel`` over links and node values until no value improves.

    ``state``: node, value. ``better(new, old)`` compares, ``best`` aggregates
    several proposals for a node. With ``missing``, sources without a value take
    part in the first round under that marker, so that a block can pass values on
    through them. ``links``: source, target and what else the kernel reads. From the second round on only links leaving a node that just
    improved are looked at. ``dealt``: values are large, but pack so well that their files look
    small to the planner; they are joined by shuffles and never sent through the driver."""
    links = links.hint("merge") if dealt else links
    sources = state.select(F.col("node").alias("source"), "value")
    active = links.join(sources, "source", "inner" if missing is None else "left")
    if missing is not None:
        active = active.withColumn("value", F.coalesce("value", missing))
    while True:
        proposed = (
            active.select(*links.columns, "value")
            .mapInArrow(kernel, f"node string, value {value_type}")
            .groupBy("node")
            .agg(best("value").alias("_proposed"))
        )
        old = F.col("value")
        moved = F.col("_proposed").isNotNull() & (old.isNull() | better(F.col("_proposed"), old))
        merged = cut_lineage(
            state.select("node", "value")
            .join(proposed, "node", "full")
            .select("node", F.when(moved, F.col("_proposed")).otherwise(old).alias("value"),
                    moved.alias("_moved"))
        )
        changed = merged.where("_moved")
        state = merged.select("node", "value")
        if changed.isEmpty():
            return state
        active = links.join(changed.select(F.col("node").alias("source"), "value"), "source")


def _greater(new: Column, old: Column) -> Column:
    return new > old


def _less(new: Column, old: Column) -> Column:
    return new < old


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) where ``component`` is the smallest node id of the
    strongly connected component. ``nodes`` has an ``id`` column.

    Chains are contracted first, so their length does not count. Then forward
    colouring and backward collection: after trimming, the highest id
    spreads along the links; the nodes of one colour that can reach the node
    the colour is named after are exactly that node's component. Links between
    colours can never be on a cycle and are dropped, then the rest repeats. Each
    round settles at least one component per colour, and most of a graph usually
    goes in the first."""
    links, layers, settled = cut_lineage(_distinct_links(edges)), [], []
    while True:
        links, chains, rings = _contract_chains(links)
        if chains is None:
            break
        layers.append(chains)
        settled.append(rings)
    links, count = _trim_fully(links)
    while count:
        ids = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        start = cut_lineage(ids.withColumn("value", F.col("node")))
        colored = _spread(links, start, blocks.spread_highest, "string", _greater, F.max)
        by_source = colored.select(F.col("node").alias("source"), F.col("value").alias("color"))
        by_target = colored.select(F.col("node").alias("target"), F.col("value").alias("_color"))
        inside = cut_lineage(
            links.join(by_source, "source")
            .join(by_target, "target")
            .where(F.col("color") == F.col("_color"))
            .select("source", "target", "color")
        )
        backward = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        roots = colored.where(F.col("node") == F.col("value")).select("node", F.lit(0).cast("bigint").alias("value"))
        reaching = _spread(
            backward, cut_lineage(roots), blocks.spread_distance, "bigint", _less, F.min,
            missing=F.lit(-1).cast("bigint"),
        ).select("node")
        members = cut_lineage(
            colored.join(reaching, "node", "left_semi").select("node", F.col("value").alias("color"))
        )
        settled.append(members)
        done = members.select(F.col("node").alias("source"))
        left = inside.join(done, "source", "left_anti").join(
            done.withColumnRenamed("source", "target"), "target", "left_anti"
        )
        links, count = _trim_fully(left.select("source", "target"))
    ids = nodes.select(F.col("id").alias("node"))
    if not settled:
        return ids.withColumn("component", F.col("node"))
    grouped = reduce(DataFrame.unionByName, settled)
    for chains in reversed(layers):
        grouped = _with_chains(grouped, chains)
    named = grouped.groupBy("color").agg(F.min("node").alias("component"))
    assigned = grouped.join(named, "color").select("node", "component")
    return cut_lineage(
        ids.join(assigned, "node", "left").select(
            "node", F.coalesce("component", "node").alias("component")
        )
    )


def cyclic_regions(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) restricted to components that contain a cycle."""
    loops = edges.where(F.col("source") == F.col("target")).select(F.col("source").alias("node"))
    large = components.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    several = large.where("_size > 1").select("component")
    return (
        components.join(several, "component", "left_semi")
        .unionByName(components.join(loops.distinct(), "node", "left_semi").select("component", "node"))
        .distinct()
        .select("node", "component")
    )


def _chain_ranks(links: DataFrame, fixed: DataFrame) -> DataFrame:
    """(node, behind, ahead, steps) for the nodes with one link in and one out that are not ``fixed(node)``.

    ``behind`` is the nearest node before it that is none, ``steps`` links away. Pointers
    double, so a chain takes a logarithmic number of rounds."""
    forth = links.select(F.col("source").alias("node"), F.col("target").alias("ahead"), F.lit(None).cast("string").alias("behind"))
    back = links.select(F.col("target").alias("node"), F.lit(None).cast("string").alias("ahead"), F.col("source").alias("behind"))
    ends = forth.unionByName(back).groupBy("node").agg(
        F.count("ahead").alias("_out"), F.count("behind").alias("_in"), F.min("ahead").alias("ahead"), F.min("behind").alias("behind")
    )
    inner = ends.where("_out = 1 AND _in = 1").join(fixed.select("node"), "node", "left_anti")
    state = cut_lineage(inner.select("node", "behind", "ahead", F.lit(1).cast("bigint").alias("steps")))
    while True:
        further = state.select(F.col("node").alias("behind"), F.col("behind").alias("_behind"), F.col("steps").alias("_steps"))
        state = cut_lineage(state.join(further, "behind", "left").select(
            "node", F.coalesce("_behind", "behind").alias("behind"), "ahead",
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_behind").isNotNull().alias("_going"),
        ))
        if state.where("_going").isEmpty():
            return state.drop("_going")
        state = state.drop("_going")


def _depths(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, value): fewest links from a root. Chains count as one link of their length."""
    chains = _chain_ranks(links, roots)
    names = chains.select("node")
    outer = links.join(names.withColumnRenamed("node", "source"), "source", "left_anti").join(
        names.withColumnRenamed("node", "target"), "target", "left_anti"
    ).select("source", "target", F.lit(1).cast("bigint").alias("weight"))
    last = chains.join(names.withColumnRenamed("node", "ahead"), "ahead", "left_anti")
    through = last.select(F.col("behind").alias("source"), F.col("ahead").alias("target"), (F.col("steps") + 1).alias("weight"))
    short = outer.unionByName(through).where("source <> target").groupBy("source", "target").agg(F.min("weight").alias("weight"))
    start = roots.select("node", F.lit(0).cast("bigint").alias("value"))
    depth = _spread(
        cut_lineage(short), cut_lineage(start), blocks.spread_weighted, "bigint", _less, F.min, missing=F.lit(-1).cast("bigint"),
    )
    below = chains.join(depth.withColumnRenamed("node", "behind"), "behind").select("node", (F.col("value") + F.col("steps")).alias("value"))
    return depth.unionByName(below)


def _on_the_way(start: DataFrame, before: DataFrame) -> DataFrame:
    """(component, node): all that pointers ``before`` lead to from ``start``, itself included.

    In round k the set is joined with the pointers of 2^k steps, so it doubles."""
    found, jump = start.select("component", "node"), cut_lineage(before)
    while True:
        new = cut_lineage(found.join(jump, ["component", "node"]).select("component", F.col("_via").alias("node")))
        if new.isEmpty():
            return found
        found = cut_lineage(found.unionByName(new).distinct())
        onward = jump.select("component", F.col("node").alias("_via"), F.col("_via").alias("_next"))
        jump = cut_lineage(jump.join(onward, ["component", "_via"]).select("component", "node", F.col("_next").alias("_via")))


def representative_cycles(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, position, node): for each cyclic component one shortest cycle
    through its smallest node, which stands at position 0.

    Distances from all smallest nodes spread at once; the cycle closes over the
    nearest (then smallest) node with a link back and is read backwards along the
    smallest predecessor one step closer. Chains are ranked and the way back is
    found by pointer doubling, so a long cycle takes few rounds; it comes as rows."""
    regions = cut_lineage(cyclic_regions(components, edges))
    owner = regions.select(F.col("node").alias("source"), "component")
    other = regions.select(F.col("node").alias("target"), F.col("component").alias("_other"))
    links = cut_lineage(
        edges.select("source", "target")
        .distinct()
        .join(owner, "source")
        .join(other, "target")
        .where(F.col("component") == F.col("_other"))
        .select("component", "source", "target")
    )
    roots = regions.where(F.col("node") == F.col("component")).select("node")
    depth = cut_lineage(_depths(links.where(F.col("source") != F.col("target")).select("source", "target"), roots))
    from_depth = depth.select(F.col("node").alias("source"), F.col("value").alias("depth"))
    at_depth = depth.select(F.col("node").alias("target"), F.col("value").alias("_depth"))
    measured = cut_lineage(links.join(from_depth, "source").join(at_depth, "target"))
    closing = cut_lineage(
        measured.where(F.col("target") == F.col("component"))
        .groupBy("component")
        .agg(F.min(F.struct("depth", "source")).alias("_end"))
        .select("component", F.col("_end.source").alias("node"), F.col("_end.depth").alias("depth"))
    )
    nearer = closing.select("component", F.col("depth").alias("_length"))
    before = (
        measured.where(F.col("depth") + 1 == F.col("_depth"))
        .join(nearer, "component").where(F.col("_depth") <= F.col("_length"))
        .groupBy("component", F.col("target").alias("node"))
        .agg(F.min("source").alias("_via"))
    )
    found = _on_the_way(closing, before)
    return found.join(depth, "node").select("component", F.col("value").alias("position"), "node")


def dependency_order_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, key): sorting by ``key`` and then ``node`` puts each
    dependency before its dependents and, whenever several groups are ready, the
    one with the smallest id first.

    ``edges`` point from a dependent to its dependency. That order, usually made
    by popping a heap, has a closed form on the condensed graph: a group's key is
    the descending chain of the ids it had to wait for, ending in itself. For a
    group ``v`` and each direct dependency ``d``, cut from the end of ``key(d)``
    the ids below ``v`` and append ``v``; the key of ``v`` is the largest such
    array. Keys spread like any other node value and the final order is an
    ordinary distributed sort instead of a sequential loop."""
    components = strong_components(nodes, edges)
    inside = components.select(F.col("node").alias("source"), F.col("component").alias("_from"))
    toward = components.select(F.col("node").alias("target"), F.col("component").alias("_to"))
    waits = cut_lineage(
        edges.select("source", "target")
        .join(inside, "source")
        .join(toward, "target")
        .where(F.col("_from") != F.col("_to"))
        .select(F.col("_to").alias("source"), F.col("_from").alias("target"))
        .distinct()
    )
    groups = components.select(F.col("component").alias("node")).distinct()
    start = cut_lineage(groups.withColumn("value", F.array("node")))
    keys = _spread(waits, start, blocks.spread_keys, "array<string>", _greater, F.max, dealt=True)
    return components.join(
        keys.select(F.col("node").alias("component"), F.col("value").alias("key")).hint("merge"), "component"
    ).select("node", "component", "key")
