"""Communities of a weighted graph, kept inside directory anchors.

Modularity is a sum over communities, and a move changes only the two it touches. So
communities are dealt to blocks, each whole in one block, and a task moves the nodes of its
block one after another between the communities there: what blocks gain adds up, however
many run at once. Only nodes that want to move, and those nearest to it as far as a block
holds them, are rows of a block; the others count by the mass of their community and by
links to it. So a block of bounded size holds many communities, and all of them once few
nodes want to move. Every turn deals anew and brings communities together with those their
nodes want to go to. Where blocks gain nothing (communities too large for
one), one half of the nodes that want to move (by a hash of node and turn) does so; the
result counts only if modularity grew. Where it did not, because moves got in each other's
way, those moves are made that are the best of both communities they touch: no two of
them share a community, so each gains what it promised. Either way modularity grows
with every step, which is why the search ends, and it ends only when no single move
gains anything. Before that, once few nodes still want to move, communities are contracted
and the same runs on the smaller graph; a graph that fits into a block is searched by one task.
A larger one is never gathered; what fits into no block is joins and aggregates over links.
Nodes are numbered by name first, so that rows are numbers.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.operators import blocks, ranking
from archtrail.session import cut_lineage

# A move must gain more than this share of the total weight.
SMALLEST_GAIN = 1e-9
# Rows (nodes and ends of links) that one task moves nodes among.
BLOCK_ROWS = 250_000
# Communities are contracted once fewer than this share of the nodes want to move.
FEW_MOVERS = 0.3
STATE = ["node", "degree", "loops", "rows", "community"]
# What the best move gains over staying, or lacks (in half powers of two); this for those that gain.
GAINS = -1000


def _both_ways(links: DataFrame) -> DataFrame:
    """low, high, weight → node, other, weight in both directions; a loop counts twice."""
    forth = links.select(F.col("low").alias("node"), F.col("high").alias("other"), "weight")
    back = links.select(F.col("high").alias("node"), F.col("low").alias("other"), "weight")
    return forth.unionByName(back)


def _offers(links: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """Per node its community and what it gains by staying and by its best move.

    Only links between communities are summed up; what a node shares with its own is the rest."""
    masses = state.groupBy("community").agg(F.sum("degree").alias("mass"))
    held = cut_lineage(state.join(masses, "community").select(*STATE, "mass"))
    at = lambda end: held.select(F.col("node").alias(end), F.col("community").alias(f"_{end}"), F.col("mass").alias(f"_{end}_mass"))
    met = links.where("low <> high").join(at("low"), "low").join(at("high"), "high").where("_low <> _high")
    sides = [
        F.struct(F.col(node).alias("node"), F.col(f"_{end}").alias("near"), F.col(f"_{end}_mass").alias("_mass"), F.col("weight").alias("shared"))
        for node, end in (("low", "high"), ("high", "low"))
    ]
    options = met.select(F.inline(F.array(*sides))).groupBy("node", "near").agg(F.sum("shared").alias("shared"), F.max("_mass").alias("_mass"))
    gain = F.col("shared") - F.col("degree") * F.col("_mass") / F.lit(total)
    away = options.join(held.select("node", "degree"), "node").select("node", "near", "shared", gain.alias("gain")).groupBy("node").agg(
        F.max("gain").alias("best"),
        F.min_by("near", F.struct(-F.round("gain", 9), F.col("near"))).alias("to"),
        F.sum("shared").alias("_away"),
    )
    inside = F.col("degree") - F.col("loops") - F.coalesce("_away", F.lit(0.0))
    stay = F.col("inside") - F.col("degree") * (F.col("mass") - F.col("degree")) / F.lit(total)
    return cut_lineage(held.join(away, "node", "left").withColumn("inside", inside).select(
        *STATE, "mass", "inside", stay.alias("now"), "best", "to"
    ))


def _value(best: DataFrame, total: float) -> float:
    """Modularity (times twice the weight, up to a constant)."""
    each = best.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("degree").alias("mass"))
    return each.agg(F.sum(F.col("inside") - F.col("mass") * F.col("mass") / F.lit(total))).first()[0] or 0.0


def _deal(best: DataFrame, movers: DataFrame, count: int, turn: int) -> DataFrame:
    """(community, block): communities next to one their best mover wants to go to.

    By a coin a community waits or goes to the one it wants, if that waits. Where more want
    to than a block holds, a share does. One whose movers are more than a block gets none."""
    coin = F.pmod(F.xxhash64(F.lit(turn), "community"), F.lit(2)) == 0
    wish = movers.groupBy("community").agg(
        F.max_by("to", F.struct(F.col("best") - F.col("now"), F.col("node"))).alias("_want"), F.sum("rows").alias("rows")
    )
    sizes = best.select("community").distinct().join(wish, "community", "left").select(
        "community", "_want", F.coalesce("rows", F.lit(0)).alias("rows"), coin.alias("_waits")
    )
    known = cut_lineage(sizes.where(F.col("rows") <= BLOCK_ROWS))
    waiting = known.where("_waits").select(F.col("community").alias("_want"), F.col("rows").alias("_held"))
    going = known.where("NOT _waits").join(waiting, "_want").select("community", "_want", "rows", "_held")
    asked = going.groupBy("_want").agg((F.sum("rows") + F.max("_held")).alias("_asked"))
    share = F.greatest(F.ceil(F.col("_asked") / F.lit(BLOCK_ROWS)), F.lit(1))
    let_in = going.join(asked, "_want").where(F.pmod(F.xxhash64("community", F.lit(turn)), share) == 0)
    key = F.coalesce("_want", "community")
    return cut_lineage(known.select("community").join(let_in.select("community", "_want"), "community", "left").select(
        "community", F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(count)).alias("block")
    ))


def _moved_in_blocks(links: DataFrame, best: DataFrame, movers: DataFrame, total: float, count: int, turn: int) -> DataFrame:
    """(node, to): moves of ``movers`` inside blocks, one after another, each with a gain."""
    there = best.select(F.col("node").alias("other"), "community", "mass")
    if count == 1:
        placed = movers.withColumn("block", F.lit(0).cast("bigint"))
    else:
        dealt = _deal(best, movers, count, turn)
        placed = movers.join(dealt, "community")
        there = there.join(dealt.withColumnRenamed("block", "_block"), "community")
    near = _both_ways(links.where("low <> high")).join(placed.select("node", "block"), "node").join(there, "other")
    if count > 1:
        near = near.where("block = _block")
    rows = placed.select("block", "node", F.lit(None).cast("bigint").alias("other"), "community", "mass", F.col("degree").alias("weight")).unionByName(
        near.select("block", "node", "other", "community", "mass", "weight")
    )
    return cut_lineage(rows.groupBy("block").applyInArrow(
        blocks.move_nodes(total, SMALLEST_GAIN * total), "node long, to long"
    ))


def _apart(movers: DataFrame) -> DataFrame:
    """Movers that are first, by gain and then name, in both communities they touch."""
    worth = F.struct(F.col("best") - F.col("now"), F.col("node"))
    touched = movers.select("node", worth.alias("_worth"), F.explode(F.array("community", "to")).alias("_at"))
    first = touched.groupBy("_at").agg(F.max("_worth").alias("_first"))
    held = touched.join(first, "_at").where(F.col("_worth") == F.col("_first")).groupBy("node").count()
    return held.where("count = 2").select("node")


def _moved(best: DataFrame, movers: DataFrame) -> DataFrame:
    going = movers.select("node", F.col("to").alias("_to"))
    return best.join(going, "node", "left").withColumn("community", F.coalesce("_to", "community")).select(*STATE)


def _degrees(links: DataFrame) -> DataFrame:
    """Nodes with their degree, the part of it that is a link to themselves, and rows."""
    loop = F.when(F.col("node") == F.col("other"), F.col("weight")).otherwise(0.0)
    return cut_lineage(_both_ways(links).groupBy("node").agg(
        F.sum("weight").alias("degree"), F.sum(loop).alias("loops"), (F.count(F.lit(1)) + 1).alias("rows")
    ))


def _move_nodes(links: DataFrame, degrees: DataFrame, start: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(node, community) and whether anything moved.

    The search begins with every node on its own and goes on until few nodes gain by a move, or
    with ``start`` (node, community) and goes on until none does."""
    total = degrees.agg(F.sum("degree")).first()[0]
    least = SMALLEST_GAIN * total
    alone = degrees.withColumn("community", F.col("node"))
    best = _offers(links, (alone if start is None else degrees.join(start, "node")).select(*STATE), total)
    gains = F.col("best") > F.col("now") + F.lit(least)
    lacks = F.floor(2 * F.log2(F.greatest(F.col("now") - F.col("best"), F.lit(least / 1000)))).cast("int")
    turn = 0
    while True:
        # Nodes without a link to another community have nothing to gain or lack.
        best = best.withColumn("lacks", F.when(gains, F.lit(GAINS)).when(F.col("best").isNotNull(), lacks))
        sizes = best.groupBy("lacks").agg(F.count(F.lit(1)).alias("nodes"), F.sum("rows").alias("rows")).collect()
        wanting = {row.lacks: row.rows for row in sizes if row.lacks is not None}
        few = start is None and turn and sum(row.nodes for row in sizes if row.lacks == GAINS) < FEW_MOVERS * sum(row.nodes for row in sizes)
        if GAINS not in wanting or few:
            return best.select("node", "community"), turn > 0
        turn += 1
        count, limit, held = ceil(wanting[GAINS] / BLOCK_ROWS), GAINS, 0
        for lack, rows in sorted(wanting.items()):
            held += rows
            if held > BLOCK_ROWS:
                break
            limit = lack
        movers = best.where(F.col("lacks") == GAINS)
        settled = _moved_in_blocks(links, best, best.where(F.col("lacks") <= limit), total, count, turn)
        if not settled.isEmpty():
            best = _offers(links, _moved(best, settled), total)
        else:
            half = movers.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
            tried = _offers(links, _moved(best, half), total)
            if _value(tried, total) <= _value(best, total) + least:
                going = movers.join(_apart(movers), "node", "left_semi")
                tried = _offers(links, _moved(best, going), total)
            best = tried


def _contracted(links: DataFrame, homes: DataFrame) -> DataFrame:
    low = homes.select(F.col("node").alias("low"), F.col("community").alias("_low"))
    high = homes.select(F.col("node").alias("high"), F.col("community").alias("_high"))
    return cut_lineage(
        links.join(low, "low")
        .join(high, "high")
        .groupBy(F.least("_low", "_high").alias("low"), F.greatest("_low", "_high").alias("high"))
        .agg(F.sum("weight").alias("weight"))
    )


def _fits(links: DataFrame) -> bool:
    """Whether all nodes and ends of links are at most a block."""
    if links.count() * 2 > BLOCK_ROWS:
        return False
    return _both_ways(links).groupBy("node").count().agg(F.sum(F.col("count") + 1)).first()[0] <= BLOCK_ROWS


def _searched(links: DataFrame) -> DataFrame:
    """(node, community) of a graph that fits into a block, by one task."""
    whole = links.withColumn("_block", F.lit(0))
    return cut_lineage(whole.groupBy("_block").applyInArrow(blocks.search(SMALLEST_GAIN), "node long, community long"))


def _upper(assigned: DataFrame, moved: DataFrame) -> DataFrame:
    outer = moved.select(F.col("node").alias("community"), F.col("community").alias("_outer"))
    return cut_lineage(assigned.join(outer, "community").select("node", F.col("_outer").alias("community")))


def _found(links: DataFrame) -> DataFrame:
    """(node, community) of numbered nodes. Nodes move, then communities as wholes, level by
    level; when those rest, nodes may move again out of what came together. The end is where
    neither a node nor a community gains by a move; modularity grew at every step before."""
    if _fits(links):
        return _searched(links)
    degrees = _degrees(links)
    assigned, changed = _move_nodes(links, degrees)
    first = True
    while changed:
        level, merged = _contracted(links, assigned), False
        while not _fits(level):  # every level but the last has fewer nodes
            moved, any_move = _move_nodes(level, _degrees(level))
            if not any_move:
                break
            merged = True
            assigned, level = _upper(assigned, moved), _contracted(level, moved)
        else:
            moved = _searched(level)
            if not moved.where("node <> community").isEmpty():
                merged, assigned = True, _upper(assigned, moved)
        if not merged and not first:
            break
        first = False
        assigned, changed = _move_nodes(links, degrees, assigned)
    return assigned


def communities(links: DataFrame) -> DataFrame:
    """(node, community) for ``links(low, high, weight)``; isolated nodes do not
    occur. The community is named by its smallest node."""
    links = cut_lineage(links)
    nodes = links.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    numbers = cut_lineage(ranking.with_position(nodes, F.col("node"), name="number"))
    low = numbers.select(F.col("node").alias("low"), F.col("number").alias("_low"))
    high = numbers.select(F.col("node").alias("high"), F.col("number").alias("_high"))
    numbered = cut_lineage(links.join(low, "low").join(high, "high").select(
        F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("weight").cast("double").alias("weight")
    ))
    found = _found(numbered)
    first = found.groupBy("community").agg(F.min("node").alias("number"))
    names = first.join(numbers, "number").select("community", F.col("node").alias("_name"))
    named = found.withColumnRenamed("node", "number").join(names, "community").select("number", "_name")
    return numbers.join(named, "number").select("node", F.col("_name").alias("community"))


def anchored_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group): communities split by anchor, isolated nodes attached.

    ``nodes``: id, anchor. An isolated node goes to the group of its anchor with
    the most members (ties: smallest first member). That group stays the largest
    as nodes join it, so all isolated nodes of an anchor go to the same one and
    the attachment is a single join. Without a group the isolated nodes of an
    anchor form one. A group is named by its smallest node."""
    inside = nodes.select("id", "anchor")
    known = (
        links.where(F.col("low") != F.col("high"))
        .join(inside.select(F.col("id").alias("low")), "low", "left_semi")
        .join(inside.select(F.col("id").alias("high")), "high", "left_semi")
    )
    known = cut_lineage(known)
    found = cut_lineage(communities(known)) if not known.isEmpty() else None
    if found is None:
        alone, groups = inside, None
    else:
        placed = found.join(inside.withColumnRenamed("id", "node"), "node")
        names = placed.groupBy("community", "anchor").agg(
            F.min("node").alias("group"), F.count(F.lit(1)).alias("_size")
        )
        groups = cut_lineage(placed.join(names, ["community", "anchor"]).select("node", "anchor", "group"))
        alone = inside.join(groups.select(F.col("node").alias("id")), "id", "left_anti")
        largest = names.groupBy("anchor").agg(
            F.min_by("group", F.struct(-F.col("_size"), F.col("group"))).alias("group")
        )
    left = alone.groupBy("anchor").agg(F.min("id").alias("_own"))
    target = left if groups is None else left.join(largest, "anchor", "left")
    name: Column = F.col("_own") if groups is None else F.coalesce("group", "_own")
    homes = target.select("anchor", name.alias("_home"))
    attached = alone.join(homes, "anchor").select(F.col("id").alias("node"), F.col("_home").alias("group"))
    every = attached if groups is None else groups.select("node", "group").unionByName(attached)
    renamed = every.groupBy("group").agg(F.min("node").alias("_name"))
    return every.join(renamed, "group").select("node", F.col("_name").alias("group"))


def merge_groups(groups: DataFrame, key: DataFrame) -> DataFrame:
    """Join groups that share a key (``key``: group, key); named by smallest node."""
    keyed = groups.join(key, "group")
    names = keyed.groupBy("key").agg(F.min("node").alias("_name"))
    return keyed.join(names, "key").select("node", F.col("_name").alias("group"))
