"""Hierarchies as intervals: everything below a node is one range of numbers.

A tour through the forest gives each node its place ``enter`` and the place ``last`` of
the last node below it. Whether one node lies below another is then a comparison, the
total of a subtree the difference of two running totals, and all members of some nodes
an interval join. No table of (node, ancestor) rows is made, and depth costs rounds
only logarithmically.

Membership is a table ``child, parent``. Where a child is listed below several parents
the smallest counts. A node on a circle, or below one, has no root: it gets no places.
Null ids are no nodes. Repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.operators.ranking import running_totals, with_position
from archtrail.session import cut_lineage

# Widths of the ranges that intervals and places meet in. An interval goes by the smallest
# width that holds it, so it is compared with at most 32 times the places it contains; one
# longer than the largest width is written once per range, each of which it fills.
WIDTHS = (1, 16, 256, 4_096, 65_536)
# Links from which on a list is ranked by pointer doubling; it decides nothing but time.
FEW = 100_000


def _forest(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, parent, inner, place): all nodes, brothers side by side, those with children last."""
    single = membership.where("child IS NOT NULL AND parent IS NOT NULL").groupBy("child").agg(F.min("parent").alias("parent"))
    above = single.select(F.col("child").alias("id"), "parent")
    inner = single.select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    ids = nodes.where("id IS NOT NULL").select("id").unionByName(above.select("id")).unionByName(inner.select("id")).distinct()
    rows = ids.join(above, "id", "left").join(inner, "id", "left").select("id", "parent", F.coalesce("inner", F.lit(False)).alias("inner"))
    return cut_lineage(with_position(rows, F.col("parent"), F.col("inner"), F.col("id"), name="place"))


def _elements(inner: DataFrame, children: DataFrame) -> DataFrame:
    """(at, next, nodes, step): the tour as a linked list, coming to and leaving each inner node.

    An inner node at place p comes in at 2p and goes out at 2p + 1; leaves have no elements
    of their own, their parent's counts them. Place 0 is a root above all roots."""
    owner = inner.select(F.col("id").alias("parent"), F.col("place").alias("_up"))
    brother = inner.select((F.col("place") - 1).alias("place"), F.col("parent").alias("_same"), F.lit(True).alias("_brother"))
    together = F.col("_brother") & F.col("parent").eqNullSafe(F.col("_same"))
    known = (
        inner.join(owner, "parent", "left").join(brother, "place", "left")
        .join(children.withColumnRenamed("parent", "id"), "id", "left")
        .select(
            "place", "leaves", "_below",
            F.when(together, F.col("place") * 2 + 2).otherwise(F.coalesce("_up", F.lit(0)) * 2 + 1).alias("_after"),
        )
    )
    top = children.where("parent IS NULL").select(
        F.lit(0).cast("bigint").alias("place"), "leaves", "_below", F.lit(None).cast("bigint").alias("_after")
    )
    return known.unionByName(top).select(F.inline(F.array(
        F.struct((F.col("place") * 2).alias("at"), F.coalesce(F.col("_below") * 2, F.col("place") * 2 + 1).alias("next"),
                 (F.col("leaves") + 1).alias("nodes"), F.lit(1).cast("bigint").alias("step")),
        F.struct((F.col("place") * 2 + 1).alias("at"), F.col("_after").alias("next"),
                 F.lit(0).cast("bigint").alias("nodes"), F.lit(-1).cast("bigint").alias("step")),
    )))


def _doubled(elements: DataFrame) -> DataFrame:
    """Sums of ``nodes`` and ``step`` from each element to the end of its list, by pointer doubling.

    Elements of a circle never end; they are left out."""
    state = cut_lineage(elements)
    count, covered = state.count(), 1
    while covered <= count and not state.where("next IS NOT NULL").isEmpty():
        onward = state.select(F.col("at").alias("_to"), F.col("next").alias("_next"),
                              F.col("nodes").alias("_nodes"), F.col("step").alias("_step"))
        # Ended elements get a key each of their own, so that they do not all meet in one task.
        keyed = state.withColumn("_to", F.coalesce("next", -1 - F.col("at")))
        state = cut_lineage(keyed.join(onward, "_to", "left").select(
            "at", F.col("_next").alias("next"), (F.col("nodes") + F.coalesce("_nodes", F.lit(0))).alias("nodes"),
            (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step"),
        ))
        covered *= 2
    return state.where("next IS NULL")


def _contracted(state: DataFrame, turn: int) -> DataFrame:
    """The list with about a quarter of its elements taken up by the element before them.

    Every element has a coin that whoever points to it can work out. One that shows 0 takes up
    the next one if that shows 1; so no two neighbours go at once. Those taken up come with
    ``gone``, as they were. Other elements are not dealt out at all."""
    coin = lambda name: F.pmod(F.xxhash64(name, F.lit(turn)), F.lit(2)) == 1
    takes = F.col("next").isNotNull() & ~coin("at") & coin("next")
    before = state.where(takes).select(F.col("at").alias("_before"), F.col("next").alias("at"), F.col("nodes").alias("_nodes"), F.col("step").alias("_step"))
    met = state.where(coin("at")).join(before, "at", "left")
    own = F.struct("at", "next", "nodes", "step", F.col("_before").isNotNull().alias("gone"))
    longer = F.struct(
        F.col("_before").alias("at"), "next", (F.col("nodes") + F.col("_nodes")).alias("nodes"),
        (F.col("step") + F.col("_step")).alias("step"), F.lit(False).alias("gone"),
    )
    rows = met.select(F.inline(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, longer))))
    return rows.unionByName(state.where(~(takes | coin("at"))).withColumn("gone", F.lit(False)))


def _to_the_end(elements: DataFrame) -> DataFrame:
    """Sums of ``nodes`` and ``step`` from each element to the end of its list.

    Every element has at most one before it. The list shrinks by a constant share a round, so
    all rounds together cost a multiple of its length; only what is left, ``FEW`` links at
    most, is doubled. Then those taken up get their sums back from the element they pointed to.
    A circle shrinks to one element that points to itself and goes, with all it took up."""
    state, taken = cut_lineage(elements), []
    while state.where("next IS NOT NULL").count() > FEW:
        round_ = cut_lineage(_contracted(state, len(taken)))
        taken.append(round_.where("gone").drop("gone"))
        state = round_.where("NOT gone AND (next IS NULL OR next <> at)").drop("gone")
    known = _doubled(state).select("at", "nodes", "step")
    for gone in reversed(taken):
        onward = known.select(F.col("at").alias("next"), F.col("nodes").alias("_nodes"), F.col("step").alias("_step"))
        # The end of a list that was taken up keeps its own sums.
        ended = gone.where("next IS NULL").select("at", "nodes", "step")
        summed = gone.where("next IS NOT NULL").join(onward, "next").select(
            "at", (F.col("nodes") + F.col("_nodes")).alias("nodes"), (F.col("step") + F.col("_step")).alias("step")
        )
        known = known.unionByName(cut_lineage(summed.unionByName(ended)))
    return known


def places(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, enter, last, depth) for ``nodes(id)`` and all nodes that ``membership`` names.

    ``enter`` numbers the nodes from 1 so that a node is followed by all that is below it,
    up to ``last``; ``depth`` is 0 for a root. Only nodes with children are ranked by
    pointers; a leaf stands at its place among its brothers, so one parent may have any
    share of all rows."""
    forest = _forest(nodes, membership)
    inner = forest.where("inner").select("id", "parent", "place")
    children = cut_lineage(forest.groupBy("parent").agg(
        F.min("place").alias("first"), F.min(F.when(F.col("inner"), F.col("place"))).alias("_below"),
        F.count_if(~F.col("inner")).alias("leaves"),
    ))
    ranked = cut_lineage(_to_the_end(_elements(inner, children.drop("first"))))
    top = ranked.where("at = 0").select("nodes").first()
    count = top.nodes if top else 0
    comes = F.col("at") % 2 == 0
    numbered = ranked.groupBy(F.shiftright("at", 1).alias("place")).agg(
        (count - F.max(F.when(comes, F.col("nodes")))).alias("enter"),
        (count - 1 - F.max(F.when(~comes, F.col("nodes")))).alias("last"),
        (-1 - F.max(F.when(comes, F.col("step")))).alias("depth"),
    )
    named = cut_lineage(inner.join(numbered, "place").select("id", "enter", "last", "depth"))
    leaves = forest.where("NOT inner")
    owner = named.join(children.where("parent IS NOT NULL").select(F.col("parent").alias("id"), "first"), "id").select(
        F.col("id").alias("parent"), F.col("enter").alias("_enter"), F.col("depth").alias("_depth"), "first"
    )
    at = F.col("_enter") + 1 + F.col("place") - F.col("first")
    hung = leaves.join(owner, "parent").select("id", at.alias("enter"), at.alias("last"), (F.col("_depth") + 1).alias("depth"))
    free = leaves.where("parent IS NULL").select("id", F.col("place").alias("enter"), F.col("place").alias("last"), F.lit(0).cast("bigint").alias("depth"))
    return cut_lineage(named.unionByName(hung).unionByName(free).withColumnRenamed("id", "node"))


def members_below(labels: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(node, member): which of ``members(node)`` lie at or below which of ``wanted(node)``.

    An interval join of places: as much work as there are results, whatever the depth."""
    spans = labels.join(wanted.select("node").distinct(), "node", "left_semi")
    width = F.lit(WIDTHS[-1])
    for size in reversed(WIDTHS[:-1]):
        width = F.when(F.col("last") - F.col("enter") < size, F.lit(size)).otherwise(width)
    spans = spans.withColumn("_width", width).select(
        "node", "enter", "last", "_width",
        F.explode(F.sequence(F.expr("enter div _width"), F.expr("last div _width"))).alias("_range"),
    )
    spots = labels.join(members.select("node").distinct(), "node", "left_semi").select(
        F.col("node").alias("member"), F.col("enter").alias("_spot"),
        F.explode(F.array(*[F.lit(size) for size in WIDTHS])).alias("_width"),
    ).withColumn("_range", F.expr("_spot div _width"))
    met = spans.join(spots, ["_width", "_range"]).where("_spot BETWEEN enter AND last")
    return met.select("node", "member")


def subtree_totals(labels: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(node, *columns): sums of ``values(node, *columns)`` over each node and all below it.

    Whole numbers; nodes and values without a row or with null count as 0, several rows of
    one node are added. One sort by place and one join, at any depth."""
    single = values.groupBy("node").agg(*[F.sum(name).cast("bigint").alias(name) for name in columns])
    filled = labels.select("node", "enter", "last").join(single, "node", "left").na.fill(0, columns)
    running = cut_lineage(running_totals(filled, columns, F.col("enter")))
    own = running.where("enter = last").select("node", *columns)
    ends = running.select(F.col("enter").alias("last"), *[F.col(f"_to_{name}").alias(f"_end_{name}") for name in columns])
    spanned = running.where("enter < last").join(ends, "last").select(
        "node", *[(F.col(f"_end_{name}") - F.col(f"_to_{name}") + F.col(name)).alias(name) for name in columns]
    )
    return own.unionByName(spanned)


def nearest_stop(ids: DataFrame, membership: DataFrame, stops: DataFrame) -> DataFrame:
    """(node, stop): the closest of ``stops(id)`` at or above each of ``ids(node)``.

    Each node points to its parent, a stop to itself; pointers double until they rest, so
    the depth costs a logarithmic number of rounds. Nodes without a stop above them, also
    those on a circle without one, disappear."""
    rest = stops.where("id IS NOT NULL").select(F.col("id").alias("node")).distinct()
    single = membership.where("child IS NOT NULL AND parent IS NOT NULL").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("at"))
    moving = single.join(rest, "node", "left_anti").withColumn("done", F.lit(False))
    state = cut_lineage(moving.unionByName(rest.select("node", F.col("node").alias("at"), F.lit(True).alias("done"))))
    count, covered = state.count(), 1
    while covered <= count and not state.where("NOT done").isEmpty():
        onward = state.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        going = state.where("NOT done").select("node", "at").join(onward, "at").select(
            "node", F.col("_at").alias("at"), F.col("_done").alias("done")
        )
        state = cut_lineage(going.unionByName(state.where("done")))
        covered *= 2
    found = state.where("done").select("node", F.col("at").alias("stop"))
    return ids.select("node").distinct().join(found, "node")
