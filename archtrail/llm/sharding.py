"""Rendezvous sharding: a record goes to the shard that draws best for its key.

Every shard draws ``-ln(u) / weight`` with ``u`` from a hash of key and shard; the least
draw wins. Only key and shard decide, so a shard that is added takes rows from all
others in proportion to its weight and moves nothing between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that give the draw (13: 52 bits, exact in a double) and the slot group (3: 4096 groups a shard).
DRAW_DIGITS, GROUP_DIGITS = 13, 3


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that holds ``key``; a null key is the empty text. Equal draws go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))
    draws = [
        F.struct((-F.log((_hex(F.concat(name, F.lit(f":{k}")), DRAW_DIGITS).cast("double") + 0.5) / F.lit(2.0 ** (4 * DRAW_DIGITS))) / F.lit(float(w))).alias("draw"), F.lit(k).alias("shard"))
        for k, w in enumerate(weights)
    ]
    return F.array_min(F.array(*draws))["shard"]


def assign(records: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """All columns of ``records`` with ``shard`` and, for ``grown`` weights, ``grown_shard``; no shuffle.

    Columns of these names are replaced.
    """
    out = records.withColumn("shard", winner(F.col(key), weights))
    return out.withColumn("grown_shard", winner(F.col(key), grown)) if grown else out


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, made longer until no column has it (case does not tell columns apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slots(assigned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number the rows of each ``shard`` from 0 without gaps, by hash group and then ``by``.

    Equal rows (in all columns) are counted before any shuffle and told apart at the end,
    so a key with very many rows is one row on the way. A shard has 4096 groups: their
    counts (65,536 rows for 16 shards, the only thing broadcast) give each its start.
    Nulls in ``by`` come first, ties are broken by all other columns; a null shard is a shard
    of its own. Columns of any name but ``slot``, which is replaced, come along as they are;
    an empty table gives no rows.
    """
    assigned = assigned.drop("slot")
    columns = assigned.columns
    group, copies, before, rows, start, of = (unused(n, columns) for n in ("slot_group", "copies", "before", "rows", "start", "of_shard"))
    text = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    counted = assigned.withColumn(group, F.substring(F.md5(text), 1, GROUP_DIGITS)).groupBy(*columns, group).agg(F.count("*").alias(copies))
    within = Window.partitionBy("shard", group).orderBy(*by, *(c for c in columns if c not in by)).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn(before, F.coalesce(F.sum(copies).over(within), F.lit(0)))
    groups = counted.groupBy("shard", group).agg(F.sum(copies).alias(rows))
    earlier = Window.partitionBy("shard").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(F.col("shard").alias(of), F.col(group).alias(unused("of_group", columns)), F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(start))
    same = placed["shard"].eqNullSafe(starts[of]) & (placed[group] == starts[unused("of_group", columns)])
    both = placed.join(F.broadcast(starts), same)
    return both.select(*columns, F.explode(F.sequence(F.col(start) + F.col(before), F.col(start) + F.col(before) + F.col(copies) - 1)).alias("slot"))
