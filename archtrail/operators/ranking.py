"""Ordinals and top-k without sending one group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archtrail.session import cut_lineage


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 1-based place of each row in the total order ``order``.

    The rows are range-partitioned and sorted, so no task sees more than its
    range. Only one number per partition (its row count) is combined to turn
    places within a partition into global ones; that small table is bounded by
    the number of shuffle partitions, which is why it may be broadcast.
    """
    ordered = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    partition = F.shiftright(F.col("_at"), 33)
    counts = ordered.groupBy(partition.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (within + F.col("_before") + 1).cast("bigint"))
        .drop("_at", "_part", "_before")
    )


def ordinal_in_group(
    df: DataFrame, keys: list[str], *order: Column, name: str = "ordinal"
) -> DataFrame:
    """0-based place of each row inside its group, safe for very large groups.

    Rows are placed globally by (keys, order); a group is then a contiguous run
    and its first place is a partial aggregate, not a per-group sort."""
    placed = with_position(df, *[F.col(key) for key in keys], *order, name="_place")
    starts = placed.groupBy(*keys).agg(F.min("_place").alias("_start"))
    return (
        placed.join(starts, keys)
        .withColumn(name, F.col("_place") - F.col("_start"))
        .drop("_place", "_start")
    )


def running_totals(df: DataFrame, columns: list[str], *order: Column) -> DataFrame:
    """Add ``_to_<column>``: the sum of each column up to and with the row, in ``order``.

    Every task adds up its own range; one row of sums per range is combined, as above."""
    ordered = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    sums = ordered.groupBy("_part").agg(*[F.sum(name).alias(f"_all_{name}") for name in columns])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_part", *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_all_{name}") for name in columns]
    )
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    added = ordered.select("*", *[F.sum(name).over(within).alias(f"_to_{name}") for name in columns])
    return added.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(F.col(f"_to_{name}") + F.col(f"_all_{name}")).alias(f"_to_{name}") for name in columns]
    )


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group.

    A ``row_number() <= n`` filter lets Spark cut every group to ``n`` rows in
    each map task before the shuffle, so a hot group costs at most ``n`` rows per
    map task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
