"""Deep hierarchies: every order hangs below the customer's order before it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archtrail.operators import nesting
from archtrail.plans import tables as t
from archtrail.plans.registry import query

URGENT = "1-URGENT"


def _orders(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderpriority",
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("customer"), "o_custkey", "o_orderkey",
    )


def _chains(spark, sf_dir):
    """(orders, membership): the first order of a customer belongs to the customer itself."""
    orders = _orders(spark, sf_dir)
    before = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return orders, orders.select(F.col("id").alias("child"), F.coalesce(before, "customer").alias("parent"))


def _labels(spark, sf_dir):
    orders, membership = _chains(spark, sf_dir)
    customers = t.table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return orders, nesting.places(customers, membership)


ONWARD = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
SO_FAR = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "nested_depths",
    f"""SELECT 'o:' || o_orderkey AS node, CAST(count(*) {SO_FAR} AS BIGINT) AS depth,
      CAST(count(*) {ONWARD} AS BIGINT) AS members FROM orders
    UNION ALL SELECT 'c:' || c_custkey, 0, 1 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) FROM customer""",
)
def nested_depths(spark, sf_dir):
    """Depth of each node and the number of nodes at or below it, from its places alone."""
    labels = _labels(spark, sf_dir)[1]
    return labels.select("node", "depth", (F.col("last") - F.col("enter") + 1).alias("members"))


@query(
    "nested_totals",
    f"""WITH filed AS (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n,
      (SELECT coalesce(sum(CAST(l_quantity AS BIGINT)), 0) FROM lineitem WHERE l_orderkey = o_orderkey) AS q FROM orders)
    SELECT 'o:' || o_orderkey AS node, CAST(sum(n) {ONWARD} AS BIGINT) AS items, CAST(sum(q) {ONWARD} AS BIGINT) AS quantity
    FROM filed UNION ALL
    SELECT 'c:' || c_custkey, CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(sum(q), 0) AS BIGINT)
    FROM customer LEFT JOIN filed ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def nested_totals(spark, sf_dir):
    labels = _labels(spark, sf_dir)[1]
    items = t.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("node"),
        F.lit(1).alias("items"), F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    return nesting.subtree_totals(labels, items, ["items", "quantity"])


@query(
    "nested_members",
    f"""SELECT 'o:' || a.o_orderkey AS node, 'o:' || b.o_orderkey AS member FROM orders a
    JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey >= a.o_orderkey WHERE a.o_orderpriority = '{URGENT}'""",
)
def nested_members(spark, sf_dir):
    """All orders at or below each urgent one."""
    orders, labels = _labels(spark, sf_dir)
    nodes = orders.select(F.col("id").alias("node"), "o_orderpriority")
    return nesting.members_below(labels, nodes.where(F.col("o_orderpriority") == URGENT), nodes)


@query(
    "nested_visible",
    f"""SELECT 'o:' || o_orderkey AS node,
      coalesce('o:' || max(o_orderkey) FILTER (WHERE o_orderpriority = '{URGENT}') {SO_FAR}, 'c:' || o_custkey) AS stop
    FROM orders""",
)
def nested_visible(spark, sf_dir):
    """The closest urgent order at or before each order, else the customer."""
    orders, membership = _chains(spark, sf_dir)
    stops = orders.where(F.col("o_orderpriority") == URGENT).select("id").unionByName(
        orders.select(F.col("customer").alias("id")).distinct()
    )
    return nesting.nearest_stop(orders.select(F.col("id").alias("node")), membership, stops)
