"""Where names that package files hand on come from, by pointer doubling.

(package file, symbol) → (next file, symbol) is a function: a package file that does not
define a symbol hands it on from the file its first fitting import leads to. Every round
each pointer takes over the pointer of where it points, so a chain of a thousand files
takes ten rounds. Pointers that never end are on the way to a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.session import cut_lineage

PACKAGE_FILE = "__init__.py"
NODE = ["file", "symbol"]


def handed_on(sites: DataFrame, direct: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, options). ``nodes``: file, symbol, next, n_options for the package files that
    hand a symbol on; ``options``: all (file, symbol, order, next).

    ``sites``: site, importer, module, line, symbols. ``direct``: site, importer, target."""
    packages = F.col("path").endswith(PACKAGE_FILE)
    own = facts.where(packages).select(F.col("path").alias("file"), F.explode(F.array_union("definitions", "exports")).alias("symbol"))
    options = (
        sites.where(F.col("importer").endswith(PACKAGE_FILE))
        .join(direct.where(F.col("importer").endswith(PACKAGE_FILE)).select("site", F.col("target").alias("next")), "site")
        .select(F.col("importer").alias("file"), F.explode("symbols").alias("symbol"), F.struct("line", "module").alias("order"), "next")
        .where("next <> file")
        .join(own, NODE, "left_anti")
    )
    options = cut_lineage(options)
    nodes = options.groupBy(*NODE).agg(F.min_by("next", "order").alias("next"), F.count_distinct("next").alias("n_options"))
    return cut_lineage(nodes), options


def _jump(state: DataFrame) -> DataFrame:
    """One round: ``at`` and ``steps`` of every row that has not ended move on by the row they point at."""
    there = state.select(F.col("file").alias("_file"), F.col("symbol").alias("_symbol"), F.col("at").alias("_at"),
                         F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
    moved = state.join(there, (~F.col("ended")) & (F.col("at") == F.col("_file")) & (F.col("symbol") == F.col("_symbol")), "left")
    going = F.col("_at").isNotNull()
    return cut_lineage(moved.select(
        *NODE, F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
        # where it points there is no row: the end
        F.when(F.col("ended"), True).when(going, F.col("_ended")).otherwise(True).alias("ended"),
    ))


def ends_of(nodes: DataFrame) -> DataFrame:
    """file, symbol, at, steps, ended: where each pointer leads. Rows that are not ``ended`` reach a circle."""
    state = cut_lineage(nodes.select(*NODE, F.col("next").alias("at"), F.lit(1).cast("bigint").alias("steps"), F.lit(False).alias("ended")))
    waiting = state.count()
    while waiting:
        state = _jump(state)
        left = state.where("not ended").count()
        if left == waiting:  # a round in which nothing ends: the rest goes in circles
            break
        waiting = left
    return state


def follow(nodes: DataFrame) -> DataFrame:
    """file, symbol, final, steps, circular, sure.

    A way into a circle ends at the file before the one it would enter twice; ``sure`` is
    false where that file has another import to try instead."""
    state = ends_of(nodes)
    straight = state.where("ended").select(*NODE, F.col("at").alias("final"), "steps", F.lit(False).alias("circular"), F.lit(True).alias("sure"))
    lost = cut_lineage(state.where("not ended"))
    if lost.isEmpty():
        return straight
    # After so many steps everything that is lost stands on a circle, and stands on all of it.
    circle = cut_lineage(lost.select(F.col("at").alias("file"), "symbol").distinct())
    on_circle = cut_lineage(nodes.join(circle, NODE, "left_semi"))
    off_circle = nodes.join(lost.select(*NODE), NODE, "left_semi").join(circle, NODE, "left_anti")
    entries = ends_of(off_circle).select(*NODE, F.col("at").alias("entry")).unionByName(circle.select(*NODE, F.col("file").alias("entry")))
    before = on_circle.select(F.col("next").alias("entry"), "symbol", F.col("file").alias("final"), (F.col("n_options") == 1).alias("sure"))
    turned = entries.join(before, ["entry", "symbol"]).select(*NODE, "final", F.lit(0).cast("bigint").alias("steps"), F.lit(True).alias("circular"), "sure")
    return straight.unionByName(turned)
