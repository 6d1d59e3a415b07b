"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (one node of its component) of every node of ``links`` (longs ``a``, ``b``).

    Each round every node moves to its smallest neighbour and the links between what is
    left are made distinct. Node keys are hashes, so neighbours are in random order and
    a round keeps a fraction of the nodes of any path: rounds grow with the logarithm
    of the path length, not with it. Ends when no link is left.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = None
    while True:
        links = written(links.where("a < b").distinct())
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")))
        move = lambda frame, key, alias: frame.join(moves.select(F.col("node").alias(key), F.col("to").alias(alias)), key, "left")
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            roots = move(roots, "root", "next").select("node", F.coalesce("next", "root").alias("root"))
        links = move(move(links, "a", "x"), "b", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else written(roots)
