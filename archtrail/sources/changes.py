"""Change tables, churn tables and content versions of a tree.

What version control knows comes in as tables (``path, status, old_path`` and
``file, commits``); the version of a tree is a digest of its contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.operators.impact import STATUS_BY_CODE

CHANGE_TYPE = "path string, status string, old_path string"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A change table from JSON lines or parquet; one-letter statuses are spelled out.

    A status that is not known, or a row without a path, is an error."""
    reader = spark.read.schema(CHANGE_TYPE)
    rows = reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)
    code = F.substring("status", 1, 1)
    names = F.create_map(*[F.lit(part) for pair in STATUS_BY_CODE.items() for part in pair])
    spelled = F.when(F.col("status").isin(*STATUS_BY_CODE.values()), F.col("status")).otherwise(names[code])
    changes = rows.select("path", spelled.alias("status"), "old_path", F.col("status").alias("_given"))
    wrong = changes.where(F.col("status").isNull() | (F.coalesce("path", F.lit("")) == "")).first()
    if wrong is not None:
        raise ValueError(f"not a change: {wrong['_given']} {wrong['path']}")
    return changes.drop("_given")


def read_churn(spark: SparkSession, path: str) -> DataFrame:
    """(file, commits) from JSON lines of ``path`` and ``commits``."""
    rows = spark.read.schema("path string, commits bigint").json(path)
    return rows.groupBy(F.concat(F.lit("file:"), "path").alias("file")).agg(F.sum("commits").alias("commits"))


def content_version(digests: DataFrame) -> str:
    """Version of a snapshot from its ``path, digest`` rows (paths are unique), whatever
    their order: two hashes of rows, each reduced in the tasks."""
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "path", "digest")) for seed in (1, 2)]
    count, *found = digests.agg(F.count("*"), *marks).first()
    return f"content:{count}:" + "".join(f"{(mark or 0) % 2**64:016x}" for mark in found)


def check_version(expected: str, digests: DataFrame) -> None:
    """A map may only be compared with the snapshot it was made from."""
    found = content_version(digests)
    if found != expected:
        raise ValueError(f"the map was made from {expected}, the files are {found}; analyse them again")
