"""From raw documents to token ids: the stages of a training corpus, one after the other.

Each stage reads what the one before has written. All but the last return the columns
of ``documents``; columns beyond those named here come along unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.llm.chunks import store_folder, written
from archtrail.llm.decontaminate import checked_broadcast, contamination
from archtrail.llm.jaccard_join import similar_groups
from archtrail.llm.quality import clean_documents
from archtrail.llm.queries import vocabulary
from archtrail.llm.sentencepiece_codec import encode
from archtrail.llm.suffix_dedup import remove_repeats

#: None: segmentation into pieces is beyond SQL; ``tests/llm`` has the brute-force version.
ORACLE_SQL = None


def _as_documents(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``doc_id`` and ``text`` with the other columns of ``row``; ``n_chars`` follows the text."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new[c] if c in new else F.col("row").getField(c).alias(c) for c in columns)).toDF(*columns)


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go, then documents that fail the base rules or lost too much (a null text fails)."""
    cleaned = clean_documents(docs, carry=_others(docs)).where("kept")
    return _as_documents(cleaned, docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar five-word grams (0.8) the smallest id stays.

    Rows without an id stay; rows that share an id count as one document.
    """
    groups = similar_groups(docs, size=5, percent=80)
    leaving = written(groups.where("doc_id <> group_id").select("doc_id").distinct())
    return docs.join(checked_broadcast(leaving), "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that start in a smaller document go; so do documents left empty.

    A character that was cut in two goes as a whole.
    """
    cut = remove_repeats(docs, carry=_others(docs), whole_chars=True)
    return _as_documents(cut.withColumn("text", F.col("kept").cast("string")), docs.columns).where("text <> ''")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lies in passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, items)
    bad = written(found.where("contaminated").select("text_key").distinct())
    return docs.join(checked_broadcast(bad), F.xxhash64(docs["text"]) == bad["text_key"], "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the piece ids of what is left."""
    return encode(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    store_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
