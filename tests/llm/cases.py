"""Documents for the operator tests: the smallest table, and rows of every awkward kind."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD, ITEM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PASSAGE = "nine brave foxes carried thirteen old lanterns over the wide frozen lake before dawn came up"
EDGES = [
    (900001, None), (900002, ""), (900003, "  \n\n a\n a\n\t"), (900004, "one"), (900005, "two two"), (900006, "日本語 テキスト 😀é́ " * 40),
    (900007, "x" * 40_000 + " end"), (900008, PASSAGE), (900009, f"Before. {PASSAGE}!"), (900010, f"{PASSAGE} and {PASSAGE} again {PASSAGE}"),
    (900011, "é ü\x0b\x1c b\x85c d | | | ▁▁ don't\x00 I'LL"), (900011, "the same id with another text"), (900012, "row twice " * 9), (900012, "row twice " * 9),
    (None, "no id here, " + PASSAGE), (None, None), (-5, f"{PASSAGE}?"), (900013, "All rights reserved.\nA fine line of text is here to stay, so it does.\n| a | b | c |"),
    (900014, "aaaa " * 3000), (900015, "aaaa " * 3000 + "b"),
]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, edges: bool = True) -> DataFrame:
    """doc_id and text with columns whose names operators use inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    if edges:
        docs = docs.unionByName(spark.createDataFrame(EDGES, "doc_id long, text string"))
    for name in ("chunk", "bucket", "node", "words", "n_words", "row", "kept", "ids", "item", "doc", "shard", "slot", "host", "count"):
        docs = docs.withColumn(name, F.lit("other").cast("string"))
    return docs


def rows_of(frame: DataFrame) -> list[tuple]:
    return [tuple(r) for r in frame.collect()]


def key(row: tuple) -> str:
    return repr(row)
