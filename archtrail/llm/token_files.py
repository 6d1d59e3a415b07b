"""Token ids as ORC files: written in id order, read back by stripe.

Ids are an ``array<int>`` column, which ORC run-length encodes; row indexes and a Bloom
filter on the document id let a reader skip stripes and row groups. Files are ranges of
document ids in ascending order, so each can be read and counted on its own.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archtrail.llm.chunks import bounded_batches, dealt_parts, store_folder
from archtrail.llm.packed import slices, words
from archtrail.llm.word_cache import WordCache

FILE_SCHEMA = "part int, doc_id long, ids array<int>"
#: Writer settings: compression, stripe bytes, rows of an index entry, Bloom filter.
ORC_OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """One cache for the tasks of a worker process."""
    return WordCache(word_encoder(path), np.dtype(np.int32))


def word_encoder(path: str):
    """Encode words by the tokenizers library: many per call, taken apart by their offsets."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values, sizes = [np.zeros(0, np.int64)], []
        texts = [w.decode() for w in found]
        for k in range(0, len(texts), 25_600):
            groups = [texts[g : g + 256] for g in range(k, min(k + 25_600, len(texts)), 256)]
            for group, got in zip(groups, tokenizer.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
                ends = np.cumsum([len(w) + 1 for w in group])
                starts = np.array([o[0] for o in got.offsets], np.int64)
                sizes.append(np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(group)))
                values.append(np.array(got.ids, np.int64))
        return np.concatenate(values), np.concatenate([np.zeros(0, np.int64), *sizes])

    return encode


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part`` (range of ``bounds`` that the id is in), ``doc_id`` and ``ids`` of every text and the end id.

    White space separates tokens of this kind of tokenizer, so a text is the sum of its words.
    """
    bounded_batches(docs.sparkSession)
    limits = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer)
        for batch in batches:
            for first, end, data, at in slices(batch.column(1), 1_500_000):
                starts, stops, of = words(data, at)
                where, size = cache.look_up(data, starts, stops)
                per_text = np.concatenate([[0], np.cumsum(size)])[of]
                ids = np.insert(cache.gather(where, size), per_text[1:], end_id)
                offsets = per_text + np.arange(len(per_text))
                doc = batch.column(0)[first:end].cast(pa.int64())
                part = np.searchsorted(limits, np.asarray(doc.fill_null(-(2**63))), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), doc, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["part", "doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, FILE_SCHEMA)


def id_bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Bounds of about equal ranges of ids (they balance the files)."""
    if parts < 2:
        return []
    got = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / parts for k in range(1, parts)], 10_000)).first()[0]
    return sorted(set(got or []))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Write the ids of all texts below ``path``: folder ``part=k`` has the k-th range of ids, in order (null first)."""
    parts = parts or dealt_parts(docs.sparkSession)
    rows = encode_documents(docs, tokenizer, end_id, id_bounds(docs, id_col, parts), id_col, text_col)
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    ordered.write.options(**ORC_OPTIONS).partitionBy("part").orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>, part int").orc(path)


def token_rows(files: DataFrame) -> DataFrame:
    """``doc_id, part, n_tokens, ids_crc32`` of every document of the files (crc32 over 32-bit little-endian ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at = ids.offsets.to_numpy()
            body = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "part", "ids").mapInArrow(run, "doc_id long, part int, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before, by id. One count per file range is all that meets in one place."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(totals.select("part", "base")), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def token_file_report(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write token files, read them back and say where each document's ids are.

    Returns ``doc_id, start, n_tokens, ids_crc32``, one row per input row. A null text is empty
    (one end id). Ids may repeat; a null id comes first. ``path``: a new folder in the
    shared store by default. Special tokens spelled out in a text become their ids, as
    the tokenizers library has it.
    """
    spark = docs.sparkSession
    if path is None:
        store_folder(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id, id_col, text_col)
    return with_starts(token_rows(read_token_files(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
