"""A corpus as rows of a few megabytes, for operators that pass over the texts more than once.

Each row holds many whole documents, compressed. Rows have lasting numbers (they are
written before use), so what a later stage finds out about a row can be sent back to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.llm.packed import release, slices

CHUNK = "chunk long, n_bytes long, ids binary, known binary, at binary, body binary, rest binary"


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; ``expand`` gives them back."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        out.append(np.array([len(a)], np.int64).tobytes() + a.dtype.str.encode().ljust(8) + a.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def expand(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    place, out = 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        n, kind = int(np.frombuffer(raw, np.int64, 1, place)[0]), np.dtype(raw[place + 8 : place + 16].strip().decode())
        out.append(np.frombuffer(raw, kind, n, place + 16))
        place += 16 + n * kind.itemsize
    return out


def store_folder(spark: SparkSession) -> None:
    """Require the shared folder for intermediate results; local sessions without one get one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="archtrail-")
        context.setCheckpointDir(folder)


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python 2,000 at a time, unless the session says how many.

    The usual 10,000 texts are tens of megabytes, which JVM and worker hold several times.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "2000")


def written(frame: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and go on from there."""
    store_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def dealt_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = 4_000_000, carry: Sequence[str] = ()) -> DataFrame:
    """Documents as numbered rows of about ``chunk_bytes`` (a longer text has a row of its own).

    Columns: ``chunk``, ``n_bytes``, ``ids`` (int64), ``known`` (0 where the id is null),
    ``at`` (offsets), ``body`` (UTF-8, a null text is empty) and ``rest`` (the columns
    of ``carry``, see ``carried``).
    """
    carry = list(carry)
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal number, waiting
            *arrays, rest = zip(*waiting, strict=True)
            ids, known, sizes, bodies = (np.concatenate(x) for x in arrays)
            waiting = []
            number += 1
            at = np.concatenate([[0], np.cumsum(sizes)])
            values = [number - 1, int(at[-1]), squeeze(ids), squeeze(known), squeeze(at), squeeze(bodies)]
            columns = [*(pa.array([v]) for v in values), pa.array([_ipc(pa.Table.from_batches(rest)) if carry else None], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "n_bytes", "ids", "known", "at", "body", "rest"])

        held = 0
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            known, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            for first, end, body, at in slices(batch.column(1), chunk_bytes):
                if held and held + len(body) > chunk_bytes:
                    yield row()
                    held = 0
                waiting.append((ids[first:end], known[first:end].astype(np.uint8), np.diff(at), body, batch.select(range(2, 2 + len(carry))).slice(first, end - first)))
                held += len(body) + 16 * (end - first)
        if waiting:
            yield row()

    return written(docs.select(id_col, text_col, *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry))).mapInArrow(rows, CHUNK))


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue().to_pybytes())


def carried(row: dict) -> list[pa.ChunkedArray]:
    """The columns carried by a packed row, in the order of ``carry``."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all().columns if row["rest"] else []


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, known, offsets and bytes of one packed row."""
    return expand(row["ids"])[0], expand(row["known"])[0].astype(bool), expand(row["at"])[0], expand(row["body"])[0]


def each_chunk(chunks: DataFrame, work: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``work`` to every packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from work(batch.slice(k, 1).to_pylist()[0])
                release()

    return chunks.mapInArrow(run, schema)


def answer_chunks(chunks: DataFrame, answers: DataFrame, work: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """Apply ``work`` to every packed row with the ``answers`` (column ``chunk``) sent to it."""

    empty = no_rows(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left.to_pylist()[0], right.to_pylist()) if left.num_rows else empty
        release()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def no_rows(schema: str) -> pa.Table:
    """An empty table; made on the driver, as it needs a session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()
