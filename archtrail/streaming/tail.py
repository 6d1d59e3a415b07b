"""Live traces: tail raw logs and keep one resolved record per tool call.

The state of the query is one record per (session, call), merged with the same
aggregate the batch path uses. There is no watermark: a late record is always
accepted, as a full recomputation would accept it. A batch writes only the calls
that changed; ``latest`` puts them together and works out relative times, so a
record that moves the origin of its session costs nothing until somebody looks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from archtrail.operators import trace
from archtrail.sources.events import parsed, shaped

RANGE_BYTES = 64 * 1024 * 1024
#: So many changes are put together into one table; the one before it stays for readers.
COMPACT_EVERY = 50


class _Store:
    """Files of a folder on whatever file system its address names."""

    def __init__(self, directory: str) -> None:
        from pyarrow import fs

        if "://" in directory:
            self.files, self.folder = fs.FileSystem.from_uri(directory)
        else:
            self.files, self.folder = fs.LocalFileSystem(), directory
        self.selector = fs.FileSelector(self.folder, allow_not_found=True)

    def logs(self) -> dict[str, int]:
        found = self.files.get_file_info(self.selector)
        return {info.path: info.size for info in sorted(found, key=lambda i: i.path) if info.path.endswith(".jsonl")}

    def read(self, path: str, start: int, size: int) -> bytes:
        with self.files.open_input_file(path) as log:
            log.seek(start)
            return log.read(size)

    def line_start(self, path: str, position: int) -> int:
        """Start of the line that ``position`` lies in: an unfinished last line stays
        for the next batch."""
        while position > 0:
            step = max(0, position - 65536)
            found = self.read(path, step, position - step).rfind(b"\n")
            if found >= 0:
                return step + found + 1
            position = step
        return 0

    def first_line(self, path: str) -> bytes:
        """The first line, empty while it is not finished."""
        head, size = b"", 4096
        while b"\n" not in head:
            more = self.read(path, len(head), size)
            if not more:
                return b""
            head, size = head + more, size * 2
        return head[: head.index(b"\n") + 1]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, origin: str, epoch: float) -> None:
        self.path, self.start, self.end, self.origin, self.epoch = path, start, end, origin, epoch


class _TailReader(DataSourceStreamReader):
    """An offset is, per file, what the file begins with and its size. A file that
    begins otherwise than before was started anew and is another origin."""

    def __init__(self, directory: str) -> None:
        self.directory = directory

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, found = _Store(self.directory), {}
        for path, size in store.logs().items():
            head = store.first_line(path) if size else b""
            if head:
                try:
                    epoch = float(json.loads(head).get("timestamp") or 0.0)
                except (ValueError, TypeError, AttributeError):
                    epoch = 0.0
                found[path] = [hashlib.sha256(head).hexdigest()[:16], epoch, store.line_start(path, size)]
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for path, (head, epoch, last) in end.items():
            before = start.get(path)
            done = before[2] if before and before[0] == head and before[2] <= last else 0
            name = path.rsplit("/", 1)[-1]
            for at in range(done, last, RANGE_BYTES):
                ranges.append(_Range(path, at, min(at + RANGE_BYTES, last), f"{name}#{head}", epoch))
        return ranges

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin in a range; what a file has grown by since is left out."""
        store = _Store(self.directory)
        with store.files.open_input_file(partition.path) as log:
            log.seek(max(0, partition.start - 1))
            at, held, begun = log.tell(), b"", partition.start == 0
            while at < partition.end:
                more = log.read(1 << 20)
                if not more:
                    return
                held += more
                *lines, held = held.split(b"\n")
                for line in lines:
                    if begun and at < partition.end:
                        yield line.decode("utf-8", "replace"), at, partition.origin, partition.epoch
                    begun = True  # a line that began earlier belongs to the range before
                    at += len(line) + 1
                if at + len(held) >= partition.end and not held:
                    return


class JsonlTail(DataSource):
    """``spark.readStream.format("jsonl_tail").option("path", directory)``: the lines of
    all ``*.jsonl`` files with byte position, origin and the time the file begins with."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "value string, sequence bigint, origin string, epoch double"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options["path"])


def read_tail(spark: SparkSession, directory: str) -> DataFrame:
    """Raw records as they are written; lines that are no objects are left out."""
    spark.dataSource.register(JsonlTail)
    lines = spark.readStream.format("jsonl_tail").option("path", str(directory)).load()
    return shaped(parsed(lines).where(F.col("_bad").isNull()))


def _folders(spark: SparkSession, target: str, kind: str) -> dict[int, str]:
    """Finished tables of one kind below ``target`` by number, on the file system Spark uses."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}=*/_SUCCESS"))
    places = [status.getPath().getParent() for status in found or []]
    return {int(place.getName().split("=")[1]): place.toString() for place in places}


def _calls(spark: SparkSession, target: str) -> DataFrame:
    """The newest state of every call: the last compacted table and the changes since."""
    base, changes = _folders(spark, target, "base"), _folders(spark, target, "change")
    newest = max(base, default=-1)
    paths = ([base[newest]] if base else []) + [path for number, path in sorted(changes.items()) if number > newest]
    if not paths:
        raise FileNotFoundError(f"no trace under {target}")
    rows = spark.read.parquet(paths[0])
    for path in paths[1:]:
        rows = rows.unionByName(spark.read.parquet(path))
    newest_of = F.max_by(F.struct("_kept", "_batch"), "_batch").alias("_last")
    return rows.groupBy("session_id", "_call").agg(newest_of).select("session_id", "_call", "_last.*")


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def compact(spark: SparkSession, target: str) -> None:
    """Put all changes into one table; older tables go, but the last one stays for readers."""
    changes, bases = _folders(spark, target, "change"), _folders(spark, target, "base")
    number = max(changes, default=-1)
    if number <= max(bases, default=-1):
        return
    _calls(spark, target).write.mode("overwrite").parquet(f"{target}/base={number}")
    kept = max(bases, default=-1)
    _remove(spark, [p for n, p in bases.items() if n < kept] + [p for n, p in changes.items() if n <= kept])


def follow(
    raw: DataFrame,
    target: str,
    checkpoint: str,
    once: bool = False,
    interval: str = "1 second",
) -> StreamingQuery:
    """Keep the calls under ``target`` current: each batch writes those that changed to
    ``change=<n>``. Writing by batch number makes a retried batch replace itself."""

    def publish(calls: DataFrame, batch: int) -> None:
        calls.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/change={batch}")
        if batch % COMPACT_EVERY == COMPACT_EVERY - 1:
            compact(calls.sparkSession, target)

    writer = (
        trace.kept_calls(raw)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def latest(spark: SparkSession, target: str, file_nodes: DataFrame) -> DataFrame:
    """The trace as it stands: relative times and nodes of all calls seen so far."""
    calls = _calls(spark, target).select("session_id", "_kept.*")
    return trace.resolve_nodes(trace.relative_time(calls.drop("origin", "epoch")), file_nodes)
