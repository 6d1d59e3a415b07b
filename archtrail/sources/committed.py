"""Impact and trace artifacts as committed parts: written by tasks, published at once.

A data source for ``section, body`` rows (``body`` is one JSON object or string). Each task
streams its rows into a part below a folder of the write's own and reports the part's
counts; when all tasks are done the driver publishes one manifest that names the parts in
order. Readers go by the manifest alone, so parts of failed, repeated or speculative
attempts are never seen, and a writer that dies leaves the previous artifact in place.
The driver holds one line per part and the one-row header, never rows.

Parts follow the order of the frame that is written; ``place`` counts from 0 within a
section. Rows with a null section or body are an error. An empty frame publishes an
artifact without parts. Paths may carry any scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from archtrail.operators import impact, trace

FORMAT = "archtrail_artifact"
MANIFEST = "manifest.json"
# Fixed value of the artifact contract.
SCHEMA_VERSION = "1.0"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class PartWritten(WriterCommitMessage):
    order: int
    name: str
    counts: dict[str, int]


class ArtifactWriter(DataSourceArrowWriter):
    """``overwrite`` must be set: an artifact is replaced as a whole."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        if not overwrite:
            raise ValueError("an artifact is one document: write it with mode 'overwrite'")
        self.path, self.header = options["path"], json.loads(options.get("header", "{}"))
        self.folder = f"parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> PartWritten:
        system, root = _open(self.path)
        order = TaskContext.get().partitionId()
        name, counts, out = f"{self.folder}/{order:06d}-{uuid.uuid4().hex}.jsonl", {}, None
        try:
            for batch in iterator:
                sections, bodies = batch.column("section").to_pylist(), batch.column("body").to_pylist()
                if None in sections or None in bodies:
                    raise ValueError("section and body must be filled")
                if out is None and sections:
                    system.create_dir(f"{root}/{self.folder}", recursive=True)
                    out = system.open_output_stream(f"{root}/{name}")
                for section, body in zip(sections, bodies):
                    counts[section] = counts.get(section, 0) + 1
                    out.write(f"{json.dumps(section, ensure_ascii=False)}\t{body}\n".encode())
        finally:
            if out is not None:
                out.close()
        return PartWritten(order, name if counts else "", counts)

    def commit(self, messages: list[PartWritten | None]) -> None:
        system, root = _open(self.path)
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.order)
        manifest = {**self.header, "parts": [{"name": m.name, "counts": m.counts} for m in parts]}
        system.create_dir(root, recursive=True)
        beside = f"{root}/{self.folder}.json"
        with system.open_output_stream(beside) as out:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        system.move(beside, f"{root}/{MANIFEST}")

    def abort(self, messages: list[PartWritten | None]) -> None:
        system, root = _open(self.path)
        if system.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.folder}")


@dataclass
class Part(InputPartition):
    name: str
    starts: dict[str, int]

    def __init__(self, name: str, starts: dict[str, int]):
        super().__init__(name)
        self.name, self.starts = name, starts


class ArtifactReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        seen: dict[str, int] = {}
        parts = []
        for part in manifest(self.path)["parts"]:
            parts.append(Part(part["name"], {s: seen.get(s, 0) for s in part["counts"]}))
            for section, count in part["counts"].items():
                seen[section] = seen.get(section, 0) + count
        return parts or [Part("", {})]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        if not partition.name:
            return
        system, root = _open(self.path)
        places = dict(partition.starts)
        with system.open_input_stream(f"{root}/{partition.name}") as source:
            for line in _lines(source):
                name, body = line.split("\t", 1)
                section = json.loads(name)
                yield section, places[section], body
                places[section] += 1


def _lines(source) -> Iterator[str]:
    rest = b""
    while block := source.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (line.decode() for line in whole)


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "section string, place bigint, body string"

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(dict(self.options), overwrite)


def manifest(path: str) -> dict:
    system, root = _open(path)
    with system.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())


def write_artifact(rows: DataFrame, path: str, header: dict) -> None:
    """Publish ``rows(section, body)``, in the order they have, under ``path``."""
    rows.sparkSession.dataSource.register(ArtifactSource)
    options = {"header": json.dumps({"schema_version": SCHEMA_VERSION, **header})}
    rows.select("section", "body").write.format(FORMAT).options(**options).mode("overwrite").save(path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(section, place, body) of the artifact last published under ``path``."""
    spark.dataSource.register(ArtifactSource)
    return spark.read.format(FORMAT).load(path)


def document(path: str) -> Iterator[str]:
    """The artifact as one JSON document, piece by piece: header fields, then one list a section.

    Rows come in the order of their sections, so no more than a line is held."""
    system, root = _open(path)
    known = manifest(path)
    parts = known.pop("parts")
    yield json.dumps(known, sort_keys=True, ensure_ascii=False)[:-1]
    open_section = None
    for part in parts:
        with system.open_input_stream(f"{root}/{part['name']}") as source:
            for line in _lines(source):
                name, body = line.split("\t", 1)
                if name == open_section:
                    yield ",\n"
                else:
                    yield f"{']' if open_section else ''},\n{name}: [\n"
                    open_section = name
                yield body
    yield "]}\n" if open_section else "}\n"


IMPACT_SECTIONS = ("files", "direct_dependents", "review_order")
TRACE_SECTIONS = ("sessions", "events")


def write_impact(mapped: DataFrame, dependents: DataFrame, order: DataFrame, path: str, map_ref: str, base: str, head: str) -> None:
    """The impact document: files by path, dependent pairs, review order, summary and map reference.

    ``mapped``: path, old_path, status, node_id; ``dependents``: changed_node_id,
    dependent_node_id; ``order``: position, path. Fields that are null are left out."""
    rank, none = F.lit(0).cast("bigint"), F.lit("")

    def part(number: int, rows: DataFrame, place, *by, body):
        first, second = [*by, none, none][:2]
        return rows.select(F.lit(number).alias("_section"), place.alias("_place"), first.alias("_first"), second.alias("_second"),
                           F.lit(IMPACT_SECTIONS[number]).alias("section"), body.alias("body"))

    rows = (
        part(0, mapped, rank, F.col("path"), F.col("status"), body=F.to_json(F.struct("node_id", "old_path", "path", "status")))
        .unionByName(part(1, dependents, rank, F.col("changed_node_id"), F.col("dependent_node_id"),
                          body=F.to_json(F.struct("changed_node_id", "dependent_node_id"))))
        .unionByName(part(2, order, F.col("position").cast("bigint"), body=F.regexp_extract(F.to_json(F.array("path")), r"(?s)^\[(.*)\]$", 1)))
    )
    summary = impact.impact_summary(mapped, dependents).first().asDict()
    header = {"map_ref": {"commit": map_ref}, "comparison": {"base": base, "head": head}, "summary": summary}
    write_artifact(rows.orderBy("_section", "_place", "_first", "_second"), path, header)


def write_trace(events: DataFrame, heads: DataFrame, path: str, map_ref: str) -> None:
    """Traces of all sessions: one line a session with agent and summary, then its events in order.

    ``events`` as ``trace.ingest`` makes them; ``heads``: session_id, agent. What an event
    carries beyond the contract's fields goes into ``detail``; nulls are kept."""
    kept = {"ignoreNullFields": "false"}
    fixed = ("session_id", "sequence", "t", "tool", "path", "node_id", "turn", "agent")
    detail = F.struct(*[name for name in events.columns if name not in fixed] or [F.lit(None).cast("string").alias("note")])
    summary = F.struct("files_edited", "files_read", "tests_run").alias("summary")
    sessions = trace.trace_summary(events).join(heads, "session_id", "left").select(
        F.lit(0).alias("_section"), "session_id", F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("sequence"),
        F.to_json(F.struct("agent", "session_id", summary), kept).alias("body"),
    )
    steps = events.select(
        F.lit(1).alias("_section"), "session_id", F.col("t").cast("double").alias("t"), F.col("sequence").cast("bigint").alias("sequence"),
        F.to_json(F.struct(detail.alias("detail"), "node_id", "path", "session_id", "t", "tool", "turn"), kept).alias("body"),
    )
    named = F.element_at(F.array(*[F.lit(name) for name in TRACE_SECTIONS]), F.col("_section") + 1).alias("section")
    rows = sessions.unionByName(steps).select("*", named)
    write_artifact(rows.orderBy("_section", "session_id", "t", "sequence"), path, {"map_ref": {"commit": map_ref}})
