"""Raw activity logs: JSON lines written by a tool hook."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.functions import text

# Bookkeeping keys that do not reach a trace.
HOOK_KEYS = ("hook_event", "tool_use_id")
LINE_TYPE = (
    "session_id string, agent string, timestamp string, turn string, tool string, path string, detail string, _bad string"
)


def parsed(lines: DataFrame) -> DataFrame:
    """Log lines (column ``value``) as fields of ``LINE_TYPE``; ``_bad`` has what is no object."""
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    fields = F.from_json("value", LINE_TYPE, options).alias("_line")
    others = [name for name in lines.columns if name != "value"]
    return lines.where(F.trim("value") != "").select(*others, fields).select(*others, "_line.*")


def shaped(fields: DataFrame) -> DataFrame:
    """Raw records from the fields of log lines, the same for a batch and a stream.

    ``detail`` is JSON with its keys in order and its types as written. Columns beyond
    those of a line (``sequence`` and the like) are kept."""
    detail = F.expr("from_json(if(startswith(ltrim(detail), '{'), detail, NULL), 'map<string,variant>')")
    inner = F.col("_detail")
    text = lambda key: F.expr(f"try_variant_get(_detail['{key}'], '$', 'string')")
    keys = F.array_sort(F.filter(F.map_keys(inner), lambda key: ~key.isin(*HOOK_KEYS)))
    rest = F.to_json(F.map_from_entries(F.transform(keys, lambda key: F.struct(key.alias("key"), inner[key].alias("value")))))
    others = [name for name in fields.columns if name not in {part.split(" ")[0] for part in LINE_TYPE.split(", ")}]
    number = lambda name: F.expr(f"try_cast({name} AS double)")
    return fields.withColumn("_detail", detail).select(
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce(F.when(F.col("agent") != "", F.col("agent")), F.lit("agent")).alias("agent"),
        F.coalesce(number("timestamp"), F.lit(0.0)).alias("timestamp"),
        F.greatest(F.lit(0), F.coalesce(number("turn").cast("bigint"), F.lit(0))).alias("turn"),
        F.coalesce("tool", F.lit("")).alias("tool"),
        F.coalesce("path", F.lit("")).alias("path"),
        text("hook_event").alias("hook_event"),
        F.coalesce(text("tool_use_id"), F.lit("")).alias("tool_use_id"),
        *others,
        F.coalesce(rest, F.lit("{}")).alias("detail"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All raw records of one or more JSONL files, strict.

    Large files are split over tasks. ``sequence`` is the order within the input, taken
    from file and row position. Bad lines or an empty log raise."""
    from archtrail.operators.ranking import with_position
    from archtrail.session import cut_lineage

    lines = (
        spark.read.text(path)
        .withColumn("_file", F.col("_metadata.file_path"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    rows = cut_lineage(parsed(lines))
    bad = rows.where(F.col("_bad").isNotNull()).select("_bad").first()
    if bad is not None:
        raise ValueError(f"invalid JSON in raw log: {bad[0][:80]}")
    if rows.isEmpty():
        raise ValueError("raw trace contains no events")
    placed = with_position(rows, F.col("_file"), F.col("_block"), F.col("_row"), name="sequence")
    return shaped(placed.drop("_file", "_block", "_row"))


def capture(payloads: DataFrame) -> DataFrame:
    """Hook payloads (session_id, tool_name, command, file_path, search_path,
    tool_use_id, hook_event, timestamp, sequence) as raw records: classified, with
    secrets removed from commands; unsupported tools are left out."""
    tool = text.classify_tool(F.col("tool_name"), F.col("command"))
    path = (
        F.when(F.col("tool_name").isin("Read", "Edit", "Write"), F.col("file_path"))
        .when(F.col("tool_name") == "Grep", F.col("search_path"))
        .otherwise(F.lit(""))
    )
    is_shell = F.col("tool_name") == "Bash"
    detail = F.to_json(
        F.struct(
            F.when(is_shell, text.redact(F.coalesce("command", F.lit("")))).alias("command"),
            F.when(F.col("hook_event") == "PostToolUse", F.lit(True)).alias("success"),
        )
    )
    return payloads.select(
        text.safe_session_id(F.col("session_id")).alias("session_id"),
        F.lit("agent").alias("agent"), "timestamp", F.lit(0).cast("bigint").alias("turn"),
        tool.alias("tool"), F.coalesce(path, F.lit("")).alias("path"), "hook_event",
        F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), "sequence", detail.alias("detail"),
    ).where(F.col("tool").isNotNull())


def write_lines(rows: list[dict], path: str | Path) -> None:
    """Append records to a log, for producers and tests."""
    with open(path, "a", encoding="utf-8") as log:
        for row in rows:
            log.write(json.dumps(row, separators=(",", ":")) + "\n")
