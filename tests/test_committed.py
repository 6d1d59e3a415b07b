"""Artifacts written by tasks: order, one manifest, nothing of failed attempts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from archtrail.sources import committed


def test_impact_document(spark, tmp_path):
    mapped = spark.createDataFrame(
        [("b", None, "modified", "file:b"), ("a\"\n", "old", "renamed", "file:a"), ("z", None, "deleted", None)],
        "path string, old_path string, status string, node_id string").repartition(3)
    dependents = spark.createDataFrame([("file:b", "file:y"), ("file:a", "file:y"), ("file:a", "file:x")],
                                       "changed_node_id string, dependent_node_id string")
    order = spark.createDataFrame([(2, "a\"\n"), (1, "b"), (3, "z")], "position int, path string")
    path = str(tmp_path / "impact")
    committed.write_impact(mapped, dependents, order, path, "v1", "one", "two")
    whole = json.loads("".join(committed.document(path)))
    assert whole == {
        "schema_version": "1.0", "map_ref": {"commit": "v1"}, "comparison": {"base": "one", "head": "two"},
        "files": [{"path": "a\"\n", "old_path": "old", "status": "renamed", "node_id": "file:a"},
                  {"path": "b", "status": "modified", "node_id": "file:b"}, {"path": "z", "status": "deleted"}],
        "direct_dependents": [{"changed_node_id": c, "dependent_node_id": d}
                              for c, d in (("file:a", "file:x"), ("file:a", "file:y"), ("file:b", "file:y"))],
        "review_order": ["b", "a\"\n", "z"],
        "summary": {"changed_files": 3, "mapped_files": 2, "direct_dependents": 2},
    }
    rows = committed.read_artifact(spark, path).where("section = 'review_order'").orderBy("place").collect()
    assert [(r.place, json.loads(r.body)) for r in rows] == [(0, "b"), (1, "a\"\n"), (2, "z")]
    with pytest.raises(Exception, match="overwrite"):
        mapped.select(F.lit("s").alias("section"), F.lit("1").alias("body")).write.format(committed.FORMAT).mode("append").save(path)


def test_trace_keeps_nulls(spark, tmp_path):
    events = spark.createDataFrame(
        [("s", 2, 1.5, "Edit", "é", "file:é", 1, None), ("s", 1, 0.0, "Bash", "", None, 0, "ls")],
        "session_id string, sequence long, t double, tool string, path string, node_id string, turn long, command string")
    heads = spark.createDataFrame([("s", "someone")], "session_id string, agent string")
    path = str(tmp_path / "trace")
    committed.write_trace(events, heads, path, "v2")
    whole = json.loads("".join(committed.document(path)))
    assert whole["sessions"] == [{"session_id": "s", "agent": "someone",
                                  "summary": {"files_read": 0, "files_edited": 1, "tests_run": 0}}]
    assert [e["detail"] for e in whole["events"]] == [{"command": "ls"}, {"command": None}]
    assert whole["events"][0]["node_id"] is None and "é" in "".join(committed.document(path))


def test_failed_write_leaves_the_last_artifact(spark, tmp_path):
    path = str(tmp_path / "one")
    good = spark.range(100, numPartitions=4).select(F.lit("n").alias("section"), F.col("id").cast("string").alias("body"))
    committed.write_artifact(good, path, {})
    assert [int(r.body) for r in committed.read_artifact(spark, path).orderBy("place").collect()] == list(range(100))
    bad = good.withColumn("body", F.when(F.col("body") != "77", F.col("body")))
    with pytest.raises(Exception):
        committed.write_artifact(bad, path, {})
    assert committed.read_artifact(spark, path).count() == 100
    assert len([name for name in os.listdir(path) if name.startswith("parts-")]) == 1
    committed.write_artifact(good.limit(0), path, {})
    assert committed.read_artifact(spark, path).isEmpty()
    assert json.loads("".join(committed.document(path))) == {"schema_version": "1.0"}
