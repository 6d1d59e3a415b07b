"""Impact and trace artifacts: written by tasks, published, read back as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from archtrail.operators import impact, trace
from archtrail.plans import activity_queries as activity
from archtrail.plans import tables as t
from archtrail.plans import trade_queries as trade
from archtrail.plans.registry import query
from archtrail.session import cut_lineage, shared_dir
from archtrail.sources import committed, contract


def _target(spark, name: str) -> str:
    return f"{shared_dir(spark)}/archtrail-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _field(name: str):
    return F.get_json_object("body", f"$.{name}")


# A customer waits for the suppliers it buys from, suppliers wait for no one: the place is
# that of the largest supplier waited for, then suppliers before customers.
@query(
    "impact_artifact",
    f"""{trade.WITH}, {trade.CHANGES_SQL}, waits AS (SELECT source, max(target) AS dep FROM edges
      WHERE source IN (SELECT node_id FROM mapped) AND target IN (SELECT node_id FROM mapped) GROUP BY source)
    SELECT 'files' AS section, row_number() OVER (ORDER BY path, status) - 1 AS place, path AS one, status AS two,
      node_id AS three FROM mapped
    UNION ALL SELECT 'direct_dependents', row_number() OVER (ORDER BY changed_node_id, dependent_node_id) - 1,
      changed_node_id, dependent_node_id, NULL FROM dependents
    UNION ALL SELECT 'review_order', row_number() OVER (ORDER BY node_id IS NULL, coalesce(dep, path), dep IS NOT NULL, path) - 1,
      path, NULL, NULL FROM mapped LEFT JOIN waits ON source = node_id
    UNION ALL SELECT 'summary', 0, CAST((SELECT count(*) FROM mapped) AS VARCHAR),
      CAST((SELECT count(node_id) FROM mapped) AS VARCHAR),
      CAST((SELECT count(DISTINCT dependent_node_id) FROM dependents) AS VARCHAR)""",
)
def impact_artifact(spark, sf_dir):
    """Every row of the impact document as read back, the summary from its manifest."""
    edges = cut_lineage(trade._edges(spark, sf_dir))
    mapped = cut_lineage(trade.mapped_changes(spark, sf_dir))
    dependents = cut_lineage(impact.direct_dependents(mapped, edges, trade.file_index(spark, sf_dir)))
    path = _target(spark, "impact")
    committed.write_impact(mapped, dependents, impact.review_order(mapped, edges), path, "tables", "before", "after")
    summary = committed.manifest(path)["summary"]
    rows = committed.read_artifact(spark, path)
    listed = rows.select(
        "section", "place",
        F.when(F.col("section") == "review_order", F.get_json_object(F.concat(F.lit('{"path":'), "body", F.lit("}")), "$.path"))
        .otherwise(F.coalesce(_field("path"), _field("changed_node_id"))).alias("one"),
        F.when(F.col("section") != "review_order", F.coalesce(_field("status"), _field("dependent_node_id"))).alias("two"),
        F.when(F.col("section") == "files", _field("node_id")).alias("three"),
    )
    counts = [str(summary[name]) for name in ("changed_files", "mapped_files", "direct_dependents")]
    head = spark.createDataFrame([("summary", 0, *counts)], listed.schema)
    return listed.unionByName(head)


@query(
    "trace_artifact",
    f"""{activity.WITH}, {activity.RESOLVED}
    SELECT 'sessions' AS section, row_number() OVER (ORDER BY session_id) - 1 AS place, session_id,
      count(DISTINCT CASE WHEN tool = 'Read' THEN path END) AS one,
      count(DISTINCT CASE WHEN tool IN ('Edit', 'Write') THEN path END) AS two, NULL AS tool, NULL AS path, NULL AS node_id
      FROM resolved GROUP BY session_id
    UNION ALL SELECT 'events', row_number() OVER (ORDER BY session_id, t_micros, sequence) - 1, session_id,
      CAST(t_micros AS BIGINT), 0, tool, path, node_id FROM resolved""",
)
def trace_artifact(spark, sf_dir):
    """Every line of the trace document as read back: sessions with counts, events in order."""
    raw = activity._raw(spark, sf_dir)
    events = cut_lineage(trace.ingest(raw, t.supplier_nodes(spark, sf_dir)))
    path = _target(spark, "trace")
    committed.write_trace(events, trace.session_heads(raw), path, "tables")
    rows = committed.read_artifact(spark, path)
    return rows.select(
        "section", "place", _field("session_id").alias("session_id"),
        F.coalesce(_field("summary.files_read").cast("bigint"), _field("t").cast("double").cast("bigint")).alias("one"),
        F.coalesce(_field("summary.files_edited").cast("bigint"), F.lit(0).cast("bigint")).alias("two"),
        _field("tool").alias("tool"), _field("path").alias("path"), _field("node_id").alias("node_id"),
    )


# A map with faults: region 1 and the suppliers of nation 3 are missing, nation 7 is listed
# nowhere, findings of the later regions are too loud, details of errors and views are broken.
@query(
    "contract_rules",
    f"""{trade.WITH}, kept AS (SELECT id, kind FROM nodes WHERE id <> 'r:1'
      AND id NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_nationkey = 3)),
    due AS (SELECT 'system' AS level, '' AS parent, id AS child FROM kept WHERE kind = 'component'
      UNION ALL SELECT CASE kind WHEN 'component' THEN 'component' ELSE 'module' END, parent, child
        FROM members JOIN kept ON id = parent),
    said AS (SELECT 'system' AS level, '' AS parent, 'r:' || r_regionkey AS child FROM region
      UNION ALL SELECT CASE WHEN parent LIKE 'r:%' THEN 'component' ELSE 'module' END, parent, child FROM members WHERE child <> 'n:7')
    SELECT source || ' -> ' || target AS subject, 'edge target is a node' AS rule FROM edges WHERE target NOT IN (SELECT id FROM kept)
    UNION ALL SELECT child || ' in ' || parent, 'member is a module or a file' FROM members WHERE child NOT IN (SELECT id FROM kept)
    UNION ALL SELECT child || ' in ' || parent, 'parent is a component or a module' FROM members WHERE parent NOT IN (SELECT id FROM kept)
    UNION ALL SELECT 'n:' || n_nationkey, 'finding names nodes of the map' FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'n:' || n_nationkey, 'finding severity is known' FROM nation WHERE n_regionkey > 1
    UNION ALL SELECT level || ' / ' || parent || ' / ' || child, 'level lists what belongs to it' FROM (FROM due EXCEPT FROM said)
    UNION ALL SELECT level || ' / ' || parent || ' / ' || child, 'level lists only what belongs to it' FROM (FROM said EXCEPT FROM due)
    UNION ALL SELECT CAST(event_id AS VARCHAR), CASE event_type WHEN 'view' THEN 'detail is an object'
      ELSE 'detail holds single values' END FROM events WHERE event_type IN ('view', 'error')""",
)
def contract_rules(spark, sf_dir):
    text = {name: F.col(name).cast("string") for name in ("n_nationkey", "n_regionkey", "r_regionkey")}
    gone = t.table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(t._key("s:", "s_suppkey").alias("id"))
    nodes = t.trade_nodes(spark, sf_dir).where("id <> 'r:1'").join(gone, "id", "left_anti")
    membership = t.trade_membership(spark, sf_dir)
    nation, nation_id = t.table(spark, sf_dir, "nation"), F.concat(F.lit("n:"), text["n_nationkey"])
    severity = F.when(F.col("n_regionkey") == 0, "warning").when(F.col("n_regionkey") == 1, "notice").otherwise("loud")
    findings = nation.select(
        nation_id.alias("id"), F.lit("code").alias("code"), severity.alias("severity"), F.col("n_name").alias("message"),
        F.array(nation_id, F.concat(F.lit("r:"), text["n_regionkey"])).alias("node_ids"), F.array("n_name").alias("evidence"),
    )
    system = t.table(spark, sf_dir, "region").select(
        F.lit("system").alias("level"), F.lit("").alias("parent"), F.concat(F.lit("r:"), text["r_regionkey"]).alias("child")
    )
    level = F.when(F.col("parent").startswith("r:"), "component").otherwise("module")
    levels = system.unionByName(membership.where("child <> 'n:7'").select(level.alias("level"), "parent", "child"))
    kind = F.col("event_type")
    detail = F.when(kind == "error", '{"k": [1]}').when(kind == "view", "none").otherwise(F.col("props"))
    events = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), detail.alias("detail"))
    edges = cut_lineage(t.trade_pairs(spark, sf_dir).select(t._key("c:", "buyer").alias("source"), t._key("s:", "seller").alias("target")))
    tables = {"nodes": nodes, "edges": edges, "membership": membership, "findings": findings}
    return (
        contract.reference_violations(tables).unionByName(contract.finding_violations(findings))
        .unionByName(contract.level_violations(levels, nodes, membership)).unionByName(contract.detail_violations(events))
    )
