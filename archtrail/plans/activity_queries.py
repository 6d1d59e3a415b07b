"""Queries over the activity log derived from the events table.

Times are whole microseconds, so every comparison with the SQL is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.functions import text
from archtrail.operators import edges, impact, trace
from archtrail.plans import tables as t
from archtrail.plans import trade_queries as trade
from archtrail.plans.registry import query

WITH = f"WITH {t.RAW_SQL}"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.raw_events(t.table(spark, sf_dir, "events"))


def _micros(events: DataFrame) -> DataFrame:
    return events.withColumn("t_micros", F.col("t").cast("bigint"))


@query("dedup_events", f"{WITH} SELECT session_id, sequence, micros, tool, path, tool_use_id, hook_event FROM kept")
def dedup_events(spark, sf_dir):
    kept = trace.deduplicate(_raw(spark, sf_dir))
    micros = F.col("timestamp").cast("bigint").alias("micros")
    return kept.select("session_id", "sequence", micros, "tool", "path", "tool_use_id", "hook_event")


@query("relative_time", f"{WITH} SELECT session_id, sequence, CAST(t_micros AS BIGINT) AS t_micros FROM timed")
def relative_time(spark, sf_dir):
    timed = trace.relative_time(trace.deduplicate(_raw(spark, sf_dir)))
    return _micros(timed).select("session_id", "sequence", "t_micros")


TURNS = """calls AS (SELECT session_id, sequence, CASE WHEN tool_use_id = '' THEN 'seq:' || sequence
    ELSE 'id:' || tool_use_id END AS call FROM raw),
firsts AS (SELECT *, min(sequence) OVER (PARTITION BY session_id, call) AS first FROM calls),
turned AS (SELECT session_id, sequence,
    dense_rank() OVER (PARTITION BY session_id ORDER BY first) - 1 AS turn FROM firsts)"""


@query("first_seen_turn", f"{WITH}, {TURNS} SELECT session_id, sequence, turn FROM turned")
def first_seen_turn(spark, sf_dir):
    return trace.number_turns(_raw(spark, sf_dir)).select("session_id", "sequence", "turn")


RESOLVED = """resolved AS (SELECT k.*, coalesce('s:' || s_suppkey, 'file:' || path) AS node_id
  FROM timed k LEFT JOIN supplier ON 's:' || s_suppkey = path)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.ingest(_raw(spark, sf_dir), t.supplier_nodes(spark, sf_dir))


@query(
    "resolve_events",
    f"""{WITH}, {RESOLVED} SELECT session_id, sequence, CAST(t_micros AS BIGINT) AS t_micros,
      tool, path, node_id FROM resolved""",
)
def resolve_events(spark, sf_dir):
    return _micros(_events(spark, sf_dir)).select(
        "session_id", "sequence", "t_micros", "tool", "path", "node_id"
    )


@query(
    "provisional_paths",
    f"""{WITH}, {RESOLVED} SELECT DISTINCT node_id AS id FROM resolved
    WHERE node_id NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal >= 0)""",
)
def provisional_paths(spark, sf_dir):
    """Suppliers in debt are taken off the map, so activity on them is provisional."""
    known = t.table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    return trace.provisional(_events(spark, sf_dir), known.select(t._key("s:", "s_suppkey").alias("id")))


@query(
    "trace_summary",
    f"""{WITH} SELECT session_id, count(DISTINCT CASE WHEN tool = 'Read' THEN path END) AS files_read,
      count(DISTINCT CASE WHEN tool IN ('Edit', 'Write') THEN path END) AS files_edited,
      count(*) FILTER (WHERE tool = 'Test') AS tests_run FROM kept GROUP BY session_id""",
)
def trace_summary(spark, sf_dir):
    return trace.trace_summary(trace.deduplicate(_raw(spark, sf_dir)))


@query(
    "session_heads",
    f"{WITH} SELECT session_id, arg_min('agent of ' || tool, (micros, sequence)) AS agent FROM kept GROUP BY session_id",
)
def session_heads(spark, sf_dir):
    return trace.session_heads(_raw(spark, sf_dir))


# Conversations are sessions with explicit turns; a turn's text length is its time.
@query(
    "trace_turns",
    "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, turn FROM conversations",
)
def trace_turns(spark, sf_dir):
    rows = t.table(spark, sf_dir, "conversations")
    return trace.turns(rows.select(F.col("conv_id").cast("string").alias("session_id"), "turn"))


@query(
    "trace_ends",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, greatest(0.0, max(CAST(length(text) AS DOUBLE))) AS "end",
      max(turn) + 1 AS turn_count FROM conversations GROUP BY conv_id""",
)
def trace_ends(spark, sf_dir):
    rows = t.table(spark, sf_dir, "conversations")
    return trace.ends(
        rows.select(
            F.col("conv_id").cast("string").alias("session_id"), "turn",
            F.length("text").cast("double").alias("t"),
        )
    )


DAY = 86_400_000_000


@query(
    "replay_at_cursor",
    f"{WITH} SELECT session_id, sequence FROM timed WHERE t_micros <= {DAY}",
)
def replay_at_cursor(spark, sf_dir):
    return trace.replay(_events(spark, sf_dir), cursor=float(DAY)).select("session_id", "sequence")


@query("replay_turn", f"{WITH}, {TURNS} SELECT session_id, sequence FROM turned WHERE turn = 3")
def replay_turn(spark, sf_dir):
    return trace.replay(trace.number_turns(_raw(spark, sf_dir)), turn=3).select("session_id", "sequence")


ACTIVITY = """activity AS (SELECT m.parent AS id, count(*) FILTER (WHERE tool IN ('Edit', 'Write')) AS edits,
    count(*) FILTER (WHERE tool IN ('Read', 'Grep')) AS reads, count(*) AS total
  FROM resolved JOIN members m ON m.child = node_id GROUP BY m.parent)"""
FULL = f"WITH {t.RAW_SQL}, {t.SITES_SQL}, {t.TRADE_SQL}, {RESOLVED}"


def _map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, what belongs to what and the visible (module) level."""
    nodes = t.trade_nodes(spark, sf_dir)
    return nodes, t.trade_membership(spark, sf_dir), nodes.where(F.col("kind") == "module")


@query("activity_overlay", f"{FULL}, {ACTIVITY} SELECT id, edits, reads, total FROM activity")
def activity_overlay(spark, sf_dir):
    return trace.activity_overlay(_events(spark, sf_dir), *_map(spark, sf_dir))


@query(
    "heat_intensity",
    f"""{FULL}, {ACTIVITY} SELECT id, edits, reads, total,
      round(0.28 + total / greatest(1, max(total) OVER ()) * 0.52, 6) AS intensity FROM activity""",
)
def heat_intensity(spark, sf_dir):
    heated = trace.heat(trace.activity_overlay(_events(spark, sf_dir), *_map(spark, sf_dir)))
    return heated.withColumn("intensity", F.round("intensity", 6))


# One session at a time would read almost every supplier; unread dependents are
# shown over customers, which depend on suppliers and are never opened.
UNREAD = """touched AS (SELECT node_id, bool_or(tool IN ('Edit', 'Write')) AS edited,
    bool_or(tool IN ('Read', 'Grep')) AS was_read FROM resolved
    WHERE node_id IN (SELECT id FROM nodes) GROUP BY node_id),
unread AS (SELECT DISTINCT source AS node FROM edges
  WHERE target IN (SELECT node_id FROM touched WHERE edited)
    AND source NOT IN (SELECT node_id FROM touched WHERE was_read))"""


@query("unread_dependents", f"{FULL}, {UNREAD} SELECT node FROM unread")
def unread_dependents(spark, sf_dir):
    links = edges.edge_weights(t.trade_sites(spark, sf_dir))
    return trace.unread_dependents(_events(spark, sf_dir), t.trade_nodes(spark, sf_dir), links)


@query("unread_overlay", f"{FULL}, {UNREAD} SELECT DISTINCT parent AS id FROM unread JOIN members ON child = node")
def unread_overlay(spark, sf_dir):
    nodes, membership, visible = _map(spark, sf_dir)
    links = edges.edge_weights(t.trade_sites(spark, sf_dir))
    return trace.unread_overlay(_events(spark, sf_dir), nodes, links, membership, visible)


@query(
    "trace_coverage",
    f"""{FULL}, {trade.CHANGES_SQL}, touched AS (SELECT node_id,
        bool_or(tool IN ('Edit', 'Write')) AS edited, bool_or(tool IN ('Read', 'Grep')) AS was_read
      FROM resolved GROUP BY node_id)
    SELECT path, coalesce(edited, false) AS edited, coalesce(was_read, false) AS "read",
      NOT coalesce(edited, false) AND NOT coalesce(was_read, false) AS unobserved
    FROM mapped LEFT JOIN touched USING (node_id) WHERE node_id IS NOT NULL""",
)
def trace_coverage(spark, sf_dir):
    return impact.trace_coverage(trade.mapped_changes(spark, sf_dir), _events(spark, sf_dir))


@query(
    "p95_index",
    """SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n
      FROM events) WHERE rn = 1 + least(n - 1, CAST(floor(n * 0.95) AS BIGINT))""",
)
def p95_index(spark, sf_dir):
    return trace.value_at_rank(t.table(spark, sf_dir, "events"), "value", 0.95)


@query(
    "frame_statistics",
    """SELECT round(count(*) / (sum(value) / 1000.0), 6) AS average_fps,
      CAST(sum(greatest(0, floor(value / (1000.0 / 60.0) + 0.5) - 1)) AS BIGINT) AS dropped_frames,
      count(*) AS frame_count FROM events""",
)
def frame_statistics(spark, sf_dir):
    frames = t.table(spark, sf_dir, "events").select(F.col("value").alias("frame_ms"))
    return trace.frame_statistics(frames).withColumn("average_fps", F.round("average_fps", 6))


@query(
    "safe_session",
    r"""SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'),
      '^[.\-]+|[.\-]+$', '', 'g'), ''), 'unknown-session') AS session FROM conversations""",
)
def safe_session(spark, sf_dir):
    rows = t.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.safe_session_id(F.col("text")).alias("session"))
