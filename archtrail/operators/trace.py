"""Resolve tool-use records against a map and overlay them on it.

Raw records: session_id, agent, timestamp (double seconds), turn, tool, path,
hook_event, tool_use_id, sequence, detail. Several sessions may share a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.functions.paths import event_path
from archtrail.operators.hierarchy import nearest_visible
from archtrail.operators.ranking import ordinal_in_group, with_position

EDITS = ("Edit", "Write")
READS = ("Read", "Grep")


def _is_post() -> Column:
    return F.coalesce(F.col("hook_event") == "PostToolUse", F.lit(False))


def precedence(columns: list[str]) -> Column:
    """Which record of one tool call stands: the last one after the call, and
    without such a record the first one seen. Larger wins.

    Records of several files carry ``epoch``, the time of the first record of their
    file; that goes before the position in the file."""
    sequence = F.col("sequence").cast("bigint")
    epoch = F.col("epoch") if "epoch" in columns else F.lit(0.0)
    return F.struct(
        _is_post().cast("int").alias("post"),
        F.when(_is_post(), epoch).otherwise(-epoch).alias("epoch"),
        F.when(_is_post(), sequence).otherwise(-sequence).alias("order"),
    )


def call_key(columns: list[str]) -> Column:
    """Identity of a call within its session; a record without an id is alone. A
    position is one within its ``origin`` (file and beginning), where that is given."""
    named = F.length(F.coalesce("tool_use_id", F.lit(""))) > 0
    place = F.col("sequence").cast("string")
    if "origin" in columns:
        place = F.concat_ws(":", "origin", place)
    return F.when(named, F.concat(F.lit("id:"), "tool_use_id")).otherwise(F.concat(F.lit("seq:"), place))


def kept_calls(raw: DataFrame) -> DataFrame:
    """(session_id, _call, _kept): the record of each tool call that stands.

    An aggregate with partial sums per map task rather than a per-call window, so
    a call or session with very many records is reduced before it is shuffled."""
    payload = F.struct(*[name for name in raw.columns if name != "session_id"])
    return raw.groupBy("session_id", call_key(raw.columns).alias("_call")).agg(
        F.max_by(payload, precedence(raw.columns)).alias("_kept")
    )


def deduplicate(raw: DataFrame) -> DataFrame:
    """One record per tool call."""
    return kept_calls(raw).select("session_id", "_kept.*")


def relative_time(events: DataFrame) -> DataFrame:
    """Add ``t``: seconds since the first kept record of the session."""
    start = events.groupBy("session_id").agg(F.min("timestamp").alias("_start"))
    shifted = F.greatest(F.lit(0.0), F.col("timestamp") - F.col("_start"))
    return events.join(start, "session_id").withColumn("t", shifted).drop("_start")


def resolve_nodes(events: DataFrame, file_nodes: DataFrame) -> DataFrame:
    """Add ``node_id``: the node of the path, a provisional ``file:<path>`` for
    an unknown one, null without a path. ``file_nodes``: id, path."""
    index = file_nodes.select("path", F.col("id").alias("_known"))
    provisional = F.when(F.col("path") != "", F.concat(F.lit("file:"), "path"))
    return (
        events.join(index, "path", "left")
        .withColumn("node_id", F.coalesce("_known", provisional))
        .drop("_known")
    )


def ingest(raw: DataFrame, file_nodes: DataFrame, repo_root: str | None = None) -> DataFrame:
    """Raw records to trace events: session_id, sequence, t, tool, path, node_id,
    turn and whatever detail the records carry."""
    kept = relative_time(deduplicate(raw))
    path = F.coalesce("path", F.lit(""))
    kept = kept.withColumn("path", event_path(path, repo_root) if repo_root else path)
    kept = kept.withColumn("turn", F.greatest(F.lit(0), F.coalesce("turn", F.lit(0))).cast("bigint"))
    return resolve_nodes(kept, file_nodes).drop("hook_event", "tool_use_id", "timestamp")


def session_heads(raw: DataFrame) -> DataFrame:
    """Agent of the first kept record per session."""
    first = F.struct("timestamp", "sequence")
    return deduplicate(raw).groupBy("session_id").agg(F.min_by("agent", first).alias("agent"))


def trace_summary(events: DataFrame) -> DataFrame:
    """Per session: distinct files read (plain reads only), distinct files edited,
    test runs."""
    has_path = F.col("path") != ""
    return events.groupBy("session_id").agg(
        F.count_distinct(F.when((F.col("tool") == "Read") & has_path, F.col("path"))).alias("files_read"),
        F.count_distinct(F.when(F.col("tool").isin(*EDITS) & has_path, F.col("path"))).alias("files_edited"),
        F.count_if(F.col("tool") == "Test").alias("tests_run"),
    )


def number_turns(raw: DataFrame) -> DataFrame:
    """Add ``turn``: place of the call among the calls of its session in the order
    they first appear; records without an id each take a place of their own."""
    calls = raw.withColumn("_call", call_key(raw.columns))
    firsts = calls.groupBy("session_id", "_call").agg(F.min("sequence").alias("_first"))
    numbered = ordinal_in_group(firsts, ["session_id"], F.col("_first"), name="turn")
    kept = calls.drop("turn") if "turn" in calls.columns else calls
    return kept.join(numbered.drop("_first"), ["session_id", "_call"]).drop("_call")


def replay(events: DataFrame, cursor: float | None = None, turn: int | None = None) -> DataFrame:
    """Events of one turn, or all events up to the cursor."""
    if turn is not None:
        return events.where(F.col("turn") == turn)
    return events if cursor is None else events.where(F.col("t") <= cursor)


def turns(events: DataFrame) -> DataFrame:
    return events.select("session_id", "turn").distinct()


def ends(events: DataFrame) -> DataFrame:
    """Per session: last time (at least 0) and number of turns."""
    return events.groupBy("session_id").agg(
        F.greatest(F.lit(0.0), F.max("t")).alias("end"), (F.max("turn") + 1).alias("turn_count")
    )


def provisional(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node ids that activity names but the map does not have."""
    named = events.where(F.col("node_id").isNotNull()).select(F.col("node_id").alias("id")).distinct()
    return named.join(nodes.select("id"), "id", "left_anti")


def activity_overlay(
    events: DataFrame, nodes: DataFrame, membership: DataFrame, visible: DataFrame
) -> DataFrame:
    """(id, edits, reads, total) per visible node.

    Events are counted per file first; only those counts are moved up the
    hierarchy, so the shuffle to a busy component carries one row per file."""
    per_file = (
        events.where(F.col("node_id").isNotNull())
        .groupBy(F.col("node_id").alias("node"))
        .agg(
            F.count_if(F.col("tool").isin(*EDITS)).alias("edits"),
            F.count_if(F.col("tool").isin(*READS)).alias("reads"),
            F.count(F.lit(1)).alias("total"),
        )
    )
    known = per_file.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return (
        known.join(nearest_visible(known, membership, visible), "node")
        .groupBy(F.col("shown").alias("id"))
        .agg(*[F.sum(name).cast("bigint").alias(name) for name in ("edits", "reads", "total")])
    )


def heat(activity: DataFrame) -> DataFrame:
    """Add ``intensity``: 0.28 for no activity up to 0.8 for the busiest node.

    ``activity`` has one row per visible node; the maximum is one number, joined
    back through a constant key."""
    peak = activity.agg(F.greatest(F.lit(1), F.max("total")).alias("_peak")).withColumn("_one", F.lit(1))
    return (
        activity.withColumn("_one", F.lit(1))
        .join(F.broadcast(peak), "_one")  # a single row
        .withColumn("intensity", F.lit(0.28) + F.col("total") / F.col("_peak") * F.lit(0.52))
        .drop("_one", "_peak")
    )


def unread_dependents(events: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that depend on an edited file and were never read themselves."""
    known = events.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    touched = known.groupBy("node_id").agg(
        F.bool_or(F.col("tool").isin(*EDITS)).alias("edited"),
        F.bool_or(F.col("tool").isin(*READS)).alias("read"),
    )
    edited = touched.where("edited").select(F.col("node_id").alias("target"))
    read = touched.where("read").select(F.col("node_id").alias("source"))
    return (
        edges.join(edited, "target", "left_semi")
        .join(read, "source", "left_anti")
        .select(F.col("source").alias("node"))
        .distinct()
    )


def unread_overlay(
    events: DataFrame, nodes: DataFrame, edges: DataFrame, membership: DataFrame, visible: DataFrame
) -> DataFrame:
    """Unread dependents moved up to the visible nodes."""
    risky = unread_dependents(events, nodes, edges)
    return nearest_visible(risky, membership, visible).select(F.col("shown").alias("id")).distinct()


def value_at_rank(values: DataFrame, column: str, fraction: float) -> DataFrame:
    """The value at index ``floor(fraction * n)`` of the sorted column, never past
    the end. No interpolation."""
    # Only a range that surely holds the value is put in order: bounds around it come
    # from approximate quantiles, and exact counts say where in the range to look.
    near = [max(0.0, fraction - 0.01), fraction, min(1.0, fraction + 0.01)]
    low, _, high = values.agg(F.percentile_approx(column, near, 1000)).first()[0] or (None,) * 3
    if low is None:
        return values.select(column).limit(0)
    at = F.col(column)
    total, below, upto = values.agg(F.count(column), F.count_if(at < low), F.count_if(at <= high)).first()
    index = min(total - 1, int(total * fraction))
    if not below <= index < upto:  # the bounds were off; take all
        low, high, below = *values.agg(F.min(column), F.max(column)).first(), 0
    # The tie breaker lets a value that fills many rows span several partitions.
    rows = values.where(at.between(low, high)).select(column, F.monotonically_increasing_id().alias("_tie"))
    placed = with_position(rows, at, F.col("_tie"), name="_place")
    return placed.where(F.col("_place") == index - below + 1).select(at)


def frame_statistics(frames: DataFrame) -> DataFrame:
    """Mean rate and dropped frames of a recording (``frame_ms``), at 60 Hz."""
    interval = 1000.0 / 60.0
    missed = F.greatest(F.lit(0), F.floor(F.col("frame_ms") / interval + 0.5) - 1)
    return frames.agg(
        (F.count(F.lit(1)) / (F.sum("frame_ms") / 1000.0)).alias("average_fps"),
        F.sum(missed).cast("bigint").alias("dropped_frames"),
        F.count(F.lit(1)).alias("frame_count"),
    )
