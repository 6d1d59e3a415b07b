"""The map contract as declared rules, compiled into few passes over the tables.

Rules about one row become one expression list per table. Rules about ids that must exist
become one tagged union whose distinct ids meet the nodes in one join, whatever number of
tables and rows refers to them. Levels and membership meet in one aggregate.

All results are (subject, rule), a row for every row that breaks a rule; a null where a
value is asked for breaks it. Empty tables break nothing. Columns beyond those named are
not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.session import cut_lineage
from archtrail.sources.artifacts import SEVERITIES, _broken, _filled, map_violations

# table, rule, expression for the id (or array of ids), what else names the row, subject from both (key, other), kinds that may stand there
REFERENCES = (
    ("edges", "edge source is a node", "source", "target", "concat_ws(' -> ', key, other)", None),
    ("edges", "edge target is a node", "target", "source", "concat_ws(' -> ', other, key)", None),
    ("membership", "member is a module or a file", "child", "parent", "concat_ws(' in ', key, other)", ("module", "file")),
    ("membership", "parent is a component or a module", "parent", "child", "concat_ws(' in ', other, key)", ("component", "module")),
    ("findings", "finding names nodes of the map", "node_ids", "id", "other", None),
)
LISTED = {"component": "module", "module": "file"}


def _asked(place: int, ids: str, other: str) -> Column:
    """One (key, other, place) per id that a row names; ``place`` is that of the rule in REFERENCES."""
    several = F.col(ids) if ids == "node_ids" else F.array(ids)
    return F.transform(several, lambda key: F.struct(
        key.alias("key"), F.col(other).cast("string").alias("other"), F.lit(place).cast("tinyint").alias("place")
    ))


def _by_place(values: list[Column]) -> Column:
    return reduce(lambda rest, at: rest.when(F.col("place") == at, values[at]), range(1, len(values)), F.when(F.col("place") == 0, values[0]))


def reference_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids in ``edges``, ``membership`` and ``findings`` that ``nodes`` (id, kind) does not have,
    or not with a kind that may stand there. Findings that name no node at all are left to the row rules.

    Each id meets the nodes once a rule, however many rows name it. Those that break the rule are
    written down, so their size is known when the rows that name them are sought: the tables are
    read twice, and dealt out again only for a broken set too large to broadcast."""
    by_table: dict[str, list[Column]] = {}
    for place, (table, _, ids, other, _, _) in enumerate(REFERENCES):
        by_table.setdefault(table, []).append(_asked(place, ids, other))
    asked = reduce(DataFrame.unionByName, [tables[name].select(F.inline(F.concat(*lists))) for name, lists in by_table.items()])
    known = tables["nodes"].where("id IS NOT NULL").groupBy(F.col("id").alias("key")).agg(F.collect_set("kind").alias("kinds"))
    fits = F.col("kinds").isNotNull() & F.coalesce(_by_place([
        F.arrays_overlap("kinds", F.array(*[F.lit(kind) for kind in kinds])) if kinds else F.lit(True) for *_, kinds in REFERENCES
    ]), F.lit(False))
    met = asked.select("key", "place").distinct().join(known, "key", "left")
    broken = cut_lineage(met.where(~fits).select(F.col("key").alias("_key"), F.col("place").alias("_place")))
    return asked.join(broken, F.col("key").eqNullSafe(F.col("_key")) & (F.col("place") == F.col("_place")), "left_semi").select(
        _by_place([F.expr(subject) for *_, subject, _ in REFERENCES]).alias("subject"),
        _by_place([F.lit(rule) for _, rule, *_ in REFERENCES]).alias("rule"),
    )


def finding_violations(findings: DataFrame) -> DataFrame:
    """``findings``: id, code, severity, message, node_ids, evidence."""
    rules = {
        "finding id is filled": _filled("id"),
        "finding code is filled": _filled("code"),
        "finding message is filled": _filled("message"),
        "finding severity is known": F.col("severity").isin(*SEVERITIES),
        "finding names nodes": (F.size("node_ids") > 0) & F.forall("node_ids", lambda n: F.length(n) > 0),
        "finding names a node once": F.size(F.array_distinct("node_ids")) == F.size("node_ids"),
        "finding has evidence": (F.size("evidence") > 0) & F.forall("evidence", lambda e: F.length(e) > 0),
    }
    return _broken(findings, F.col("id"), rules)


def level_rows(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(level, parent, child) as the document has to list them; the system's parent is empty."""
    top = nodes.where("kind = 'component'").select(F.lit("system").alias("level"), F.lit("").alias("parent"), F.col("id").alias("child"))
    owner = nodes.where(F.col("kind").isin(*LISTED)).select(F.col("id").alias("parent"), F.col("kind").alias("level"))
    return top.unionByName(membership.join(owner.distinct(), "parent").select("level", "parent", "child").distinct())


def level_violations(levels: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """``levels(level, parent, child)``, as a document lists them, against nodes and membership."""
    both = levels.select("level", "parent", "child", F.lit(1).alias("_said"), F.lit(0).alias("_due")).unionByName(
        level_rows(nodes, membership).distinct().select("*", F.lit(0).alias("_said"), F.lit(1).alias("_due"))
    )
    counted = both.groupBy("level", "parent", "child").agg(F.sum("_said").alias("said"), F.sum("_due").alias("due"))
    rules = {
        "level lists what belongs to it": (F.col("due") == 0) | (F.col("said") > 0),
        "level lists only what belongs to it": (F.col("said") == 0) | (F.col("due") > 0),
        "level lists a node once": F.col("said") <= 1,
    }
    return _broken(counted, F.concat_ws(" / ", "level", "parent", "child"), rules)


def detail_violations(events: DataFrame) -> DataFrame:
    """``events(sequence, detail)``: detail is a JSON object of text, numbers, truth values and nulls.

    A null detail is no detail and keeps the rule."""
    parsed = F.from_json("detail", "map<string,variant>", {"mode": "PERMISSIVE"})
    nested = F.exists(F.map_values(parsed), lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))
    rules = {
        "detail is an object": F.col("detail").isNull() | parsed.isNotNull(),
        "detail holds single values": F.col("detail").isNull() | parsed.isNull() | ~nested,
    }
    return _broken(events, F.col("sequence").cast("string"), rules)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules over nodes, edges, evidence, membership, findings and, where given, levels and events."""
    parts = [
        map_violations(tables["nodes"], tables["edges"], tables["evidence"]),
        reference_violations(tables), finding_violations(tables["findings"]),
    ]
    if "levels" in tables:
        parts.append(level_violations(tables["levels"], tables["nodes"], tables["membership"]))
    if "events" in tables:
        parts.append(detail_violations(tables["events"]))
    return reduce(DataFrame.unionByName, parts)
