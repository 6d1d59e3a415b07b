"""One row that breaks it for every rule, and nothing else reported."""

import pytest
from pyspark.sql import functions as F

from archtrail.plans import tables
from archtrail.session import cut_lineage
from archtrail.sources import contract

NODES = "id string, kind string, role string, label string, loc long, fan_in long, fan_out long"
TYPES = {
    "nodes": NODES, "edges": "source string, target string, weight long, kind string",
    "evidence": "source string, target string, file string, line long", "membership": "child string, parent string",
    "findings": "id string, code string, severity string, message string, node_ids array<string>, evidence array<string>",
    "levels": "level string, parent string, child string", "events": "sequence long, detail string",
}
GOOD = {
    "nodes": [("c", "component", "source", "C", 1, 0, 0), ("m", "module", "source", "M", 1, 0, 0),
              ("f", "file", "source", "F", 1, 0, 1), ("g", "file", "source", "G", 1, 1, 0)],
    "edges": [("f", "g", 1, "imports")], "evidence": [("f", "g", "f.py", 1)],
    "membership": [("m", "c"), ("f", "m"), ("g", "m")],
    "findings": [("x", "large", "notice", "Large.", ["f", "g"], ["f.py"])],
    "levels": [("system", "", "c"), ("component", "c", "m"), ("module", "m", "f"), ("module", "m", "g")],
    "events": [(1, '{"a": 1, "b": "t", "c": null, "d": true, "e": 1.5}'), (2, "{}"), (3, None)],
}
FINDING = GOOD["findings"][0]


def finding(**changed):
    names = ("id", "code", "severity", "message", "node_ids", "evidence")
    return tuple(changed.get(name, value) for name, value in zip(names, FINDING))


# table, rows to add (or, where a set, rows to leave out), what is reported
CASES = [
    ("edges", [("f", "no", 1, "imports")], {("f -> no", "edge target is a node"), ("f -> no", "edge has evidence")}),
    ("edges", [(None, "g", 1, "imports")],
     {("g", "edge source is a node"), ("g", "edge ends are filled"), ("g", "edge has evidence")}),
    ("membership", [("no", "m")], {("no in m", "member is a module or a file"), ("module / m / no", "level lists what belongs to it")}),
    ("membership", [("g", "f")], {("g in f", "parent is a component or a module")}),
    ("findings", [finding(node_ids=["f", "no"])], {("x", "finding names nodes of the map")}),
    ("findings", [finding(id="")], {("", "finding id is filled")}),
    ("findings", [finding(code=None)], {("x", "finding code is filled")}),
    ("findings", [finding(message="")], {("x", "finding message is filled")}),
    ("findings", [finding(severity="loud")], {("x", "finding severity is known")}),
    ("findings", [finding(node_ids=[])], {("x", "finding names nodes")}),
    ("findings", [finding(node_ids=["f", "f"])], {("x", "finding names a node once")}),
    ("findings", [finding(evidence=[])], {("x", "finding has evidence")}),
    ("levels", {("module", "m", "f")}, {("module / m / f", "level lists what belongs to it")}),
    ("levels", [("module", "m", "c")], {("module / m / c", "level lists only what belongs to it")}),
    ("levels", [("system", "", "c")], {("system /  / c", "level lists a node once")}),
    ("events", [(4, '{"a": [1]}'), (5, '{"a": {"b": 1}}')], {("4", "detail holds single values"), ("5", "detail holds single values")}),
    ("events", [(6, "[1]"), (7, "no json")], {("6", "detail is an object"), ("7", "detail is an object")}),
    ("events", [], set()),
]


@pytest.mark.parametrize("table,change,expected", CASES, ids=[str(i) for i in range(len(CASES))])
def test_rule(spark, table, change, expected):
    rows = dict(GOOD)
    rows[table] = [r for r in GOOD[table] if r not in change] if isinstance(change, set) else GOOD[table] + change
    tables = {name: spark.createDataFrame(rows[name], TYPES[name]) for name in GOOD}
    got = [(r.subject, r.rule) for r in contract.violations(tables).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_empty(spark):
    tables = {name: spark.createDataFrame([], kind) for name, kind in TYPES.items()}
    assert contract.violations(tables).isEmpty()


def shuffled(spark):
    """Bytes shuffled by the session so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    known = context.statusStore().executorList(False)
    return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))


def test_ids_meet_the_nodes_once(spark):
    """Edges are not dealt out by their ends, however many name a node."""
    name = "concat('node ', id % 2000)"
    edges = cut_lineage(spark.range(200_000).selectExpr(f"{name} AS source", "IF(id = 7, 'gone', concat('node ', id * 7 % 2000)) AS target"))
    nodes = cut_lineage(spark.range(2000).selectExpr(f"{name} AS id", "'file' AS kind"))
    empty = {table: spark.createDataFrame([], TYPES[table]) for table in ("membership", "findings")}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        before = shuffled(spark)
        found = contract.reference_violations({"nodes": nodes, "edges": edges, **empty}).collect()
        assert [tuple(row) for row in found] == [("node 7 -> gone", "edge target is a node")]
        assert shuffled(spark) - before < 1_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_pairs_are_the_ends_of_sites(spark, tmp_path):
    for name in ("lineitem", "orders", "part"):
        rows = tables.table(spark, "/root/testdata/sf0.001", name)
        rows = rows.where("p_partkey % 5 <> 0") if name == "part" else rows
        rows = rows.withColumn("l_partkey", F.expr("nullif(l_partkey, 7)")) if name == "lineitem" else rows
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    pairs = tables.trade_pairs(spark, str(tmp_path)).selectExpr("concat('c:', buyer) AS source", "concat('s:', seller) AS target").collect()
    ends = tables.trade_sites(spark, str(tmp_path)).select("source", "target").distinct().collect()
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(ends)
