"""Trees, changes, logs, streaming, artifacts and prose on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from archtrail.functions import paths, text
from archtrail.operators import enrich, ignore, impact, trace
from archtrail.sources import artifacts, changes, events, tree
from archtrail.streaming import tail


def record(seconds, tool, path, call, phase, turn=0):
    detail = {"tool_use_id": call, "hook_event": phase}
    return {"session_id": "s", "agent": "a", "timestamp": seconds, "turn": turn, "tool": tool,
            "path": path, "detail": detail}


LOG = [
    record(10.0, "Read", "src/a.py", "read-1", "PreToolUse"),
    record(10.5, "Read", "src/a.py", "read-1", "PostToolUse"),
    record(13.5, "Write", "src/new.py", "write-1", "PostToolUse", 1),
    record(15.5, "Test", "", "test-1", "PostToolUse", 2),
]


def file_nodes(spark):
    return spark.createDataFrame([("file:src/a.py", "src/a.py")], "id string, path string")


def shown(df):
    rows = df.orderBy("t", "sequence").collect()
    return [(r.t, r.tool, r.path, r.node_id) for r in rows]


EXPECTED = [
    (0.0, "Read", "src/a.py", "file:src/a.py"),
    (3.0, "Write", "src/new.py", "file:src/new.py"),
    (5.0, "Test", "", None),
]


def test_log_becomes_a_trace(spark, tmp_path):
    events.write_lines(LOG, tmp_path / "s.jsonl")
    raw = events.read_log(spark, str(tmp_path / "s.jsonl"))
    resolved = trace.ingest(raw, file_nodes(spark))
    assert shown(resolved) == EXPECTED
    summary = trace.trace_summary(resolved).first()
    assert (summary.files_read, summary.files_edited, summary.tests_run) == (1, 1, 1)
    assert artifacts.trace_violations(resolved).isEmpty()
    (tmp_path / "bad.jsonl").write_text("{]\n")
    with pytest.raises(ValueError):
        events.read_log(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        events.read_log(spark, str(tmp_path / "empty.jsonl"))


def test_tail_keeps_up_with_late_and_unfinished_lines(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    target, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        tail.follow(tail.read_tail(spark, str(logs)), target, state, once=True).awaitTermination()
        return shown(tail.latest(spark, target, file_nodes(spark)))

    events.write_lines(LOG[2:3], logs / "s.jsonl")  # out of order: the start comes later
    with open(logs / "s.jsonl", "a") as log:
        log.write(json.dumps(LOG[0])[:30])  # unfinished line
    assert [row[1] for row in run()] == ["Write"]
    with open(logs / "s.jsonl", "a") as log:
        log.write(json.dumps(LOG[0])[30:] + "\nnot json\n")
    events.write_lines([LOG[1], LOG[3]], logs / "s.jsonl")
    assert run() == EXPECTED


def test_tail_keeps_files_and_generations_apart(spark, tmp_path):
    logs, target, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()

    def line(seconds, path, **more):
        return {"session_id": "s", "timestamp": seconds, "tool": "Read", "path": path, "turn": 1.0, "detail": {"n": 3, "success": True, **more}}

    def paths():
        tail.follow(tail.read_tail(spark, str(logs)), target, state, once=True).awaitTermination()
        return sorted(r.path for r in tail.latest(spark, target, file_nodes(spark)).collect())

    events.write_lines([line(10.0, "src/a.py")], logs / "one.jsonl")
    events.write_lines([line(11.0, "src/b.py")], logs / "two.jsonl")
    assert paths() == ["src/a.py", "src/b.py"]
    (logs / "one.jsonl").unlink()  # rotated: a new file under the old name, as long as the old one
    events.write_lines([line(20.0, "src/c.py")], logs / "one.jsonl")
    assert paths() == ["src/a.py", "src/b.py", "src/c.py"]
    events.write_lines([line(5.0, "src/d.py", tool_use_id="x", hook_event="PostToolUse")], logs / "late.jsonl")
    events.write_lines([line(21.0, "src/e.py", tool_use_id="x", hook_event="PostToolUse")], logs / "one.jsonl")
    assert paths() == ["src/a.py", "src/b.py", "src/c.py", "src/e.py"]  # the later file has the last word
    tail.compact(spark, target)
    assert paths() == ["src/a.py", "src/b.py", "src/c.py", "src/e.py"]
    one = tail.latest(spark, target, file_nodes(spark)).where("path = 'src/c.py'").first()
    batch = trace.ingest(events.read_log(spark, str(logs / "one.jsonl")), file_nodes(spark)).where("path = 'src/c.py'").first()
    assert (one.detail, one.turn) == (batch.detail, batch.turn) == ('{"n":3,"success":true}', 1)


def test_tree_walk_honours_ignore_layers(spark, tmp_path):
    for name, body in {
        "src/__init__.py": "", "src/gen/machine.py": "x", "src/gen/keep.py": "x", "node_modules/a.js": "",
        "src/gen/.gitignore": "*.py\n!keep.py\n", ".gitignore": "/skip/\n*.tmp.js\n", "skip/a.py": "",
        "web/a.tmp.js": "", "web/b.TSX": "", "README.md": "# Top\n", "setup.py": "",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    listed = tree.list_tree(spark, tmp_path)
    sources = {r.path for r in listed.where("kind = 'source'").collect()}
    assert sources == {"src/__init__.py", "src/gen/keep.py", "web/b.TSX", "setup.py"}
    contents = tree.read_contents(listed.where("path = 'README.md'"), tmp_path).first()
    assert bytes(contents.content) == b"# Top\n"
    with pytest.raises(ValueError):
        tree.path_pattern("!")


RULES = [
    ("*.log", "a.log", "a.log.b"), ("*.log", "x/y/a.log", "a.logs"), ("/a.py", "a.py", "x/a.py"), ("x/a.py", "x/a.py", "y/x/a.py"), ("**/x/a", "y/z/x/a", "y/xx/a"),
    ("x/**", "x/y/z", "x"), ("a/**/b", "a/b", "ab"), ("a/**/b", "a/x/y/b", "a/bb"), ("a?c", "abc", "a/c"), ("[a-c]x", "bx", "dx"), ("[!a]x", "bx", "ax"), ("a**b", "aXb", "a/b"),
    (r"\#a", "#a", "a"), (r"\!a", "!a", "a"), (r"a\ ", "a ", "a"), ("a  ", "a", "a  "), ("a[b", "a[b", "ab"), ("a.c", "a.c", "abc"), ("[]]", "]", "["), ("!x", "x", "y"),
]


@pytest.mark.parametrize(("line", "fits", "differs"), RULES)
def test_ignore_lines(line, fits, differs):
    import re

    found = ignore.rule(line)
    assert re.fullmatch(found[0], fits) and not re.fullmatch(found[0], differs)
    assert found[1] == (not line.startswith("!"))


def test_nested_ignore_files_of_a_table(spark):
    from archtrail.plans.analyze import table_sources

    files = {
        ".gitignore": "gen/*\n!gen/keep/\nlogs/\n*.tmp.py\n", "gen/.gitignore": "", "gen/a.py": "", "gen/keep/b.py": "", "gen/keep/.gitignore": "c.py\n", "gen/keep/c.py": "",
        "logs/.gitignore": "!*.py\n", "logs/d.py": "", "e.tmp.py": "", "sub/.gitignore": "!f.tmp.py\n", "sub/f.tmp.py": "", "sub/node_modules/g.py": "", "logs/setup.py": "", "sub/setup.py": "",
    }
    rows = [(path, bytearray(text.encode())) for path, text in files.items()]
    found = table_sources(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path for r in found.files.collect()} == {"gen/keep/b.py", "sub/f.tmp.py", "sub/setup.py"}
    assert [r.directory for r in found.markers.collect()] == ["sub"]


def test_role_overrides(spark):
    rows = [("pkg/bindings.py",), ("third/x/a.py",), ("src/test_a.py",), ("a.test.tsx",), ("tests.py",)]
    df = spark.createDataFrame(rows, "path string")
    role = paths.role(F.col("path"), [tree.path_pattern("pkg/bindings.py")], [tree.path_pattern("third/")])
    found = {r.path: r.role for r in df.select("path", role.alias("role")).collect()}
    assert list(found.values()) == ["generated", "vendored", "test", "test", "source"]


def test_event_paths_and_labels(spark):
    df = spark.createDataFrame([("/r/a/../b.py",), ("x/./y.py",), ("/else/z.py",), ("",)], "p string")
    assert [r[0] for r in df.select(paths.event_path(F.col("p"), "/r")).collect()] == [
        "b.py", "x/y.py", "/else/z.py", ""]
    labels = spark.createDataFrame([("foo_bar",), ("x9y",), ("ui-v2 kit",), ("api",)], "v string")
    assert [r[0] for r in labels.select(text.title_label(F.col("v"))).collect()] == [
        "Foo Bar", "X9Y", "UI V2 Kit", "Api"]


def test_a_change_table_becomes_an_impact(spark, tmp_path):
    log = tmp_path / "changes.jsonl"
    rows = [("core/disk.py", "M", None), ("GUIDE.md", "modified", None), ("core/tape.py", "D", None),
            ("core/cloud.py", "added", None), ("todo.txt", "A", None), ("core/new_name.py", "R090", "core/old.py")]
    log.write_text("".join(json.dumps(dict(zip(("path", "status", "old_path"), row))) + "\n" for row in rows))
    found = changes.read_changes(spark, str(log))
    assert {(r.path, r.status) for r in found.collect()} == {
        ("core/disk.py", "modified"), ("GUIDE.md", "modified"), ("core/tape.py", "deleted"),
        ("core/cloud.py", "added"), ("todo.txt", "added"), ("core/new_name.py", "renamed")}
    names = ("core/disk.py", "core/cloud.py", "app/start.py")
    nodes = spark.createDataFrame([(f"file:{n}", n) for n in names], "id string, path string")
    edges = spark.createDataFrame(
        [("file:app/start.py", "file:core/disk.py", 1), ("file:core/cloud.py", "file:core/disk.py", 1)],
        "source string, target string, weight int")
    mapped = impact.changed_nodes(found.where("old_path IS NULL"), nodes)
    dependents = impact.direct_dependents(mapped, edges, nodes)
    assert [tuple(r) for r in dependents.collect()] == [("file:core/disk.py", "file:app/start.py")]
    assert tuple(impact.impact_summary(mapped, dependents).first()) == (5, 2, 1)
    order = [r.path for r in impact.review_order(mapped, edges).orderBy("position").collect()]
    assert order == ["core/disk.py", "core/cloud.py", "GUIDE.md", "core/tape.py", "todo.txt"]
    assert artifacts.impact_violations(mapped).isEmpty()
    log.write_text(json.dumps({"path": "a", "status": "Z"}) + "\n")
    with pytest.raises(ValueError):
        changes.read_changes(spark, str(log))


def test_versions_follow_contents(spark):
    def digests(*rows):
        return spark.createDataFrame(rows, "path string, digest string")

    one = changes.content_version(digests(("a", "1"), ("b", "2")))
    assert one == changes.content_version(digests(("b", "2"), ("a", "1")))
    assert one != changes.content_version(digests(("a", "2"), ("b", "1")))
    changes.check_version(one, digests(("a", "1"), ("b", "2")))
    with pytest.raises(ValueError):
        changes.check_version(one, digests(("a", "1")))


def test_contract_violations(spark):
    nodes = spark.createDataFrame(
        [("a", "file", "source", "A", 1, 0, 0), ("a", "widget", "source", "", -1, 0, 0)],
        "id string, kind string, role string, label string, loc long, fan_in long, fan_out long")
    edges = spark.createDataFrame([("a", "b", 0)], "source string, target string, weight long")
    evidence = spark.createDataFrame([], "source string, target string, file string, line long")
    rules = {r.rule for r in artifacts.map_violations(nodes, edges, evidence).collect()}
    assert rules == {"node kind is known", "node label is filled", "metrics are not negative", "node id is unique",
                     "edge weight is at least 1", "edge has evidence"}


def test_prose_is_bounded_checked_and_guarded(spark):
    nodes = spark.createDataFrame(
        [("mod:a", "module", "A", "old", None, 5, 0, 1), ("mod:b", "module", "B", "old", None, 5, 1, 0),
         ("comp:x", "component", "X", "old", None, 10, 0, 0)],
        "id string, kind string, label string, summary string, path string, loc long, fan_in long, fan_out long")
    edges = spark.createDataFrame([("mod:a", "mod:b", 1, "run")], "source string, target string, weight long, label string")
    members = spark.createDataFrame([("mod:a", "comp:x"), ("mod:b", "comp:x")], "child string, parent string")
    context = enrich.module_context(nodes, edges, members)
    required = spark.createDataFrame([("comp:x", "{}")], "component string, head string")
    whole = enrich.bounded_prompts(context, required, "Do.").first()
    assert len(whole["items"]) == 3 and whole["omitted"] == 0
    json.loads(whole["prompt"].split("\n", 1)[1])
    short = enrich.bounded_prompts(context, required, "Do.", len(whole["prompt"]) - 1).first()
    assert len(short["items"]) == 2 and short["omitted"] == 1 and len(short["prompt"]) < len(whole["prompt"])

    prompts = enrich.bounded_prompts(context, required, "Do.")
    expected = spark.createDataFrame([("comp:x", "mod:a"), ("comp:x", "mod:b")], "component string, id string")
    answers = "component string, id string, label string, summary string"
    prose = spark.createDataFrame([("comp:x", i, "New", "Text.") for i in ("mod:a", "mod:b")], answers)
    told = "component string, source string, target string, label string"
    labels = spark.createDataFrame([("comp:x", "mod:a", "mod:b", "runs")], told)
    assert enrich.answer_violations(prompts, expected, prose, labels).isEmpty()
    wrong = spark.createDataFrame([("comp:x", "mod:a", "New", ""), ("comp:x", "mod:c", "New", "Text.")], answers)
    unseen = spark.createDataFrame([("comp:x", "mod:b", "mod:a", "l" * 121)] * 2, told)
    rules = {(r.subject, r.rule.split(" ")[0]) for r in enrich.answer_violations(prompts, expected, wrong, unseen).collect()}
    assert rules == {("mod:b", "every"), ("mod:c", "every"), ("mod:a", "texts"), ("mod:b -> mod:a", "links"), ("mod:b -> mod:a", "texts")}
    prose, labels = prose.drop("component"), labels.drop("component")
    new_nodes, new_edges = enrich.write_back(nodes, edges, prose, labels)
    assert {r.label for r in new_nodes.where("prose_source = 'llm'").collect()} == {"New"}
    assert new_edges.first().label == "runs"
    with pytest.raises(ValueError):
        enrich.write_back(nodes, edges, prose.unionByName(prose), labels)


def test_alias_with_nothing_for_the_star_equals_its_sql(spark, tmp_path):
    """A word that is the pattern's beginning and no more, and one that is dots only."""
    import duckdb
    from oracle import compare

    from archtrail.plans import registry

    html = "".join(f'<a href="/{word}">x</a>' for word in ("th", "...", "th.", "the", "thé.", "Th", "a b", ".", "..", "y"))
    spark.createDataFrame([(1, html), (2, None), (3, "none")], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(registry.QUERIES["resolve_alias"](spark, str(tmp_path)), con, registry.ORACLES["resolve_alias"]) is None


def test_files_are_parsed_by_many_tasks(spark):
    """One small input partition is dealt to all cores before it is parsed."""
    from archtrail.operators import facts

    files = spark.range(200).selectExpr("concat('m', id, '.py') AS path", "encode('import os\\n', 'UTF-8') AS content").coalesce(1)
    parsed = facts.extract(files)
    assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert parsed.selectExpr("sum(loc) AS n", "count(DISTINCT path) AS p").first().asDict() == {"n": 200, "p": 200}
