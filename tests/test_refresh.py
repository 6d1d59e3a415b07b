"""Re-export chains by doubling, and resolution of what a change can touch, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from tree_cases import make_files, pairs

from archtrail.operators import incremental, lookups, reexports, resolve
from archtrail.operators.facts import extract, import_sites
from archtrail.plans.analyze import table_sources


def walk(options, importer, target, symbol):
    """The way through package files, one file after the other."""
    seen = {importer, target}
    while target.endswith("__init__.py"):
        ahead = [n for _, n in sorted(options.get((target, symbol), [])) if n not in seen]
        if not ahead:
            return target
        target = ahead[0]
        seen.add(target)
    return target


def follow_all(spark, options, sites):
    rows = [(file, symbol, (line, "m"), to) for (file, symbol), own in options.items() for line, to in own]
    table = spark.createDataFrame(rows, "file string, symbol string, order struct<line: long, module: string>, next string")
    nodes = table.groupBy("file", "symbol").agg(F.min_by("next", "order").alias("next"), F.count_distinct("next").alias("n_options"))
    ends = reexports.follow(nodes)
    placed = spark.createDataFrame([(str(k), i, s, t, "package") for k, (i, t, s) in enumerate(sites)], "site string, importer string, symbol string, target string, via string")
    got = {r.site: r.target for r in resolve._follow_packages(placed, nodes, table, ends).collect()}
    assert got == {str(k): walk(options, i, t, s) for k, (i, t, s) in enumerate(sites)}
    return ends


def test_thousand_files_hand_a_name_on(spark, monkeypatch):
    rounds = []
    jump = reexports._jump
    monkeypatch.setattr(reexports, "_jump", lambda state: rounds.append(1) or jump(state))
    name = lambda k: f"p{k}/__init__.py"
    options = {(name(k), "x"): [(1, name(k + 1))] for k in range(1000)}
    options[name(1000), "x"] = [(3, "end.py")]
    sites = [("a.py", name(0), "x"), ("b.py", name(617), "x"), (name(3), name(4), "x"), ("c.py", name(0), "missing")]
    ends = follow_all(spark, options, sites)
    assert len(rounds) <= 11 and ends.where("final = 'end.py'").count() == 1001


def test_circles_and_other_imports(spark):
    random.seed(5)
    names = [f"p{k}/__init__.py" for k in range(30)]
    options = {}
    for name in names:
        for symbol in "xy":
            if random.random() < 0.9:
                options[name, symbol] = [(line, to) for line in range(random.choice([1, 1, 1, 2, 3])) if (to := random.choice([*names, "a.py", "b.py"])) != name] or [(9, "c.py")]
    sites = [(random.choice([*names, "s.py", "t.py"]), random.choice(names), random.choice("xyz")) for _ in range(200)]
    ends = follow_all(spark, options, [s for s in sites if s[0] != s[1]])
    assert not ends.where("circular").isEmpty()


SMALL = {
    "pyproject.toml": "", "lib/src/__init__.py": "", "lib/src/tools/__init__.py": "from .cut import cut\nfrom .bend import bend\n", "lib/src/tools/cut.py": "def cut(): pass\n",
    "lib/src/tools/bend.py": "def bend(): pass\n", "shop/__init__.py": "from shop.desk import sell\n", "shop/desk.py": "import tools.cut\nfrom tools import bend\n\ndef sell(): pass\n",
    "shop/cart.py": "from shop import sell\nfrom shop import missing\nimport prices\n", "shop/old/prices.py": "ONE = 1\n", "shop/view.py": "import prices\nfrom .cart import total\n", "logging.py": "", "uses.py": "import logging\n",
    "web/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["parts/*"]}}}', "web/app.ts": "import { knob } from '@/knob'\nimport './side'\n", "web/parts/knob.ts": "export const knob = 1\n", "web/side.js": "",
}
EDITS = {
    "symbols come and go": {
        "lib/src/tools/__init__.py": "from .cut import cut\n", "shop/__init__.py": "from shop.till import sell\nmissing = 1\n", "shop/till.py": "def sell(): pass\n",
        "web/parts/knob.tsx": "export const knob = 2\n", "web/parts/knob.ts": None,
    },
    "closer file": {"shop/prices.py": "TWO = 2\n"},
    "files go, a root comes": {
        "shop/old/prices.py": None, "web/side.js": None, "lib/src/tools/__init__.py": None, "more/src/prices.py": "", "other.py": "import prices\n",
        "web/tsconfig.json": '{"compilerOptions": {"baseUrl": "parts"}}',
    },
    "nothing": {},
}


@pytest.fixture(scope="module")
def first(spark):
    sources = table_sources(make_files(spark, SMALL))
    facts = extract(sources.files).cache()
    return sources, lookups.resolve_all(facts, sources.markers, sources.configs)


@pytest.fixture(scope="module")
def snapshot(spark):
    from archtrail.plans import refresh

    return refresh.first(table_sources(make_files(spark, SMALL)))


@pytest.mark.parametrize("name", EDITS)
def test_changed_equals_all(spark, first, name):
    before, state = first
    files = {path: text for path, text in {**SMALL, **EDITS[name]}.items() if text is not None}
    after = table_sources(make_files(spark, files))
    facts = extract(after.files).cache()
    changes = incremental.snapshot_changes(incremental.fingerprint(before.files), incremental.fingerprint(after.files))
    now, change = lookups.resolve_changed(state, facts, changes.select("path"), after.markers, after.configs)
    full = lookups.resolve_all(facts, after.markers, after.configs)
    columns = ["source", "target", "file", "line", "symbols"]
    assert incremental.same_structure(now.resolved, full.resolved, columns)
    for view, own in (("sites", ["site"]), ("direct", ["site", "target", "via"]), ("questions", [*lookups.KEY, "site"])):
        assert incremental.same_structure(getattr(now, view), getattr(full, view), own), view
    old = {tuple(r) for r in state.resolved.select("source", "target", "line").collect()}
    for r in change.delta.collect():
        (old.remove if r.sign < 0 else old.add)((r.source, r.target, r.line))
    assert old == {tuple(r) for r in full.resolved.select("source", "target", "line").collect()}
    touched = {r.importer for r in change.again.collect()}
    if name == "closer file":
        assert touched == {"shop/cart.py", "shop/view.py"}
    if name == "nothing":
        assert not touched and change.delta.isEmpty()
    assert pairs(now.resolved) == pairs(resolve.resolve_sites(import_sites(facts), facts, after.markers, after.configs))


CHANGES = {
    "touched groups": {"shop/desk.py": "import tools.cut\nfrom tools import bend\n\ndef sell(): pass\n\ndef buy(): pass\n" + "# more\n" * 30, "shop/view.py": "import prices\nfrom .cart import amount, total\n"},
    "formed again": {"shop/view.py": "import prices\n", "shop/new.py": "from shop import desk\n"},
    "reused": {},
}
KEYS = {"nodes": ["id", "kind", "role", "label", "summary", "path", "loc", "fan_in", "fan_out"], "edges": ["source", "target", "weight", "label"],
        "evidence": ["source", "target", "file", "line"], "membership": ["child", "parent"], "findings": ["id", "code", "severity", "message", "node_ids", "evidence"]}


@pytest.mark.parametrize("kind", CHANGES)
def test_refreshed_map_equals_a_new_one(spark, snapshot, kind, monkeypatch):
    from archtrail.plans import analyze, refresh

    after = table_sources(make_files(spark, {**SMALL, **CHANGES[kind]}))
    whole = None if kind == "reused" else refresh.first(after)
    if kind != "formed again":
        monkeypatch.setattr(analyze, "layers", None)  # forming layers again would fail
    if kind == "reused":
        monkeypatch.setattr(lookups, "resolve_changed", None)  # and so would any look at the sites
    now, report = refresh.refresh(snapshot, after)
    assert report.layers == kind
    if kind == "reused":
        assert now is snapshot
        return
    for table, columns in KEYS.items():
        assert incremental.same_structure(getattr(now.map, table), getattr(whole.map, table), columns), table
    assert incremental.same_structure(now.lines, whole.lines, [*refresh.PAIR, "file", "line", "n"])
    assert incremental.same_structure(now.symbols, whole.symbols, [*refresh.PAIR, "symbol", "n"])
    if kind == "touched groups":
        all_groups = now.map.nodes.where("kind <> 'file'").count()
        assert 0 < report.touched.count() < all_groups


def test_sites_of_one_directory_share_their_questions(spark):
    rows = [(f"app/x{k}.py", b"from lib.a import f\nfrom .y import z\n") for k in range(20)]
    rows += [("lib/a.py", b"def f(): pass\n"), ("app/y.py", b"z = 1\n")]
    facts = extract(spark.createDataFrame(rows, "path string, content binary"))
    state = lookups.resolve_all(facts, spark.createDataFrame([], "directory string"), spark.createDataFrame([], resolve.CONFIG_TYPE))
    assert sorted(map(tuple, state.resolved.groupBy("target").count().collect())) == [("file:app/y.py", 20), ("file:lib/a.py", 20)]
    assert state.questions.count() == 8


def test_closest_file_is_not_the_importer(spark):
    places = spark.createDataFrame([("d/m.py", "d", "m"), ("d/e/m.py", "d/e", "m"), ("z/m.py", "z", "m")], "path string, root string, module string")
    importers = ["d/m.py", "d/b.py", "d/e/m.py", "d/e/c.py", "z/m.py", "top.py"]
    sites = spark.createDataFrame([(i, i, "m") for i in importers], "site string, importer string, module string")
    got = {r.site: r.target for r in resolve.closest_files(sites, places, places, ["module"]).collect()}
    assert got == {
        "d/m.py": "d/e/m.py", "d/b.py": "d/e/m.py", "d/e/m.py": "d/m.py", "d/e/c.py": "d/e/m.py", "z/m.py": "d/e/m.py", "top.py": "d/e/m.py",
    }


def test_imports_in_all_kinds_of_blocks(spark):
    body = (
        b"import a\ntry:\n    import b\nexcept E:\n    import c\nelse:\n    import d\nfinally:\n    import e\n"
        b"match x:\n    case 1:\n        import f\nfor i in j:\n    import g\nelse:\n    def k():\n        class L:\n            import h\n"
        b"with m as n:\n    if o:\n        pass\n    elif p:\n        from . import q\n"
    )
    rows = [("x.py", body), ("bad.py", b"def ("), ("none.py", b""), ("s.ts", b"import {a, b} from './c'\n")]
    got = {r.path: r for r in extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert [i.module for i in got["x.py"].imports] == ["a", "b", "c", "d", "e", "f", "g", "h", ".q"]
    assert got["x.py"].definitions == ["L", "k"] and got["x.py"].imports[-1].fallbacks == ["."]
    assert got["bad.py"].error and not got["bad.py"].imports and got["none.py"].loc == 0
    assert [(i.module, i.symbols) for i in got["s.ts"].imports] == [("./c", ["a", "b"])]
