"""The whole analysis on one invented depot, and the readers of single files."""

import pytest
from pyspark.sql import functions as F
from tree_cases import make_files, pairs

from archtrail.operators import incremental
from archtrail.operators.facts import extract, python_facts
from archtrail.operators.script import script_facts
from archtrail.plans.analyze import analyze, file_graph, table_sources

MAPS = "".join(f"def {name}(leg):\n    return leg\n\n\n" for name in ("ebb", "flow", "gale", "isle", "jetty", "knot", "lock"))
DEPOT = {
    "README.md": "# Depot\n",
    "depot/intake/__init__.py": '"""Goods come in here.\n\nThey are weighed and labelled."""\nfrom depot.intake.weigh import weigh\n',
    "depot/intake/weigh.py": "import json\nimport depot.intake.scales\nfrom depot.intake.scales import Scale, zero\nfrom . import labels\n\nLIMIT: int = 40\n\n\ndef weigh(crate):\n    return Scale().read(crate)\n",
    "depot/intake/scales.py": "class Scale:\n    def read(self, crate):\n        return crate\n\n\ndef zero():\n    return 0\n",
    "depot/intake/labels.py": "STICKER = 'fragile'\n",
    "depot/json.py": "def dumps():\n    return ''\n",
    "depot/ship/README.md": "no heading yet\n\n### Everything that sails\n",
    "depot/ship/route.py": "from depot.intake import weigh\nfrom depot.ship.maps import ebb, flow, gale, isle, jetty, knot, lock\nfrom depot.ship.crew import captain\n",
    "depot/ship/maps.py": MAPS,
    "depot/ship/crew.py": "def cook():\n    return 'soup'\n",
    "depot/ship/queue.py": "from depot.ship import wharf\n",
    "depot/ship/wharf.py": "from depot.ship import queue\n",
    "tools/src/gauge/__init__.py": "",
    "tools/src/gauge/dial.py": "def turn():\n    return 7\n",
    "scripts/inspect_all.py": "import gauge.dial\nfrom depot.intake.scales import zero\n",
    "scripts/ancient.py": "exec 'no longer python'\n",
    "tests/test_weigh.py": "from depot.intake.weigh import weigh\n",
    "depot/generated/tariffs.py": "from depot.ship import maps\n",
    "panel/tsconfig.json": '{ "compilerOptions": { "paths": { "~parts/*": ["./pieces/*"], }, "baseUrl": "." } } // for the panel\n',
    "panel/main.tsx": "import { Knob } from '~parts/knob'\nimport type { Shade } from './shade'\n\nexport const Panel = () => <main>Don't (touch) {'}'}<Knob /></main>\n\nexport async function later() {\n  return (await import('./lazy')).default\n}\n",
    "panel/pieces/knob.tsx": "import { round } from '../maths'\n\nexport class Knob { turn(by: number) { return round(by) } }\n",
    "panel/maths.js": "export const round = (x) => /[.,]\\d+/.test(x) ? x | 0 : x\n",
    "panel/shade.ts": "export type Shade = 'dark'\n",
    "panel/lazy.ts": "export default 1\n",
}


@pytest.fixture(scope="module")
def result(spark):
    built = analyze(table_sources(make_files(spark, DEPOT)))
    nodes = {r.id: r for r in built.nodes.collect()}
    parents = {r.child: r.parent for r in built.membership.collect()}
    return built, nodes, parents, pairs(built.edges)


def edge(source, target):
    return (f"file:{source}", f"file:{target}")


@pytest.mark.parametrize(("source", "target"), [
    ("depot/intake/__init__.py", "depot/intake/weigh.py"), ("depot/intake/weigh.py", "depot/intake/scales.py"),
    ("depot/intake/weigh.py", "depot/intake/labels.py"), ("depot/ship/route.py", "depot/ship/maps.py"),
    ("depot/ship/route.py", "depot/intake/weigh.py"),  # through the package file that hands it on
    ("scripts/inspect_all.py", "tools/src/gauge/dial.py"), ("scripts/inspect_all.py", "depot/intake/scales.py"),
    ("depot/ship/queue.py", "depot/ship/wharf.py"), ("depot/ship/wharf.py", "depot/ship/queue.py"),
    ("panel/main.tsx", "panel/pieces/knob.tsx"), ("panel/main.tsx", "panel/lazy.ts"), ("panel/pieces/knob.tsx", "panel/maths.js"),
])
def test_edges(result, source, target):
    assert edge(source, target) in result[3]


@pytest.mark.parametrize(("source", "target"), [
    ("depot/intake/weigh.py", "depot/json.py"),  # the library's module, not a file that shares its name
    ("depot/ship/route.py", "depot/ship/crew.py"),  # the file does not provide the name
    ("depot/ship/route.py", "depot/intake/__init__.py"), ("panel/main.tsx", "panel/shade.ts"),
])
def test_no_edges(result, source, target):
    assert edge(source, target) not in result[3]


def test_nodes_and_roles(result):
    _, nodes, parents, found = result
    assert nodes["file:scripts/ancient.py"].loc == 1 and not any("ancient" in end for pair in found for end in pair)
    scales = nodes["file:depot/intake/scales.py"]
    assert (scales.fan_in, scales.fan_out) == (2, 0)
    assert nodes["file:tests/test_weigh.py"].role == "test" and nodes["file:depot/generated/tariffs.py"].role == "generated"
    files = {i for i, n in nodes.items() if n.kind == "file" and n.role == "source"}
    modules = {i for i, n in nodes.items() if n.kind == "module"}
    assert {c for c in parents if c.startswith("file:")} == files
    assert {c for c in parents if c.startswith("mod:")} == modules


def test_layers_are_named(result):
    _, nodes, parents, _ = result
    for kind in ("module", "component"):
        labels = [n.label for n in nodes.values() if n.kind == kind]
        assert len(labels) == len(set(labels))
        assert all(n.summary for n in nodes.values() if n.kind == kind)
    assert nodes[parents["file:depot/intake/weigh.py"]].summary == "Goods come in here."
    assert nodes[parents["file:depot/ship/maps.py"]].summary == "Everything that sails"


def test_weights_and_labels(result):
    built = result[0]
    counted = built.evidence.groupBy("source", "target").count().withColumnRenamed("count", "n")
    joined = built.edges.join(counted, ["source", "target"], "left")
    assert joined.where(~F.col("weight").eqNullSafe(F.col("n"))).isEmpty()
    label = {(r.source, r.target): r.label for r in built.edges.collect()}
    assert label[edge("depot/ship/route.py", "depot/ship/maps.py")] == "ebb, flow, gale, isle, jetty, knot, lock"


def test_incremental_equals_full(spark, result):
    before = table_sources(make_files(spark, DEPOT))
    after = table_sources(make_files(spark, {**DEPOT, "depot/intake/scales.py": "def one():\n    return 1\n"}))
    refreshed, changes = incremental.refresh_facts(after.files, incremental.fingerprint(before.files), result[0].facts)
    assert [(r.path, r.status) for r in changes.collect()] == [("depot/intake/scales.py", "modified")]
    partly, fully = file_graph(refreshed, after)[1], file_graph(extract(after.files), after)[1]
    assert incremental.same_structure(partly, fully, ["source", "target", "file", "line", "symbols"])
    assert edge("scripts/inspect_all.py", "depot/intake/scales.py") not in pairs(partly)  # not edited, but it asked for what is gone


def test_layers_are_kept_while_weights_are(spark, result, monkeypatch):
    """A longer file changes lines only: membership is taken over, totals are not."""
    from archtrail.plans import analyze as plan
    from archtrail.sources.artifacts import map_violations

    built, nodes, parents, found = result
    longer = {**DEPOT, "depot/ship/maps.py": MAPS + "# end\n"}
    sources = table_sources(make_files(spark, longer))
    before = table_sources(make_files(spark, DEPOT)).files
    refreshed, _ = incremental.refresh_facts(sources.files, incremental.fingerprint(before), built.facts)
    monkeypatch.setattr(plan, "layers", None)  # clustering again would fail
    again = analyze(sources, facts=refreshed, previous=built)
    assert pairs(again.edges) == found
    assert {r.child: r.parent for r in again.membership.collect()} == parents
    loc = {r.id: r.loc for r in again.nodes.collect()}
    home = parents["file:depot/ship/maps.py"]
    assert {i for i in loc if loc[i] != nodes[i].loc} == {"file:depot/ship/maps.py", home, parents[home]}
    assert map_violations(again.nodes, again.edges, again.evidence).isEmpty()


def test_python_facts():
    found = python_facts(b"import a.b as c, d\nfrom . import x\nfrom m import *\nV: int = 1\ndef f():\n    class G: pass\n")
    assert found["definitions"] == {"f", "G"}
    assert found["exports"] == {"f", "V"}
    assert found["imports"] == {
        ("a.b", 1, (), ("c",)), ("d", 1, (), ("d",)), (".x", 2, (".",), ("x",)), ("m", 3, (), ("*",)),
    }


SCRIPTS = {
    "pattern": ("import { a } from './b'; const r = /\\(/;", {("./b", 1, ("a",))}),
    "tag text": ("const x = <p>Don't (</p>\nimport z from './z'", {("./z", 2, ("z",))}),
    "type before import": ("export type X = { a: number }\nimport { y } from './y'", {("./y", 2, ("y",))}),
    "interface before import": ("export interface P { a: string }\nexport const q = 1\nimport { y } from './y'", {("./y", 3, ("y",))}),
    "class before import": ("export default class B {}\nimport './s'", {("./s", 2, ("s",))}),
    "template": ("const t = `${require('./in')} ${`so ${import('./deep')}`} import x from './no'`", {("./in", 1, ()), ("./deep", 1, ())}),
    "long clause": ("import {\n  a,\n  b as c,\n} from './m'\nimport d, * as e from './n'", {("./m", 1, ("a", "b", "c")), ("./n", 5, ("d", "e"))}),
    "hand on": ("export { k }\nexport * from './all'\nexport { d as e } from './d'\nexport type { T } from './t'", {("./all", 2, ()), ("./d", 3, ("d", "e"))}),
    "types": ("import type { U } from './u'\nimport type from './type'\nimport { type V, w } from './v'", {("./type", 2, ()), ("./v", 3, ("V", "w"))}),
    "comments": ("// import './a'\n/* require('b') */ s = \"import q from './no'\"; o.require('c'); x / y / require('./yes')", {("./yes", 2, ())}),
    "tags": ("const F = () => (<div a='x' b={require('./in')}>it's {import('./kid')} <br/> ( </div>)\nimport q from './q'", {("./in", 1, ()), ("./kid", 1, ()), ("./q", 2, ("q",))}),
    "generic": ("const f = <T,>(x: T) => x\nlet a = b < c\nimport fs = require('fs')", {("fs", 3, ())}),
    "bracket": ("function f( {\nimport x from './x'", {("./x", 2, ("x",))}),
    "pattern after a condition": ("if (x) /`/.test(y)\nimport a from './a'", {("./a", 2, ("a",))}),
    "pattern after a block": ("function f() {\n}\n/`/.test(y)\nimport a from './a'", {("./a", 4, ("a",))}),
    "division after a call and an object": ("x = f(a) / 2; y = {} / 2; z = (a) / `b`\nimport a from './a'", {("./a", 2, ("a",))}),
    "type parameter": ("type F = <T>(x: T) => T\nimport a from './a'", {("./a", 2, ("a",))}),
    "type parameter of a member": ("interface A { f: <T>(x: T) => void; g: <U>(y: U): U }\nimport a from './a'", {("./a", 2, ("a",))}),
    "tag with brackets": ("const x = <Note>(so): {require('./in')}</Note>\nimport a from './a'", {("./in", 1, ()), ("./a", 2, ("a",))}),
    "template that never ends": ("const t = `open ${1}\nimport a from './a'\nexport * from './b'", {("./a", 2, ("a",)), ("./b", 3, ())}),
    "condition named like a method": ("x.if(a) / 2 / `t`\nimport a from './a'", {("./a", 2, ("a",))}),
    "key": ("x = {\nimport: 'a', from: 'b' }", set()),
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_script_imports(name):
    code, expected = SCRIPTS[name]
    assert {(m, line, s) for m, line, _, s in script_facts(code.encode())["imports"]} == expected


def test_script_definitions():
    code = """
export default class Crane extends Machine {
  static async lift<T>(load: T): Promise<void> { if (load) { swing(load) } }
  get height() { return this.#h }
  handler = () => { while (true) { break } }
  render(): { a: string } { return { a: `${1}` } }
}
export abstract class Hoist {}
export async function* steps() {}
export const enum Gear { Low }
export interface Rope { length: number }
function helper() { const inner = class Named { go() {} } }
"""
    found = script_facts(code.encode())
    assert found["definitions"] == {"Crane", "lift", "height", "render", "Hoist", "steps", "helper", "Named", "go"}
    assert found["exports"] == {"Crane", "Hoist", "steps", "Gear", "Rope"}
    assert found["public_names"] == {"Crane", "Hoist", "steps"}


def test_bytes_that_are_no_text_keep_their_place(spark):
    files = spark.createDataFrame([("a.ts", bytearray(b"\xff\xfe import"))], "path string, content binary")
    row = extract(files).first()
    assert row.error and not row.imports
