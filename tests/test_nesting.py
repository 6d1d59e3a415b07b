"""Intervals of a hierarchy against climbing it row by row."""

import random

import pytest

from archtrail.operators import nesting


def climb(up, node):
    """The node and all above it; None where the way ends in a circle."""
    way = [node]
    while way[-1] in up:
        way.append(up[way[-1]])
        if way[-1] in way[:-1]:
            return None
    return way


def make(spark, nodes, links):
    return (
        spark.createDataFrame([(n, 1) for n in nodes], "id string, enter int"),
        spark.createDataFrame(links, "child string, parent string"),
    )


def random_forest(seed):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(120)]
    rng.shuffle(nodes)
    hot = nodes[0]
    links = []
    for i, node in enumerate(nodes[1:], 1):
        kind = rng.random()
        if kind < 0.4:
            links.append((node, hot))
        elif kind < 0.9:
            links.append((node, nodes[rng.randrange(max(0, i - 3), i)]))
    return nodes, links


@pytest.mark.parametrize("seed", [1, 2])
def test_against_climbing(spark, seed):
    nodes, links = random_forest(seed)
    links += [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), (None, "n001"), ("n001", None), links[0]]
    up = {}
    for child, parent in links:
        if child is not None and parent is not None:
            up[child] = min(parent, up.get(child, parent))
    every = set(nodes) | {"x", "y", "z", "below"}
    ways = {n: climb(up, n) for n in every}
    ids, membership = make(spark, [*nodes, None, nodes[3]], links)
    labels = nesting.places(ids, membership)
    got = {r.node: r for r in labels.collect()}
    assert set(got) == {n for n in every if ways[n]}
    assert sorted(r.enter for r in got.values()) == list(range(1, len(got) + 1))
    for node, row in got.items():
        assert row.depth == len(ways[node]) - 1
        inside = {m for m, r in got.items() if row.enter <= r.enter <= row.last}
        assert inside == {m for m in got if node in ways[m]}
    worth = {n: i for i, n in enumerate(sorted(nodes))}
    values = spark.createDataFrame([(n, w) for n, w in worth.items()] + [("n001", None), ("nobody", 5)], "node string, w int")
    totals = {r.node: r.w for r in nesting.subtree_totals(labels, values, ["w"]).collect()}
    assert totals == {n: sum(worth.get(m, 0) for m in got if n in ways[m]) for n in got}
    some = sorted(got)[::3]
    wanted = spark.createDataFrame([(n,) for n in some + some[:1]], "node string")
    members = spark.createDataFrame([(n,) for n in sorted(got)[::2]], "node string")
    pairs = nesting.members_below(labels, wanted, members).collect()
    assert sorted(map(tuple, pairs)) == sorted((n, m) for n in some for m in sorted(got)[::2] if n in ways[m])
    stops = set(some[::2]) | {"x"}
    expected = {}
    for node in every:
        here, seen = node, set()
        while here not in stops and here in up and here not in seen:
            seen.add(here)
            here = up[here]
        if here in stops:
            expected[node] = here
    asked = spark.createDataFrame([(n,) for n in sorted(every) + ["nobody", None]], "node string")
    shown = nesting.nearest_stop(asked, membership, spark.createDataFrame([(s,) for s in stops], "id string"))
    assert {r.node: r.stop for r in shown.collect()} == expected


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    size, written = 3_000, []
    cut = nesting.cut_lineage
    monkeypatch.setattr(nesting, "cut_lineage", lambda df, *a: written.append(1) or cut(df, *a))
    chain = spark.range(1, size).selectExpr("concat('c', id) child", "concat('c', id - 1) parent")
    nodes = spark.range(size).selectExpr("concat('c', id) id")
    labels = nesting.places(nodes, chain)
    assert labels.where("depth <> int(substring(node, 2)) OR last <> 3000 OR enter <> depth + 1").isEmpty()
    assert len(written) < 25
    ones = nodes.selectExpr("id node", "1 w")
    assert nesting.subtree_totals(labels, ones, ["w"]).where("w <> 3000 - int(substring(node, 2))").isEmpty()
    del written[:]
    shown = nesting.nearest_stop(nodes.selectExpr("id node"), chain, spark.createDataFrame([("c0",)], "id string"))
    assert shown.where("stop = 'c0'").count() == size
    assert len(written) < 15


@pytest.mark.parametrize("few", [0, 40])
def test_lists_shrink_before_they_are_doubled(spark, monkeypatch, few):
    size, rows = 400, []
    cut = nesting.cut_lineage

    def counted(df, *a):
        kept = cut(df, *a)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(nesting, "FEW", few)
    monkeypatch.setattr(nesting, "cut_lineage", counted)
    order = list(range(size))
    random.Random(5).shuffle(order)  # places far from the order of the list
    elements = [(order[i], order[i + 1], 1, i % 3) for i in range(size - 1)] + [(order[-1], None, 1, (size - 1) % 3)]
    circle = [(size + i, size + (i + 1) % 7, 1, 1) for i in range(7)] + [(size + 9, size + 9, 1, 1)]
    given = spark.createDataFrame(elements + circle, "at bigint, next bigint, nodes bigint, step bigint")
    got = {r.at: (r.nodes, r.step) for r in nesting._to_the_end(given).collect()}
    assert got == {order[i]: (size - i, sum(j % 3 for j in range(i, size))) for i in range(size)}
    assert sum(rows) < 10 * size


def test_forest_with_lists_that_shrink(spark, monkeypatch):
    monkeypatch.setattr(nesting, "FEW", 5)
    nodes, links = random_forest(4)
    links += [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x")]
    up = {}
    for child, parent in links:
        up[child] = min(parent, up.get(child, parent))
    ways = {n: climb(up, n) for n in nodes}
    got = {r.node: r for r in nesting.places(*make(spark, nodes, links)).collect()}
    assert set(got) == set(nodes)
    assert sorted(r.enter for r in got.values()) == list(range(1, len(got) + 1))
    for node, row in got.items():
        assert row.depth == len(ways[node]) - 1
        assert {m for m, r in got.items() if row.enter <= r.enter <= row.last} == {m for m in nodes if node in ways[m]}


def test_empty(spark):
    ids, membership = make(spark, [], [])
    assert nesting.places(ids, membership).isEmpty()
    ids, membership = make(spark, [], [("a", "a")])
    labels = nesting.places(ids, membership)
    assert labels.isEmpty()
    assert nesting.subtree_totals(labels, spark.createDataFrame([], "node string, w int"), ["w"]).isEmpty()
    nothing = spark.createDataFrame([], "id string")
    assert nesting.nearest_stop(spark.createDataFrame([("a",)], "node string"), membership, nothing).isEmpty()
