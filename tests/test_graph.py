"""Graph operators against brute force on random graphs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from archtrail.operators import blocks, communities, cycles, impact


def reachable(nodes, links):
    out = {n: {t for s, t in links if s == n} for n in nodes}
    result = {}
    for n in nodes:
        seen, todo = set(), list(out[n])
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += out[m]
        result[n] = seen
    return result


def brute_components(nodes, links):
    reach = reachable(nodes, links)
    return {n: min([n] + [m for m in reach[n] if n in reach[m]]) for n in nodes}


def brute_order(nodes, links):
    comp = brute_components(nodes, links)
    groups = sorted(set(comp.values()))
    needs = {g: {comp[t] for s, t in links if comp[s] == g and comp[t] != g} for g in groups}
    ready, done, order = [g for g in groups if not needs[g]], set(), []
    heapq.heapify(ready)
    queued = set(ready)
    while ready:
        g = heapq.heappop(ready)
        done.add(g)
        order += sorted(n for n in nodes if comp[n] == g)
        for other in groups:
            if other not in queued and needs[other] <= done:
                heapq.heappush(ready, other)
                queued.add(other)
    return order


def random_graph(seed, size, count):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(size)]
    rng.shuffle(nodes)
    return nodes, {(rng.choice(nodes), rng.choice(nodes)) for _ in range(count)}


def tables(spark, nodes, links):
    return (
        spark.createDataFrame([(n,) for n in nodes], "id string"),
        spark.createDataFrame(sorted(links), "source string, target string"),
    )


@pytest.mark.parametrize("seed,size,count,block", [(1, 24, 30, 1_000_000), (2, 30, 40, 3), (3, 16, 40, 2)])
def test_components_cycles_and_order(spark, monkeypatch, seed, size, count, block):
    """Small blocks make values travel over several rounds."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    nodes, links = random_graph(seed, size, count)
    ids, edges = tables(spark, nodes, links)
    components = cycles.strong_components(ids, edges)
    found = {r.node: r.component for r in components.collect()}
    expected = brute_components(nodes, links)
    assert found == expected

    rows = cycles.representative_cycles(components, edges).collect()
    by_component = {}
    for row in rows:
        by_component.setdefault(row.component, {})[row.position] = row.node
    cyclic = {c for c in expected.values() if list(expected.values()).count(c) > 1}
    cyclic |= {s for s, t in links if s == t and expected[s] == s}
    assert set(by_component) == cyclic
    for component, places in by_component.items():
        cycle = [places[i] for i in range(len(places))]
        assert cycle[0] == component == min(cycle)
        assert all((a, b) in links for a, b in zip(cycle, cycle[1:] + cycle[:1]))

    mapped = ids.select(F.concat(F.lit("p/"), "id").alias("path"), F.col("id").alias("node_id")).unionByName(
        spark.createDataFrame([("z", None), ("a", None)], "path string, node_id string")
    )
    order = impact.review_order(mapped, edges).orderBy("position").collect()
    assert [r.path for r in order] == ["p/" + n for n in brute_order(nodes, links)] + ["a", "z"]
    assert [r.position for r in order] == list(range(1, len(nodes) + 3))


@pytest.mark.parametrize("seed", range(30))
def test_dependency_keys_equal_a_heap(seed):
    """The closed form of the ready-smallest-first order, without Spark."""
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(14)]
    rng.shuffle(nodes)
    needs = {n: set(rng.sample(nodes[:i], min(i, rng.randint(0, 3)))) for i, n in enumerate(nodes)}
    keys = {}
    for n in nodes:
        keys[n] = max([[n]] + [blocks.extend_key(keys[d], n) for d in needs[n]])
    links = {(n, d) for n in nodes for d in needs[n]}
    assert sorted(nodes, key=keys.get) == brute_order(nodes, links)


def test_long_chain_needs_few_rounds(spark):
    chain = [(f"f{i:03d}", f"f{i + 1:03d}") for i in range(499)]
    nodes = [f"f{i:03d}" for i in range(500)]
    ids, edges = tables(spark, nodes, chain)
    assert all(r.node == r.component for r in cycles.strong_components(ids, edges).collect())
    ring = edges.unionByName(spark.createDataFrame([("f499", "f000")], edges.schema))
    assert {r.component for r in cycles.strong_components(ids, ring).collect()} == {"f000"}


def test_communities_keep_their_invariants(spark):
    rng = random.Random(7)
    nodes = [(f"n{i:02d}", f"dir{i % 3}") for i in range(40)]
    links = {}
    for _ in range(60):
        a, b = sorted(rng.sample(range(34), 2))
        links[(f"n{a:02d}", f"n{b:02d}")] = rng.randint(1, 4)
    node_table = spark.createDataFrame(nodes, "id string, anchor string")
    link_table = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "low string, high string, weight long")
    first = {r.node: r.group for r in communities.anchored_groups(node_table, link_table).collect()}
    second = {r.node: r.group for r in communities.anchored_groups(node_table, link_table).collect()}
    assert first == second
    anchor = dict(nodes)
    assert set(first) == set(anchor)
    assert all(anchor[n] == anchor[g] for n, g in first.items())
    members = {}
    for n, g in first.items():
        members.setdefault(g, set()).add(n)
    assert all(g == min(m) for g, m in members.items())
    # isolated nodes of an anchor are together, in the largest group before they came
    linked = {n for pair in links for n in pair}
    for name in {"dir0", "dir1", "dir2"}:
        alone = {n for n in anchor if anchor[n] == name and n not in linked}
        homes = {first[n] for n in alone}
        assert len(homes) <= 1
        for home in homes:
            sizes = {g: len(m - alone) for g, m in members.items() if anchor[g] == name}
            assert sizes[home] == max(sizes.values())


def test_two_clear_clusters_are_found(spark):
    left = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")]
    right = [("p", "q"), ("p", "r"), ("q", "r"), ("q", "s"), ("r", "s")]
    rows = [(x, y, 5) for x, y in left + right] + [("d", "p", 1)]
    table = spark.createDataFrame(rows, "low string, high string, weight long")
    found = {r.node: r.community for r in communities.communities(table).collect()}
    assert {n for n in found if found[n] == found["a"]} == set("abcd")
    assert {n for n in found if found[n] == found["p"]} == set("pqrs")


def test_labels_stay_unique_beside_numbered_ones(spark):
    from archtrail.operators.naming import unique_labels

    rows = [(f"g{k}", "x/core", "Core") for k in range(4)] + [("h1", "y", "Core / Core"), ("h2", "z", "Core / Core 2"), ("h3", "v", "Core / Core 4")]
    named = unique_labels(spark.createDataFrame(rows, "group string, directory string, label string")).collect()
    labels = {r.group: r.label for r in named}
    assert len(set(labels.values())) == len(rows)
    assert {labels[g] for g in ("h1", "h2", "h3")} >= {"Core / Core 2", "Core / Core 4"}
    many = [(f"g{k:03d}", ".", "Api") for k in range(30)] + [("z1", ".", "Api 2"), ("z2", ".", "Api 3"), ("z3", ".", "Api 11")]
    named = unique_labels(spark.createDataFrame(many, "group string, directory string, label string"))
    assert named.select("label").distinct().count() == len(many)


def test_communities_end_where_no_move_gains(spark):
    """Anchorless: planted groups are found, and no node would be better off elsewhere."""
    import random

    from archtrail.operators.communities import communities

    draw = random.Random(5)
    links = {}
    for _ in range(900):
        a, b = draw.sample(range(60), 2)
        if a // 12 == b // 12 or draw.random() < 0.06:
            key = (f"n{min(a, b):02d}", f"n{max(a, b):02d}")
            links[key] = links.get(key, 0) + 1
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "low string, high string, weight long")
    home = {r.node: r.community for r in communities(frame).collect()}
    weight = lambda n, c: sum(w for (a, b), w in links.items() if (a == n and home[b] == c) or (b == n and home[a] == c))
    degree = {n: sum(w for pair, w in links.items() if n in pair) for n in home}
    total = sum(degree.values())
    for n in home:
        rest = lambda c, n=n: sum(degree[m] for m in home if home[m] == c and m != n)
        gain = {c: weight(n, c) - degree[n] * rest(c) / total for c in set(home.values())}
        assert max(gain.values()) <= gain[home[n]] + 1e-6
    assert len(set(home.values())) == 5


@pytest.mark.parametrize("block_rows", [250_000, 120])
def test_communities_around_hubs_take_few_turns(spark, monkeypatch, block_rows):
    """Many nodes between few hubs, in one block and in many: few turns, and no node would be better off elsewhere."""
    draw = random.Random(1)
    links = {(f"h{hub}", f"n{i:03d}"): 1 for i in range(150) for hub in draw.sample(range(10), 2)}
    turns, offers = [], communities._offers
    monkeypatch.setattr(communities, "_offers", lambda *given: turns.append(1) or offers(*given))
    monkeypatch.setattr(communities, "BLOCK_ROWS", block_rows, raising=False)
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "low string, high string, weight long")
    home = {r.node: r.community for r in communities.communities(frame).collect()}
    near = {n: [a if b == n else b for a, b in links if n in (a, b)] for n in home}
    total = sum(map(len, near.values()))
    mass = {c: sum(len(near[n]) for n in home if home[n] == c) for c in set(home.values())}
    for n, others in near.items():
        gain = {c: sum(home[m] == c for m in others) - len(others) * (mass[c] - len(others) * (c == home[n])) / total for c in mass}
        assert max(gain.values()) <= gain[home[n]] + 1e-6
    assert set(home) == {n for pair in links for n in pair}
    assert len(turns) <= (16 if block_rows > 1000 else 60)


def test_few_movers_share_a_block_however_large_their_communities(spark, monkeypatch):
    """Some blocks of rows: nodes that do not move take no room in a block, so few turns settle the
    others; no node and no community would be better off elsewhere."""
    draw = random.Random(3)
    links = {}
    for i in range(120):
        for j in draw.sample(range(i // 30 * 30, i // 30 * 30 + 30), 3) + draw.sample(range(120), 1):
            if i != j:
                links[(f"n{min(i, j):03d}", f"n{max(i, j):03d}")] = draw.randint(1, 3)
    turns, offers = [], communities._offers

    def counted(*given):
        turns.append(1)
        assert len(turns) <= 18
        return offers(*given)

    monkeypatch.setattr(communities, "_offers", counted)
    monkeypatch.setattr(communities, "BLOCK_ROWS", 330)
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "low string, high string, weight long")
    home = {r.node: r.community for r in communities.communities(frame).collect()}
    degree, shared = dict.fromkeys(home, 0), {}
    for (a, b), w in links.items():
        for node, other in ((a, b), (b, a)):
            degree[node] += w
            shared[node, home[other]] = shared.get((node, home[other]), 0) + w
    total, names = sum(degree.values()), set(home.values())
    mass = {c: sum(degree[n] for n in home if home[n] == c) for c in names}
    for n, here in home.items():
        gain = {c: shared.get((n, c), 0) - degree[n] * (mass[c] - degree[n] * (c == here)) / total for c in names}
        assert max(gain.values()) <= gain[here] + 1e-5
    for c in names:
        for other in names - {c}:
            assert sum(shared.get((n, other), 0) for n in home if home[n] == c) - mass[c] * mass[other] / total <= 1e-5


def test_a_graph_that_fits_into_a_block_is_one_task(spark, monkeypatch):
    frame = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", 1) for i in range(20) for j in range(i) if i // 5 == j // 5], "high string, low string, weight long")
    written, cut = [], communities.cut_lineage
    monkeypatch.setattr(communities, "cut_lineage", lambda *given: written.append(1) or cut(*given))
    assert {r.community for r in communities.communities(frame).collect()} == {"n00", "n05", "n10", "n15"}
    assert len(written) <= 5


@pytest.mark.parametrize("shape", ["chain", "ring", "lollipop"])
def test_long_paths_take_few_rounds(spark, monkeypatch, shape):
    """Many partitions, ids in no order: tables written grow with the logarithm of the length."""
    import random

    from archtrail.operators import cycles

    size = 3000
    names = [f"n{k:05d}" for k in range(size)]
    random.Random(2).shuffle(names)
    links = list(zip(names, names[1:]))
    if shape == "ring":
        links.append((names[-1], names[0]))
    if shape == "lollipop":
        links += [(names[-1], names[size // 2]), (names[size // 2], "x"), ("x", names[size // 3])]
    written = []
    monkeypatch.setattr(cycles, "cut_lineage", lambda df, cut=cycles.cut_lineage: written.append(1) or cut(df))
    nodes = spark.createDataFrame([(n,) for n in {*names, "x"}], "id string")
    frame = spark.createDataFrame(links, "source string, target string").repartition(16)
    found = {r.node: r.component for r in cycles.strong_components(nodes, frame).collect()}
    on_cycle = {"chain": [], "ring": names, "lollipop": [*names[size // 3:], "x"]}[shape]
    lowest = min(on_cycle, default=None)
    assert found == {n: lowest if n in set(on_cycle) else n for n in {*names, "x"}}
    assert len(written) < 50


def test_cycle_through_a_long_ring(spark, monkeypatch):
    """Two rings of one component: the shorter way closes; tables written grow with the logarithm of the length."""
    size = 2000
    names = [f"n{k:05d}" for k in range(size)]
    random.Random(4).shuffle(names)
    start = names.index(min(names))
    ring = names[start:] + names[:start]
    links = [*zip(ring, ring[1:] + ring[:1]), (ring[700], ring[900])]
    written = []
    monkeypatch.setattr(cycles, "cut_lineage", lambda df, cut=cycles.cut_lineage: written.append(1) or cut(df))
    components = spark.createDataFrame([(n, ring[0]) for n in names], "node string, component string")
    frame = spark.createDataFrame(links, "source string, target string").repartition(16)
    at = {r.position: r.node for r in cycles.representative_cycles(components, frame).collect()}
    assert [at[k] for k in range(len(at))] == ring[:701] + ring[900:]
    assert len(written) < 75


@pytest.mark.parametrize("component", [False, True])
def test_rolled_sites_are_joined_once_and_equal_the_operator(spark, component):
    from archtrail.operators import edges
    from archtrail.plans import registry, tables

    sf = "/root/testdata/sf0.001"
    parents = tables.trade_component_membership(spark, sf) if component else tables.trade_file_membership(spark, sf)
    rolled = edges.roll_sites(tables.trade_sites(spark, sf), parents)
    early = tables.trade_rolled_sites(spark, sf, component)
    assert sorted(edges.edge_weights(early).collect()) == sorted(edges.edge_weights(rolled).collect())
    result = registry.QUERIES["rolled_edges_component" if component else "rolled_edges_module"](spark, sf)
    assert not any("lineitem" in file for file in result.inputFiles())


def test_keys_are_not_broadcast(spark, monkeypatch):
    """A chain's keys are as long as the chain and pack into few bytes; no join sends them through the driver."""
    names = [f"n{i:04}" for i in range(300, 0, -1)]
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    links = spark.createDataFrame(list(zip(names[1:], names)), "source string, target string")
    plans, cut = [], cycles.cut_lineage

    def seen(df, *rest):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, *rest)

    monkeypatch.setattr(cycles, "cut_lineage", seen)
    keyed = cycles.dependency_order_keys(nodes, links)
    plans.append((keyed.columns, keyed._jdf.queryExecution().executedPlan().toString()))
    carrying = [plan for columns, plan in plans if "array<string>" in plan or "key" in columns or "_moved" in columns and "spread_keys" in plan]
    assert carrying and not [plan for plan in carrying if "BroadcastExchange" in plan]
