"""Golden loads of a six-router network, brute force on random graphs, and the edge cases of each operator."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from linkpeak.operators import flow, loads, rules

PAIRS = [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (2, 3), (4, 5)]
EACH = {(1, 2), (2, 1), (1, 3), (3, 1), (2, 4), (4, 2), (3, 4), (4, 3)}
GOLDEN = {
    0: {(0, 1): 5, (1, 0): 5, (2, 3): 1, (3, 2): 1, (4, 5): 5, (5, 4): 5} | dict.fromkeys(EACH, 4),
    1: {(0, 1): 10, (1, 0): 6, (2, 3): 6, (3, 2): 6, (4, 5): 6, (5, 4): 10} | dict.fromkeys(EACH, 8),
    None: {(0, 1): 30, (1, 0): 6, (2, 3): 6, (3, 2): 6, (4, 5): 6, (5, 4): 30} | dict.fromkeys(EACH, 12),
}


def links_of(spark, pairs):
    both = [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]
    return spark.createDataFrame([(i, a, b, w) for i, (a, b, w) in enumerate(sorted(both))], "edge_id int, src int, dst int, weight long")


@pytest.fixture(scope="module")
def net(spark):
    links = links_of(spark, [(a, b, 1) for a, b in PAIRS])
    roots = spark.createDataFrame([(i,) for i in range(6)], "root int")
    demand = spark.createDataFrame([(r, p, 1.0) for r in range(6) for p in range(6)], "src int, prefix long, demand double")
    states = spark.createDataFrame([(p, [p]) for p in range(6)], "prefix long, egresses array<int>")
    return links, roots, demand, states


@pytest.mark.parametrize("k", [0, 1, None])
def test_golden_loads(spark, net, k):
    links, roots, demand, states = net
    f = flow.unit_flow(links, roots, flow.base_scenario(spark))
    kinds = states.select("prefix", F.lit("ingress").alias("kind"))
    out = loads.changed_load(f, demand, states, kinds, k).join(links, "edge_id").collect()
    assert {(r["src"], r["dst"]): round(r["load"], 7) for r in out} == GOLDEN[k]


def shortest(n, edges):
    d = [[0 if i == j else 10**9 for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        d[a][b] = min(d[a][b], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


def load_of(n, edges, sets, demand):
    """Loads by pushing each source's demand to its nearest egress, ties to the smaller."""
    d, out = shortest(n, edges), {}
    for src, amount in demand.items():
        best = min((d[src][r], r) for r in sets)
        if best[0] >= 10**9:
            continue
        todo = {src: amount}
        while todo:
            node = max(todo, key=lambda x: d[x][best[1]])
            x = todo.pop(node)
            nxt = [(a, b) for a, b, w in edges if a == node and d[a][best[1]] == w + d[b][best[1]]] if node != best[1] else []
            for e in nxt:
                out[e] = out.get(e, 0) + x / len(nxt)
                todo[e[1]] = todo.get(e[1], 0) + x / len(nxt)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_worst_egress_under_failures_is_that_of_all_sets(spark, seed):
    draw = random.Random(seed)
    n = 6
    pairs = sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(9)})
    weighted = [(a, b, draw.randint(1, 3)) for a, b in pairs]
    demand = {s: float(draw.randint(1, 9)) for s in range(n)}
    roots = [0, 2, 3]
    expected = {}
    for failed in [None, *pairs]:
        edges = [(x, y, w) for a, b, w in weighted if (a, b) != failed for x, y in ((a, b), (b, a))]
        for size in range(1, 4):
            for sets in itertools.combinations(roots, size):
                for e, x in load_of(n, edges, sets, demand).items():
                    expected[e] = max(expected.get(e, 0), x)
    links = links_of(spark, weighted)
    scenarios = flow.failure_scenarios(links, 1)
    f = flow.unit_flow(links, spark.createDataFrame([(r,) for r in roots], "root int"), scenarios)
    cells = spark.createDataFrame([(s, 1, x) for s, x in demand.items()], "src int, prefix long, demand double")
    states = spark.createDataFrame([(1, [0])], "prefix long, egresses array<int>")
    kinds = spark.createDataFrame([(1, "egress")], "prefix long, kind string")
    out = loads.over_scenarios(loads.changed_load(f, cells, states, kinds, None), links, scenarios).collect()
    assert {(r["src"], r["dst"]): round(r["load"], 6) for r in out if r["load"] > 0} == {e: round(x, 6) for e, x in expected.items()}


def test_costs_agree_with_relaxation(spark, net):
    links, roots, *_ = net
    kernel = flow.node_costs(flow.unit_flow(links, roots, flow.base_scenario(spark))).select("root", "src", "cost")
    assert sorted(kernel.collect()) == sorted(flow.relaxed_costs(links, roots, 5).select("root", "src", "cost").collect())


def test_failure_scenarios_count_and_start_with_none(spark, net):
    links = net[0]
    rows = flow.failure_scenarios(links, 2).collect()
    assert len(rows) == len({r["scenario_id"] for r in rows}) == 1 + 7 + 21
    assert min(rows, key=lambda r: r["scenario_id"])["failed"] == []
    assert flow.failure_scenarios(links, 1, directed=True).count() == 15


def test_at_most_k_never_lowers_a_load(spark, net):
    links, roots, demand, states = net
    f = flow.unit_flow(links, roots, flow.base_scenario(spark))
    kinds = states.select("prefix", F.lit("egress").alias("kind"))
    now = {r["edge_id"]: r["load"] for r in loads.fixed_load(f, demand, states).collect()}
    most = {r["edge_id"]: r["load"] for r in loads.changed_load(f, demand, states, kinds, 2, at_most=True).collect()}
    assert all(most[e] >= x - 1e-9 for e, x in now.items())


@pytest.mark.parametrize(("sets", "count"), [({0: [1, 2, 3], 1: [2, 3], 2: [3]}, 8), ({}, 1), ({0: [1, 3], 1: [1, 2], 2: [2, 3]}, 7)])
def test_compatible_subsets(spark, sets, count):
    rows = [(e, p) for e, prefs in sets.items() for p in prefs]
    df = spark.createDataFrame(rows, "egress int, local_pref int")
    assert rules.compatible_subsets(df).count() == count


def test_paths_override_shortest_flow(spark, net):
    links, roots, demand, states = net
    ids = {(r["src"], r["dst"]): r["edge_id"] for r in links.collect()}
    path = [ids[0, 1], ids[1, 3], ids[3, 2]]
    te = spark.createDataFrame([(2, 0, 2, 0, path)], "prefix long, ingress int, egress int, path_no int, edges array<int>")
    f = flow.unit_flow(links, roots, flow.base_scenario(spark))
    one = demand.where("prefix = 2 AND src = 0")
    out = loads.with_paths(f, one, states, te).collect()
    assert {r["edge_id"]: r["load"] for r in out} == dict.fromkeys(path, 1.0)


def test_worst_egress_with_paths_considers_sets(spark, net):
    links, roots, demand, _ = net
    ids = {(r["src"], r["dst"]): r["edge_id"] for r in links.collect()}
    te = spark.createDataFrame([(1, 0, 2, 0, [ids[0, 1], ids[1, 3], ids[3, 2]])], "prefix long, ingress int, egress int, path_no int, edges array<int>")
    prefs = spark.createDataFrame([(2, 100), (4, 100), (5, 200)], "egress int, local_pref int")
    sets = rules.candidate_sets(prefs, spark.createDataFrame([(2,)], "egress int"))
    assert sorted(r["egresses"] for r in sets.collect()) == [[2], [2, 4], [4], [5]]
    f = flow.unit_flow(links, roots, flow.base_scenario(spark))
    one = demand.where("prefix = 1")
    worst = {r["edge_id"]: r["worst"] for r in loads.worst_egress_with_paths(f, one, sets, te).collect()}
    assert worst[ids[3, 2]] >= 1.0


def budget_by_hand(groups, budget):
    """groups: (key, members, traffic); the quota of every group that is not full, again and again."""
    if len(groups) >= budget:
        return {k: 1 for k, *_ in groups}
    free, full = budget - len(groups), {}
    while True:
        left = [g for g in groups if g[0] not in full]
        total = sum(t for *_, t in left)
        room = free - sum(full.values())
        filled = [g for g in left if room * (g[2] / total) // 1 >= g[1] - 1]
        if not filled:
            break
        full[filled[0][0]] = filled[0][1] - 1
        if len(full) == len(groups):
            return {k: 1 + n for k, n in full.items()}
    quota = {k: room * (t / total) for k, _, t in left}
    given = {k: int(q) for k, q in quota.items()}
    for k, *_ in sorted(left, key=lambda g: (-round(quota[g[0]] % 1, 9), g[1], g[0]))[: room - sum(given.values())]:
        given[k] += 1
    return {k: 1 + n for k, n in (full | given).items()}


def test_clusters_are_shared_out_by_traffic(spark):
    draw = random.Random(2)
    cases = [([("a", 3, 90.0), ("b", 50, 9.0), ("c", 50, 1.0)], 20), ([("a", 3, 1.0), ("b", 3, 1.0)], 2), ([("a", 5, 1.0)], 5)]
    for _ in range(12):
        groups = [(f"g{i}", draw.randint(1, 40), float(draw.randint(1, 300))) for i in range(draw.randint(1, 12))]
        cases.append((groups, draw.randint(1, sum(m for _, m, _ in groups))))
    for groups, budget in cases:
        rows = rules.shared_budget(spark.createDataFrame(groups, "class string, members long, total double"), budget).collect()
        given = {r["class"]: r["k"] for r in rows}
        assert given == budget_by_hand(groups, budget), (groups, budget)
        assert sum(given.values()) == max(budget, len(groups))


def test_heaviest_only_and_overload(spark, net):
    _, _, demand, _ = net
    kept, dropped = loads.heaviest_only(demand, 2)
    assert kept.select("prefix").distinct().count() == 2
    assert dropped.first()[0] == 24.0
    report = spark.createDataFrame([(0, 1, 5.0)], "src int, dst int, load double")
    capacity = spark.createDataFrame([(0, 1, 5.0), (1, 0, 1.0)], "src int, dst int, capacity double")
    assert [(r["src"], r["dst"]) for r in loads.overloaded(report, capacity).collect()] == [(0, 1)]


def test_weights_below_one_are_refused(spark, net):
    with pytest.raises(ValueError, match="weights"):
        flow.unit_flow(net[0].withColumn("weight", F.lit(0).cast("long")), net[1], flow.base_scenario(spark))


def compatible(prefs):
    """Every set of the routers in prefs (router: values) that shares a value, and the empty one, by trying all."""
    routers = sorted(prefs)
    sets = itertools.chain.from_iterable(itertools.combinations(routers, n) for n in range(1, len(routers) + 1))
    return [()] + [s for s in sets if set.intersection(*(set(prefs[r]) for r in s))]


@pytest.mark.parametrize("seed", range(4))
def test_compatible_subsets_by_trying_all(spark, seed):
    draw = random.Random(seed)
    prefs = {r: draw.sample([100, 150, 200, 250], draw.randint(1, 3)) for r in draw.sample(range(40), 9)}
    df = spark.createDataFrame([(r, v) for r, values in prefs.items() for v in values], "egress int, local_pref int")
    rows = rules.compatible_subsets(df).collect()
    assert sorted(tuple(r["egresses"]) for r in rows) == sorted(compatible(prefs))
    assert all(set(r["local_prefs"]) == set.intersection(*(set(prefs[e]) for e in r["egresses"])) for r in rows if r["egresses"])
    few = rules.compatible_subsets(df, 2).collect()
    assert sorted(tuple(r["egresses"]) for r in few) == sorted(s for s in compatible(prefs) if len(s) <= 2)
