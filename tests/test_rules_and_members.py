"""Members of clusters, rules with sets of their own, paths under failures and bounds, each against brute force or another way."""

import pytest
from pyspark.sql import functions as F

from linkpeak.operators import blocks, flow, loads, rules
from linkpeak.plans.analysis import Analysis
from tests.test_analysis import base, loads_of  # noqa: F401


def weighted(spark, base):  # noqa: F811
    """Prefixes of two states; those of one state have the same shares by source and weights of their own."""
    shares = {0: [3, 1, 0, 2, 0, 4], 1: [0, 5, 1, 1, 2, 0]}
    rows = [(s, 10 * g + i, x * (1.0 + i % 4 + 0.5 * i)) for g, xs in shares.items() for i in range(7) for s, x in enumerate(xs) if x]
    state = spark.createDataFrame([(10 * g + i, 100 + 3 * g) for g in (0, 1) for i in range(7)], "prefix long, ext int")
    return Analysis(base.links, base.ext_links, spark.createDataFrame(rows, "src int, prefix long, demand double"), state)


@pytest.mark.parametrize("kind", ["egress", "ingress"])
def test_members_of_clusters_change_one_by_one(spark, base, kind):  # noqa: F811
    net = weighted(spark, base).set_default_uncertainty(kind)
    clusters = net.with_clustering(net.demand.select("prefix").distinct().withColumn("cluster", (F.col("prefix") / 10).cast("int")))
    for k, failures in ((1, 0), (3, 1)):
        assert loads_of(clusters.analyze(k, failures)) == pytest.approx(loads_of(net.analyze(k, failures)), abs=1e-6)
    named = lambda df: sorted((r["src"], r["dst"], r["rank"], r["prefix"], round(r["worst"] - r["current"], 6), r["egress"], r["ingress"]) for r in df.collect())
    assert named(clusters.causes(2, 0)) == named(net.causes(2, 0))
    change = lambda df: {(r["src"], r["dst"], r["prefix"]): round(r["worst"] - r["current"], 6) for r in df.collect() if r["prefix"] is not None}
    assert change(clusters.causes(None, 0)) == change(net.causes(None, 0))


def test_equal_prefixes_in_one_cluster(spark, base):  # noqa: F811
    rows = [(s, p, 1.0) for s in range(6) for p in range(10)]
    net = Analysis(base.links, base.ext_links, spark.createDataFrame(rows, "src int, prefix long, demand double"), spark.createDataFrame([(p, 100) for p in range(10)], "prefix long, ext int"))
    assert loads_of(net.with_cluster_number(1).analyze(1, 0)) == loads_of(net.analyze(1, 0))


def brute(unit, links, demand, state, rule_of, k):
    """Each link's highest load over scenarios; rule_of: prefix to (kind, egresses, ingresses)."""
    share, cost = {}, {}
    for r in unit.collect():
        cost[r["scenario_id"], r["src"], r["root"]] = r["cost"]
        if r["edge_id"] is not None:
            share[r["scenario_id"], r["src"], r["root"], r["edge_id"]] = r["frac"]
    high = {}
    for f in {c[0] for c in cost}:
        for e in links:
            total, gains = 0.0, []
            for p, egress in state.items():
                amounts = {s: x for (s, q), x in demand.items() if q == p}
                at = lambda s, r: share.get((f, s, r, e), 0.0)  # noqa: B023, E731
                now = sum(x * at(s, egress) for s, x in amounts.items())
                kind, egresses, ingresses = (x or () for x in rule_of(p))
                all_of = sum(amounts.values())
                ways = {
                    "egress": [sum(x * at(s, r) for s, x in amounts.items()) for r in egresses],
                    "ingress": [all_of * at(s, egress) for s in ingresses],
                    "both": [all_of * at(s, r) for s in ingresses for r in egresses],
                }[kind]
                total += now
                gains.append(max([0.0, *ways]) - now)
            high[e] = max(high.get(e, 0.0), total + sum(sorted(gains, reverse=True)[:k]))
    return high


def test_rules_with_sets_of_their_own_under_a_failure(spark, base):  # noqa: F811
    some = lambda *p: spark.createDataFrame([(x,) for x in p], "prefix long")
    net = base.set_default_uncertainty("both").modify_default_egresses(F.col("root") > 2).modify_default_ingresses(F.col("router") < 4)
    net = net.with_uncertainty(some(0, 1), "ingress", ingresses=[2, 5]).with_uncertainty(some(2), "egress", egresses={1: [7], 4: [8]}).with_uncertainty(some(1), "both", [0], [3, 4])
    of = {0: ("ingress", None, [2, 5]), 1: ("both", [0], [3, 4]), 2: ("egress", [1, 4], None)}
    default = ("both", [3, 4, 5], [0, 1, 2, 3])
    demand = {(r["src"], r["prefix"]): r["demand"] for r in base.demand.collect()}
    scenarios = flow.failure_scenarios(base.links, 1)
    unit = flow.unit_flow(base.links, base.roots(), scenarios)
    ids = {r["edge_id"]: (r["src"], r["dst"]) for r in base.links.collect()}
    for k in (1, 6):
        expected = brute(unit, ids, demand, {p: p for p in range(6)}, lambda p: of.get(p, default), k)
        assert loads_of(net.analyze(k, 1)) == {ids[e]: pytest.approx(x, abs=1e-6) for e, x in expected.items()}
    with pytest.raises(ValueError, match="ingress or both"):
        base.with_uncertainty(some(0), "neither")


def test_bounds_change_no_result(spark, base, monkeypatch):  # noqa: F811
    net = weighted(spark, base)
    for k, at_most in ((1, False), (3, True)):
        found = []
        for few in (1, 10**9):
            monkeypatch.setattr(blocks, "BOUNDED", few)
            found.append({(r["src"], r["dst"]): (round(r["load"], 6), r["failed"]) for r in net.analyze(k, 1, at_most).collect()})
        assert found[0] == found[1]


def test_installed_paths_under_a_failure_agree_with_relations(spark, base):  # noqa: F811
    ids = {(r["src"], r["dst"]): r["edge_id"] for r in base.links.collect()}
    routes = [(0, 5, 0, [(0, 1), (1, 3), (3, 4), (4, 5)]), (0, 5, 1, [(0, 1), (1, 2), (2, 4), (4, 5)]), (3, 1, 0, [(3, 2), (2, 1)])]
    paths = spark.createDataFrame([(a, b, i, [ids[e] for e in way]) for a, b, i, way in routes], "ingress int, egress int, path_no int, edges array<int>")
    own = spark.createDataFrame([(2, 4, 0, 0, [ids[4, 2], ids[2, 1], ids[1, 0]])], "prefix long, ingress int, egress int, path_no int, edges array<int>")
    net = base.install_te_paths(paths).add_te_paths(own)
    every = net.demand.select("prefix").distinct().crossJoin(paths).unionByName(own)
    demand, states, kinds = base.prepared()
    scenarios = flow.failure_scenarios(base.links, 1)
    unit = flow.unit_flow(base.links, base.roots(), scenarios)
    prefs = base.roots().select(F.col("root").alias("egress"), F.lit(100).alias("local_pref"))
    sets = rules.candidate_sets_by_prefix(prefs, every)
    for k in (1, None):
        plain = loads.changed_load(unit, demand, states, kinds, k, at_most=True, te_paths=every, sets=sets)
        assert loads_of(net.analyze(k, 1, at_most=True)) == loads_of(loads.over_scenarios(plain, base.links, scenarios))
    # What changes makes the load: the sum of current loads and of the largest change.
    now = loads_of(net.analyze(0, 0))
    rows = {(r["src"], r["dst"]): r for r in net.causes(1, 0).collect()}
    for ends, load in loads_of(net.analyze(1, 0)).items():
        if load > 0:
            assert now[ends] + rows[ends]["worst"] - rows[ends]["current"] == pytest.approx(load, abs=1e-6)
            assert rows[ends]["egress"] is None or rows[ends]["egresses"] == [rows[ends]["egress"]]


def test_clusters_tell_explicit_paths_apart(spark, base):  # noqa: F811
    net = weighted(spark, base)
    ids = {(r["src"], r["dst"]): r["edge_id"] for r in base.links.collect()}
    way = spark.createDataFrame([(p, 0, 5, 0, [ids[e] for e in ((0, 1), (1, 3), (3, 4), (4, 5))]) for p in (0, 1, 2)], "prefix long, ingress int, egress int, path_no int, edges array<int>")
    tied = net.add_te_paths(way)
    groups = net.demand.select("prefix").distinct().withColumn("cluster", (F.col("prefix") / 10).cast("int"))
    with pytest.raises(ValueError, match="mixes"):
        tied.with_clustering(groups).analyze(1, 0)
    assert loads_of(tied.with_cluster_number(3).analyze(2, 0)) == pytest.approx(loads_of(tied.analyze(2, 0)), abs=1e-6)


def test_lost_demand_and_sole_paths(spark, base):  # noqa: F811
    packed = base.packed()
    cut = [r["edge_id"] for r in base.links.collect() if 0 in (r["src"], r["dst"])]
    scenarios = spark.createDataFrame([(0, []), (1, cut)], "scenario_id long, failed array<int>")
    # Without its links router 0 keeps what stays there: its own demand for prefix 0; all else that starts or ends there is lost.
    assert {r["scenario_id"]: r["dropped"] for r in blocks.dropped_demand(packed, scenarios).collect()} == {0: 0.0, 1: 10.0}
    few = Analysis(base.links, base.ext_links, base.demand.where("src IN (0, 5)"), base.route_state)
    best = few.analyze(1, 1).where("load > 0").collect()
    n, all_n = few.inaccurate_links(1, 1).first()["n"], few.inaccurate_links(1, 1, invent_new=True).first()["n"]
    ids = {(r["src"], r["dst"]): r["edge_id"] for r in base.links.collect()}
    wanted = {True: 0, False: 0}
    for r in best:
        one = spark.createDataFrame([(0, r["failed"])], "scenario_id long, failed array<int>")
        sole = {(x["src"], x["edge_id"]) for x in flow.unit_flow(base.links, base.roots(), one).where("`unique`").collect()}
        for invent in (True, False):
            wanted[invent] += not any((s, ids[r["src"], r["dst"]]) in sole for s in (range(6) if invent else (0, 5)))
    assert (n, all_n) == (wanted[False], wanted[True])
