"""The analysis as users build it, trees and drawn paths, budgets and search."""

import itertools

import pytest
from pyspark.sql import functions as F

from linkpeak.operators import blocks, clustering, flow, loads, paths, sweeps
from linkpeak.plans.analysis import Analysis
from tests.test_loads import GOLDEN, PAIRS, links_of


@pytest.fixture(scope="module")
def base(spark):
    links = links_of(spark, [(a, b, 1) for a, b in PAIRS])
    ext = spark.createDataFrame([(100 + i, i) for i in range(6)], "ext int, router int")
    demand = spark.createDataFrame([(r, p, 1.0) for r in range(6) for p in range(6)], "src int, prefix long, demand double")
    state = spark.createDataFrame([(p, 100 + p) for p in range(6)], "prefix long, ext int")
    return Analysis(links, ext, demand, state)


def loads_of(df):
    return {(r["src"], r["dst"]): round(r["load"], 6) for r in df.collect()}


@pytest.mark.parametrize("k", [0, 1, None])
def test_golden_by_builder(base, k):
    assert loads_of(base.set_default_uncertainty("ingress").analyze(k, 0)) == GOLDEN[k]


def test_rules_precede_and_limits_hold(spark, base):
    some = spark.createDataFrame([(0,), (1,)], "prefix long")
    mixed = base.with_uncertainty(some, "both").with_uncertainty(some.where("prefix = 1"), "ingress")
    kinds = {r["prefix"]: r["kind"] for r in mixed.kinds().collect()}
    assert kinds == {0: "both", 1: "ingress", **dict.fromkeys(range(2, 6), "egress")}
    all_ways, few = loads_of(base.analyze(None, 0)), loads_of(base.set_default_uncertainty("egress", (0, 5)).analyze(None, 0))
    assert all(few[e] <= x + 1e-9 for e, x in all_ways.items())
    assert few[3, 1] > 0


def test_blocks_agree_with_relations(spark, base):
    demand, states, _ = base.prepared()
    kinds = demand.select("prefix").distinct().withColumn("kind", F.when(F.col("prefix") % 3 == 0, "both").when(F.col("prefix") % 3 == 1, "ingress").otherwise("egress"))
    scenarios = flow.failure_scenarios(base.links, 1)
    unit = flow.unit_flow(base.links, base.roots(), scenarios)
    for k in (1, 3):
        one = loads.over_scenarios(blocks.changed_load(base.links, base.roots(), scenarios, demand, states, kinds, k), base.links, scenarios)
        two = loads.over_scenarios(loads.changed_load(unit, demand, states, kinds, k), base.links, scenarios)
        assert loads_of(one) == loads_of(two)


def test_clusters_of_alike_prefixes_change_nothing(spark, base):
    grouped = base.demand.withColumn("prefix", F.col("prefix") % 2)
    state = spark.createDataFrame([(0, 100), (1, 103)], "prefix long, ext int")
    plain = Analysis(base.links, base.ext_links, grouped.groupBy("src", "prefix").agg(F.sum("demand").alias("demand")), state)
    assignment = spark.createDataFrame([(0, 0), (1, 1)], "prefix long, cluster int")
    assert loads_of(plain.with_clustering(assignment).analyze(0, 0)) == loads_of(plain.analyze(0, 0))
    bounds = plain.with_clustering(assignment).only_heaviest_prefixes(1).bounds().first()
    assert bounds["plus"] == pytest.approx(18.0)
    assert bounds["minus"] == pytest.approx(0.0)
    with pytest.raises(ValueError, match="mixes"):
        plain.with_clustering(assignment.withColumn("cluster", F.lit(0))).analyze(0, 0)


def test_missing_state_is_an_error(base):
    with pytest.raises(ValueError, match="routing state"):
        Analysis(base.links, base.ext_links, base.demand, base.route_state.where("prefix > 0")).analyze(0, 0)


def test_trees_paths_and_subtrees(spark, base):
    unit = flow.unit_flow(base.links, base.roots(), flow.base_scenario(spark))
    hops = paths.tree(flow.ecmp_dag(base.links, flow.node_costs(unit)))
    routes = paths.paths(hops, 8)
    found = {(r["root"], r["node"]): r["routers"] for r in routes.collect()}
    assert len(found) == 30
    assert found[5, 0] == [0, 1, 2, 4, 5]
    assert {r["node"] for r in paths.subtree(routes.where("root = 5"), 4).collect()} == {0, 1, 2, 3, 4}
    assert paths.node_at(routes.where("root = 5 AND node = 0"), 2).first()["at"] == 2


def test_drawn_paths_connect_their_ends(spark, base):
    prefixes, sources = spark.range(20).withColumnRenamed("id", "prefix"), spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "src int, weight double")
    wanted = paths.wanted_paths(prefixes, sources, base.roots(), 2, 4, by="weight")
    ends = {r["edge_id"]: (r["src"], r["dst"]) for r in base.links.collect()}
    rows = paths.drawn_paths(wanted, base.links, 5).collect()
    assert rows
    for r in rows:
        steps = [ends[e] for e in r["edges"]]
        assert (steps[0][0], steps[-1][1]) == (r["ingress"], r["egress"])
        assert all(a[1] == b[0] for a, b in zip(steps, steps[1:], strict=False))


def test_budget_and_error_driven_clusters(spark):
    rows = [(s, p, float(1 + (p * 7 + s * 3) % 5)) for p in range(12) for s in range(2)]
    demand = spark.createDataFrame(rows, "src int, prefix long, demand double")
    settings = spark.createDataFrame([(p, "egress", [p % 2]) for p in range(12)], "prefix long, kind string, egresses array<int>")
    five = sweeps.cluster_within_budget(demand, settings, 5, max_iter=2)
    assert five.count() == 12
    assert five.select("cluster").distinct().count() <= 5
    # Prefixes that may change their ingress are one cluster for each class, whatever the budget.
    mixed = settings.withColumn("kind", F.when(F.col("prefix") < 6, "ingress").otherwise("egress"))
    found = sweeps.cluster_within_budget(demand, mixed, 4).join(mixed, "prefix").collect()
    assert {len({r["cluster"] for r in found if (r["kind"], r["egresses"]) == ("ingress", [x])}) for x in (0, 1)} == {1}
    assert len({r["cluster"] for r in found if r["kind"] == "egress"}) <= 4
    assert sum(r["kind"] == "ingress" for r in found) == 6
    near = sweeps.cluster_to_error(demand, settings, 0.5, max_iter=1)
    vec = clustering.vectors(demand)
    e = clustering.errors(vec, near, "scaled").agg(F.sum(F.col("error_pos") + F.col("error_neg"))).first()[0]
    assert e <= 0.5 * sum(r[2] for r in rows)


def test_classes_are_clustered_as_they_are_alone(spark):
    rows = [(s, p, float(1 + (p * p * 7 + s * 5 + p * s) % 23)) for p in range(24) for s in range(3)]
    demand = spark.createDataFrame(rows, "src int, prefix long, demand double")
    vec = clustering.vectors(demand).withColumn("class", F.col("prefix") % 2)
    sizes = spark.createDataFrame([(0, 3), (1, 2)], "class long, k int")
    for mode in clustering.MODES:
        found = {r["prefix"]: r["cluster"] for r in clustering.kmeans_by_class(vec, sizes, mode).collect()}
        alone = {}
        for c, k in ((0, 3), (1, 2)):
            alone |= {r["prefix"]: r["cluster"] for r in clustering.kmeans(vec.where(F.col("class") == c).drop("class"), k, mode).collect()}
        assert found == alone


def test_clusters_by_the_builder(spark, base):
    net = base.with_uncertainty(spark.createDataFrame([(0,), (1,)], "prefix long"), "ingress")
    plain = net.analyze(None, 0)
    # As many clusters as prefixes: nothing is lost. With fewer, bounds tell by how much a load may be off.
    assert loads_of(net.with_cluster_number(10).analyze(None, 0)) == loads_of(plain)
    assert loads_of(net.with_cluster_error(0.0).clustered().analyze(0, 0)) == loads_of(net.analyze(0, 0))
    assert net.with_cluster_number(1).bounds().first()["plus"] >= 0


def test_causes_make_the_worst_load(spark, base):
    under = {}

    def now(failed):
        if (key := tuple(failed or ())) not in under:
            under[key] = loads_of(Analysis(base.links.where(~F.col("edge_id").isin(*key or (-1,))), base.ext_links, base.demand, base.route_state).analyze(0, 0))
        return under[key]

    for k in (2, None):
        found = base.analyze(k, 1).collect()
        rows = base.causes(k, 1).collect()
        current = {}
        for r in rows:
            current.setdefault((r["src"], r["dst"]), [r["failed"], []])[1].append(r)
        for r in found:
            failed, why = current[r["src"], r["dst"]]
            assert failed == r["failed"]
            gain = sum(x["worst"] - x["current"] for x in why if x["prefix"] is not None)
            assert now(failed).get((r["src"], r["dst"]), 0.0) + gain == pytest.approx(r["load"], abs=1e-6)
            assert k is None or len(why) == k
            assert all(x["egress"] is not None and x["ingress"] is None for x in why if x["prefix"] is not None)


def test_default_limits_leave_named_rules_alone(spark, base):
    some = spark.createDataFrame([(0,), (1,)], "prefix long")
    limited = base.set_default_uncertainty("egress", (5,)).with_uncertainty(some, "egress")
    of = lambda df: loads_of(df.analyze(None, 0))
    only = lambda net, prefixes: Analysis(net.links, net.ext_links, net.demand.where(prefixes), net.route_state, net.default_kind, net.default_egresses)
    free, bound = of(only(base, "prefix < 2")), of(only(base.set_default_uncertainty("egress", (5,)), "prefix >= 2"))
    assert of(limited) == {e: pytest.approx(free[e] + bound[e], abs=1e-6) for e in free}


def test_unknown_sources_and_too_many_failures_are_errors(spark, base):
    with pytest.raises(ValueError, match="topology"):
        Analysis(base.links, base.ext_links, base.demand.withColumn("src", F.col("src") + 3), base.route_state).analyze(0, 0)
    with pytest.raises(ValueError, match="too many"):
        flow.failure_scenarios(base.links, 30)


def test_installed_paths_hold_for_every_prefix(spark, base):
    ids = {(r["src"], r["dst"]): r["edge_id"] for r in base.links.collect()}
    path = spark.createDataFrame([(0, 5, 0, [ids[e] for e in ((0, 1), (1, 3), (3, 4), (4, 5))])], "ingress int, egress int, path_no int, edges array<int>")
    plain, tied = loads_of(base.analyze(0, 0)), loads_of(base.install_te_paths(path).analyze(0, 0))
    assert tied[1, 3] == pytest.approx(plain[1, 3] + 0.5)
    assert tied[1, 2] == pytest.approx(plain[1, 2] - 0.5)


def test_sweeps_and_search(spark):
    grid = spark.createDataFrame([(1,), (2,)], "x int")
    out = sweeps.explore(grid, lambda row: [{"x": row["x"], "y": row["x"] ** 2}], "x int, y int").collect()
    assert sorted((r["x"], r["y"]) for r in out) == [(1, 1), (2, 4)]
    assert len(sweeps.one_at_a_time({"k": 10, "l": 2}, {"k": [1, 100], "l": [0]})) == 4
    at, values, good = sweeps.search(lambda p: p, (0.5, 0.5), (0.9, 0.3))
    assert good
    assert at == values == pytest.approx((0.9, 0.3), abs=0.06)
    assert sweeps.search(lambda p: (0.0,), (0.5,), (1.0,), most=3)[2] is False
    # Values that jump over the target: the search comes round, and gives the nearest setting that it has seen.
    at, values, good = sweeps.search(lambda p: (0.0 if p[0] < 0.55 else 0.8,), (0.5,), (0.5,))
    assert (values, good) == ((0.8,), False)
    assert at == pytest.approx((0.56,), abs=0.011)


@pytest.mark.parametrize("kind", ["egress", "ingress", "both"])
def test_explicit_paths_count_in_current_and_worst_loads(spark, base, kind):
    """Against every set of compatible egresses (and every ingress), the load of each by with_paths()."""
    ids = {(r["src"], r["dst"]): r["edge_id"] for r in base.links.collect()}
    routes = [(0, 0, 5, [(0, 1), (1, 3), (3, 2), (2, 4), (4, 5)]), (0, 0, 5, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]), (0, 3, 1, [(3, 2), (2, 1)]), (1, 5, 0, [(5, 4), (4, 2), (2, 3), (3, 1), (1, 0)])]
    te = spark.createDataFrame([(p, a, b, i, [ids[e] for e in path]) for i, (p, a, b, path) in enumerate(routes)], "prefix long, ingress int, egress int, path_no int, edges array<int>")
    prefs = {0: {1}, 1: {1, 2}, 2: {2}, 3: {1}, 4: {2, 3}, 5: {1, 3}}
    values = spark.createDataFrame([(e, v) for e, vs in prefs.items() for v in vs], "egress int, local_pref int")
    some = base.demand.where("prefix < 3")
    demand = {(r["src"], r["prefix"]): r["demand"] for r in some.collect()}
    net = Analysis(base.links, base.ext_links, some, base.route_state.where("prefix < 3")).set_default_uncertainty(kind).add_te_paths(te).set_local_prefs(values)
    unit = flow.unit_flow(base.links, base.roots(), flow.base_scenario(spark))
    cost = {(r["src"], r["root"]): r["cost"] for r in unit.select("src", "root", "cost").distinct().collect()}
    share = {}
    for r in unit.where("edge_id IS NOT NULL").collect():
        share.setdefault((r["src"], r["root"]), {})[r["edge_id"]] = r["frac"]

    def one(prefix, src, root):
        own = [path for p, a, b, path in routes if (p, a, b) == (prefix, src, root)]
        if not own:
            return share.get((src, root), {})
        return {ids[e]: sum(path.count(e) for path in own) / len(own) for path in own for e in path}

    def load(prefix, sets, amounts):
        out = {}
        for src, x in amounts.items():
            root = min((cost[src, r], r) for r in sets)[1]
            for e, f in one(prefix, src, root).items():
                out[e] = out.get(e, 0.0) + x * f
        return out

    every = [s for n in range(1, 7) for s in itertools.combinations(range(6), n) if set.intersection(*(prefs[r] for r in s))]
    now, worst = {}, {}
    for p in range(3):
        amounts = {s: x for (s, q), x in demand.items() if q == p}
        now[p] = load(p, [p], amounts)
        at_one = [{s: sum(amounts.values())} for s in range(6)]
        ways = {"egress": [load(p, s, amounts) for s in every], "ingress": [load(p, [p], a) for a in at_one], "both": [load(p, [r], a) for a in at_one for r in range(6)]}[kind]
        worst[p] = {e: max(w.get(e, 0.0) for w in ways) for e in ids.values()}
    for k in (0, 1, None):
        found = loads_of(net.analyze(k, 0))
        for ends, e in ids.items():
            current = sum(now[p].get(e, 0.0) for p in range(3))
            gain = max(worst[p][e] - now[p].get(e, 0.0) for p in range(3))
            expected = {0: current, 1: max(current + gain, 0.0), None: sum(w[e] for w in worst.values())}[k]
            assert found[ends] == pytest.approx(expected, abs=1e-6), (k, ends)
