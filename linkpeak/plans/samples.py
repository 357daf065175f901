"""Queries about generated networks and matrices, explicit paths, clusters, reports and sweeps; SQL in sample_oracles.py."""

from __future__ import annotations

import uuid
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkpeak.operators import blocks, clustering, flow, paths, reports, rules, sweeps, traffic
from linkpeak.plans.analysis import Analysis
from linkpeak.sources import generators as g
from linkpeak.sources.tables import Tables, shared_folder

#: What the distributions of the query ``distributions`` and of the matrices are.
LAWS = {
    "uniform": g.between(2.0, 5.0),
    "normal": g.normal(1.0, 2.0),
    "exponential": g.exponential(0.5),
    "poisson": g.poisson(4.0),
    "beta": g.beta(2, 3),
    "log_normal": g.log_normal(0.5),
    "log_normal_mean_one": g.log_normal_mean_one(0.8),
    "pareto": g.shifted_pareto(1.5),
}
#: The setting of the running-time experiments and what is changed of it, one at a time.
BASE = {"clusters": 300, "k": "10", "externals": 30, "te_paths": 0, "l": 2}
CHANGES = {"clusters": [100, 600, 1000], "k": ["1", "100", "inf"], "externals": [100], "te_paths": [1, 3, 5], "l": [0, 1]}
#: A measurement is a fourth of an order's price in seconds, its two parts a third and two thirds of that.
PARTS = {"running_time_sec": 0.25, "analysis_time_sec": 0.25 / 3, "clustering_time_sec": 0.5 / 3}


def _r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def _r4(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 4)


def _listed(c: Column | str) -> Column:
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), ",")


def _prefixes(t: Tables) -> DataFrame:
    return t.read("part").select(F.col("p_partkey").alias("prefix"))


def _sources(t: Tables) -> DataFrame:
    return t.routers.select(F.col("router_id").alias("src"), (F.col("region") + 1).cast("double").alias("weight"))


def complete_graph(t: Tables) -> DataFrame:
    return g.complete_graph(t.spark, t.routers.count())


def random_weights(t: Tables) -> DataFrame:
    return g.random_weights(t.links, 5).select("src", "dst", "weight")


def internal_graph(t: Tables) -> DataFrame:
    """The network with its external routers, whose ids come after all others, as a graph of the internal ones."""
    ext = t.ext_links.select((F.col("ext") + 1000).cast("int").alias("ext"), "router")
    routers = t.routers.select("router_id", F.lit("internal").alias("kind")).union(ext.select("ext", F.lit("external")))
    links = t.links.select("edge_id", "src", "dst", (F.col("weight") + 0.4).alias("weight")).union(ext.select(F.lit(-1), F.col("router"), "ext", F.lit(1.0)))
    return g.internal_graph(links, routers)


def external_routers(t: Tables) -> DataFrame:
    return g.external_routers(t.routers, 60, 3)


def random_states(t: Tables) -> DataFrame:
    return g.random_states(_prefixes(t), t.ext_links, 21)


def pooled_states(t: Tables) -> DataFrame:
    return g.pooled_states(_prefixes(t), t.ext_links, 10, 22)


def distributions(t: Tables) -> DataFrame:
    return g.spread(_prefixes(t), "prefix").select("prefix", *[_r6(law(31, "prefix")).alias(name) for name, law in LAWS.items()])


def gravity_matrix(t: Tables) -> DataFrame:
    return g.gravity(_sources(t), _prefixes(t), 41, g.uniform_around_one(0.5), LAWS["pareto"], g.uniform_around_one(0.5)).withColumn("demand", _r6("demand"))


def gravity_matrix_options(t: Tables) -> DataFrame:
    """Friction multiplied, and prefixes with the traffic that their attraction asks for."""
    out = g.gravity(_sources(t), _prefixes(t), 42, LAWS["log_normal"], LAWS["log_normal_mean_one"], LAWS["log_normal"], invert_friction=True, renormalise_attraction=True)
    return out.withColumn("demand", _r6("demand"))


def iid_matrix(t: Tables) -> DataFrame:
    return g.iid(_sources(t), _prefixes(t), 43, LAWS["poisson"])


def all_pairs_matrix(t: Tables) -> DataFrame:
    demand, ext_links, state = g.all_pairs(t.routers, 44, LAWS["log_normal"], LAWS["log_normal"], LAWS["log_normal"])
    return demand.join(state, "prefix").join(ext_links, "ext").select("src", "prefix", "router", _r6("demand").alias("demand"))


def parsed_edges(t: Tables) -> DataFrame:
    """Edge strings of the links out of each region, each link twice and with loops between."""
    links = t.links.join(t.routers.select(F.col("router_id").alias("src"), "region"), "src")
    text = F.concat_ws(":", "src", "dst", "weight"), F.concat_ws(":", "dst", "dst", F.lit(7)), F.concat_ws(":", "src", "dst", F.lit(99))
    strings = links.groupBy(F.col("region").alias("graph")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", F.concat_ws(";", *text).alias("e")))), lambda x: x["e"]), ";").alias("edges"))
    return g.parse_edges(strings.withColumn("edges", F.concat("edges", F.lit(";"))))


def te_ends_weighted(t: Tables) -> DataFrame:
    return paths.wanted_paths(_prefixes(t), _sources(t), t.borders, 2, 51, by="weight")


def te_ends_alike(t: Tables) -> DataFrame:
    return paths.wanted_paths(_prefixes(t), _sources(t), t.borders, 2, 52)


def te_ends_in_turn(t: Tables) -> DataFrame:
    return paths.wanted_paths(_prefixes(t), _sources(t), t.borders, 3, 53, in_turn=True)


def te_path_costs(t: Tables) -> DataFrame:
    """What the drawn path of each pair of ends costs by the weights that were drawn for it."""
    wanted = paths.wanted_paths(_prefixes(t), _sources(t), t.borders, 1, 54, by="weight")
    found = paths.drawn_paths(wanted, t.links, 55)
    hops = found.select("prefix", "ingress", "egress", "path_no", F.explode("edges").alias("edge_id"))
    cost = F.sum(paths.drawn_weight(55, 1, 10, "prefix", "ingress", "egress", "path_no", "edge_id"))
    return hops.groupBy("prefix", "ingress", "egress").agg(cost.alias("cost"), F.count("*").alias("_hops")).drop("_hops")


def _tree(t: Tables, turned: bool) -> DataFrame:
    links, roots = (paths.from_sources(t.links), t.routers.select(F.col("router_id").alias("root"))) if turned else (t.links, t.borders)
    unit = flow.unit_flow(links, roots, flow.base_scenario(t.spark))
    return paths.tree(flow.ecmp_dag(links, flow.node_costs(unit)))


def destination_tree(t: Tables) -> DataFrame:
    return _tree(t, False).select("root", "node", "next_node")


def source_tree(t: Tables) -> DataFrame:
    """Of each node the one before it on the way from a source."""
    return _tree(t, True).select(F.col("root").alias("source"), "node", F.col("next_node").alias("from_node"))


def tree_paths(t: Tables) -> DataFrame:
    return paths.paths(_tree(t, False), t.routers.count()).select("root", "node", _listed("routers").alias("routers"))


def tree_subpaths(t: Tables) -> DataFrame:
    """The part between routers 1 and 0 of the paths that have it, and how many of their hops it is."""
    part = paths.subpath(paths.paths(_tree(t, False), t.routers.count()), 1, 0)
    return part.select("root", "node", _listed("routers").alias("routers"), (F.size("routers") - 1).alias("hops"))


def subtree_sizes(t: Tables) -> DataFrame:
    """Nodes whose path to each root passes router 0."""
    return paths.subtree(paths.paths(_tree(t, False), t.routers.count()), 0).groupBy("root").agg(F.count("*").alias("nodes"))


def _measurements(t: Tables, schema: str = reports.RUNNING_TIME) -> DataFrame:
    """Orders as rows of the experiments' files: regions are topologies, priorities failures, nations links."""
    rows = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.routers, F.col("c_nationkey") == F.col("router_id"))
    given = {
        "topo": F.concat(F.lit("r"), "region"),
        "num_edges": (F.col("c_nationkey") * 10).cast("long"),
        "link_failures": (F.substring("o_orderpriority", 1, 1).cast("int") % 3).cast("long"),
        "input_changes": F.when(F.col("o_orderstatus") == "O", "inf").otherwise(F.lit("10")),
        "cluster_mode": F.lit("Scaled"),
        "approx_error_max": F.col("o_totalprice") * 0.25 / 1e6,
        **{name: F.col("o_totalprice") * x for name, x in PARTS.items()},
    }
    kinds = dict(c.split(" ") for c in schema.split(", "))
    return rows.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def csv_report(t: Tables) -> DataFrame:
    """Quantiles of the newest of two measurement files, written as a prepared file and read again."""
    folder, rows = f"{shared_folder(t.spark)}/measured-{uuid.uuid4().hex}", _measurements(t)
    reports.write_csv(rows.where("link_failures = 0"), f"{folder}/running_time_2023-01-01_10-00-00.csv")
    reports.write_csv(rows, f"{folder}/running_time_2024-02-03_08-30-00.csv")
    newest = reports.newest_csv(t.spark, folder, "running_time_2", reports.RUNNING_TIME, timed=True)
    unbounded = newest.where(reports.as_number(F.col("input_changes")) == float("inf"))
    values = list(PARTS)
    prepared = reports.quantiles(unbounded, ["num_edges", "link_failures"], values)
    names = [c for c in prepared.columns if c not in ("num_edges", "link_failures")]
    reports.write_csv(prepared.repartition(1), f"{folder}/running_time_prepared.csv")
    back = reports.newest_csv(t.spark, folder, "running_time_prepared", ", ".join(f"{c} {k}" for c, k in prepared.dtypes))
    return back.select("num_edges", "link_failures", *[_r4(c).alias(c) for c in names])


def accuracy_tables(t: Tables) -> DataFrame:
    """Five numbers of each region and status, as lines of a text and of a LaTeX table."""
    folder = f"{shared_folder(t.spark)}/measured-{uuid.uuid4().hex}"
    reports.write_csv(_measurements(t, reports.ACCURACY), f"{folder}/accuracy_2024-02-03_08-30-00.csv")
    rows = reports.newest_csv(t.spark, folder, "accuracy_", reports.ACCURACY, timed=True)
    five = ["min", "q25", "q50", "q75", "max"]
    numbers = reports.five_numbers(rows, ["topo", "input_changes"], "approx_error_max")
    label = F.concat_ws(" | ", F.lpad("topo", 8, " "), F.lpad("input_changes", 4, " "))
    text = F.concat_ws(" | ", label, reports.box_text(five, 5), reports.box_text(five, 4, 7))
    latex = F.concat(F.col("topo"), F.lit(" & "), reports.box_latex("EpsilonBoxPlot", five, 8), F.lit(" \\\\"))
    return numbers.select(text.alias("text"), latex.alias("latex"))


def network(t: Tables, kind: str = "egress") -> Analysis:
    """The network of the tables with named rules for the prefixes of kinds other than the default."""
    state = t.route_state.select("prefix", F.col("egress").alias("ext"))
    ext = t.borders.select(F.col("root").alias("ext"), F.col("root").alias("router"))
    out = Analysis(t.links, ext, t.demand, state).set_default_uncertainty(kind)
    for other in ("ingress", "both"):
        out = out.with_uncertainty(t.rules.where(F.col("kind") == other), other)
    return out


def link_report_columns(t: Tables) -> DataFrame:
    """Lines of current loads beside the worst ones for one change and for any number, the latter with bounds of 5 % and 2 %."""
    net = network(t)
    total = float(round(net.known()[0].agg(F.sum("demand")).first()[0] or 1.0))
    packed = net.packed(1)
    report = reports.report_columns(net.analyze(0, 0, packed=packed), [net.analyze(1, 0, packed=packed), net.analyze(None, 0, packed=packed)])
    return reports.link_text(report, t.routers, total, [(0.0, 0.0), (total * 0.05, total * 0.02)])


def causes_k1(t: Tables) -> DataFrame:
    """The route change that makes each link's highest load under one change, and what it adds."""
    out = network(t).causes(1, 0)
    return out.select("src", "dst", "rank", "prefix", _r4("current").alias("current"), _r4("worst").alias("worst"), "egress", "ingress")


def failures_l1_k1_failed(t: Tables) -> DataFrame:
    """The failure under which each link's load is highest, one route change included."""
    out = network(t).analyze(1, 1)
    return out.select("src", "dst", _r4("load").alias("load"), _listed("failed").alias("failed"))


def worst_ingress_witness(t: Tables) -> DataFrame:
    cells = blocks.worst_cells(t.links, t.borders, flow.base_scenario(t.spark), t.demand, t.states, t.rules.select("prefix", F.lit("ingress").alias("kind")))
    return cells.where("worst > 0").select("prefix", "edge_id", _r4("worst").alias("worst"), "ingress")


def worst_both_witness(t: Tables) -> DataFrame:
    cells = blocks.worst_cells(t.links, t.borders, flow.base_scenario(t.spark), t.demand, t.states, t.rules.select("prefix", F.lit("both").alias("kind")))
    return cells.where("worst > 0").select("prefix", "edge_id", _r4("worst").alias("worst"), "egress", "ingress")


def graph_counts(t: Tables) -> DataFrame:
    return reports.graph_counts(t.links, t.routers)


def demand_shares(t: Tables) -> DataFrame:
    by_source = traffic.per_source(t.demand)
    return traffic.shares(by_source, by_source.agg(F.sum("demand")).first()[0] or 0.0).select("src", F.round("demand", 9).alias("share"))


def sampled_for(t: Tables) -> DataFrame:
    """What to sample with for the parameters that each part asks for by its size."""
    tenth = lambda low, n: (F.lit(low) + F.col("p_size") % n * 5) / 10.0
    wanted = t.read("part").select("p_partkey", tenth(20, 6).alias("attraction"), tenth(20, 4).alias("repulsion"), tenth(30, 3).alias("friction"))
    return traffic.sampled_for(wanted)


def classes_by_members(t: Tables) -> DataFrame:
    """Classes of prefixes from the largest on, with their place by members and by demand."""
    members, _ = rules.prefix_classes(t.rules.join(t.states, "prefix"), t.demand)
    # One row for each class.
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    named = members.select("kind", _listed("egresses").alias("egresses"), "members", _r4("total").alias("total"))
    return named.select("*", place(F.desc("members"), "kind", "egresses").alias("by_members"), place(F.desc("total"), "kind", "egresses").alias("by_demand"))


def class_demand(t: Tables) -> DataFrame:
    """The demand of each class by source."""
    _, by_source = rules.prefix_classes(t.rules.join(t.states, "prefix"), t.demand)
    return by_source.select("kind", _listed("egresses").alias("egresses"), "src", _r4("demand").alias("demand"))


def cluster_budget(t: Tables) -> DataFrame:
    return sweeps.cluster_budget(t.demand, t.rules.join(t.states, "prefix"), 600)


def cluster_within_budget(t: Tables) -> DataFrame:
    """No SQL iterates k-means in so many classes; tests check the parts."""
    return sweeps.cluster_within_budget(t.demand, t.rules.join(t.states, "prefix"), 600)


def cluster_members(t: Tables) -> DataFrame:
    vec = clustering.vectors(t.demand)
    _, _, reverse = clustering.approximated(vec, clustering.heaviest(vec, 50), "scaled")
    return reverse.select("cluster", F.size("prefixes").alias("members"), F.md5(_listed("prefixes")).alias("prefixes"))


def first_points(t: Tables) -> DataFrame:
    """The vectors that k-means starts from."""
    return clustering.first_points(clustering.vectors(t.demand), 10, "scaled").withColumn("centre", F.round("centre", 6))


def first_points_drawn(t: Tables) -> DataFrame:
    """The vectors that k-means starts from if they are drawn."""
    return clustering.first_points(clustering.vectors(t.demand), 10, "normalized", 61).withColumn("centre", F.round("centre", 6))


def scenario_network(t: Tables) -> DataFrame:
    """A complete graph of the routers as a network with 60 external ones: its links, those to external routers last."""
    links, ext_links = g.scenario(g.complete_graph(t.spark, t.routers.count()), t.routers, 60, 71)
    return links.select("src", "dst", "weight").union(ext_links.select("router", (F.col("ext") + 1000).cast("int"), F.lit(None).cast("long")))


def limited_egress_inf(t: Tables) -> DataFrame:
    """The worst loads where prefixes without a rule of their own may leave at routers of even number only."""
    found = network(t).modify_default_egresses(F.col("root") % 2 == 0).analyze(None, 0)
    return found.select("src", "dst", _r4("load").alias("load"))


def class_clustered_inf(t: Tables) -> DataFrame:
    """The worst loads where the prefixes of a class count as one."""
    return network(t).with_cluster_number(1).analyze(None, 0).select("src", "dst", _r4("load").alias("load"))


def sweep_settings(t: Tables) -> DataFrame:
    """The settings of the running-time sweeps, with the number of failure scenarios that each has in this network."""
    n = flow.undirected_links(t.links).count()
    grid = t.spark.createDataFrame(sweeps.one_at_a_time(BASE, CHANGES), "clusters int, k string, externals int, te_paths int, l int")
    work = lambda row: [{**row, "scenarios": sum(comb(n, i) for i in range(row["l"] + 1))}]
    return sweeps.explore(grid, work, "clusters int, k string, externals int, te_paths int, l int, scenarios long")


QUERIES = (
    complete_graph, random_weights, internal_graph, external_routers, random_states, pooled_states, distributions, gravity_matrix, gravity_matrix_options, iid_matrix,
    all_pairs_matrix, parsed_edges, te_ends_weighted, te_ends_alike, te_ends_in_turn, te_path_costs, destination_tree, source_tree, tree_paths, tree_subpaths, subtree_sizes,
    csv_report, accuracy_tables, link_report_columns, causes_k1, failures_l1_k1_failed, worst_ingress_witness, worst_both_witness, graph_counts, demand_shares, sampled_for,
    classes_by_members, class_demand, cluster_budget, cluster_within_budget, cluster_members, first_points, first_points_drawn, scenario_network, limited_egress_inf, class_clustered_inf, sweep_settings,
)
