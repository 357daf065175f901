"""All queries of the link-load library by name; their SQL twins are in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkpeak.operators import blocks, clustering, flow, loads, reports, rules, traffic
from linkpeak.plans import experiment_oracles, experiments, oracles, sample_oracles, samples
from linkpeak.sources.tables import Tables


def r4(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 4)


def _flow(t: Tables, failures: int = 0) -> tuple[DataFrame, DataFrame]:
    scenarios = flow.failure_scenarios(t.links, failures)
    return flow.unit_flow(t.links, t.borders, scenarios), scenarios


def _report(t: Tables, edge_loads: DataFrame) -> DataFrame:
    joined = t.links.join(edge_loads.where("scenario_id = 0").drop("scenario_id"), "edge_id", "left")
    return joined.select("src", "dst", r4(F.coalesce("load", F.lit(0.0))).alias("load"))


def current_link_load(t: Tables) -> DataFrame:
    return _report(t, loads.fixed_load(_flow(t)[0], t.demand, t.states))


def unit_flow_costs(t: Tables) -> DataFrame:
    return flow.node_costs(_flow(t)[0]).select("root", "src", "cost")


def unit_flow(t: Tables) -> DataFrame:
    return _flow(t)[0].where("edge_id IS NOT NULL").select("root", "src", "edge_id", r4("frac").alias("frac"), F.col("unique").alias("sole"))


def ecmp_dag(t: Tables) -> DataFrame:
    return flow.ecmp_dag(t.links, flow.node_costs(_flow(t)[0])).select("root", "node", "next_node")


def merged_dag(t: Tables) -> DataFrame:
    out = flow.merged_dag(t.links, flow.node_costs(_flow(t)[0]), t.states)
    return out.select(_listed("egresses").alias("egresses"), "node", _listed("next_nodes").alias("next_nodes"))


def _listed(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def chosen_egress(t: Tables) -> DataFrame:
    return flow.chosen_egress(flow.node_costs(_flow(t)[0]), t.states).select(_listed("egresses").alias("egresses"), "src", "root")


def _kinds(t: Tables, kind: str) -> DataFrame:
    return t.rules.select("prefix", F.lit(kind).alias("kind"))


def _changed(t: Tables, kinds: DataFrame, k: int | None) -> DataFrame:
    return _report(t, blocks.changed_load(t.links, t.borders, flow.base_scenario(t.spark), t.demand, t.states, kinds, k))


def _worst_all(t: Tables, kind: str) -> DataFrame:
    return _changed(t, _kinds(t, kind), None)


def worst_egress_inf(t: Tables) -> DataFrame:
    return _worst_all(t, "egress")


def worst_ingress_inf(t: Tables) -> DataFrame:
    return _worst_all(t, "ingress")


def worst_both_inf(t: Tables) -> DataFrame:
    return _worst_all(t, "both")


def worst_mixed_inf(t: Tables) -> DataFrame:
    return _changed(t, t.rules, None)


def worst_k1(t: Tables) -> DataFrame:
    return _changed(t, t.rules, 1)


def worst_k10(t: Tables) -> DataFrame:
    return _changed(t, t.rules, 10)


def worst_egress_witness(t: Tables) -> DataFrame:
    cells = blocks.worst_cells(t.links, t.borders, flow.base_scenario(t.spark), t.demand, t.states, _kinds(t, "egress"))
    return cells.where("worst > 0").select("prefix", "edge_id", r4("worst").alias("worst"), "egress")


def failures_l1_fixed(t: Tables) -> DataFrame:
    f, scenarios = _flow(t, 1)
    out = loads.over_scenarios(loads.fixed_load(f, t.demand, t.states), t.links, scenarios)
    return out.select("src", "dst", r4("load").alias("load"))


def failures_l1_witness(t: Tables) -> DataFrame:
    f, scenarios = _flow(t, 1)
    return loads.fixed_load(f, t.demand, t.states).join(scenarios, "scenario_id").select(_listed("failed").alias("failed"), "edge_id", r4("load").alias("load"))


def failures_l1_k1(t: Tables) -> DataFrame:
    return _over(t, 1)


def _over(t: Tables, failures: int, directed: bool = False) -> DataFrame:
    scenarios = flow.failure_scenarios(t.links, failures, directed)
    packed = blocks.Packed.of(t.links, t.borders, t.demand, blocks.settings_of(t.states, t.rules))
    return loads.over_scenarios(blocks.highest_loads(packed, scenarios, 1), t.links, scenarios).select("src", "dst", r4("load").alias("load"))


def failures_l2_k1(t: Tables) -> DataFrame:
    """Two failures: too many for walks in SQL; tests compare the kernel with the relational form."""
    return _over(t, 2)


def failures_directed_k1(t: Tables) -> DataFrame:
    """Links that fail in one direction only."""
    return _over(t, 1, directed=True)


def link_combinations(t: Tables) -> DataFrame:
    return flow.failure_scenarios(t.links, 2).select(_listed("failed").alias("failed"))


def undirected_links(t: Tables) -> DataFrame:
    return flow.undirected_links(t.links).select("link_id", _listed("edges").alias("edges"))


def lp_compatible_subsets(t: Tables) -> DataFrame:
    """Sets of up to four border routers, by the operator's own bound on their size."""
    return rules.compatible_subsets(t.local_prefs, 4).select(_listed("egresses").alias("egresses"))


def lp_compatible_subsets_all(t: Tables) -> DataFrame:
    """Sets of any size; up to 2^25 of them, so without SQL."""
    return rules.compatible_subsets(t.local_prefs).select(_listed("egresses").alias("egresses"))


def te_of_parts(t: Tables) -> DataFrame:
    """Explicit paths: for prefixes of size 7 from router 0 by way of its ring neighbours to each current egress."""
    some = t.read("part").where("p_size % 10 = 7").select(F.col("p_partkey").alias("prefix"))
    ring = t.links.where("dst = (src + 1) % 25").select("src", "edge_id")
    hops = ring.agg(F.array_sort(F.collect_list(F.struct("src", "edge_id"))).alias("ring"))
    rows = t.route_state.join(some, "prefix").where("egress > 0").crossJoin(F.broadcast(hops))
    edges = F.transform(F.filter("ring", lambda x: x["src"] < F.col("egress")), lambda x: x["edge_id"])
    return rows.select("prefix", F.lit(0).alias("ingress"), "egress", F.lit(0).alias("path_no"), edges.alias("edges"))


def te_path_override(t: Tables) -> DataFrame:
    out = loads.with_paths(_flow(t)[0], t.demand, t.states, te_of_parts(t)).groupBy("scenario_id", "edge_id").agg(F.sum("load").alias("load"))
    return _report(t, out)


def _te_worst(t: Tables, k: int | None) -> DataFrame:
    return _report_of(t, samples.network(t).add_te_paths(te_of_parts(t)).set_local_prefs(t.local_prefs).analyze(k, 0))


def _report_of(t: Tables, found: DataFrame) -> DataFrame:
    return found.select("src", "dst", r4("load").alias("load"))


def te_worst_k1(t: Tables) -> DataFrame:
    """The worst loads under one route change where explicit paths override shortest ones."""
    return _te_worst(t, 1)


def te_worst_inf(t: Tables) -> DataFrame:
    return _te_worst(t, None)


def path_to_edges(t: Tables) -> DataFrame:
    """Paths over each order's parts' suppliers' routers; many of them have missing links."""
    items = t.read("lineitem").join(t.ext_links, F.col("l_suppkey") == F.col("ext"))
    hops = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "router"))).alias("h")).where(F.size("h") >= 2)
    paths = hops.select(F.col("l_orderkey").alias("path_id"), F.transform("h", lambda x: x["router"]).alias("routers"))
    return flow.path_edges(paths, t.links).select("path_id", _listed("edges").alias("edges"))


def rule_precedence(t: Tables) -> DataFrame:
    """Rule r names prefixes divisible by r, for r from 2 to 7; the last one holds."""
    named = t.rules.select("prefix", F.explode(F.sequence(F.lit(2), F.lit(7))).alias("rule_id")).where("prefix % rule_id = 0")
    kinds = t.spark.createDataFrame([(2, "ingress"), (3, "both"), (4, "egress"), (5, "ingress"), (6, "both"), (7, "egress")], "rule_id int, kind string")
    return rules.effective_rules(t.rules.select("prefix"), named, kinds).select("prefix", "rule_id", "kind")


def prefix_classes(t: Tables) -> DataFrame:
    members, _ = rules.prefix_classes(t.rules.join(t.states, "prefix"), t.demand)
    return members.select("kind", _listed("egresses").alias("egresses"), "members", r4("total").alias("total"))


def heaviest_truncation(t: Tables) -> DataFrame:
    kept, dropped = loads.heaviest_only(t.demand, 100)
    return kept.agg(F.countDistinct("prefix").alias("kept"), r4(F.sum("demand")).alias("demand")).crossJoin(dropped.select(r4("dropped").alias("dropped")))


def tm_stats_source(t: Tables) -> DataFrame:
    return traffic.per_source(t.demand).select("src", r4("demand").alias("demand"))


def tm_stats_prefix(t: Tables) -> DataFrame:
    return traffic.per_prefix(t.demand).select("prefix", r4("demand").alias("demand"))


def tm_topk_share(t: Tables) -> DataFrame:
    return traffic.top_shares(t.demand, [1, 10, 100, 1000, 2000, 5000, 10000, 15000]).select("top", r4("demand").alias("demand"), F.round("share", 6).alias("share"))


def top_k_prefixes(t: Tables) -> DataFrame:
    return traffic.top_prefixes(t.demand, 20).select("prefix", r4("demand").alias("demand"))


def normalized_demand(t: Tables) -> DataFrame:
    return traffic.normalised(t.demand).select("src", "prefix", F.round("norm", 6).alias("norm"), r4("scale").alias("scale"))


def _centre(t: Tables, mode: str) -> DataFrame:
    v = clustering.vectors(t.demand)
    return clustering.centres(v, clustering.single(v), mode).select("cluster", "src", F.round("centre", 6).alias("centre"))


def single_cluster_center_direct(t: Tables) -> DataFrame:
    return _centre(t, "direct")


def single_cluster_center_norm(t: Tables) -> DataFrame:
    return _centre(t, "normalized")


def single_cluster_center_scaled(t: Tables) -> DataFrame:
    return _centre(t, "scaled")


def heaviest_k_error(t: Tables) -> DataFrame:
    return clustering.heaviest_errors(t.demand, 10, "scaled").select("cluster", r4("error_pos").alias("error_pos"), r4("error_neg").alias("error_neg"))


def effective_demand(t: Tables) -> DataFrame:
    v = clustering.vectors(t.demand)
    return clustering.effective_demand(v, clustering.heaviest(v, 10), "scaled").select("cluster", "src", r4("demand").alias("demand"))


def kmeans_one_step(t: Tables) -> DataFrame:
    return clustering.nearest_start(t.demand, 10)


def kmeans(t: Tables) -> DataFrame:
    return clustering.kmeans(t.demand, 8)


def approx_matrix_error(t: Tables) -> DataFrame:
    total = t.demand.agg(F.sum("demand").alias("total"))
    return clustering.heaviest_errors(t.demand, 50, "scaled").agg(F.sum("error_pos").alias("e")).crossJoin(total).select(F.round(F.col("e") / F.col("total"), 6).alias("error"))


def clustering_scores(t: Tables) -> DataFrame:
    """The part of the grid that the SQL twin has."""
    return _scores(t, (10, 50), ())


def clustering_scores_all(t: Tables) -> DataFrame:
    """The whole grid; no SQL iterates k-means."""
    return _scores(t)


def _scores(t: Tables, *sizes: tuple[int, ...]) -> DataFrame:
    return clustering.score_grid(t.demand, *sizes).select("method", "k", "mode", F.round("error", 6).alias("error"))


def equivalent_top_k(t: Tables) -> DataFrame:
    total = t.demand.agg(F.sum("demand")).first()[0] or 0.0
    return traffic.equivalent_top_k(t.demand, float(round(total * 0.3)))


def report_difference(t: Tables) -> DataFrame:
    d = traffic.difference(current_link_load(t), worst_egress_inf(t), 1000.0)
    return d.select(*[F.round(c, 5).alias(f"d_{c}") for c in d.columns])


def link_overload(t: Tables) -> DataFrame:
    capacity = t.links.select("src", "dst", (F.col("weight") * 20000).cast("double").alias("capacity"))
    return loads.overloaded(current_link_load(t), capacity)


def lognormal_sigma(t: Tables) -> DataFrame:
    s = traffic.lognormal_sigmas(t.demand)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def gravity_expected(t: Tables) -> DataFrame:
    return traffic.gravity_expected(t.demand).select("src", "prefix", r4("demand").alias("demand"))


def attraction_renorm(t: Tables) -> DataFrame:
    from linkpeak.sources.generators import renormalised

    attraction = t.read("part").select(F.col("p_partkey").alias("prefix"), F.col("p_size").cast("double").alias("attraction"))
    return renormalised(t.demand, attraction).select("src", "prefix", r4("demand").alias("demand"))


def variability_check(t: Tables) -> DataFrame:
    f, _ = _flow(t)
    return loads.inaccurate_variability(f, loads.fixed_load(f, t.demand, t.states))


def variability_added(t: Tables) -> DataFrame:
    return loads.add_variability(current_link_load(t), 100.0)


def _measured(t: Tables) -> DataFrame:
    """Orders as measurements: links by region, failures by priority, seconds by price."""
    orders, customers = t.read("orders"), t.read("customer").join(t.routers, F.col("c_nationkey") == F.col("router_id"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("region", F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_totalprice").alias("seconds"), F.col("c_nationkey").alias("nation"))


def runtime_quantiles(t: Tables) -> DataFrame:
    q = reports.quantiles(_measured(t).where("status = 'F'"), ["region", "priority"], ["seconds"])
    return q.select("region", "priority", *[r4(c).alias(c) for c in q.columns if c.startswith("seconds")])


def accuracy_quantiles(t: Tables) -> DataFrame:
    q = reports.five_numbers(_measured(t), ["region", "status"], "seconds")
    return q.select("region", "status", *[r4(c).alias(c) for c in ("min", "q25", "q50", "q75", "max", "mean")])


def aspect_factors(t: Tables) -> DataFrame:
    q = reports.ratios_to_base(_measured(t), ["region", "status"], "seconds", (F.col("region") == 0) & (F.col("status") == "F"))
    return q.select("region", "status", r4("median").alias("median"), F.round("ratio", 6).alias("ratio"))


def kl_ecdf(t: Tables) -> DataFrame:
    m = _measured(t).groupBy("nation", "status").agg(F.max("seconds").alias("most"))
    out = reports.ratio_ecdf(m, "nation", "most", F.col("status") != "F", F.col("status") == "F", ["status"])
    return out.select("status", F.round("fraction", 9).alias("fraction"), F.round("ecdf", 9).alias("ecdf"))


def link_report_text(t: Tables) -> DataFrame:
    return reports.link_text(reports.report_columns(current_link_load(t), []), t.routers, 1000000.0)


def topk_per_link(t: Tables) -> DataFrame:
    """The three prefixes that load each link most now."""
    cells = loads.prefix_load(_flow(t)[0], t.demand, t.states).select("edge_id", "prefix", F.round("current", 6).alias("current"))
    rank = F.row_number().over(Window.partitionBy("edge_id").orderBy(F.desc("current"), "prefix"))
    return cells.withColumn("rank", rank).where("rank <= 3").select("edge_id", "rank", "prefix", r4("current").alias("current"))


_NAMES = (
    current_link_load, unit_flow_costs, unit_flow, ecmp_dag, merged_dag, chosen_egress, worst_egress_inf, worst_ingress_inf, worst_both_inf, worst_mixed_inf,
    worst_k1, worst_k10, worst_egress_witness, failures_l1_fixed, failures_l1_witness, failures_l1_k1, failures_l2_k1, failures_directed_k1, link_combinations, undirected_links, lp_compatible_subsets,
    lp_compatible_subsets_all,
    te_path_override, te_worst_k1, te_worst_inf, path_to_edges, rule_precedence, prefix_classes, heaviest_truncation, tm_stats_source, tm_stats_prefix, tm_topk_share, top_k_prefixes,
    normalized_demand, single_cluster_center_direct, single_cluster_center_norm, single_cluster_center_scaled, heaviest_k_error, effective_demand, kmeans_one_step,
    kmeans, approx_matrix_error, clustering_scores, clustering_scores_all, equivalent_top_k, report_difference, link_overload, lognormal_sigma, gravity_expected, attraction_renorm,
    variability_check, variability_added, runtime_quantiles, accuracy_quantiles, aspect_factors, kl_ecdf, link_report_text, topk_per_link,
)


def _query(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {plan.__name__: _query(plan) for plan in (*_NAMES, *samples.QUERIES, *experiments.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {**oracles.SQL, **sample_oracles.SQL, **experiment_oracles.SQL}
