"""Queries about rules with sets of their own, installed paths, clusters with members, and failures; SQL in experiment_oracles.py."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkpeak.operators import blocks, flow, reports, sweeps, traffic
from linkpeak.plans.analysis import Analysis
from linkpeak.plans.samples import network
from linkpeak.sources.tables import Tables, checkpointed


def _r4(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 4)


def _report(found: DataFrame) -> DataFrame:
    return found.select("src", "dst", _r4("load").alias("load"))


def _of_size(t: Tables, tenth: int) -> DataFrame:
    return t.read("part").where(F.col("p_size") % 10 == tenth).select(F.col("p_partkey").alias("prefix"))


def thirds(t: Tables, net: Analysis) -> DataFrame:
    """(prefix, cluster): the prefixes of a class by their remainder of three."""
    demand, states = net.known()
    settings = t.rules.join(states, "prefix").join(demand.select("prefix").distinct(), "prefix", "left_semi")
    named = settings.select("prefix", F.concat_ws(":", "kind", F.array_join(F.col("egresses").cast("array<string>"), ","), F.col("prefix") % 3).alias("_name"))
    # One row for each cluster.
    numbers = checkpointed(named.select("_name").distinct().select("_name", (F.row_number().over(Window.orderBy("_name")) - 1).alias("cluster")))
    return checkpointed(named.join(numbers, "_name").select("prefix", "cluster"))


def _by_thirds(t: Tables) -> Analysis:
    net = network(t)
    return net.with_clustering(thirds(t, net))


def clustered_k10(t: Tables) -> DataFrame:
    """The worst loads under ten route changes, where prefixes route by clusters and change one by one."""
    return _report(_by_thirds(t).analyze(10, 0))


def clustered_causes_k1(t: Tables) -> DataFrame:
    """The prefix, of all members of clusters, whose change makes each link's highest load."""
    out = _by_thirds(t).causes(1, 0)
    return out.select("src", "dst", "prefix", _r4("current").alias("current"), _r4("worst").alias("worst"), "egress", "ingress")


def limited_ingress_inf(t: Tables) -> DataFrame:
    """Traffic may enter at routers of even number; prefixes with a rule of their own leave at routers divisible by three."""
    net = Analysis(t.links, _ends(t), t.demand, _announced(t)).set_default_uncertainty("ingress").modify_default_ingresses(F.col("router") % 2 == 0)
    third = [r["root"] for r in t.borders.where("root % 3 = 0").collect()]
    return _report(net.with_uncertainty(_of_size(t, 5), "egress", egresses=third).analyze(None, 0))


def limited_both_k1(t: Tables) -> DataFrame:
    """One change of ingress and egress, from routers of odd to such of even number; some prefixes change their ingress only, among ten."""
    net = Analysis(t.links, _ends(t), t.demand, _announced(t)).set_default_uncertainty("both").modify_default_egresses(F.col("root") % 2 == 0)
    net = net.modify_default_ingresses(F.col("router") % 2 == 1).with_uncertainty(_of_size(t, 0), "ingress", ingresses=range(10))
    return _report(net.analyze(1, 0))


def _ends(t: Tables) -> DataFrame:
    return t.borders.select(F.col("root").alias("ext"), F.col("root").alias("router"))


def _announced(t: Tables) -> DataFrame:
    return t.route_state.select("prefix", F.col("egress").alias("ext"))


def installed(t: Tables) -> Analysis:
    """The network with two explicit paths for every prefix, along the ring from router 0 to 3 and from 5 to 8."""
    ring = t.links.where("dst = src + 1")
    edges = lambda low, high: F.array_sort(F.collect_list(F.when(F.col("src").between(low, high - 1), F.struct("src", "edge_id"))))
    lists = ring.agg(edges(0, 3).alias("a"), edges(5, 8).alias("b")).select(F.col("a.edge_id").alias("a"), F.col("b.edge_id").alias("b"))
    path = lambda ingress, egress, c: lists.select(F.lit(ingress).alias("ingress"), F.lit(egress).alias("egress"), F.lit(0).alias("path_no"), F.col(c).alias("edges"))
    return network(t).install_te_paths(path(0, 3, "a").union(path(5, 8, "b")))


def te_installed_at(t: Tables) -> DataFrame:
    """Current loads with an explicit path from router 0 along the ring to 3 for the three largest classes."""
    net = network(t)
    path = t.links.where("dst = src + 1 AND src < 3").agg(F.array_sort(F.collect_list("edge_id")).alias("edges")).select(F.lit(0).alias("ingress"), F.lit(3).alias("egress"), F.lit(0).alias("path_no"), "edges")
    # A class keeps its place by demand when it gets paths.
    for i in range(3):
        net = net.install_te_paths_at(i, path)
    return _report(net.analyze(0, 0))


def te_installed_k1(t: Tables) -> DataFrame:
    """The worst loads under one route change, with explicit paths for every prefix."""
    return _report(installed(t).analyze(1, 0))


def te_installed_l1_k1(t: Tables) -> DataFrame:
    """The same under one failure; no SQL walks all sets of egresses under all failures, tests compare with the relational form."""
    return _report(installed(t).analyze(1, 1))


def _own_paths(t: Tables) -> Analysis:
    from linkpeak.plans.registry import te_of_parts

    return network(t).add_te_paths(te_of_parts(t)).set_local_prefs(t.local_prefs)


def causes_te_k1(t: Tables) -> DataFrame:
    """The route change that makes each link's highest load where prefixes of one size have explicit paths: sets of egresses."""
    out = _own_paths(t).causes(1, 0)
    listed = F.array_join(F.col("egresses").cast("array<string>"), ",").alias("egresses")
    return out.select("src", "dst", "prefix", _r4("current").alias("current"), _r4("worst").alias("worst"), listed, "ingress")


def te_clustered_inf(t: Tables) -> DataFrame:
    """The worst loads where the prefixes of a class count as one, and explicit paths tell classes apart."""
    return _report(_own_paths(t).with_cluster_number(1).analyze(None, 0))


def variability_worst_k1(t: Tables) -> DataFrame:
    """Links that no source reaches by a sole path, each under the failure that makes its highest load under one change."""
    return network(t).inaccurate_links(1, 1)


def dropped_demand_routers(t: Tables) -> DataFrame:
    """The demand that loses its way when all links of a router fail, for each router."""
    ends = t.links.select(F.explode(F.array("src", "dst")).alias("router"), "edge_id")
    scenarios = ends.groupBy(F.col("router").cast("long").alias("scenario_id")).agg(F.array_sort(F.collect_list("edge_id")).alias("failed"))
    packed = blocks.Packed.of(t.links, t.borders, t.demand, blocks.settings_of(t.states, t.rules))
    return blocks.dropped_demand(packed, scenarios).select(F.col("scenario_id").alias("router"), _r4("dropped").alias("dropped"))


def outside_sources(t: Tables) -> DataFrame:
    """Demand that enters outside of the topology, if that is the routers of regions 0 and 1 only: what an analysis refuses."""
    inside = t.routers.where("region <= 1").select(F.col("router_id").alias("r"))
    links = t.links.join(inside.withColumnRenamed("r", "src"), "src", "left_semi").join(inside.withColumnRenamed("r", "dst"), "dst", "left_semi")
    lost = flow.outside(t.demand, links, t.borders.join(inside.withColumnRenamed("r", "root"), "root", "left_semi"))
    return t.demand.join(lost, "src", "left_semi").groupBy("src").agg(_r4(F.sum("demand")).alias("demand"))


def cluster_to_error(t: Tables) -> DataFrame:
    """Clusters of all classes that keep the error below a fifth of all demand; no SQL iterates k-means, tests go class by class."""
    return sweeps.cluster_to_error(t.demand, t.rules.join(t.states, "prefix"), 0.2)


def fitted_widths(t: Tables) -> DataFrame:
    """What is fitted to gravity matrices of the parts, for 27 settings of widths at once."""
    return sweeps.fitted_widths(_settings(t), _src(t), _parts(t), 81).select("setting", *[F.round(f"fitted_{c}", 6).alias(c) for c in ("attraction", "repulsion", "friction")])


def parameter_search(t: Tables) -> DataFrame:
    """The widths to draw with so that those fitted to the matrix come close to the target; no SQL searches."""
    at, values, good = sweeps.search_widths((0.6, 0.5, 0.7), _src(t), _parts(t), 82)
    return t.spark.createDataFrame([(*[round(x, 6) for x in (*at, *values)], good)], "attraction double, repulsion double, friction double, fitted_attraction double, fitted_repulsion double, fitted_friction double, close boolean")


def _src(t: Tables) -> DataFrame:
    return t.routers.select(F.col("router_id").alias("src"))


def _parts(t: Tables) -> DataFrame:
    return t.read("part").select(F.col("p_partkey").alias("prefix"))


def _settings(t: Tables) -> DataFrame:
    third = lambda by: (F.floor(F.col("id") / by) % 3 * 0.5 + 0.5).alias
    return t.spark.range(27).select(F.col("id").cast("int").alias("setting"), third(1)("attraction"), third(3)("repulsion"), third(9)("friction"))


def accuracy(net: Analysis, clusters: tuple[int, ...], k: int, l: int = 0, mode: str = "scaled") -> DataFrame:  # noqa: E741
    """A row for each number of clusters: how far the loads under k changes and l failures, in shares of all demand, are from those
    without clusters (min, median, max, sum, mean), the bound that clusters give, and how many heaviest prefixes would be as good. The analysis
    without clusters runs once."""
    demand, _ = net.known()
    total = float(demand.agg(F.sum("demand")).first()[0] or 1.0)
    run = traffic.running_demand(demand)
    exact = checkpointed(net.analyze(k, l).select("src", "dst", "load"))
    out = None
    for n in clusters:
        some = net.with_cluster_number(n, mode).clustered()
        gaps = traffic.difference(exact, some.analyze(k, l), total)
        bound = some.bounds().first()["plus"]
        top = traffic.equivalent_top_k(demand, bound, run)
        row = gaps.crossJoin(top).select(F.lit(n).alias("clusters"), F.lit(k).alias("k"), *[F.col(c).alias(f"error_{c}") for c in gaps.columns], F.lit(bound / total).alias("bound"), F.col("k").alias("equivalent_top_k"))
        out = row if out is None else out.unionByName(row)
    return out


def accuracy_sweep(t: Tables) -> DataFrame:
    """A hundred route changes with 100 and 300 clusters against none; no SQL iterates k-means, tests compare with separate runs."""
    found = accuracy(network(t), (100, 300), 100)
    return found.select("clusters", "k", *[F.round(c, 6).alias(c) for c in found.columns if c.startswith(("error", "bound"))], "equivalent_top_k")


def accuracy_lines(t: Tables) -> DataFrame:
    """Lines of the accuracy tables: orders as measurements, statuses as clusters, the nations' regions as the widths that were asked for."""
    rows = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.routers, F.col("c_nationkey") == F.col("router_id"))
    price = F.col("o_totalprice") / 1e6
    widths = {"repulsion": F.col("region") + 1, "attraction": F.col("c_nationkey") / 10.0, "friction": price + 1}
    columns = [x.cast("double").alias(f"{name}_{kind}") for name, x in widths.items() for kind in ("measured", "sampled")]
    rows = rows.select("region", F.col("o_orderstatus").alias("status"), *columns, (price * 0.5).alias("clustering_error"), (price * price).alias("approx_error_max"), (price * 100 + 1).alias("efficiency_speedup"))
    found = reports.accuracy_lines(reports.accuracy_summary(rows, ["region", "status"]), F.col("region") % 3)
    return found.select("region", "status", "text", "latex", F.round("fraction", 6).alias("fraction"))


def sweep(net: Analysis, settings: list[dict]) -> DataFrame:
    """A row for each setting (clusters: none or a number, k: a number or "inf", l): the highest load, the sum of all links' highest loads, and
    the seconds that clusters and analysis took. Settings run one after the other, each of them on the whole cluster, as their seconds count.
    Settings without clusters share what is packed once; its seconds count for each of them."""
    rows, start = [], time.perf_counter()
    plain = [s["k"] for s in settings if not s.get("clusters")]
    packed = net.packed(max((int(k) for k in plain if k != "inf"), default=None)) if plain else None
    packing = time.perf_counter() - start
    for s in settings:
        start = time.perf_counter()
        some = net.with_cluster_number(s["clusters"]).clustered() if s.get("clusters") else net
        between = time.perf_counter()
        own, before = (None, 0.0) if s.get("clusters") else (packed, packing)
        found = some.analyze(None if s["k"] == "inf" else int(s["k"]), s["l"], packed=own).agg(F.max("load").alias("m"), F.sum("load").alias("s")).first()
        rows.append((s.get("clusters"), s["k"], s["l"], found["m"], found["s"], between - start, before + time.perf_counter() - between))
    return net.demand.sparkSession.createDataFrame(rows, "clusters int, k string, l int, highest double, sum double, clustering_time_sec double, analysis_time_sec double")


def running_time_sweep(t: Tables) -> DataFrame:
    """One change and no failure, and what is changed of it: ten changes, any number, one failure. Without the seconds, which no twin could give."""
    settings = sweeps.one_at_a_time({"k": "1", "l": 0}, {"k": ["10", "inf"], "l": [1]})
    return sweep(network(t), settings).select("k", "l", F.round(F.col("highest") + 1e-7, 3).alias("highest"), F.round(F.col("sum") + 1e-7, 2).alias("sum"))


QUERIES = (
    running_time_sweep,
    accuracy_lines,
    outside_sources, cluster_to_error, fitted_widths, parameter_search, accuracy_sweep,
    clustered_k10, clustered_causes_k1, limited_ingress_inf, limited_both_k1, te_installed_at, te_installed_k1, te_installed_l1_k1, causes_te_k1, te_clustered_inf, variability_worst_k1, dropped_demand_routers,
)
