"""Current and worst-case link loads over failures and route changes.

All inputs are relations: demand (src, prefix, demand), states (prefix, egresses), kinds (prefix, kind), and
the unit flow of every failure scenario. The plans are joins and sums that Spark partitions by scenario, prefix
and link; argmax and ties are structs under max, never sorts of whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from linkpeak.functions.ranking import top_per_group
from linkpeak.operators.flow import chosen_egress, node_costs


def crossings(flow: DataFrame) -> DataFrame:
    """Rows of the unit flow that cross a link."""
    return flow.where("edge_id IS NOT NULL").select("scenario_id", "root", "src", "edge_id", "frac")


def routed(flow: DataFrame, states: DataFrame) -> DataFrame:
    """(scenario_id, egresses, src, edge_id, frac): the flow of each source to the egress it chooses."""
    return chosen_egress(node_costs(flow), states).join(crossings(flow), ["scenario_id", "root", "src"]).select("scenario_id", "egresses", "src", "edge_id", "frac")


def fixed_load(flow: DataFrame, demand: DataFrame, states: DataFrame) -> DataFrame:
    """(scenario_id, edge_id, load) in the current state. Prefixes of one state are summed up before flows are joined."""
    by_state = demand.join(states, "prefix").groupBy("egresses", "src").agg(F.sum("demand").alias("demand"))
    return by_state.join(routed(flow, states), ["egresses", "src"]).groupBy("scenario_id", "edge_id").agg(F.sum(F.col("demand") * F.col("frac")).alias("load"))


def prefix_load(flow: DataFrame, demand: DataFrame, states: DataFrame) -> DataFrame:
    """(scenario_id, prefix, edge_id, current) by prefix."""
    joined = demand.join(states, "prefix").join(routed(flow, states), ["egresses", "src"])
    return joined.groupBy("scenario_id", "prefix", "edge_id").agg(F.sum(F.col("demand") * F.col("frac")).alias("current"))


def _best(value: str, *order: Column) -> Column:
    return F.max(F.struct(F.col(value), *order))


def worst_egress(flow: DataFrame, demand: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(scenario_id, prefix, edge_id, worst, egress, ingress): the most a prefix can load a link through one egress.

    allowed (prefix, root) limits the egresses. Of equal loads the smallest egress is named. Without explicit
    paths no larger set of egresses loads a link more than its worst single one.
    """
    cells = demand if allowed is None else demand.join(allowed, "prefix").withColumnRenamed("root", "_root")
    joined = cells.join(crossings(flow), "src")
    if allowed is not None:
        joined = joined.where("root = _root")
    sums = joined.groupBy("scenario_id", "prefix", "root", "edge_id").agg(F.sum(F.col("demand") * F.col("frac")).alias("load"))
    best = sums.groupBy("scenario_id", "prefix", "edge_id").agg(_best("load", -F.col("root")).alias("b"))
    return best.select("scenario_id", "prefix", "edge_id", F.col("b.load").alias("worst"), (-F.col("b.col2")).alias("egress"), F.lit(None).cast("int").alias("ingress"))


def worst_ingress(flow: DataFrame, demand: DataFrame, states: DataFrame) -> DataFrame:
    """The same where all of a prefix's traffic may enter at one router; of equal loads the largest is named."""
    most = routed(flow, states).groupBy("scenario_id", "egresses", "edge_id").agg(_best("frac", F.col("src")).alias("b"))
    totals = demand.groupBy("prefix").agg(F.sum("demand").alias("total")).join(states, "prefix")
    joined = totals.join(most, "egresses")
    return joined.select("scenario_id", "prefix", "edge_id", (F.col("total") * F.col("b.frac")).alias("worst"), F.lit(None).cast("int").alias("egress"), F.col("b.src").alias("ingress"))


def worst_both(flow: DataFrame, demand: DataFrame) -> DataFrame:
    """The same where all traffic may enter at one router and leave at another."""
    most = crossings(flow).groupBy("scenario_id", "edge_id").agg(_best("frac", F.col("src"), -F.col("root")).alias("b"))
    totals = demand.groupBy("prefix").agg(F.sum("demand").alias("total"))
    # One row for each scenario and link on the right, as many as the topology has: the product is the result itself, all links of all prefixes.
    joined = totals.crossJoin(F.broadcast(most))
    return joined.select("scenario_id", "prefix", "edge_id", (F.col("total") * F.col("b.frac")).alias("worst"), (-F.col("b.col3")).alias("egress"), F.col("b.src").alias("ingress"))


def worst(flow: DataFrame, demand: DataFrame, states: DataFrame, kinds: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(scenario_id, prefix, edge_id, worst, egress, ingress), each prefix by the kind of its rule."""
    tagged = demand.join(kinds, "prefix")
    of = lambda kind: tagged.where(F.col("kind") == kind).select("src", "prefix", "demand")
    return worst_egress(flow, of("egress"), allowed).union(worst_ingress(flow, of("ingress"), states)).union(worst_both(flow, of("both")))


def changed_load(flow: DataFrame, demand: DataFrame, states: DataFrame, kinds: DataFrame, k: int | None, at_most: bool = False, allowed: DataFrame | None = None, te_paths: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """(scenario_id, edge_id, load) with k prefixes changed for the worst; None: as many as there are.

    Exactly k changes are made unless at_most, where changes that would lower the load are left out. With
    te_paths explicit paths count before and after a change; sets (prefix, egresses), from
    rules.candidate_sets_by_prefix(), are what their prefixes may change to.
    """
    if te_paths is None:
        most, now = worst(flow, demand, states, kinds, allowed), lambda: prefix_load(flow, demand, states)
    else:
        most, now = worst_with_paths(flow, demand, states, kinds, te_paths, sets, allowed), lambda: with_paths(flow, demand, states, te_paths).withColumnRenamed("load", "current").drop("egresses")
    if k is None:
        return most.groupBy("scenario_id", "edge_id").agg(F.sum("worst").alias("load"))
    current = fixed_load(flow, demand, states) if te_paths is None else now().groupBy("scenario_id", "edge_id").agg(F.sum("current").alias("load"))
    if k == 0:
        return current
    cells = most.select("scenario_id", "prefix", "edge_id", "worst").join(now(), ["scenario_id", "prefix", "edge_id"], "full")
    diff = F.round(F.coalesce("worst", F.lit(0.0)) - F.coalesce("current", F.lit(0.0)), 9)
    cells = cells.select("scenario_id", "edge_id", "prefix", (F.greatest(diff, F.lit(0.0)) if at_most else diff).alias("diff"))
    extra = top_per_group(cells, ["scenario_id", "edge_id"], [F.desc("diff"), F.col("prefix")], k).groupBy("scenario_id", "edge_id").agg(F.sum("diff").alias("extra"))
    joined = current.join(extra, ["scenario_id", "edge_id"], "full")
    return joined.select("scenario_id", "edge_id", (F.coalesce("load", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("load"))


def over_scenarios(loads: DataFrame, links: DataFrame, scenarios: DataFrame, named: bool = False) -> DataFrame:
    """(src, dst, load, failed): each link's highest load over all scenarios, with the first scenario that has it;
    where named, its number and the link's too (scenario_id, edge_id).

    A link that is never loaded has load 0 and no failures.
    """
    best = loads.where("load > 0").groupBy("edge_id").agg(F.max(F.struct(F.round("load", 9).alias("load"), -F.col("scenario_id"))).alias("b"))
    rows = links.join(best, "edge_id", "left").select("edge_id", "src", "dst", F.coalesce("b.load", F.lit(0.0)).alias("load"), (-F.col("b.col2")).alias("scenario_id"))
    return rows.join(scenarios, "scenario_id", "left").select(*(["scenario_id", "edge_id"] if named else []), "src", "dst", "load", "failed")


def by_change() -> WindowSpec:
    """The changes of a link in a scenario, the largest first."""
    return Window.partitionBy("scenario_id", "edge_id").orderBy(F.desc("_d"), "prefix")


def with_paths(flow: DataFrame, demand: DataFrame, states: DataFrame, te_paths: DataFrame) -> DataFrame:
    """(scenario_id, prefix, egresses, edge_id, load) where explicit paths override shortest ones.

    te_paths: prefix, ingress, egress, path_no, edges. A path holds where its ingress chooses its egress; the
    demand there is split over its paths and leaves the shortest-path flow. Paths are used whether or not
    their links have failed. states may hold several sets of egresses for a prefix.
    """
    chosen = chosen_egress(node_costs(flow), states)
    cells = demand.join(states.select("prefix", "egresses"), "prefix").join(chosen, ["egresses", "src"])
    many = te_paths.groupBy("prefix", F.col("ingress").alias("src"), F.col("egress").alias("root")).agg(F.count("*").alias("paths"), F.flatten(F.collect_list("edges")).alias("all_edges"))
    tied = cells.join(many, ["prefix", "src", "root"])
    on_paths = tied.select("scenario_id", "prefix", "egresses", F.explode("all_edges").alias("edge_id"), (F.col("demand") / F.col("paths")).alias("load"))
    rest = cells.join(many, ["prefix", "src", "root"], "left_anti").join(crossings(flow), ["scenario_id", "root", "src"])
    shortest = rest.select("scenario_id", "prefix", "egresses", "edge_id", (F.col("demand") * F.col("frac")).alias("load"))
    return on_paths.union(shortest).groupBy("scenario_id", "prefix", "egresses", "edge_id").agg(F.sum("load").alias("load"))


def worst_egress_with_paths(flow: DataFrame, demand: DataFrame, sets: DataFrame, te_paths: DataFrame) -> DataFrame:
    """(scenario_id, prefix, edge_id, worst, egresses) over candidate sets of egresses (from rules.candidate_sets(),
    or with a column prefix from rules.candidate_sets_by_prefix())."""
    prefixes = demand.select("prefix").distinct()
    if "prefix" in sets.columns:
        states = prefixes.join(sets, "prefix").select("prefix", "egresses")
    else:
        # Sets of border routers, as many as the topology has.
        states = prefixes.crossJoin(F.broadcast(sets)).select("prefix", "egresses")
    best = with_paths(flow, demand, states, te_paths).groupBy("scenario_id", "prefix", "edge_id").agg(F.max_by(F.struct("load", "egresses"), F.struct(F.round("load", 9), -F.size("egresses"))).alias("b"))
    return best.select("scenario_id", "prefix", "edge_id", F.col("b.load").alias("worst"), F.col("b.egresses").alias("egresses"))


def _unit_shares(flow: DataFrame, routes: DataFrame, te_paths: DataFrame) -> DataFrame:
    """(scenario_id, prefix, src, root, edge_id, frac): routes (scenario_id, prefix, src, root) by explicit paths where there are any."""
    keys = ["prefix", "src", "root"]
    many = te_paths.groupBy("prefix", F.col("ingress").alias("src"), F.col("egress").alias("root")).agg(F.count("*").alias("paths"), F.flatten(F.collect_list("edges")).alias("all_edges"))
    hops = many.select(*keys, "paths", F.explode("all_edges").alias("edge_id")).groupBy(*keys, "edge_id").agg((F.count("*") / F.first("paths")).alias("frac"))
    rest = routes.join(many, keys, "left_anti").join(crossings(flow), ["scenario_id", "root", "src"])
    columns = ["scenario_id", *keys, "edge_id", "frac"]
    return routes.join(hops, keys).select(*columns).union(rest.select(*columns))


def worst_with_paths(flow: DataFrame, demand: DataFrame, states: DataFrame, kinds: DataFrame, te_paths: DataFrame, sets: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(scenario_id, prefix, edge_id, worst): worst() where prefixes with explicit paths use them.

    These change to any of sets (prefix, egresses); where their ingress may change too, any source may have all
    traffic, and with it any single egress.
    """
    own = te_paths.select("prefix").distinct()
    tied = demand.join(own, "prefix", "left_semi").join(kinds, "prefix")
    of = lambda kind: tied.where(F.col("kind") == kind).select("src", "prefix", "demand")
    totals = lambda kind: of(kind).groupBy("prefix").agg(F.sum("demand").alias("total"))
    costs = node_costs(flow)
    columns = ["scenario_id", "prefix", "edge_id", "worst"]

    def largest(routes: DataFrame, kind: str) -> DataFrame:
        shares = _unit_shares(flow, routes, te_paths).groupBy("scenario_id", "prefix", "edge_id").agg(F.max("frac").alias("frac"))
        return shares.join(totals(kind), "prefix").select("scenario_id", "prefix", "edge_id", (F.col("total") * F.col("frac")).alias("worst"))

    as_now = totals("ingress").join(states, "prefix").join(chosen_egress(costs, states), "egresses").select("scenario_id", "prefix", "src", "root")
    # Pairs of routers in each scenario, as many as the topology has.
    any_way = totals("both").crossJoin(F.broadcast(costs.select("scenario_id", "src", "root"))).select("scenario_id", "prefix", "src", "root")
    plain = worst(flow, demand.join(own, "prefix", "left_anti"), states, kinds, allowed).select(*columns)
    by_egress = worst_egress_with_paths(flow, of("egress"), sets, te_paths).select(*columns)
    return plain.union(by_egress).union(largest(as_now, "ingress")).union(largest(any_way, "both"))


def heaviest_only(demand: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Demand of the n heaviest prefixes, and (dropped): the demand left out, which widens the positive bound."""
    sums = demand.groupBy("prefix").agg(F.sum("demand").alias("total"))
    kept = sums.orderBy(F.desc("total"), "prefix").limit(n)
    dropped = sums.join(kept, "prefix", "left_anti").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("dropped"))
    return demand.join(kept.select("prefix"), "prefix", "left_semi"), dropped


def inaccurate_variability(flow: DataFrame, loads: DataFrame, scenario: int = 0) -> DataFrame:
    """(n): loaded links that no source reaches by nodes of a single next hop."""
    sole = flow.where((F.col("scenario_id") == scenario) & F.col("unique") & F.col("edge_id").isNotNull()).select("edge_id").distinct()
    return loads.where("load > 0").join(sole, "edge_id", "left_anti").agg(F.count("*").alias("n"))


def add_variability(report: DataFrame, x: float) -> DataFrame:
    return report.withColumn("load", F.when(F.col("load") > 0, F.col("load") + x).otherwise(F.col("load")))


def overloaded(report: DataFrame, capacity: DataFrame) -> DataFrame:
    """(src, dst, capacity, load): links at or above their capacity; none means the network is satisfied."""
    joined = capacity.join(report.select("src", "dst", "load"), ["src", "dst"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    return joined.where("load >= capacity")
