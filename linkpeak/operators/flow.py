"""Shortest-path ECMP flows as a relation, and what follows from it by joins.

``unit_flow`` holds, for every failure scenario, root, source and link, the share of one unit of traffic from
the source to the root that crosses the link. Everything else about routing is DataFrame algebra over it.
Scenarios are dealt over the cluster; a task handles a scenario at a time with a few small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of a matrix for each root that are held at once.
ROOM = 1 << 24
UNIT_FLOW = "scenario_id long, root int, src int, edge_id int, frac double, cost long, `unique` boolean"


def undirected_links(links: DataFrame) -> DataFrame:
    """(link_id, edges): each pair of opposite links, or the single link that has no opposite; link_id is the smaller edge."""
    ends = links.select("edge_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return ends.groupBy("a", "b").agg(F.array_sort(F.collect_list("edge_id")).alias("edges")).select(F.element_at("edges", 1).alias("link_id"), "edges")


def failure_scenarios(links: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """(scenario_id, failed): every set of at most ``most`` links that fail together, the empty one first.

    Undirected failures take both directions of a link down. Ids number the sets by size, then by their links.
    """
    units = links.select(F.col("edge_id").alias("link_id"), F.array("edge_id").alias("edges")) if directed else undirected_links(links)
    spark = links.sparkSession
    none = spark.range(1).select(F.array().cast("array<int>").alias("ids"), F.array().cast("array<int>").alias("failed"))
    level, every = none, none
    for _ in range(most):
        # A larger set extends a smaller one by a link of a larger id.
        grown = level.join(units, (F.size("ids") == 0) | (F.try_element_at("ids", F.lit(-1)) < F.col("link_id")))
        level = grown.select(F.concat("ids", F.array("link_id")).alias("ids"), F.concat("failed", "edges").alias("failed"))
        every = every.union(level)
    # The id is the set in the number system of the links: ordered by size, then by links, without any global sort.
    base = (units.agg(F.max("link_id")).first()[0] or 0) + 2
    if base**most >= 1 << 63:
        raise ValueError(f"sets of {most} links with ids up to {base - 2} are too many to number")
    code = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a * base + x + 1)
    return every.select(code.alias("scenario_id"), "failed")


@dataclass(frozen=True)
class Graph:
    """The topology as arrays that travel with the tasks; roots are in order."""

    names: np.ndarray
    edge: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    root_at: np.ndarray

    @classmethod
    def of(cls, links: DataFrame, roots: DataFrame) -> Graph:
        graph = links.select("edge_id", "src", "dst", "weight").orderBy("edge_id").toPandas()
        if len(graph) and graph["weight"].min() < 1:
            raise ValueError("link weights must be 1 or more")
        ids = np.sort(roots.select("root").distinct().toPandas()["root"].to_numpy(dtype=np.int64))
        names = np.unique(np.concatenate([graph["src"], graph["dst"], ids]).astype(np.int64))
        return cls(names, graph["edge_id"].to_numpy(), np.searchsorted(names, graph["src"]), np.searchsorted(names, graph["dst"]), graph["weight"].to_numpy(dtype=np.float64), np.searchsorted(names, ids))

    def edges_at(self, failed) -> np.ndarray:
        return np.isin(self.edge, np.asarray(failed, dtype=np.int64)).nonzero()[0]

    def roots_at(self, egresses) -> np.ndarray:
        """Places among the roots of those egresses that are roots."""
        return np.nonzero(np.isin(self.names[self.root_at], np.asarray(egresses, dtype=np.int64)))[0]

    def _routes(self, failed: np.ndarray, roots: np.ndarray) -> Routes:
        """Towards some of the roots (places among nodes), from every node; by groups of roots, as each takes matrices of nodes by nodes."""
        step = max(1, ROOM // max(1, len(self.names) ** 2))
        parts = [self._some_routes(failed, roots[i : i + step]) for i in range(0, max(len(roots), 1), step)]
        return parts[0] if len(parts) == 1 else Routes(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _some_routes(self, failed: np.ndarray, roots: np.ndarray) -> Routes:
        src, dst, weight, n = self.src, self.dst, self.weight, len(self.names)
        alive = np.ones(len(src), dtype=bool)
        alive[failed] = False
        cost = np.full((len(roots), n), np.inf)
        cost[np.arange(len(roots)), roots] = 0
        by_src = np.argsort(src, kind="stable")
        by_src = by_src[alive[by_src]]
        first = np.nonzero(np.r_[True, src[by_src][1:] != src[by_src][:-1]])[0] if len(by_src) else by_src
        while len(by_src):
            nearer = cost.copy()
            step = np.minimum.reduceat(cost[:, dst[by_src]] + weight[by_src], first, axis=1)
            nearer[:, src[by_src][first]] = np.minimum(nearer[:, src[by_src][first]], step)
            if np.array_equal(nearer, cost):
                break
            cost = nearer
        near, far = cost[:, dst], cost[:, src]
        on = alive & np.isfinite(near) & np.isfinite(far) & (far == weight + near)
        degree = np.zeros((len(roots), n))
        r, e = np.nonzero(on)
        np.add.at(degree, (r, src[e]), 1)
        part = np.where(on, 1 / np.maximum(degree[:, src], 1), 0)
        hop, sole = np.zeros((2, len(roots), n, n))
        np.add.at(hop, (r, src[e], dst[e]), part[r, e])
        np.add.at(sole, (r, src[e], dst[e]), part[r, e] == 1)
        # Next hops never form a circle, so that the sum over walks of all lengths is an inverse.
        visits, alone = np.linalg.inv(np.eye(n) - hop), np.linalg.inv(np.eye(n) - sole)
        share = np.where(np.abs(visits) < 1e-14, 0, visits)[:, :, src] * part[:, None, :]
        lone = (alone[:, :, src] > 0.5) & (part == 1)[:, None, :]
        return Routes(share, cost, lone, on)

    @cached_property
    def whole(self) -> Routes:
        """Without any failure."""
        return self._routes(np.zeros(0, dtype=np.int64), self.root_at)

    def routes(self, failed: np.ndarray) -> Routes:
        """Under a failure: only roots that had a failed link on a shortest path are computed anew."""
        hit = self.whole.on[:, failed].any(axis=1)
        if not hit.any():
            return self.whole
        share, cost, lone, on = (x.copy() for x in self.whole)
        share[hit], cost[hit], lone[hit], on[hit] = self._routes(failed, self.root_at[hit])
        return Routes(share, cost, lone, on)


class Routes(NamedTuple):
    """Towards each root: shares (root, source, link), costs (root, source), whether a source reaches and passes a link
    by nodes of a single next hop (root, source, link), and the links on shortest paths (root, link)."""

    share: np.ndarray
    cost: np.ndarray
    lone: np.ndarray
    on: np.ndarray


def unit_flow(links: DataFrame, roots: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, root, src, edge_id, frac, cost, unique); a root's own row has no edge, frac 1 and cost 0.

    links: edge_id, src, dst, weight of 1 or more; roots: root; scenarios: scenario_id, failed. The topology
    (some thousand links) travels with the tasks; unreachable sources have no rows. ``unique`` says that the
    source reaches the link, and passes it, by nodes of a single next hop.
    """
    graph = Graph.of(links, roots)

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            for scenario, failed in zip(batch["scenario_id"], batch["failed"], strict=True):
                out, found = [], graph.routes(graph.edges_at(failed))
                for root, c, share, lone in zip(graph.root_at, found.cost, found.share, found.lone, strict=True):
                    s, e = np.nonzero(share)
                    name = graph.names[root]
                    out.append(pd.DataFrame({"root": name, "src": graph.names[s], "edge_id": pd.array(graph.edge[e], dtype="Int32"), "frac": share[s, e], "cost": c[s].astype(np.int64), "unique": lone[s, e]}))
                    out.append(pd.DataFrame({"root": [name], "src": [name], "edge_id": pd.array([None], dtype="Int32"), "frac": [1.0], "cost": [0], "unique": [True]}))
                if out:
                    yield pd.concat(out).assign(scenario_id=scenario)[["scenario_id", "root", "src", "edge_id", "frac", "cost", "unique"]]

    many = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scenarios.repartition(many, "scenario_id").mapInPandas(run, UNIT_FLOW)


def node_costs(flow: DataFrame) -> DataFrame:
    """(scenario_id, root, src, cost)"""
    return flow.select("scenario_id", "root", "src", "cost").distinct()


def chosen_egress(costs: DataFrame, states: DataFrame) -> DataFrame:
    """(scenario_id, egresses, src, root): the nearest of each distinct set of egresses, ties to the smaller router."""
    sets = states.select("egresses").distinct().select("egresses", F.explode("egresses").alias("root"))
    joined = costs.join(sets, "root")
    return joined.groupBy("scenario_id", "egresses", "src").agg(F.min(F.struct("cost", "root"))["root"].alias("root"))


def ecmp_dag(links: DataFrame, costs: DataFrame) -> DataFrame:
    """(scenario_id, root, node, next_node, edge_id): a link is on the DAG if it closes the difference of costs."""
    near, far = costs.withColumnsRenamed({"src": "dst", "cost": "next_cost"}), costs
    joined = far.join(links, "src").join(near, ["scenario_id", "root", "dst"]).where(F.col("cost") == F.col("weight") + F.col("next_cost"))
    return joined.select("scenario_id", "root", F.col("src").alias("node"), F.col("dst").alias("next_node"), "edge_id")


def merged_dag(links: DataFrame, costs: DataFrame, states: DataFrame) -> DataFrame:
    """(egresses, node, next_nodes): next hops towards all nearest egresses of a set at once, equal costs all kept."""
    dag = ecmp_dag(links, costs)
    sets = states.select("egresses").distinct().select("egresses", F.explode("egresses").alias("root"))
    nearest = costs.join(sets, "root").withColumn("_r", F.rank().over(Window.partitionBy("scenario_id", "egresses", "src").orderBy("cost"))).where("_r = 1")
    hops = nearest.select("scenario_id", "egresses", "root", F.col("src").alias("node")).join(dag, ["scenario_id", "root", "node"])
    return hops.groupBy("scenario_id", "egresses", "node").agg(F.array_sort(F.collect_set("next_node")).alias("next_nodes"))


def path_edges(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path_id, edges) from (path_id, routers): links along each path; paths with a missing link are dropped."""
    hops = paths.select("path_id", F.posexplode("routers").alias("at", "src"))
    pairs = hops.withColumn("dst", F.lead("src").over(Window.partitionBy("path_id").orderBy("at"))).where("dst IS NOT NULL")
    joined = pairs.join(links.select("src", "dst", "edge_id"), ["src", "dst"], "left")
    whole = joined.groupBy("path_id").agg(F.count("*").alias("n"), F.count("edge_id").alias("found"), F.array_sort(F.collect_list(F.struct("at", "edge_id"))).alias("e"))
    return whole.where("n = found").select("path_id", F.transform("e", lambda x: x["edge_id"]).alias("edges"))


def relaxed_costs(links: DataFrame, roots: DataFrame, most_hops: int) -> DataFrame:
    """(root, src, cost) by relaxation over DataFrames, without the kernel: a cross-check for small graphs."""
    costs = roots.select("root", F.col("root").alias("src"), F.lit(0).cast("long").alias("cost"))
    for _ in range(most_hops):
        step = costs.withColumnRenamed("src", "dst").join(links, "dst").select("root", "src", (F.col("cost") + F.col("weight")).alias("cost"))
        costs = costs.union(step).groupBy("root", "src").agg(F.min("cost").alias("cost"))
    return costs


def outside(demand: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(src): where demand enters at a router that the topology does not have."""
    routers = links.select("src").union(links.select("dst")).union(roots.select("root")).distinct()
    return demand.select("src").distinct().join(routers, "src", "left_anti")


def base_scenario(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("scenario_id"), F.array().cast("array<int>").alias("failed"))
