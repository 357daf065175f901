"""Shortest-path trees over the ECMP relation, their paths and subtrees, and explicit paths drawn by weights."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkpeak.sources.generators import draw, spread, uniform


def tree(dag: DataFrame) -> DataFrame:
    """(scenario_id, root, node, next_node, edge_id): one next hop for each node, the smallest of equal ones."""
    return dag.groupBy("scenario_id", "root", "node").agg(F.min(F.struct("next_node", "edge_id")).alias("h")).select("scenario_id", "root", "node", "h.next_node", "h.edge_id")


def paths(hops: DataFrame, most_hops: int) -> DataFrame:
    """(scenario_id, root, node, routers): the routers from each node to the root, both included.

    Paths double in length with each join, so that log2(most_hops) joins do. hops is a tree.
    """
    step = hops.select("scenario_id", "root", "node", F.array("node").alias("routers"), F.col("next_node").alias("at"))
    length = 1
    while length < most_hops:
        further = step.select("scenario_id", "root", F.col("node").alias("at"), F.col("routers").alias("_more"), F.col("at").alias("_to"))
        joined = step.join(further, ["scenario_id", "root", "at"], "left")
        step = joined.select("scenario_id", "root", "node", F.concat("routers", F.coalesce("_more", F.array().cast("array<int>"))).alias("routers"), F.coalesce("_to", "at").alias("at"))
        length *= 2
    return step.where("at = root").select("scenario_id", "root", "node", F.concat("routers", F.array(F.col("root"))).alias("routers"))


def node_at(routes: DataFrame, distance: int) -> DataFrame:
    """(scenario_id, root, node, at): the router so many hops on the way to the root; null where the path is shorter."""
    return routes.select("scenario_id", "root", "node", F.get("routers", F.lit(distance)).alias("at"))


def subpath(routes: DataFrame, first: int, last: int) -> DataFrame:
    """(scenario_id, root, node, routers): the part of each path from one router to another; only paths that pass both in
    this order."""
    a, b = F.array_position("routers", first), F.array_position("routers", last)
    return routes.where((a > 0) & (b >= a)).select("scenario_id", "root", "node", F.slice("routers", a.cast("int"), (b - a + 1).cast("int")).alias("routers"))


def from_sources(links: DataFrame) -> DataFrame:
    """links turned round: trees towards roots of these are trees from sources of those."""
    return links.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def subtree(routes: DataFrame, through: int) -> DataFrame:
    """(scenario_id, root, node): nodes whose path passes a router, itself included."""
    return routes.where(F.array_contains("routers", through)).select("scenario_id", "root", "node")


def _cheapest(links: pd.DataFrame, weights: list[int], start: int, goal: int) -> list[int] | None:
    out: dict[int, list[tuple[int, int, int]]] = {}
    for edge, a, b, w in zip(links["edge_id"], links["src"], links["dst"], weights, strict=True):
        out.setdefault(a, []).append((w, b, edge))
    queue, seen = [(0, start, [])], set()
    while queue:
        cost, node, edges = heapq.heappop(queue)
        if node == goal:
            return edges
        if node not in seen:
            seen.add(node)
            for w, b, e in out.get(node, ()):
                heapq.heappush(queue, (cost + w, b, [*edges, e]))
    return None


def drawn_weight(seed: int, low: int, high: int, *keys: Column | str) -> Column:
    return low + F.pmod(draw(seed, *keys), F.lit(high - low + 1))


def drawn_paths(wanted: DataFrame, links: DataFrame, seed: int, low: int = 1, high: int = 10) -> DataFrame:
    """(prefix, ingress, egress, path_no, edges): for each row of wanted the cheapest path under link weights
    drawn for that row alone. Rows without any path are dropped. wanted: prefix, ingress, egress, path_no."""
    graph = links.select("edge_id", "src", "dst").orderBy("edge_id").toPandas()
    ids = F.array(*[F.lit(int(e)) for e in graph["edge_id"]])
    weights = F.transform(ids, lambda e: drawn_weight(seed, low, high, "prefix", "ingress", "egress", "path_no", e))

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            found = [_cheapest(graph, list(w), a, b) for w, a, b in zip(batch["_w"], batch["ingress"], batch["egress"], strict=True)]
            out = batch.drop(columns="_w").assign(edges=found)
            yield out[[f is not None for f in found]]

    return wanted.select("prefix", "ingress", "egress", "path_no", weights.alias("_w")).mapInPandas(run, "prefix long, ingress int, egress int, path_no int, edges array<int>")


def wanted_paths(prefixes: DataFrame, sources: DataFrame, egresses: DataFrame, count: int, seed: int, by: str | None = None, in_turn: bool = False) -> DataFrame:
    """(prefix, ingress, egress, path_no): the ends of count explicit paths a prefix, drawn for each path.

    Egresses are drawn alike, or, in_turn, come round in an order drawn for the prefix. Ingresses, other than the
    egress, are drawn alike or by the column ``by`` of sources (weighted, by the least of -ln(u) / weight).
    """
    # Sources and egresses are routers, a small fixed list; each path orders them by its own draws.
    few = F.broadcast(sources.agg(F.array_sort(F.collect_list(F.struct("src", *([F.col(by).alias("by")] if by else [])))).alias("_s")))
    out = F.broadcast(egresses.agg(F.array_sort(F.collect_list("root")).alias("_e")))
    drawn = lambda *path: F.transform("_e", lambda e: F.struct(draw(seed + 1, *path, e).alias("h"), e.alias("e")))
    rows = spread(prefixes.select("prefix"), "prefix").crossJoin(few).crossJoin(out)
    # The order of a prefix's egresses is the same for all of its paths.
    rows = rows.withColumn("_o", F.array_sort(drawn(F.col("prefix")))) if in_turn else rows
    cells = rows.withColumn("path_no", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    egress = F.get("_o", F.col("path_no") % F.size("_e"))["e"] if in_turn else F.array_min(drawn(F.col("prefix"), F.col("path_no")))["e"]
    key = lambda s: draw(seed, "prefix", "path_no", s["src"]) if by is None else -F.ln(uniform(seed, "prefix", "path_no", s["src"])) / s["by"]
    others = lambda e: F.filter("_s", lambda s: s["src"] != e)
    ingress = lambda e: F.array_min(F.transform(others(e), lambda s: F.struct(key(s).alias("h"), s["src"].alias("src"))))["src"]
    # One list for each path, of one pair or none: egress and ingress are found once, and a filter above does not find them again.
    ends = F.filter(F.transform(F.array(egress), lambda e: F.struct(ingress(e).alias("ingress"), e.alias("egress"))), lambda c: c["ingress"].isNotNull())
    return cells.select("prefix", "path_no", F.explode(ends).alias("c")).select("prefix", "c.ingress", "c.egress", "path_no")
