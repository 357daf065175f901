"""Worst-case link loads by blocks of prefixes: the main path of an analysis.

The plans of loads.py hold a row for each scenario, prefix and link, and on their way one for each source and root as
well. That is far more than the result, so here a task takes blocks of prefixes (matrices of demand by source) and
failure scenarios, and gives out, for each scenario, the sums of current loads and the largest changes of
its blocks. Spark deals pairs of blocks and chunks of scenarios over the cluster; a second pass by scenario merges what tasks gave out.
Results are those of loads.py, which stays as the relational form that tests compare with.

A scenario's routes are computed once for all blocks that a task holds of its chunk, and so is where the traffic of a set of
egresses goes. Demand is copied only as often as there are chunks: one, where the blocks alone keep the cluster busy.

A row of a block is a prefix or a cluster of prefixes. A cluster routes as one, but its members change one by one: each has a
share of the cluster's load and of its change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkpeak.functions.ranking import top_per_group
from linkpeak.operators.flow import Graph, Routes
from linkpeak.sources.tables import checkpointed

#: Prefixes of a block; numbers of the blocks that a task holds at once; most scenarios of a chunk; rows by links that are ranked at once.
BLOCK, HELD, CHUNK, RANKED = 1024, 1 << 23, 4096, 1 << 20
#: From so many scenarios on, and more pairs of scenario and link than so many a link, bounds tell first which of them can hold a link's worst load.
BOUNDED, FEW = 64, 4
#: Rows of a block that change alike, from which on ways that others exceed are left out.
LEAST = 32
#: The local preference of egresses that have no other.
PREFERENCE = 100


@dataclass(frozen=True)
class Rule:
    """What may change about a prefix: its "egress", its "ingress" or "both". egresses: the border routers that it may change to, with
    the local preferences that their routes may have; ingresses: where its traffic may enter. None: any router."""

    kind: str = "egress"
    egresses: dict[int, frozenset[int]] | None = None
    ingresses: frozenset[int] | None = None


#: Rules by the kinds of a relation (prefix, kind).
KINDS = ("egress", "ingress", "both")
PLAIN = {i: Rule(kind) for i, kind in enumerate(KINDS)}

_PACKED = "prefixes binary, mat binary, groups array<struct<egresses:array<int>,rule:int,te:string,n:int>>, counts binary, names binary, shares binary"


def settings_of(states: DataFrame, kinds: DataFrame) -> DataFrame:
    """(prefix, egresses, rule, te) for prefixes that differ by kind only; the rules are PLAIN."""
    rule = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    return states.join(kinds, "prefix").select("prefix", "egresses", rule.alias("rule"), F.lit(None).cast("string").alias("te"))


def te_text(paths: DataFrame) -> DataFrame:
    """(prefix, te): the explicit paths of each prefix as a text, equal for equal paths: "ingress,egress,paths,edges" by ";"."""
    ends = paths.groupBy("prefix", "ingress", "egress").agg(F.count("*").alias("n"), F.array_sort(F.flatten(F.collect_list("edges"))).alias("e"))
    one = F.concat_ws(",", "ingress", "egress", "n", F.array_join(F.col("e").cast("array<string>"), " "))
    return ends.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("te"))


def cells_of(demand: DataFrame) -> DataFrame:
    """(prefix, cells: src and demand), a row a prefix, of demand (src, prefix, demand)."""
    return demand.groupBy("prefix").agg(F.collect_list(F.struct("src", "demand")).alias("cells"))


def demand_of(cells: DataFrame) -> DataFrame:
    """(src, prefix, demand): the opposite of cells_of()."""
    return cells.select("prefix", F.inline("cells")).select("src", "prefix", "demand")


_BLOCKS = pa.schema([
    ("prefixes", pa.binary()), ("mat", pa.binary()), ("groups", pa.list_(pa.struct([("egresses", pa.list_(pa.int32())), ("rule", pa.int32()), ("te", pa.string()), ("n", pa.int32())]))),
    ("counts", pa.binary()), ("names", pa.binary()), ("shares", pa.binary()),
])


def _packed(names: np.ndarray):
    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            for start in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(start, BLOCK))

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, prefixes = rows.num_rows, rows["prefix"].to_numpy()
        at = np.repeat(np.arange(n), pc.list_value_length(rows["srcs"]).to_numpy(zero_copy_only=False))
        places = np.searchsorted(names, rows["srcs"].flatten().to_numpy(zero_copy_only=False))
        mat = np.bincount(at * len(names) + places, weights=rows["amounts"].flatten().to_numpy(zero_copy_only=False), minlength=n * len(names))
        setting = list(zip(map(tuple, rows["egresses"].to_pylist()), rows["rule"].to_pylist(), (te or "" for te in rows["te"].to_pylist()), strict=True))
        groups = [{"egresses": list(key[0]), "rule": key[1], "te": key[2], "n": sum(1 for _ in same)} for key, same in groupby(setting)]
        counts, listed, shares = np.ones(n, dtype=np.int64), prefixes.astype(np.int64), np.ones(n)
        if "members" in rows.schema.names and rows["members"].null_count < n:
            members, parts = rows["members"].to_pylist(), rows["parts"].to_pylist()
            counts = np.array([1 if m is None else len(m) for m in members], dtype=np.int64)
            listed = np.array([x for p, m in zip(prefixes.tolist(), members, strict=True) for x in ([p] if m is None else m)], dtype=np.int64)
            shares = np.array([x for own in parts for x in ([1.0] if own is None else own)], dtype=np.float64)
        columns = {"prefixes": prefixes.astype(np.int64).tobytes(), "mat": mat.astype(np.float64).tobytes(), "groups": groups, "counts": counts.tobytes(), "names": listed.tobytes(), "shares": shares.tobytes()}
        return pa.RecordBatch.from_pylist([columns], schema=_BLOCKS)

    return run


@dataclass
class Packed:
    """Demand by blocks, with the topology and the rules that it is meant for; packed once for several calls."""

    graph: Graph
    rules: dict[int, Rule]
    blocks: DataFrame
    many: int = field(default=0)

    @classmethod
    def of(cls, links: DataFrame, roots: DataFrame, demand: DataFrame, settings: DataFrame, rules: dict[int, Rule] | None = None, members: DataFrame | None = None) -> Packed:
        """demand (src, prefix, demand) or, of cells_of(), (prefix, cells); settings (prefix, egresses, rule, te); members (prefix,
        members: prefix and share) of clusters. Rules are few; they travel with the tasks like the topology."""
        # Cells are long rows, so that they are not sorted for the join.
        cells = (demand if "cells" in demand.columns else cells_of(demand)).join(settings.hint("shuffle_hash"), "prefix")
        cells = cells if members is None else cells.join(members, "prefix", "left")
        return cls._of_cells(Graph.of(links, roots), rules or PLAIN, cells)

    @classmethod
    def _of_cells(cls, graph: Graph, rules: dict[int, Rule], cells: DataFrame) -> Packed:
        # Lists of nothing but nulls cost more on their way to Python than the cells do.
        own = [F.col("members.prefix").alias("members"), F.col("members.share").alias("parts")] if "members" in cells.columns else []
        rows = cells.select(F.col("prefix").cast("long").alias("prefix"), F.col("cells.src").cast("array<long>").alias("srcs"), F.col("cells.demand").cast("array<double>").alias("amounts"), "egresses", "rule", "te", *own)
        # Rows of one setting stand together, so that a block has few settings and they are routed in few products.
        packed = checkpointed(rows.sortWithinPartitions("egresses", "rule", "te").mapInArrow(_packed(graph.names), _PACKED).withColumn("block", F.monotonically_increasing_id()))
        return cls(graph, rules, packed, max(packed.count(), 1))

    def settled(self) -> Packed:
        """The same with one row for all prefixes of the same egresses and explicit paths, which is all that current loads depend on."""
        names = self.graph.names

        def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in part:
                sums: dict = {}
                for row in batch.itertuples(index=False):
                    block = Block(row)
                    for rows, egresses, _, te in block.groups:
                        own = sums.setdefault((egresses, te), np.zeros(len(names)))
                        own += block.mat[rows].sum(axis=0)
                if sums:
                    cells = [[{"src": int(names[i]), "demand": float(own[i])} for i in np.flatnonzero(own)] for own in sums.values()]
                    yield pd.DataFrame({"egresses": [list(e) for e, _ in sums], "te": [te for _, te in sums], "cells": cells})

        found = self.blocks.mapInPandas(run, "egresses array<int>, te string, cells array<struct<src:bigint,demand:double>>").select("egresses", "te", F.inline("cells"))
        cells = found.groupBy("egresses", "te", "src").agg(F.sum("demand").alias("demand")).groupBy("egresses", "te").agg(F.collect_list(F.struct("src", "demand")).alias("cells"))
        return Packed._of_cells(self.graph, self.rules, cells.select(F.monotonically_increasing_id().alias("prefix"), "cells", "egresses", F.lit(min(self.rules)).alias("rule"), "te"))

    def reach(self, k: int) -> float:
        """The most that k changes can add to the load of a link, or take from it, under any failures."""
        graph, rules = self.graph, self.rules

        def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ways, tops = Ways(graph, rules), np.zeros(0)
            for batch in part:
                for row in batch.itertuples(index=False):
                    block = Block(row)
                    most = block.total.copy()
                    for rows, _, _, te in block.groups:
                        # A path that uses a link twice loads it twice.
                        most[rows] *= max([1.0, *(links.max(initial=0.0) for _, _, links in ways.paths(te))])
                    tops = _top(np.concatenate([tops, most[block.owner] * block.shares])[:, None], k)[:, 0]
            yield pd.DataFrame({"amount": tops})

        return self.blocks.mapInPandas(run, "amount double").orderBy(F.desc("amount")).limit(k).agg(F.sum("amount")).first()[0] or 0.0

    def beside(self, scenarios: DataFrame) -> DataFrame:
        """Blocks beside chunks of scenarios (scenario_id, failed and, if only some links are asked for, edges)."""
        spark = self.blocks.sparkSession
        many = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n_scenarios = scenarios.count()
        chunks = min(max(-(-n_scenarios // CHUNK), -(-2 * many // self.many)), max(n_scenarios, 1))
        lists = scenarios.groupBy(F.pmod(F.xxhash64("scenario_id"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct(*scenarios.columns)).alias("scenarios"))
        # Scenarios are short lists, so chunks go to the blocks and not the other way round.
        homes = self.blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return homes.repartition(many, "block", "chunk").sortWithinPartitions("chunk").join(F.broadcast(lists), "chunk")


class Ways:
    """Rules, sets of egresses and explicit paths in terms of the graph's arrays; the same under all failures."""

    def __init__(self, graph: Graph, rules: dict[int, Rule]):
        self.graph, self.rules = graph, rules
        self._roots: dict = {}
        self._te: dict = {}
        self._sets: dict = {}

    def roots(self, egresses: tuple[int, ...] | None) -> np.ndarray:
        if egresses not in self._roots:
            self._roots[egresses] = np.arange(len(self.graph.root_at)) if egresses is None else self.graph.roots_at(egresses)
        return self._roots[egresses]

    def allowed(self, rule: int) -> tuple[int, ...] | None:
        own = self.rules[rule].egresses
        return None if own is None else tuple(sorted(own))

    def sources(self, rule: int) -> np.ndarray:
        own, names = self.rules[rule].ingresses, self.graph.names
        return np.arange(len(names)) if own is None else np.nonzero(np.isin(names, np.array(sorted(own), dtype=np.int64)))[0]

    def paths(self, te: str) -> list[tuple[int, int, np.ndarray]]:
        """(source, root, share of each link) of explicit paths, as places in the graph."""
        if te not in self._te:
            found, names = [], self.graph.names
            for entry in filter(None, te.split(";")):
                ingress, egress, n, edges = entry.split(",")
                s, r = np.flatnonzero(names == int(ingress)), self.graph.roots_at([int(egress)])
                used = np.array(edges.split(), dtype=np.int64)
                places = np.searchsorted(self.graph.edge, used)
                places = places[self.graph.edge[np.minimum(places, len(self.graph.edge) - 1)] == used]
                if len(s) and len(r):
                    found.append((int(s[0]), int(r[0]), np.bincount(places, minlength=len(self.graph.edge)) / int(n)))
            self._te[te] = found
        return self._te[te]

    def candidates(self, te: str, rule: int) -> list[tuple[int, ...]]:
        """Sets of egresses that a prefix with explicit paths may change to: those with paths, as far as one preference suits all,
        alone or with one other egress; small ones first. Their number is exponential in the egresses that one prefix has paths to."""
        key = (te, rule)
        if key not in self._sets:
            routers = self.graph.names[self.graph.root_at].tolist()
            prefs = self.rules[rule].egresses or {r: frozenset([PREFERENCE]) for r in routers}
            prefs = {r: prefs[r] for r in routers if prefs.get(r)}
            tied = sorted({int(entry.split(",")[1]) for entry in filter(None, te.split(";"))} & set(prefs))
            sets = set()
            for size in range(len(tied) + 1):
                for some in combinations(tied, size):
                    shared = frozenset.intersection(*(prefs[r] for r in some)) if some else None
                    if shared is not None and not shared:
                        continue
                    if some:
                        sets.add(some)
                    sets |= {tuple(sorted((*some, r))) for r in prefs if r not in tied and (shared is None or shared & prefs[r])}
            self._sets[key] = sorted(sets, key=lambda s: (len(s), s))
        return self._sets[key]


class Scene:
    """A scenario's routes as far as some links go (all by default), and what follows from them for sets and rules."""

    def __init__(self, ways: Ways, routes: Routes, at: np.ndarray | None = None):
        self.ways, self.cost, self.at = ways, routes.cost, at
        self.share = routes.share if at is None else routes.share[:, :, at]
        self._routed: dict = {}
        self._most: dict = {}

    @property
    def width(self) -> int:
        return self.share.shape[2]

    def _part(self, links: np.ndarray) -> np.ndarray:
        return links if self.at is None else links[self.at]

    def near(self, egresses: tuple[int, ...]) -> np.ndarray:
        """The nearest root of each source; roots are in order, so the first of equal costs is the smallest router."""
        at = self.ways.roots(egresses)
        return at[np.argmin(self.cost[at], axis=0)]

    def routed(self, egresses: tuple[int, ...], te: str) -> np.ndarray:
        """The share of each source's traffic on each link; an explicit path holds where its ingress chooses its egress."""
        if egresses not in self._routed:
            if not len(self.ways.roots(egresses)):
                return np.zeros(self.share.shape[1:])
            near = self.near(egresses)
            self._routed[egresses] = near, self.share[near, np.arange(len(near))]
        near, out = self._routed[egresses]
        # Only routes without paths are kept: sets by paths are far more than sets, and paths change few rows.
        changed = [(s, links) for s, r, links in (self.ways.paths(te) if te else ()) if near[s] == r and np.isfinite(self.cost[r, s])]
        if changed:
            out = out.copy()
            for s, links in changed:
                out[s] = self._part(links)
        return out

    def both(self, rule: int, te: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest share over ingresses and egresses of a rule, and the places of both: of equal shares the largest source, then the smallest egress."""
        key = (rule, te)
        if key not in self._most:
            roots, sources = self.ways.roots(self.ways.allowed(rule)), self.ways.sources(rule)
            if not len(roots) or not len(sources):
                return np.zeros(self.width), np.full(self.width, -1), np.full(self.width, -1)
            share = self.share[np.ix_(roots, sources)]
            for s, r, links in self.ways.paths(te) if te else ():
                i, j = np.flatnonzero(roots == r), np.flatnonzero(sources == s)
                if len(i) and len(j) and np.isfinite(self.cost[r, s]):
                    share[i[0], j[0]] = self._part(links)
            by_source = share.max(axis=0)
            s = by_source.shape[0] - 1 - by_source[::-1].argmax(axis=0)
            self._most[key] = share.max(axis=(0, 1)), sources[s], roots[share[:, s, np.arange(self.width)].argmax(axis=0)]
        return self._most[key]

    def leading(self, rule: int, te: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """The shares of what a prefix may change to, for largest loads: of each link only ways that no other way exceeds or
        equals for all sources. Places of the links, those with most ways first; then shares (source, link): the first way of all
        links that have one, the second one of those that have two, and so on."""
        key = (rule, te, "leading")
        if key not in self._most:
            front = np.zeros((0, *self.share.shape[1:]))
            roots = self.ways.roots(self.ways.allowed(rule))
            ways = (self.routed(s, te) for s in self.ways.candidates(te, rule)) if te else iter(self.share[roots])
            kept = np.zeros((0, self.width), dtype=bool)
            # By pieces, as sets of egresses may be very many.
            while some := list(islice(ways, 64)):
                front = np.concatenate([front, np.array(some)])
                kept = np.concatenate([kept, front[len(kept) :].any(axis=1)])
                for i in range(len(front)):
                    over = (front[i] <= front).all(axis=1) & kept
                    over[i] = False
                    kept[i] &= ~over.any(axis=0)
                used = kept.any(axis=1)
                front, kept = front[used], kept[used]
            many = kept.sum(axis=0)
            order = np.argsort(-many, kind="stable")
            # The ways of each link, those that are kept first.
            first = np.argsort(~kept, axis=0, kind="stable")
            parts = []
            for i in range(many.max(initial=0)):
                links = order[: np.count_nonzero(many > i)]
                parts.append(np.ascontiguousarray(front[first[i, links], :, links].T))
            self._most[key] = order, parts
        return self._most[key]

    def any_root(self, rule: int) -> np.ndarray:
        """The largest share of each source over the egresses of a rule."""
        key = (rule, None)
        if key not in self._most:
            roots = self.ways.roots(self.ways.allowed(rule))
            self._most[key] = self.share[roots].max(axis=0) if len(roots) else np.zeros(self.share.shape[1:])
        return self._most[key]


class Block:
    """Some prefixes with their demand by source; rows with the same current egresses, rule and explicit paths stand together."""

    def __init__(self, row):
        self.prefixes = np.frombuffer(row.prefixes, dtype=np.int64)
        self.mat = np.frombuffer(row.mat).reshape(len(self.prefixes), -1)
        self.total = self.mat.sum(axis=1)
        self.counts, self.names, self.shares = np.frombuffer(row.counts, dtype=np.int64), np.frombuffer(row.names, dtype=np.int64), np.frombuffer(row.shares)
        self.owner = np.repeat(np.arange(len(self.prefixes)), self.counts)
        self.alone = len(self.owner) == len(self.prefixes) and bool((self.shares == 1).all())
        self.groups, start = [], 0
        leaving: dict = {}
        for g in row.groups:
            rows = slice(start, start + g["n"])
            start += g["n"]
            te = g["te"] or ""
            self.groups.append((rows, tuple(g["egresses"]), g["rule"], te))
            leaving.setdefault((g["rule"], te), []).append(np.arange(rows.start, rows.stop))
        self.leaving = {key: np.concatenate(parts) for key, parts in leaving.items()}

    def evaluated(self, scene: Scene, witness: bool = False, loose: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Current and worst loads (prefix by link), and where asked for what causes the worst ones: the number of the set of
        egresses (for prefixes with explicit paths, of Ways.candidates(); else of the root), and of the source, -1 for none. loose: for
        prefixes that change their egress no more than bounds of the worst loads, at a fraction of the cost."""
        shape = (len(self.mat), scene.width)
        current, most = np.zeros(shape), np.zeros(shape)
        egress, ingress = (np.full(shape, -1), np.full(shape, -1)) if witness else (None, None)
        for rows, egresses, rule, te in self.groups:
            routed = scene.routed(egresses, te)
            current[rows] = self.mat[rows] @ routed
            kind = scene.ways.rules[rule].kind
            if kind == "ingress":
                sources = scene.ways.sources(rule)
                if len(sources):
                    part = routed[sources]
                    most[rows] = self.total[rows, None] * part.max(axis=0)
                    if witness:
                        # Of equal shares the largest source.
                        ingress[rows] = sources[len(sources) - 1 - part[::-1].argmax(axis=0)]
            elif kind == "both":
                share, s, r = scene.both(rule, te)
                most[rows] = self.total[rows, None] * share
                if witness:
                    ingress[rows], egress[rows] = s, r
        for (rule, te), rows in self.leaving.items():
            if scene.ways.rules[rule].kind != "egress":
                continue
            demand = self.mat[rows]
            if loose and not te:
                most[rows] = demand @ scene.any_root(rule)
                continue
            best = np.zeros((len(rows), scene.width))
            # For a few rows the ways themselves cost less than to compare them.
            if not witness and len(rows) > LEAST:
                order, parts = scene.leading(rule, te)
                for way in parts:
                    first = best[:, : way.shape[1]]
                    np.maximum(first, demand @ way, out=first)
                most[rows] = best[:, np.argsort(order)]
                continue
            of = np.full((len(rows), scene.width), -1)
            roots = scene.ways.roots(scene.ways.allowed(rule))
            ways = ((r, scene.share[r]) for r in roots) if not te else ((i, scene.routed(s, te)) for i, s in enumerate(scene.ways.candidates(te, rule)))
            for number, way in ways:
                loads = demand @ way
                if witness:
                    of = np.where(np.round(loads - best, 9) > 0, number, of)
                np.maximum(best, loads, out=best)
            most[rows] = best
            if witness:
                egress[rows] = of
        return current, most, egress, ingress

    def now(self, scene: Scene) -> np.ndarray:
        """The sums of current loads."""
        sums = np.zeros(scene.width)
        for rows, egresses, _, te in self.groups:
            sums += self.mat[rows].sum(axis=0) @ scene.routed(egresses, te)
        return sums

    def changes(self, diff: np.ndarray, k: int) -> np.ndarray:
        """The k largest changes of each link (up to k by link), of members one by one."""
        tops = np.zeros((0, diff.shape[1]))
        step = max(k, RANKED // max(1, diff.shape[1]))
        for start in range(0, len(self.owner), step):
            some = slice(start, start + step)
            part = diff[some] if self.alone else diff[self.owner[some]] * self.shares[some, None]
            tops = _top(np.concatenate([tops, part]), k)
        return tops


def _top(tops: np.ndarray, k: int) -> np.ndarray:
    return tops if len(tops) <= k else np.partition(tops, len(tops) - k, axis=0)[len(tops) - k :]


def _held(part: Iterator[pd.DataFrame], packed_graph: Graph, rules: dict[int, Rule]) -> Iterator[tuple[dict, Scene, list[Block]]]:
    """(scenario, scene, blocks): blocks of a chunk, up to HELD numbers at once, for each of its scenarios."""
    ways = Ways(packed_graph, rules)
    held = max(1, HELD // (BLOCK * max(1, len(packed_graph.names))))
    rows = (row for batch in part for row in batch.itertuples(index=False))
    for _, of_chunk in groupby(rows, key=lambda row: row.chunk):
        while some := list(islice(of_chunk, held)):
            blocks = [Block(row) for row in some]
            for scenario in some[0].scenarios:
                edges = scenario["edges"] if "edges" in scenario else None
                at = None if edges is None else packed_graph.edges_at(edges)
                yield scenario, Scene(ways, packed_graph.routes(packed_graph.edges_at(scenario["failed"])), at), blocks


_SUMS = "scenario_id long, at binary, current binary, tops binary"


def partials(packed: Packed, scenarios: DataFrame, k: int | None, at_most: bool = False, loose: bool = False) -> DataFrame:
    """A row for each scenario and group of blocks that a task held together: places of links, sums of current loads (for k
    None: of the worst ones), and the k largest changes, for merged()."""
    graph, rules = packed.graph, packed.rules

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scenario, scene, blocks in _held(part, graph, rules):
            sums, tops = np.zeros(scene.width), np.zeros((0, scene.width))
            for block in blocks:
                if k == 0:
                    sums += block.now(scene)
                    continue
                current, most, *_ = block.evaluated(scene, loose=loose and k is not None)
                sums += (most if k is None else current).sum(axis=0)
                if k:
                    diff = np.round(most - current, 9)
                    tops = _top(np.concatenate([tops, block.changes(np.maximum(diff, 0) if at_most else diff, k)]), k)
            at = np.arange(scene.width) if scene.at is None else scene.at
            yield pd.DataFrame({"scenario_id": [scenario["scenario_id"]], "at": [at.astype(np.int32).tobytes()], "current": [sums.tobytes()], "tops": [tops.tobytes()]})

    return packed.beside(scenarios).mapInPandas(run, _SUMS)


def merged(found: DataFrame, graph: Graph, k: int | None, best: bool = False) -> DataFrame:
    """(scenario_id, edge_id, load) from partials(). best: of the scenarios that a task merges only the first one of
    those with a link's highest load."""

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, of = np.zeros(len(graph.edge)), np.full(len(graph.edge), -1, dtype=np.int64)
        rows = (row for batch in part for row in batch.itertuples(index=False))
        for scenario, same in groupby(rows, key=lambda row: row.scenario_id):
            sums, tops = None, None
            for row in same:
                at, current = np.frombuffer(row.at, dtype=np.int32), np.frombuffer(row.current)
                more = np.frombuffer(row.tops).reshape(-1, len(at))
                sums = current.copy() if sums is None else sums + current
                tops = more if tops is None else np.concatenate([tops, more])
                if k:
                    tops = _top(tops, k)
            load = np.round(sums + (tops.sum(axis=0) if k else 0.0), 9)
            if not best:
                yield pd.DataFrame({"scenario_id": scenario, "edge_id": graph.edge[at], "load": load})
                continue
            more = (load > high[at]) | ((load == high[at]) & (load > 0) & (scenario < of[at]))
            high[at[more]], of[at[more]] = load[more], scenario
        if best and (of >= 0).any():
            yield pd.DataFrame({"scenario_id": of[of >= 0], "edge_id": graph.edge[of >= 0], "load": high[of >= 0]})

    return found.repartition("scenario_id").sortWithinPartitions("scenario_id").mapInPandas(run, "scenario_id long, edge_id int, load double")


def scenario_loads(packed: Packed, scenarios: DataFrame, k: int | None, at_most: bool = False, best: bool = False, loose: bool = False) -> DataFrame:
    """(scenario_id, edge_id, load) with the k worst changes of each scenario and link; compare loads.changed_load()."""
    return merged(partials(packed, scenarios, k, at_most, loose), packed.graph, k, best)


def highest_loads(packed: Packed, scenarios: DataFrame, k: int | None, at_most: bool = False) -> DataFrame:
    """Rows (scenario_id, edge_id, load) among which is each link's highest load, with the first scenario that has it.

    Of several scenarios and a finite k, most cannot hold the highest load of a link: the current loads decide, and k changes add
    little. So the current loads of all scenarios come first, which need a row for each setting and not for each prefix, and with them
    the pairs of scenario and link that k changes, however large, can lift to the top. Where these are still many, bounds follow that
    cost far less than the loads; then the load of each link where its bound is highest; and then those pairs whose bound reaches that.
    """
    many = scenarios.count()
    if not k or many < 2:
        return scenario_loads(packed, scenarios, k, at_most, best=True)
    every = scenarios
    asked = lambda pairs: every.join(pairs.groupBy("scenario_id").agg(F.collect_set("edge_id").alias("edges")), "scenario_id")
    now, reach = checkpointed(scenario_loads(packed.settled(), scenarios, 0)), packed.reach(k)
    # One row for each link.
    high = now.groupBy("edge_id").agg(F.max("load").alias("_high"))
    lifted = now.join(F.broadcast(high), "edge_id").where(F.col("load") >= F.col("_high") * (1 - 1e-9) - (reach if at_most else 2 * reach) - 1e-6)
    pairs = checkpointed(lifted.select("scenario_id", "edge_id"), now)
    scenarios = asked(pairs)
    if many < BOUNDED or pairs.count() <= FEW * len(packed.graph.edge):
        return scenario_loads(packed, scenarios, k, at_most, best=True)
    bounds = checkpointed(scenario_loads(packed, scenarios, k, at_most, loose=True))
    first = bounds.groupBy("edge_id").agg(F.max(F.struct("load", -F.col("scenario_id"))).alias("b")).select((-F.col("b.col2")).alias("scenario_id"), "edge_id")
    known = checkpointed(scenario_loads(packed, asked(first), k, at_most))
    # One row for each link.
    reach = known.select("edge_id", F.col("load").alias("_least"), F.col("scenario_id").alias("_known"))
    open_pairs = bounds.join(F.broadcast(reach), "edge_id").where((F.col("load") >= F.col("_least") - 1e-6) & (F.col("scenario_id") != F.col("_known")))
    rest = checkpointed(open_pairs.select("scenario_id", "edge_id"), bounds)
    return known.union(scenario_loads(packed, asked(rest), k, at_most, best=True))


def changed_load(links: DataFrame, roots: DataFrame, scenarios: DataFrame, demand: DataFrame, states: DataFrame, kinds: DataFrame, k: int | None, at_most: bool = False) -> DataFrame:
    """(scenario_id, edge_id, load) where rules are kinds; compare loads.changed_load()."""
    return scenario_loads(Packed.of(links, roots, demand, settings_of(states, kinds)), scenarios, k, at_most)


def _named(places: np.ndarray, names: np.ndarray) -> pd.Series:
    out = pd.Series(names[np.maximum(places, 0)], dtype="Int32")
    out[places < 0] = pd.NA
    return out


def worst_cells(links: DataFrame, roots: DataFrame, scenarios: DataFrame, demand: DataFrame, states: DataFrame, kinds: DataFrame) -> DataFrame:
    """(scenario_id, prefix, edge_id, current, worst, egress, ingress): every cell that is or can be loaded, with what
    causes the worst load."""
    packed = Packed.of(links, roots, demand, settings_of(states, kinds))
    graph, rules = packed.graph, packed.rules

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scenario, scene, blocks in _held(part, graph, rules):
            for block in blocks:
                current, most, egress, ingress = block.evaluated(scene, witness=True)
                p, e = np.nonzero((current > 0) | (most > 0))
                yield pd.DataFrame({"scenario_id": scenario["scenario_id"], "prefix": block.prefixes[p], "edge_id": graph.edge[e], "current": current[p, e], "worst": most[p, e], "egress": _named(egress[p, e], graph.names[graph.root_at]), "ingress": _named(ingress[p, e], graph.names)})

    return packed.beside(scenarios).mapInPandas(run, "scenario_id long, prefix long, edge_id int, current double, worst double, egress int, ingress int")


_CHANGE = "scenario_id long, edge_id int, prefix long, current double, worst double, diff double, egresses array<int>, ingress int"


def largest_changes(packed: Packed, wanted: DataFrame, k: int | None, at_most: bool = False) -> DataFrame:
    """(scenario_id, edge_id, rank, prefix, current, worst, egresses, ingress): the k largest changes of the links (edges) of each
    scenario (scenario_id, failed, edges), of equal ones those of the smaller prefixes; for k None all that raise a load. Tasks give
    out no more than k of each link and group of blocks."""
    graph, rules = packed.graph, packed.rules

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        routers = graph.names[graph.root_at].tolist()
        for scenario, scene, blocks in _held(part, graph, rules):
            out = []
            for block in blocks:
                current, most, egress, ingress = block.evaluated(scene, witness=True)
                whole = np.round(most - current, 9)
                setting = np.concatenate([np.full(rows.stop - rows.start, i) for i, (rows, *_) in enumerate(block.groups)])
                for j, edge in enumerate(scene.at):
                    diff = whole[block.owner, j] * block.shares
                    some = np.flatnonzero((diff > 0) if at_most or k is None else (current[block.owner, j] > 0) | (most[block.owner, j] > 0))
                    if k is not None and len(some) > k:
                        least = -np.partition(-diff[some], k - 1)[k - 1]
                        some = some[diff[some] >= least]
                        some = some[np.lexsort((block.names[some], -diff[some]))[:k]]
                    for m in some:
                        p = block.owner[m]
                        _, _, rule, te = block.groups[setting[p]]
                        e, s = egress[p, j], ingress[p, j]
                        by_sets = te and rules[rule].kind == "egress"
                        to = None if e < 0 else list(scene.ways.candidates(te, rule)[e]) if by_sets else [routers[e]]
                        out.append((scenario["scenario_id"], int(graph.edge[edge]), int(block.names[m]), current[p, j] * block.shares[m], most[p, j] * block.shares[m], diff[m], to, None if s < 0 else int(graph.names[s])))
            if out:
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGE.split(", ")])
                yield frame.astype({"ingress": "Int32"})

    found = packed.beside(wanted).mapInPandas(run, _CHANGE)
    order = [F.desc(F.round("diff", 9)), F.col("prefix")]
    if k is not None:
        found = top_per_group(found, ["scenario_id", "edge_id"], order, k)
    return found.drop("diff").withColumn("_d", F.round(F.col("worst") - F.col("current"), 9))


def dropped_demand(packed: Packed, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, dropped): the demand of sources that reach no current egress of a prefix, in each scenario."""
    graph, rules = packed.graph, packed.rules

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scenario, scene, blocks in _held(part, graph, rules):
            lost = 0.0
            for block in blocks:
                for rows, egresses, *_ in block.groups:
                    at = scene.ways.roots(egresses)
                    cut = ~np.isfinite(scene.cost[at]).any(axis=0) if len(at) else np.ones(scene.cost.shape[1], dtype=bool)
                    lost += block.mat[rows][:, cut].sum()
            yield pd.DataFrame({"scenario_id": [scenario["scenario_id"]], "dropped": [lost]})

    found = packed.beside(scenarios).mapInPandas(run, "scenario_id long, dropped double")
    return found.groupBy("scenario_id").agg(F.sum("dropped").alias("dropped"))
