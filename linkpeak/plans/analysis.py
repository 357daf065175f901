"""The analysis as a user builds it: a network, what may change, and how to approximate; then ``analyze(k, l)``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkpeak.functions.ranking import top_per_group
from linkpeak.operators import blocks, clustering, flow, loads, rules, sweeps
from linkpeak.operators.blocks import Rule
from linkpeak.sources.tables import checkpointed

Egresses = Iterable[int] | Mapping[int, Iterable[int]] | None


def _rule(kind: str, egresses: Egresses, ingresses: Iterable[int] | None) -> tuple[str, Egresses, frozenset[int] | None]:
    if kind not in blocks.KINDS:
        raise ValueError(f"a rule changes the egress, the ingress or both, not {kind!r}")
    if isinstance(egresses, Mapping):
        egresses = {int(r): frozenset(p) for r, p in egresses.items()}
    elif egresses is not None:
        egresses = tuple(egresses)
    return kind, egresses, None if ingresses is None else frozenset(ingresses)


@dataclass(frozen=True)
class Analysis:
    """links (edge_id, src, dst, weight), ext_links (ext, router), demand (src, prefix, demand), route_state (prefix, ext).

    Prefixes without demand are left out. Each setter returns a changed copy.
    """

    links: DataFrame
    ext_links: DataFrame
    demand: DataFrame
    route_state: DataFrame
    default_kind: str = "egress"
    default_egresses: Egresses = None
    named: tuple[tuple[DataFrame, tuple], ...] = field(default=())
    te_paths: DataFrame | None = None
    installed: DataFrame | None = None
    local_prefs: DataFrame | None = None
    heaviest: int | None = None
    directed: bool = False
    assignment: DataFrame | None = None
    mode: str = "scaled"
    clusters: tuple[str, float] | None = None
    default_ingresses: frozenset[int] | None = None

    def _with(self, **changes) -> Analysis:
        """A changed copy; what is written of demand and states serves it as well, as no setter changes these."""
        new = replace(self, **changes)
        new.__dict__.update({name: self.__dict__[name] for name in ("_written_cells", "_written_demand", "_written_states") if name in self.__dict__})
        return new

    def set_default_uncertainty(self, kind: str, egresses: Egresses = None, ingresses: Iterable[int] | None = None) -> Analysis:
        """The rule of prefixes that no other rule names; egresses and ingresses as in with_uncertainty()."""
        kind, egresses, ingresses = _rule(kind, egresses, ingresses)
        return self._with(default_kind=kind, default_egresses=egresses, default_ingresses=ingresses)

    def modify_default_egresses(self, keep: Column) -> Analysis:
        """Of the egresses of the default rule those for which ``keep``, a condition on the column root, holds."""
        egresses = self.default_egresses
        # Border routers are a part of the topology, which travels with the tasks.
        kept = {r["root"] for r in self.roots().where(keep).collect()}
        if isinstance(egresses, Mapping):
            return self._with(default_egresses={r: p for r, p in egresses.items() if r in kept})
        return self._with(default_egresses=tuple(sorted(kept if egresses is None else kept & set(egresses))))

    def modify_default_ingresses(self, keep: Column) -> Analysis:
        """Of the ingresses of the default rule those for which ``keep``, a condition on the column router, holds."""
        kept = frozenset(r["router"] for r in self.routers().where(keep).collect())
        return self._with(default_ingresses=kept if self.default_ingresses is None else kept & self.default_ingresses)

    def with_uncertainty(self, prefixes: DataFrame, kind: str, egresses: Egresses = None, ingresses: Iterable[int] | None = None) -> Analysis:
        """A rule for some prefixes (column prefix); of several that name a prefix the last one holds.

        egresses: the border routers that they may change to, or these with the local preferences that their routes may have (by
        default those of set_local_prefs()); ingresses: the routers where their traffic may enter. By default all.
        """
        return self._with(named=(*self.named, (prefixes.select("prefix"), _rule(kind, egresses, ingresses))))

    def add_te_paths(self, paths: DataFrame) -> Analysis:
        """Explicit paths (prefix, ingress, egress, path_no, edges)."""
        return self._with(te_paths=paths if self.te_paths is None else self.te_paths.unionByName(paths))

    def install_te_paths(self, paths: DataFrame) -> Analysis:
        """The same explicit paths (ingress, egress, path_no, edges) for every prefix, beside its own ones; paths are few."""
        own = paths.select("ingress", "egress", "path_no", "edges")
        return self._with(installed=own if self.installed is None else self.installed.unionByName(own))

    def install_te_paths_at(self, i: int, paths: DataFrame) -> Analysis:
        """The same explicit paths for the prefixes of one class of kind egress, in place of their own ones: the i-th (from 0) by
        demand, the largest first, of equal ones that of the smaller egresses. Past the last class nothing changes."""
        key = ["egresses", "rule", "_te"]
        settings = self.settings().where(self._kind_of(F.col("rule")) == "egress").withColumn("_te", F.coalesce("te", F.lit("")))
        totals = self._checked().join(settings, "prefix").groupBy(*key).agg(F.sum("demand").alias("_sum"))
        # One row for each class.
        at = totals.withColumn("_at", F.row_number().over(Window.orderBy(F.desc("_sum"), *key)) - 1).where(F.col("_at") == i)
        own = settings.join(F.broadcast(at.select(*key)), key).select("prefix")
        new = own.join(F.broadcast(paths)).select("prefix", "ingress", "egress", "path_no", "edges")
        rest = None if self.te_paths is None else self.te_paths.join(own, "prefix", "left_anti").select(*new.columns)
        return self._with(te_paths=checkpointed(new if rest is None else rest.union(new)))

    def set_local_prefs(self, local_prefs: DataFrame) -> Analysis:
        """(egress, local_pref): the values that announcements at a border router may carry. Egresses without any
        cannot be changed to. By default all share one value."""
        return self._with(local_prefs=local_prefs)

    def only_heaviest_prefixes(self, n: int) -> Analysis:
        return self._with(heaviest=n)

    def directional_link_failures(self) -> Analysis:
        return self._with(directed=True)

    def with_clustering(self, assignment: DataFrame, mode: str = "scaled") -> Analysis:
        """Prefixes of a cluster (prefix, cluster) route as one; all must share their state, rule and explicit paths."""
        return self._with(assignment=assignment, mode=mode, clusters=None)

    def with_cluster_number(self, n: int, mode: str = "scaled") -> Analysis:
        """K-means in each class of prefixes of equal state, rule and explicit paths, with n clusters over all classes of kind egress."""
        return self._with(clusters=("number", n), mode=mode, assignment=None)

    def with_cluster_error(self, target: float, mode: str = "scaled") -> Analysis:
        """The same with as few clusters as keep the error below target, a share of all demand."""
        return self._with(clusters=("error", target), mode=mode, assignment=None)

    def clustered(self) -> Analysis:
        """The analysis with the clusters that its method gives, computed once; use it for several calls of analyze()."""
        if self.clusters is None:
            return self
        plain = self._with(clusters=None)
        demand, own = plain._checked(), checkpointed(plain.settings())
        settings = own.withColumn("kind", plain._kind_of(F.col("rule")))
        method, value = self.clusters
        found = sweeps.cluster_within_budget(demand, settings, int(value), self.mode) if method == "number" else sweeps.cluster_to_error(demand, settings, value, self.mode)
        out = self.with_clustering(checkpointed(found), self.mode)
        # Clusters change no settings.
        out.__dict__["_written_settings"] = own
        return out

    def roots(self) -> DataFrame:
        return self.ext_links.select(F.col("router").alias("root")).distinct()

    def routers(self) -> DataFrame:
        return self.links.select(F.col("src").alias("router")).union(self.links.select("dst")).union(self.roots()).distinct()

    def states(self) -> DataFrame:
        """(prefix, egresses): announcing externals as their border routers."""
        return self.route_state.join(self.ext_links, "ext").groupBy("prefix").agg(F.array_sort(F.collect_set("router")).alias("egresses"))

    def rules(self) -> dict[int, Rule]:
        """The rules by number: those named in their order, and -1 for the default one."""
        prefs: dict[int, set[int]] | None = None
        if self.local_prefs is not None:
            prefs = {}
            for egress, value in self.local_prefs.select("egress", "local_pref").distinct().collect():
                prefs.setdefault(egress, set()).add(value)

        def whole(egresses: Egresses) -> dict[int, frozenset[int]] | None:
            if isinstance(egresses, Mapping):
                return dict(egresses)
            if egresses is None:
                return None if prefs is None else {r: frozenset(p) for r, p in prefs.items()}
            return {r: frozenset([blocks.PREFERENCE]) for r in egresses} if prefs is None else {r: frozenset(prefs[r]) for r in egresses if r in prefs}

        return {i: Rule(kind, whole(egresses), ingresses) for i, (kind, egresses, ingresses) in [(-1, (self.default_kind, self.default_egresses, self.default_ingresses)), *((i, rule) for i, (_, rule) in enumerate(self.named))]}

    def _kind_of(self, rule: Column) -> Column:
        out = F.lit(self.default_kind)
        for i, (_, (kind, *_)) in enumerate(self.named):
            out = F.when(rule == i, F.lit(kind)).otherwise(out)
        return out

    def kinds(self) -> DataFrame:
        return self._rule_of().select("prefix", self._kind_of(F.col("rule")).alias("kind"))

    def _rule_of(self) -> DataFrame:
        """(prefix, rule)"""
        prefixes = self._written_prefixes()
        if not self.named:
            return prefixes.withColumn("rule", F.lit(-1))
        rows = self.named[0][0].withColumn("rule_id", F.lit(0))
        for i, (some, _) in enumerate(self.named[1:], 1):
            rows = rows.union(some.withColumn("rule_id", F.lit(i)))
        return rules.last_rule(prefixes, rows).select("prefix", F.coalesce("rule_id", F.lit(-1)).alias("rule"))

    def _te(self) -> DataFrame | None:
        """(prefix, te) of prefixes with explicit paths, and what others have."""
        if self.installed is None:
            return None if self.te_paths is None else blocks.te_text(self.te_paths)
        everyone = self.installed if self.te_paths is None else self.installed.limit(0)
        if self.te_paths is None:
            text = blocks.te_text(everyone.withColumn("prefix", F.lit(0)))
            return self._written_prefixes().join(F.broadcast(text.select("te")))
        own = self.te_paths.select("prefix").distinct()
        # Installed paths are few; they go to the prefixes with own ones, and as one text to all others.
        mixed = self.te_paths.unionByName(own.join(F.broadcast(self.installed)).select(*self.te_paths.columns))
        text = blocks.te_text(self.installed.withColumn("prefix", F.lit(0))).select("te")
        rest = self._written_prefixes().join(own, "prefix", "left_anti").join(F.broadcast(text))
        return blocks.te_text(mixed).union(rest.select("prefix", "te"))

    def settings(self) -> DataFrame:
        """(prefix, egresses, rule, te): what tells classes of prefixes apart."""
        if "_written_settings" in self.__dict__:
            return self.__dict__["_written_settings"]
        te, known = self._te(), self._written_states.join(self._rule_of(), "prefix")
        return known.withColumn("te", F.lit(None).cast("string")) if te is None else known.join(te, "prefix", "left").select("prefix", "egresses", "rule", "te")

    @cached_property
    def _written_states(self) -> DataFrame:
        return checkpointed(self.states())

    @cached_property
    def _written_cells(self) -> DataFrame:
        """(prefix, cells: src and demand): demand above zero, a row a prefix, written once for the checks and all that follows;
        a prefix without a state is an error."""
        cells = checkpointed(blocks.cells_of(self.demand.where("demand > 0")))
        if cells.join(self._written_states, "prefix", "left_anti").limit(1).count():
            raise ValueError("a prefix with demand has no routing state")
        if flow.outside(blocks.demand_of(cells), self.links, self.roots()).limit(1).count():
            raise ValueError("demand enters at a router that the topology does not have")
        return cells

    @cached_property
    def _written_demand(self) -> DataFrame:
        """(src, prefix, demand): what _written_cells holds."""
        return blocks.demand_of(self._written_cells)

    def _written_prefixes(self) -> DataFrame:
        """(prefix), each once."""
        return self._written_cells.select("prefix")

    def known(self) -> tuple[DataFrame, DataFrame]:
        """Demand above zero, and states (prefix, egresses), as written for all that follows."""
        return self._written_demand, self._written_states

    def _checked(self) -> DataFrame:
        """Demand above zero, of the heaviest prefixes where only these count."""
        return self._written_demand if self.heaviest is None else loads.heaviest_only(self._written_demand, self.heaviest)[0]

    def _inputs(self, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Demand, settings, and of clusters the members that can be among the ``most`` largest changes (None: no members)."""
        demand, settings = self._checked(), self.settings()
        if self.assignment is None:
            return demand, settings, None
        named = self.assignment.select("prefix", F.col("cluster").cast("long").alias("_c"))
        # A row for each cluster.
        of = checkpointed(named.join(settings, "prefix").select("_c", "egresses", "rule", F.coalesce("te", F.lit("")).alias("te")).distinct())
        if of.groupBy("_c").count().where("count > 1").limit(1).count():
            raise ValueError("a cluster mixes states, rules or explicit paths")
        settings = of.select(F.col("_c").alias("prefix"), "egresses", "rule", "te")
        members = None
        if most:
            sizes = checkpointed(demand.groupBy("prefix").agg(F.sum("demand").alias("w")).join(named, "prefix"))
            # The largest shares make the largest rises and the smallest ones the least falls.
            ends = top_per_group(sizes, ["_c"], [F.desc("w"), F.col("prefix")], most).union(top_per_group(sizes, ["_c"], [F.col("w"), F.col("prefix")], most)).distinct()
            totals = sizes.groupBy("_c").agg(F.sum("w").alias("_all"))
            lists = ends.join(totals, "_c").groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("prefix", (F.col("w") / F.col("_all")).alias("share")))).alias("members"))
            members = lists.select(F.col("_c").alias("prefix"), "members")
        demand = clustering.clustered_demand(demand, self.assignment, self.mode).select("src", F.col("cluster").cast("long").alias("prefix"), "demand").where("demand > 0")
        return demand, settings, members

    def prepared(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Demand, states and kinds after truncation and clustering; a prefix without a state is an error."""
        demand, settings, _ = self._inputs()
        settings = settings.join(demand.select("prefix").distinct(), "prefix", "left_semi")
        return demand, settings.select("prefix", "egresses"), settings.select("prefix", self._kind_of(F.col("rule")).alias("kind"))

    def bounds(self) -> DataFrame:
        """(plus, minus): the demand that a report may miss, and that it may make up: half of the error of
        clusters each way, and what truncation leaves out on top."""
        if self.clusters is not None:
            return self.clustered().bounds()
        demand = self._written_demand
        dropped = self.demand.sparkSession.range(1).select(F.lit(0.0).alias("dropped"))
        if self.heaviest is not None:
            demand, dropped = loads.heaviest_only(demand, self.heaviest)
        if self.assignment is None:
            return dropped.select(F.col("dropped").alias("plus"), F.lit(0.0).alias("minus"))
        half = clustering.half_error(demand, self.assignment, self.mode)
        return half.crossJoin(dropped).select((F.col("half") + F.col("dropped")).alias("plus"), F.col("half").alias("minus"))

    def packed(self, most: int | None = None) -> blocks.Packed:
        """The demand by blocks, for calls with up to ``most`` changes (None: with any number, or with none)."""
        if self.clusters is not None:
            return self.clustered().packed(most)
        demand, settings, members = self._inputs(most)
        if self.assignment is None and self.heaviest is None:
            demand = self._written_cells
        return blocks.Packed.of(self.links, self.roots(), demand, settings, self.rules(), members)

    def scenarios(self, l: int) -> DataFrame:  # noqa: E741
        return flow.failure_scenarios(self.links, l, self.directed)

    def analyze(self, k: int | None, l: int, at_most: bool = False, packed: blocks.Packed | None = None) -> DataFrame:  # noqa: E741
        """(src, dst, load, failed): each link's highest load over up to l failures and k changes (None: any number). packed:
        from packed(), where several calls share it."""
        return loads.over_scenarios(blocks.highest_loads(packed or self.packed(k), self.scenarios(l), k, at_most), self.links, self.scenarios(l))

    def causes(self, k: int | None, l: int, at_most: bool = False) -> DataFrame:  # noqa: E741
        """(src, dst, failed, rank, prefix, current, worst, egress, egresses, ingress): what makes each link's highest load: the
        failed links, and the prefixes that change, the largest change first, with the egresses (egress, where it is one) and the
        ingress (null: as it is) that they change to. Members of clusters change one by one. Of equal changes the smaller
        prefix is named, of equal sets of egresses the smaller one."""
        if self.clusters is not None:
            return self.clustered().causes(k, l, at_most)
        packed, scenarios = self.packed(k), self.scenarios(l)
        found = blocks.highest_loads(packed, scenarios, k, at_most)
        best = checkpointed(loads.over_scenarios(found, self.links, scenarios, named=True).where("scenario_id IS NOT NULL"))
        wanted = scenarios.join(best.groupBy("scenario_id").agg(F.collect_set("edge_id").alias("edges")), "scenario_id")
        changed = blocks.largest_changes(packed, wanted, k, at_most)
        changed = self._whole_clusters(changed) if k is None and self.assignment is not None else changed
        rank = F.row_number().over(loads.by_change())
        ranked = (changed.limit(0) if k == 0 else changed).withColumn("rank", rank)
        egress = F.when(F.size("egresses") == 1, F.col("egresses")[0]).alias("egress")
        return best.join(ranked, ["scenario_id", "edge_id"], "left").select("src", "dst", "failed", "rank", "prefix", "current", "worst", egress, "egresses", "ingress")

    def _whole_clusters(self, changed: DataFrame) -> DataFrame:
        """Each member of the clusters that change, with its share."""
        sizes = self._checked().groupBy("prefix").agg(F.sum("demand").alias("w")).join(self.assignment.select("prefix", F.col("cluster").cast("long").alias("_c")), "prefix")
        shares = sizes.join(sizes.groupBy("_c").agg(F.sum("w").alias("_all")), "_c").select("_c", F.col("prefix").alias("_p"), (F.col("w") / F.col("_all")).alias("_s"))
        parts = changed.withColumnRenamed("prefix", "_c").join(shares, "_c")
        return parts.select("scenario_id", "edge_id", F.col("_p").alias("prefix"), (F.col("current") * F.col("_s")).alias("current"), (F.col("worst") * F.col("_s")).alias("worst"), "egresses", "ingress", (F.col("_d") * F.col("_s")).alias("_d"))

    def inaccurate_links(self, k: int | None, l: int, invent_new: bool = False) -> DataFrame:  # noqa: E741
        """(n): loaded links that no source reaches by nodes of a single next hop, each under the failures that make its highest
        load. Only sources with demand count, unless invent_new."""
        scenarios = self.scenarios(l)
        best = checkpointed(loads.over_scenarios(blocks.highest_loads(self.packed(k), scenarios, k), self.links, scenarios, named=True).where("scenario_id IS NOT NULL"))
        # Of all scenarios only those that make some link's highest load.
        unit = flow.unit_flow(self.links, self.roots(), scenarios.join(best.select("scenario_id").distinct(), "scenario_id", "left_semi"))
        sole = unit.where(F.col("unique") & F.col("edge_id").isNotNull())
        if not invent_new:
            sole = sole.join(self._written_demand.select("src").distinct(), "src", "left_semi")
        return best.join(sole.select("scenario_id", "edge_id").distinct(), ["scenario_id", "edge_id"], "left_anti").agg(F.count("*").alias("n"))
