"""Rules about what may change: precedence, equivalence classes, compatible egresses, explicit paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def effective_rules(prefixes: DataFrame, rule_prefixes: DataFrame, rules: DataFrame, default: str = "egress") -> DataFrame:
    """(prefix, rule_id, kind): of the rules that name a prefix the last one holds, of others the default (rule_id null).

    rule_prefixes: rule_id, prefix; rules: rule_id, kind; larger rule ids came later.
    """
    return last_rule(prefixes, rule_prefixes).join(rules, "rule_id", "left").select("prefix", "rule_id", F.coalesce("kind", F.lit(default)).alias("kind"))


def last_rule(prefixes: DataFrame, rule_prefixes: DataFrame) -> DataFrame:
    """(prefix, rule_id): of the rules that name a prefix the last one, null for none."""
    last = rule_prefixes.groupBy("prefix").agg(F.max("rule_id").alias("rule_id"))
    return prefixes.select("prefix").join(last, "prefix", "left")


def prefix_classes(settings: DataFrame, demand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kind, egresses, members, total), (kind, egresses, src, demand)): prefixes of equal settings as one.

    settings: prefix, kind, egresses; demand: src, prefix, demand.
    """
    joined = demand.join(settings, "prefix")
    members = joined.groupBy("kind", "egresses").agg(F.countDistinct("prefix").alias("members"), F.sum("demand").alias("total"))
    return members, joined.groupBy("kind", "egresses", "src").agg(F.sum("demand").alias("demand"))


def compatible_subsets(local_prefs: DataFrame, most: int | None = None) -> DataFrame:
    """(egresses, local_prefs): every set of egresses whose announcements can be equally preferred, the empty one too.

    local_prefs: egress, local_pref. A set is compatible if one preference value is possible at all of its
    routers. Their number is exponential in the number of egresses that share a value. Without ``most`` the
    subsets of the routers of each value are counted through, in parallel and without a shuffle. ``most`` bounds
    the size of a set; then sets grow by joins, an egress at a time, and stop as soon as no value is left.
    """
    if most is None:
        return _subsets_by_value(local_prefs)
    each = local_prefs.groupBy("egress").agg(F.array_sort(F.collect_set("local_pref")).alias("prefs"))
    empty = local_prefs.sparkSession.range(1).select(F.array().cast("array<int>").alias("egresses"), F.lit(None).cast("array<int>").alias("local_prefs"))
    level = each.select(F.array("egress").alias("egresses"), F.col("prefs").cast("array<int>").alias("local_prefs")).where(F.size("local_prefs") > 0)
    every = empty
    for _ in range(most):
        every = every.union(level)
        grown = level.join(each, (F.col("egress") > F.element_at("egresses", -1)) & F.arrays_overlap("local_prefs", F.col("prefs").cast("array<int>")))
        level = grown.select(F.concat("egresses", F.array("egress")).alias("egresses"), F.array_intersect("local_prefs", F.col("prefs").cast("array<int>")).alias("local_prefs"))
    return every


def _subsets_by_value(local_prefs: DataFrame) -> DataFrame:
    """compatible_subsets() of any size: bits of a number tell a set of the routers of a value. Sets that the
    routers of an earlier value hold as well are left to it, so that each comes once."""
    spark = local_prefs.sparkSession
    of: dict[int, set[int]] = {}
    for egress, value in local_prefs.select("egress", "local_pref").distinct().collect():
        of.setdefault(value, set()).add(egress)
    every = spark.range(1).select(F.array().cast("array<int>").alias("egresses"), F.lit(None).cast("array<int>").alias("local_prefs"))
    done: list[set[int]] = []
    for routers in sorted(of.values(), key=lambda r: (-len(r), sorted(r))):
        if any(routers <= other for other in done):
            continue
        listed = sorted(routers)
        if len(listed) > 62:
            raise ValueError("too many egresses share a value; bound the size of a set by most")
        without = lambda other: sum(1 << i for i, r in enumerate(listed) if r not in other)  # noqa: E731, B023
        sets = spark.range(1, 1 << len(listed))
        for other in done:
            sets = sets.where(F.col("id").bitwiseAND(F.lit(without(other))) != 0)
        values = [F.when(F.col("id").bitwiseAND(F.lit(without(of[v]))) == 0, F.lit(v)) for v in sorted(of)]
        members = F.expr(f"filter(array({', '.join(map(str, listed))}), (x, i) -> (shiftright(id, i) & 1L) = 1L)")
        every = every.union(sets.select(members.cast("array<int>").alias("egresses"), F.array_compact(F.array(*values)).cast("array<int>").alias("local_prefs")))
        done.append(routers)
    return every


def candidate_sets(local_prefs: DataFrame, te_egresses: DataFrame, most: int | None = None) -> DataFrame:
    """(egresses): what must be compared where explicit paths exist: each compatible set of egresses with paths,
    alone or with one other compatible egress. te_egresses: egress."""
    te = local_prefs.join(te_egresses.select("egress").distinct(), "egress", "left_semi")
    other = local_prefs.join(te_egresses.select("egress").distinct(), "egress", "left_anti").groupBy("egress").agg(F.collect_set("local_pref").alias("prefs"))
    sets = compatible_subsets(te, most)
    with_one = sets.crossJoin(other).where(F.col("local_prefs").isNull() | F.arrays_overlap("local_prefs", F.col("prefs").cast("array<int>")))
    grown = with_one.select(F.array_sort(F.array_append("egresses", F.col("egress").cast("int"))).alias("egresses"))
    return sets.where(F.size("egresses") > 0).select("egresses").union(grown).distinct()


def candidate_sets_by_prefix(local_prefs: DataFrame, te_paths: DataFrame) -> DataFrame:
    """(prefix, egresses): candidate_sets() for each prefix of te_paths, by the egresses of its own paths.

    Their number is exponential in the egresses that one prefix has paths to.
    """
    each = local_prefs.groupBy("egress").agg(F.collect_set("local_pref").alias("prefs"))
    can = te_paths.select("prefix", "egress").distinct().join(each, "egress")
    lists = te_paths.select("prefix").distinct().join(can.groupBy("prefix").agg(F.array_sort(F.collect_list("egress")).alias("tes"), F.map_from_entries(F.collect_list(F.struct("egress", "prefs"))).alias("prefs_of")), "prefix", "left")
    lists = lists.select("prefix", F.coalesce("tes", F.array().cast("array<int>")).alias("tes"), "prefs_of")
    kinds = lists.groupBy("tes").agg(F.first("prefs_of").alias("prefs_of"))
    bits = kinds.select("*", F.explode(F.expr("sequence(0L, shiftleft(1L, size(tes)) - 1L)")).alias("id"))
    subset = bits.select("tes", "prefs_of", F.expr("filter(tes, (x, i) -> (shiftright(id, i) & 1L) = 1L)").alias("own"))
    shared = F.expr("aggregate(slice(own, 2, size(own)), prefs_of[own[0]], (a, x) -> array_intersect(a, prefs_of[x]))")
    subset = subset.select("tes", "own", F.when(F.size("own") > 0, shared).alias("shared")).where("shared IS NULL OR size(shared) > 0")
    # Border routers, as many as the topology has.
    more = subset.crossJoin(F.broadcast(each)).where(~F.array_contains("tes", F.col("egress")) & (F.col("shared").isNull() | F.arrays_overlap("shared", "prefs")))
    grown = more.select("tes", F.array_sort(F.array_append("own", F.col("egress").cast("int"))).alias("egresses"))
    sets = subset.where(F.size("own") > 0).select("tes", F.col("own").alias("egresses")).union(grown)
    return lists.select("prefix", "tes").join(sets, "tes").select("prefix", "egresses")


def shared_budget(groups: DataFrame, budget: int) -> DataFrame:
    """(class, k): how many of ``budget`` clusters each group gets. groups: class, members, total (its traffic).

    Each has one; the others go by traffic, by largest remainders, and none gets more than it has members. Where there
    are as many groups as clusters or more, each gets one. Groups that their share would fill up come first in the
    order of (members - 1) / traffic, so that running sums find them. One row for each group: the windows are small.
    """
    n = groups.count()
    if n >= budget:
        return groups.select("class", F.lit(1).alias("k"))
    order = Window.orderBy("_r", "class")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    room = F.col("members") - 1
    ranked = groups.withColumn("_r", room / F.col("total")).withColumns({"_free": F.lit(budget - n) - F.coalesce(F.sum(room).over(before), F.lit(0)), "_all": F.sum("total").over(rest)})
    full = ranked.withColumn("_full", F.floor(F.col("_free") * (F.col("total") / F.col("_all"))) >= room)
    # A group after one that is not full cannot be full.
    full = full.withColumn("_full", F.min(F.col("_full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ones = full.withColumns({"_left": F.lit(budget - n) - F.sum(F.when(F.col("_full"), room).otherwise(0)).over(every), "_open": F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("total"))).over(every)})
    quota = F.when(F.col("_full"), room.cast("double")).otherwise(F.col("_left") * (F.col("total") / F.col("_open")))
    parts = open_ones.withColumn("_q", quota).withColumn("_whole", F.floor("_q"))
    more = F.col("_left") - F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_whole"))).over(every)
    rank = F.row_number().over(Window.orderBy(F.col("_full"), F.desc(F.round(F.col("_q") - F.col("_whole"), 9)), "members", "class"))
    out = parts.withColumns({"_more": more, "_rank": rank})
    return out.select("class", (1 + F.col("_whole") + F.when(~F.col("_full") & (F.col("_rank") <= F.col("_more")), 1).otherwise(0)).cast("int").alias("k"))
