"""Clusters of prefixes with like demand vectors, their centres, errors and the matrix they approximate.

Vectors stay in long form, one row for each prefix and source. Modes: "direct" compares demands, "normalized"
and "scaled" compare shares; "scaled" weighs a prefix's shares by its demand.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkpeak.operators.means import Problem, Vectors, started
from linkpeak.operators.traffic import normalised
from linkpeak.sources.generators import draw
from linkpeak.sources.tables import checkpointed

MODES = ("direct", "normalized", "scaled")


def vectors(demand: DataFrame) -> DataFrame:
    """(prefix, src, demand, scale, norm) with a row for every source, also those without demand."""
    sources = F.broadcast(demand.select("src").distinct().agg(F.array_sort(F.collect_list("src")).alias("_all")))
    cells = demand.select("prefix").distinct().crossJoin(sources).select("prefix", F.explode("_all").alias("src"))
    full = cells.join(demand, ["prefix", "src"], "left").withColumn("demand", F.coalesce("demand", F.lit(0.0)))
    return normalised(full)


def single(vec: DataFrame) -> DataFrame:
    """(prefix, cluster): all in one."""
    return vec.select("prefix").distinct().withColumn("cluster", F.lit(0))


def heaviest(vec: DataFrame, k: int) -> DataFrame:
    """(prefix, cluster): the k heaviest prefixes alone, the others together in cluster k."""
    scales = vec.select("prefix", "scale").distinct()
    top = scales.orderBy(F.desc("scale"), "prefix").limit(k)
    ranked = top.select("prefix", (F.row_number().over(Window.orderBy(F.desc("scale"), "prefix")) - 1).alias("cluster"))
    return scales.join(ranked, "prefix", "left").select("prefix", F.coalesce("cluster", F.lit(k)).alias("cluster"))


def centres(vec: DataFrame, assignment: DataFrame, mode: str) -> DataFrame:
    """(cluster, src, centre)"""
    joined = vec.join(assignment, "prefix")
    value = {"direct": F.avg("demand"), "normalized": F.avg("norm"), "scaled": F.sum("demand") / F.sum("scale")}[mode]
    return joined.groupBy("cluster", "src").agg(value.alias("centre"))


def errors(vec: DataFrame, assignment: DataFrame, mode: str) -> DataFrame:
    """(cluster, error_pos, error_neg): demand that the centre misses, and demand it makes up."""
    joined = vec.join(assignment, "prefix").join(centres(vec, assignment, mode), ["cluster", "src"])
    x, weight = (F.col("demand"), F.lit(1.0)) if mode == "direct" else (F.col("norm"), F.col("scale"))
    gap = x - F.col("centre")
    return joined.groupBy("cluster").agg(F.sum(F.greatest(gap, F.lit(0.0)) * weight).alias("error_pos"), F.sum(F.greatest(-gap, F.lit(0.0)) * weight).alias("error_neg"))


def effective_demand(vec: DataFrame, assignment: DataFrame, mode: str) -> DataFrame:
    """(cluster, src, demand): the centre times the members, or times their demand."""
    members = vec.select("prefix", "scale").distinct().join(assignment, "prefix").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("scale").alias("s"))
    factor = F.col("n") if mode == "direct" else F.col("s")
    return centres(vec, assignment, mode).join(members, "cluster").select("cluster", "src", (F.col("centre") * factor).alias("demand"))


def clustered_demand(demand: DataFrame, assignment: DataFrame, mode: str) -> DataFrame:
    """(cluster, src, demand) as effective_demand(), from demand (src, prefix, demand) without rows of zeros: the centre times what it
    is divided by is the cluster's own demand, except where shares are averaged."""
    rows = demand.join(assignment, "prefix")
    if mode != "normalized":
        return rows.groupBy("cluster", "src").agg(F.sum("demand").alias("demand"))
    rows = rows.withColumn("_scale", F.sum("demand").over(Window.partitionBy("prefix")))
    sums = rows.groupBy("cluster", "src").agg(F.sum(F.col("demand") / F.col("_scale")).alias("_norm"))
    members = rows.groupBy("cluster").agg(F.countDistinct("prefix").alias("n"), F.sum("demand").alias("s"))
    return sums.join(members, "cluster").select("cluster", "src", (F.col("_norm") / F.col("n") * F.col("s")).alias("demand"))


def half_error(demand: DataFrame, assignment: DataFrame, mode: str) -> DataFrame:
    """(half): half of all errors(), from demand (src, prefix, demand) above zero. In each mode the demand that the centres of a cluster miss
    is as much as they make up, and zeros miss nothing."""
    scale = F.sum("demand").over(Window.partitionBy("prefix"))
    rows = demand.join(assignment, "prefix").withColumn("_scale", scale)
    x, weight = (F.col("demand"), F.lit(1.0)) if mode == "direct" else (F.col("demand") / F.col("_scale"), F.col("_scale"))
    # What belongs to a prefix counts once for each of its rows, divided by their number.
    part = 1 / F.count("*").over(Window.partitionBy("prefix"))
    rows = rows.withColumn("_part", part * (F.col("_scale") if mode == "scaled" else F.lit(1.0)))
    parts = rows.groupBy("cluster", "src").agg(F.sum("demand" if mode == "scaled" else x).alias("_sum"), F.sum("_part").alias("_part"))
    # A row for each cluster and source; written, so that the planner knows how small it is.
    centres = checkpointed(parts.select("cluster", "src", (F.col("_sum") / F.sum("_part").over(Window.partitionBy("cluster"))).alias("centre")))
    return rows.join(centres, ["cluster", "src"]).agg(F.coalesce(F.sum(F.greatest(x - F.col("centre"), F.lit(0.0)) * weight), F.lit(0.0)).alias("half"))


def approximated(vec: DataFrame, assignment: DataFrame, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matrix (src, prefix: the cluster, demand), the lookup (prefix, cluster), and its reverse (cluster, prefixes)."""
    matrix = effective_demand(vec, assignment, mode).withColumnRenamed("cluster", "prefix")
    return matrix, assignment, assignment.groupBy("cluster").agg(F.array_sort(F.collect_list("prefix")).alias("prefixes"))


def assign(vec: DataFrame, points: DataFrame, mode: str) -> DataFrame:
    """(prefix, cluster): the nearest point by the sum of absolute differences; ties to the lowest cluster.

    points: cluster, src, centre. Distances go by source: each prefix meets each point once for every source.
    """
    x = F.col("demand") if mode == "direct" else F.col("norm")
    weight = F.col("scale") if mode == "scaled" else F.lit(1.0)
    far = vec.join(points, "src").groupBy("prefix", "cluster").agg(F.sum(F.abs(x - F.col("centre")) * weight).alias("d"))
    return far.groupBy("prefix").agg(F.min(F.struct(F.round("d", 6).alias("d"), "cluster"))["cluster"].alias("cluster"))


def first_points(vec: DataFrame, k: int, mode: str, seed: int | None = None) -> DataFrame:
    """(cluster, src, centre): the vectors of the k heaviest prefixes, or of k prefixes picked by seed."""
    scales = vec.select("prefix", "scale").distinct()
    order = [F.desc("scale"), F.col("prefix")] if seed is None else [draw(seed, "prefix"), F.col("prefix")]
    top = scales.orderBy(*order).limit(k)
    named = top.select("prefix", (F.row_number().over(Window.orderBy(*order)) - 1).alias("cluster"))
    return vec.join(named, "prefix").select("cluster", "src", F.col("demand" if mode == "direct" else "norm").alias("centre"))


def kmeans_by_class(vec: DataFrame, sizes: DataFrame, mode: str = "scaled", max_iter: int = 150, tolerance: float = 1e-5, seed: int | None = None) -> DataFrame:
    """(class, prefix, cluster): k-means in each class of prefixes by itself, all classes in the same jobs.

    vec: class, prefix, src, demand; sizes: class, k, one row for each class. Means and assignments alternate until the points of a
    class hardly move; then that class stands still. Clusters without members move to zero.
    """
    kind = dict(vec.dtypes)["class"]
    blocks = Vectors.of(vec)
    wanted = {str(r["class"]): r["k"] for r in sizes.select(F.col("class").cast("string").alias("class"), "k").collect()}
    problems = dict(enumerate(started(blocks, wanted, mode, seed).values()))
    found = blocks.assignment(blocks.converged(problems, max_iter, tolerance))
    return found.select(F.col("class").cast(kind).alias("class"), "prefix", "cluster")


def kmeans(vec: DataFrame, k: int, mode: str = "scaled", max_iter: int = 150, tolerance: float = 1e-5, seed: int | None = None) -> DataFrame:
    """(prefix, cluster) after alternating assignment and means until the points hardly move; see kmeans_by_class(). vec: prefix, src, demand."""
    blocks = Vectors.of(vec.select("prefix", "src", "demand"))
    problems = dict(enumerate(started(blocks, {"": k}, mode, seed).values()))
    return blocks.assignment(blocks.converged(problems, max_iter, tolerance)).select("prefix", "cluster")


def heaviest_errors(demand: DataFrame, k: int, mode: str) -> DataFrame:
    """(cluster, error_pos, error_neg) of the k heaviest prefixes alone and the others together; errors() of heaviest(), by blocks."""
    blocks = Vectors.of(demand.select("prefix", "src", "demand"))
    return blocks.cluster_errors({0: Problem("", mode, alone=blocks.heaviest({"": k})[""][0])}).drop("problem")


def nearest_start(vec: DataFrame, k: int, mode: str = "scaled", seed: int | None = None) -> DataFrame:
    """(prefix, cluster): the nearest of the points that k-means starts from; its first step."""
    blocks = Vectors.of(vec.select("prefix", "src", "demand"))
    return blocks.assignment(dict(enumerate(started(blocks, {"": k}, mode, seed).values()))).select("prefix", "cluster")


def score_grid(vec: DataFrame, heavy: tuple[int, ...] = (10, 50, 100, 500, 1000), means: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """(method, k, mode, error): positive error over all demand, for each method and mode; k-means runs until it
    converges, for all k of a mode in the same jobs."""
    blocks, top, points = Vectors.folded(vec.select("prefix", "src", "demand"), max((*heavy, *means), default=0))
    total = blocks.totals().get("", 0.0)
    problems = {}
    for mode in MODES:
        problems["single", 1, mode] = Problem("", mode, alone=np.zeros(0, dtype=np.int64))
        problems |= {("heaviest", k, mode): Problem("", mode, alone=top[:k]) for k in heavy}
    moving = {}
    for mode in MODES if means else ():
        scale = points.sum(axis=1, keepdims=True)
        begin = points if mode == "direct" else points / np.where(scale == 0, 1.0, scale)
        moving |= {("kmeans", k, mode): Problem("", mode, begin[:k]) for k in means}
    names = [*problems, *moving]
    found = blocks.converged(dict(enumerate(moving.values())))
    error = blocks.errors(dict(enumerate([*problems.values(), *found.values()])))
    rows = [(*name, error[i][0] / total if total and i in error else None) for i, name in enumerate(names)]
    return vec.sparkSession.createDataFrame(rows, "method string, k int, mode string, error double")
