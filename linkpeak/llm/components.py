"""Connected components of a graph, by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b), both long; label is the smallest node of its component.

    Each round every component takes the label of its smallest neighbour, if that is smaller, and chains of
    such steps are shortened until all point at their end. At least half of the components that have a
    neighbour vanish in a round. Edges within a component are left out of the next round.
    """
    open_edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while open_edges.limit(1).count():
        # a is the smaller end, so only b may hook onto it.
        hooks = materialize(open_edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")).withColumn("_moved", F.lit(True)))
        moved = True
        while moved:
            further = hooks.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            step = hooks.join(further, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("_moved"))
            hooks = materialize(step, hooks)
            moved = hooks.where("_moved").limit(1).count()
        ends = lambda end: hooks.select(F.col("node").alias(end), F.col("to").alias(f"_{end}"))  # noqa: E731, B023
        labels = materialize(labels.join(ends("label"), "label", "left").select("node", F.coalesce("_label", "label").alias("label")), labels)
        moved_edges = open_edges.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        open_edges = materialize(moved_edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), open_edges, hooks)
    discard(open_edges)
    return labels
