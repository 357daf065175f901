"""Statistics of a traffic matrix and of load reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkpeak.sources.tables import checkpointed


def per_source(demand: DataFrame) -> DataFrame:
    return demand.groupBy("src").agg(F.sum("demand").alias("demand"))


def per_prefix(demand: DataFrame) -> DataFrame:
    return demand.groupBy("prefix").agg(F.sum("demand").alias("demand"))


def top_prefixes(demand: DataFrame, k: int) -> DataFrame:
    """(prefix, demand): the k heaviest prefixes of some demand; ties to the smaller prefix."""
    return per_prefix(demand).where("demand > 0").orderBy(F.desc("demand"), "prefix").limit(k)


def top_shares(demand: DataFrame, sizes: list[int]) -> DataFrame:
    """(top, demand, share): what the heaviest prefixes carry, for several numbers of prefixes.

    Only the heaviest max(sizes) prefixes are ranked; the total is a plain sum.
    """
    sums = per_prefix(demand)
    heavy = sums.orderBy(F.desc("demand"), "prefix").limit(max(sizes))
    ranked = heavy.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("demand"), "prefix")))
    each = ranked.withColumn("top", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("rank <= top").groupBy("top").agg(F.sum("demand").alias("demand"))
    total = sums.agg(F.sum("demand").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("top", "demand", (F.col("demand") / F.col("total")).alias("share"))


def normalised(demand: DataFrame) -> DataFrame:
    """(src, prefix, demand, scale, norm): each prefix's demand over its sum; a prefix without demand keeps zeros and scale 1."""
    total = F.sum("demand").over(Window.partitionBy("prefix"))
    rows = demand.withColumn("_sum", total)
    scale = F.when(F.col("_sum") == 0, F.lit(1.0)).otherwise(F.col("_sum"))
    return rows.select("src", "prefix", "demand", scale.alias("scale"), (F.col("demand") / scale).alias("norm"))


def running_demand(demand: DataFrame) -> DataFrame:
    """(prefix, demand, rank, upto): prefixes from the heaviest on, with the sum of demand so far.

    Prefixes are dealt by ranges of their demand; a running sum is that of the range plus the sums of the ranges before.
    """
    many = int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("demand"), F.col("prefix")]
    dealt = checkpointed(per_prefix(demand).repartitionByRange(many, *order).withColumn("_range", F.spark_partition_id()))
    # One row for each range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum("demand").alias("_d"), F.count("*").alias("_c"))
    offsets = sums.select("_range", F.coalesce(F.sum("_d").over(before), F.lit(0.0)).alias("_sum"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_range").orderBy(*order)
    rows = dealt.withColumns({"_in": F.row_number().over(inside), "_so": F.sum("demand").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return rows.join(F.broadcast(offsets), "_range").select("prefix", "demand", (F.col("_n") + F.col("_in")).alias("rank"), (F.col("_sum") + F.col("_so")).alias("upto"))


def equivalent_top_k(demand: DataFrame, bound: float, run: DataFrame | None = None) -> DataFrame:
    """(k): how many heaviest prefixes leave out no more than bound of all demand. run: its running_demand(), where several calls share it."""
    run = running_demand(demand) if run is None else run
    totals = F.broadcast(run.agg(F.sum("demand").alias("total"), F.count("*").alias("all_n")))
    found = run.crossJoin(totals).where(F.col("upto") > F.col("total") - bound).agg(F.min("rank").alias("k"))
    return found.crossJoin(totals).select(F.coalesce("k", "all_n").cast("long").alias("k"))


def difference(a: DataFrame, b: DataFrame, norm: float) -> DataFrame:
    """(min, median, max, sum, mean) of the links' absolute differences of load over norm; the median is the upper one."""
    rows = a.select("src", "dst", F.col("load").alias("x")).join(b.select("src", "dst", F.col("load").alias("y")), ["src", "dst"], "full")
    d = rows.select((F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) / norm).alias("d"))
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC)")
    return d.agg(F.min("d").alias("min"), upper.alias("median"), F.max("d").alias("max"), F.sum("d").alias("sum"), F.avg("d").alias("mean"))


def shares(values: DataFrame, total: float, value: str = "demand") -> DataFrame:
    """values as shares of the total. They must sum up to the total, or to 1 if they are shares already."""
    found = values.agg(F.coalesce(F.sum(value), F.lit(0.0))).first()[0]
    near = lambda x: abs(found - x) <= 1e-7 * max(abs(found), abs(x))
    if near(total):
        return values.withColumn(value, F.col(value) / F.lit(total))
    if near(1.0):
        return values
    raise ValueError(f"values sum up to {found}, neither to {total} nor to 1")


#: Fixed values: (attraction, repulsion, friction) wanted of a matrix, in tenths, and what to sample with for it.
SAMPLED_FOR = (
    ((30, 30, 25), (2.82, 3.0, 2.28)),
    ((30, 30, 30), (2.76, 3.0, 2.74)),
    ((30, 20, 40), (2.68, 1.96, 3.74)),
    ((30, 30, 35), (2.66, 3.0, 3.2)),
    ((30, 25, 40), (2.62, 2.5, 3.72)),
    ((40, 30, 40), (3.7, 2.98, 3.62)),
    ((45, 30, 40), (4.24, 2.94, 3.6)),
    ((35, 30, 40), (3.14, 3.0, 3.64)),
    ((30, 30, 40), (2.56, 3.0, 3.66)),
    ((25, 30, 40), (1.94, 3.0, 3.68)),
    ((30, 35, 40), (2.48, 3.5, 3.62)),
    ((30, 30, 45), (2.44, 2.98, 4.12)),
    ((30, 30, 20), (2.9, 3.0, 1.82)),
    ((30, 45, 40), (2.32, 4.5, 3.52)),
    ((30, 30, 50), (2.3, 2.94, 4.6)),
    ((30, 40, 40), (2.4, 4.0, 3.56)),
    ((20, 30, 40), (1.2, 3.0, 3.7)),
)


def sampled_for(wanted: DataFrame) -> DataFrame:
    """wanted (attraction, repulsion, friction, and more) with sample_attraction, sample_repulsion and sample_friction:
    what to sample with, null where it is not known. Wanted values count by tenths."""
    names = ("attraction", "repulsion", "friction")
    rows = [(*want, *got) for want, got in SAMPLED_FOR]
    known = wanted.sparkSession.createDataFrame(rows, ", ".join([f"_{n} int" for n in names] + [f"sample_{n} double" for n in names]))
    meets = [F.round(F.col(n) * 10).cast("int") == F.col(f"_{n}") for n in names]
    return wanted.join(F.broadcast(known), meets, "left").drop(*[f"_{n}" for n in names])


def lognormal_sigmas(demand: DataFrame, floor: float = 1e-9) -> DataFrame:
    """(attraction, repulsion, friction): widths of log-normal distributions fitted with location 0."""
    total = F.broadcast(demand.agg(F.sum("demand").alias("total")))
    rel = demand.crossJoin(total).select("src", "prefix", (F.col("demand") / F.col("total")).alias("rel"))
    by_src, by_prefix = rel.groupBy("src").agg(F.sum("rel").alias("s")), rel.groupBy("prefix").agg(F.sum("rel").alias("p"))
    # Every source beside every prefix is the matrix itself; sources are few.
    cells = by_prefix.crossJoin(F.broadcast(by_src)).join(rel, ["src", "prefix"], "left")
    inverse = F.greatest(F.coalesce("rel", F.lit(0.0)), F.lit(floor)) / (F.col("s") * F.col("p"))
    width = lambda df, c: df.agg(F.stddev_pop(F.ln(c)).alias("v"))
    a, r, f = width(by_prefix, F.col("p")), width(by_src, F.col("s")), width(cells, inverse)
    return a.withColumnRenamed("v", "attraction").crossJoin(r.withColumnRenamed("v", "repulsion")).crossJoin(f.withColumnRenamed("v", "friction"))


def gravity_expected(demand: DataFrame) -> DataFrame:
    """(src, prefix, demand): row sum times column sum over the total, for each cell of the matrix."""
    by_src = demand.groupBy("src").agg(F.sum("demand").alias("s"))
    by_prefix = demand.groupBy("prefix").agg(F.sum("demand").alias("p"))
    total = demand.agg(F.sum("demand").alias("t"))
    return by_prefix.crossJoin(F.broadcast(by_src.crossJoin(total))).select("src", "prefix", (F.col("s") * F.col("p") / F.col("t")).alias("demand"))
