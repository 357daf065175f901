"""Measurement reports: reading the newest CSV, quantiles by group, ratios, distribution functions, text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNNING_TIME = (
    "topo string, num_nodes long, num_edges long, num_externals long, config_seed long, tm_seed long, num_prefixes long, "
    "repulsion_uniform_width double, attraction_shape double, friction_uniform_width double, num_initial_states long, cluster_target long, "
    "cluster_mode string, link_failures long, input_changes string, num_te_paths long, running_time_sec double, analysis_time_sec double, "
    "clustering_time_sec double, clustering_error double, total_demand double, num_clusters long, num_edges_inaccurate_variability long"
)
ACCURACY = (
    "topo string, num_nodes long, num_edges long, num_externals long, config_seed long, tm_seed long, num_prefixes long, "
    "repulsion_measured double, repulsion_target double, repulsion_sampled double, attraction_measured double, attraction_target double, attraction_sampled double, "
    "friction_measured double, friction_target double, friction_sampled double, num_initial_states long, cluster_target long, cluster_mode string, input_changes string, "
    "num_te_paths long, exact_time_sec double, approx_time_sec double, clustering_time_sec double, clustering_error double, total_demand double, num_clusters long, "
    "approx_error_min double, approx_error_max double, approx_error_mean double, approx_error_median double, approx_error_sum double, efficiency_speedup double, num_edges_inaccurate_variability long"
)


def newest_csv(spark: SparkSession, folder: str, prefix: str, schema: str, suffix: str = ".csv", timed: bool = False) -> DataFrame:
    """The rows of the newest file (or folder of part files) ``prefix*suffix`` of a folder, by its name, which ends in a
    time; timed leaves out names without one. Only names are listed, and only that file is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    found = [n for n in names if n.startswith(prefix) and n.endswith(suffix) and (not timed or re.search(r"\d{4}-\d{2}-\d{2}", n))]
    if not found:
        raise FileNotFoundError(f"no {prefix}*{suffix} in {folder}")
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/{max(found)}")


def write_csv(df: DataFrame, path: str) -> None:
    """Adds df to a folder of CSV files with headers."""
    df.write.mode("append").option("header", True).csv(path)


def as_number(text: Column) -> Column:
    """A number, "inf" as infinity."""
    return F.when(F.lower(text) == "inf", F.lit(float("inf"))).otherwise(text.try_cast("double"))


def quantiles(df: DataFrame, keys: list[str], values: list[str], shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact quantiles, interpolated between neighbours, named value_q10 and so on."""
    return df.groupBy(*keys).agg(*[F.percentile(v, F.lit(q)).alias(f"{v}_q{round(q * 100)}") for v in values for q in shares])


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, q25, q50, q75, max and mean by group."""
    return df.groupBy(*keys).agg(F.min(value).alias("min"), *[F.percentile(value, F.lit(q)).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(value).alias("max"), F.avg(value).alias("mean"))


def ratios_to_base(df: DataFrame, keys: list[str], value: str, base: Column) -> DataFrame:
    """Median of value by keys, and its ratio to that of the one group for which base holds."""
    medians = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    one = medians.where(base).select(F.col("median").alias("_base")).limit(1)
    return medians.crossJoin(F.broadcast(one)).withColumn("ratio", F.col("median") / F.col("_base")).drop("_base")


def ratio_ecdf(df: DataFrame, key: str, value: str, over: Column, under: Column, by: list[str]) -> DataFrame:
    """(by, fraction, ecdf): value of the rows ``over`` to that of the rows ``under`` of the same key, by size of the ratio.

    Ratios are counted within their group; groups are series of a chart.
    """
    a, b = df.where(over).select(key, *by, F.col(value).alias("_x")), df.where(under).select(key, F.col(value).alias("_y"))
    rows = a.join(b, key).select(*by, (F.col("_x") / F.col("_y")).alias("fraction"), key)
    group = Window.partitionBy(*by)
    return rows.select(*by, key, "fraction", (F.row_number().over(group.orderBy("fraction", key)) / F.count("*").over(group)).alias("ecdf"))


def percent(load: Column, total: float) -> Column:
    """The share of a load as text of 8 characters."""
    share = load * 100 / F.lit(total)
    return F.when(F.abs(share) <= 1e-9, F.lit("  0%    ")).otherwise(F.format_string("%7.3f%%", F.round(share + 1e-9, 3)))


def bound_text(plus: float, minus: float, total: float) -> str:
    """Bounds of a report as shares of the total: "± x%" where both are alike, else those above zero."""
    p, m = plus * 100 / total, minus * 100 / total
    if abs(p - m) <= 1e-9 * max(abs(p), abs(m), 1.0):
        return f"± {p:.1f}%"
    return " ".join(f"{sign}{x:.1f}%" for sign, x in (("+", p), ("-", m)) if x > 1e-9)


def report_columns(current: DataFrame, results: list[DataFrame]) -> DataFrame:
    """(src, dst, current, r0, r1, ...): the loads of several reports (src, dst, load) side by side; a link that one does
    not name has load 0 there."""
    rows = current.select("src", "dst", F.lit(0).alias("at"), "load")
    for i, result in enumerate(results, 1):
        rows = rows.union(result.select("src", "dst", F.lit(i), "load"))
    of = lambda i: F.coalesce(F.sum(F.when(F.col("at") == i, F.col("load"))), F.lit(0.0))
    return rows.groupBy("src", "dst").agg(of(0).alias("current"), *[of(i + 1).alias(f"r{i}") for i in range(len(results))])


def link_text(report: DataFrame, routers: DataFrame, total: float, bounds: list[tuple[float, float]] = ()) -> DataFrame:
    """(line): "a -> b: current | worst ± bound | ..." of each link of report_columns(), by the routers' names; bounds:
    (plus, minus) of each result."""
    name = lambda end: routers.select(F.col("router_id").alias(end), F.col("name").alias(f"{end}_name"))
    named = report.join(name("src"), "src").join(name("dst"), "dst")
    ends = F.format_string("%20s -> %-20s: ", "src_name", "dst_name")
    more = [F.concat(F.lit(" | "), percent(F.col(f"r{i}"), total), F.lit(f" {bound_text(*bound, total)}")) for i, bound in enumerate(bounds)]
    return named.select(F.concat(ends, percent(F.col("current"), total), *more).alias("line"))


def box_text(five: list[str], digits: int, width: int = 0) -> Column:
    """Columns of numbers (min, quartiles, max) as "[a, b, c, d, e]", padded with zeros to a width."""
    form = f"%0{width}.{digits}f" if width else f"%.{digits}f"
    return F.format_string(f"[{', '.join([form] * len(five))}]", *[F.round(F.col(c) + 1e-12, digits) for c in five])


def box_latex(command: str, five: list[str], digits: int) -> Column:
    """The same as a LaTeX command with an argument for each number."""
    arguments = f"{{%.{digits}f}}" * len(five)
    return F.format_string(f"\\{command}{arguments}", *[F.round(F.col(c) + 1e-12, digits) for c in five])


#: Commands of the box plots of an accuracy table, and the form of their numbers.
PLOTS = (("EpsilonBoxPlot", "clustering_error", 8, 0), ("DeltaBoxPlot", "approx_error_max", 8, 0), ("EfficiencyBoxPlot", "efficiency_speedup", 6, 9))
FIVE = ("min", "q25", "q50", "q75", "max")
WIDTHS = ("repulsion", "attraction", "friction")


def accuracy_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys with five numbers of each measure of PLOTS (measure_min and so on), the mean of the widths sampled and measured, and the
    median share of the clustering error that is the error of loads (fraction)."""
    numbers = [f.alias(f"{c}_{name}") for _, c, *_ in PLOTS for name, f in zip(FIVE, (F.min(c), *[F.percentile(c, F.lit(q)) for q in (0.25, 0.5, 0.75)], F.max(c)), strict=True)]
    means = [F.avg(f"{w}_{x}").alias(f"{w}_{x}") for w in WIDTHS for x in ("measured", "sampled")]
    return rows.groupBy(*keys).agg(*numbers, *means, F.percentile(F.col("approx_error_max") / F.col("clustering_error"), F.lit(0.5)).alias("fraction"))


def accuracy_lines(summary: DataFrame, strong: Column) -> DataFrame:
    """summary with text and latex: a line of each table of accuracy. strong: the number of the width in WIDTHS that a row is about."""

    def box(command: str, c: str, digits: int, width: int) -> Column:
        form = f"{{%0{width}.{digits}f}}" if width else f"{{%.{digits}f}}"
        return F.format_string(f"\\{command}{form * 5}", *[F.round(F.col(f"{c}_{name}") + 1e-12, digits) for name in FIVE])

    def field(i: int, name: str) -> Column:
        numbers = [F.round(F.col(f"{name}_measured") + 1e-12, 2), F.round(F.col(f"{name}_sampled") + 1e-12, 1)]
        return F.when(strong == i, F.format_string("\\textbf{%4.2f (%3.1f)}", *numbers)).otherwise(F.format_string("  \\WEAK{%4.2f (%3.1f)}", *numbers))

    fields = F.concat_ws(" & ", *[field(i, name) for i, name in enumerate(WIDTHS)])
    latex = F.concat(F.lit("  yes & "), F.concat_ws(" & ", fields, *[box(*plot) for plot in PLOTS]), F.lit(" \\\\"))
    boxes = [box_text([f"{c}_{name}" for name in FIVE], 4 if width else 5, 7 if width else 0) for _, c, _, width in PLOTS]
    scenario = F.format_string("%4.2f, %4.2f, %4.2f", *[F.round(F.col(f"{name}_measured") + 1e-12, 2) for name in WIDTHS])
    return summary.withColumns({"latex": latex, "text": F.concat_ws(" | ", scenario, *boxes)})


def graph_counts(links: DataFrame, routers: DataFrame) -> DataFrame:
    """(nodes, edges)"""
    return routers.agg(F.count("*").alias("nodes")).crossJoin(links.agg(F.count("*").alias("edges")))
