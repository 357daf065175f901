"""Seeded generators: complete graphs, link weights, externals, states, traffic matrices and explicit paths' ends.

Every value is a hash of the seed and the row's keys put through the inverse of a distribution function, so
that rows need no order, no shared state and no driver. The hash is MD5, which every SQL engine has, so that what is
drawn here can be drawn there as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkpeak.sources.hashes import Tails
from linkpeak.sources.tables import checkpointed

#: A distribution: a column from a seed and the columns that tell rows apart.
Draw = Callable[..., Column]


def draw(seed: int, *keys: Column | str) -> Column:
    """A whole number below 2**52; keys are compared as text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is found once for each row: Spark else copies it to every place, lambdas' bodies too, that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all tasks by its keys: a short file is one task's, but each of its rows asks for many draws."""
    spark = df.sparkSession
    return df.repartition(2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1)."""
    return (draw(seed, *keys) + 0.5) / float(1 << 52)


def between(low: float, high: float) -> Draw:
    return lambda seed, *keys: low + (high - low) * uniform(seed, *keys)


def normal(mean: float = 0.0, deviation: float = 1.0) -> Draw:
    """By Box and Muller."""
    return lambda seed, *keys: mean + deviation * F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 7919, *keys))


def exponential(rate: float) -> Draw:
    return lambda seed, *keys: -F.ln(uniform(seed, *keys)) / rate


def poisson_steps(mean: float) -> list[float]:
    """The distribution function at 0, 1 and so on, as far as a double tells it from 1."""
    most = int(mean + 12 * math.sqrt(mean) + 30)
    return list(accumulate(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(most)))


def poisson(mean: float) -> Draw:
    """How many values of the distribution function lie below a uniform number."""
    steps = poisson_steps(mean)
    return lambda seed, *keys: once(uniform(seed, *keys), lambda u: F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda x: x < u))).cast("double")


def _stream(seeds: np.ndarray, step: int) -> np.ndarray:
    """The step-th uniform number in (0, 1) of each seed, all seeds at once: mixed bits of seed and step."""
    z = seeds + np.uint64(0x9E3779B97F4A7C15) * np.uint64(step + 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def _gammas(seeds: np.ndarray, shape: float, first: int) -> np.ndarray:
    """A gamma number for each seed by squeezed normals (Marsaglia and Tsang); those that are refused draw again."""
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    out, left, step = np.zeros(len(seeds)), np.arange(len(seeds)), first
    while len(left):
        u, v, w = (_stream(seeds[left], step + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = np.maximum(1 + x / np.sqrt(9 * d), 0) ** 3
        taken = (cube > 0) & (np.log(w) < x * x / 2 + d - d * cube + d * np.log(np.maximum(cube, 1e-300)))
        out[left[taken]] = d * cube[taken]
        left, step = left[~taken], step + 3
    return out if shape >= 1 else out * _stream(seeds, first + (1 << 20)) ** (1 / shape)


def beta(a: float, b: float) -> Draw:
    """For whole a and b the a-th smallest of a + b - 1 uniform numbers; for others a ratio of gamma numbers, by numpy for whole batches."""
    if float(a).is_integer() and float(b).is_integer() and a >= 1 and b >= 1:
        n = int(a + b - 1)
        return lambda seed, *keys: F.element_at(F.array_sort(F.array(*[uniform(seed + 101 * i, *keys) for i in range(n)])), int(a))

    @F.pandas_udf("double")
    def by_numpy(seeds: pd.Series) -> pd.Series:
        x = seeds.to_numpy(dtype=np.uint64)
        one, two = _gammas(x, a, 0), _gammas(x, b, 1 << 30)
        return pd.Series(one / (one + two))

    return lambda seed, *keys: by_numpy(draw(seed, *keys))


def log_normal(sigma: float) -> Draw:
    return lambda seed, *keys: F.exp(normal(0.0, sigma)(seed, *keys))


def log_normal_mean_one(cv: float) -> Draw:
    """Log-normal of mean 1 and the given coefficient of variation."""
    sigma2 = math.log(1 + cv * cv)
    return lambda seed, *keys: F.exp(normal(-sigma2 / 2, math.sqrt(sigma2))(seed, *keys))


def shifted_pareto(shape: float) -> Draw:
    """Pareto of median 1, moved to start at 0."""
    scale = 2 ** (-1 / shape)
    return lambda seed, *keys: scale * F.pow(uniform(seed, *keys), F.lit(-1 / shape)) - scale


def uniform_around_one(width: float) -> Draw:
    return between(1 - width / 2, 1 + width / 2)


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    """(edge_id, src, dst, weight 1): all ordered pairs of n routers."""
    pairs = spark.range(n).select(F.col("id").cast("int").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("dst")).where("src <> dst")
    return pairs.select((F.col("src") * (n - 1) + F.col("dst") - (F.col("dst") > F.col("src")).cast("int")).alias("edge_id"), "src", "dst", F.lit(1).cast("long").alias("weight"))


def random_weights(links: DataFrame, seed: int, low: int = 10, high: int = 100) -> DataFrame:
    """Links with integer weights from low to high, the same in both directions."""
    return links.withColumn("weight", low + F.pmod(draw(seed, F.least("src", "dst"), F.greatest("src", "dst")), F.lit(high - low + 1)))


def internal_graph(links: DataFrame, routers: DataFrame, kind: str = "kind") -> DataFrame:
    """(edge_id, src, dst, weight) of a network's links between internal routers, weights rounded to whole numbers."""
    inside = routers.where(F.col(kind) == "internal").select("router_id")
    both = links.join(inside.withColumnRenamed("router_id", "src"), "src", "left_semi").join(inside.withColumnRenamed("router_id", "dst"), "dst", "left_semi")
    return both.select("edge_id", "src", "dst", F.round("weight").cast("long").alias("weight"))


def external_routers(routers: DataFrame, count: int, seed: int) -> DataFrame:
    """(ext, router): count externals on routers in a drawn order, in turn if there are more externals than routers."""
    # One row for each router of a topology, so that a window over all of them is small.
    order = F.row_number().over(Window.orderBy(draw(seed, "router_id"), "router_id"))
    placed = routers.select("router_id", order.alias("_r"))
    total = max(placed.count(), 1)
    many = placed.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(max(-(-count // total) - 1, 0))))).select((F.col("_t") * total + F.col("_r") - 1).alias("ext"), F.col("router_id").alias("router"))
    return many.where(F.col("ext") < count)


def scenario(links: DataFrame, routers: DataFrame, externals: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """A topology (edge_id, src, dst) as a network: links with drawn weights, and ext_links (ext, router) of so many
    external routers. Every border router announces to all others, so that this is all that routing needs."""
    return random_weights(links, seed), external_routers(routers, externals, seed + 1)


#: Rows, and externals, that a task sets against each other at once.
ROWS, EXTERNALS = 512, 65536


def _chosen(rows: DataFrame, ext_links: DataFrame, seed: int, by: str, many: Column) -> DataFrame:
    """(by, ext): for each of the rows the first ``many`` externals in the order that is drawn for it.

    Each row meets each external, which is what is asked for: that many hashes are made, in numpy, of blocks of rows beside blocks of
    externals. Of a pair of blocks no more than ``many`` externals of a row go on.
    """
    kind, ext_kind = dict(rows.dtypes)[by], dict(ext_links.dtypes)["ext"]
    dealt = max(-(-rows.count() // ROWS), 1)
    keyed = rows.select(by, many.cast("int").alias("many"), F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string")).alias("head"))
    some = ext_links.where("ext IS NOT NULL")
    parts = max(-(-some.count() // EXTERNALS), 1)
    homes = keyed.groupBy(F.pmod(F.xxhash64("head"), F.lit(dealt)).cast("int").alias("_home")).agg(F.collect_list(F.struct(by, "many", "head")).alias("rows"))
    # A block of rows is a task, some seconds' work where externals are many: what is dealt by hashes leaves one task several of them.
    homes = homes.repartitionById(dealt, "_home")
    exts = some.groupBy(F.pmod(F.xxhash64("ext"), F.lit(parts)).alias("_part")).agg(F.array_sort(F.collect_list("ext")).alias("exts"))

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            for own, exts in zip(batch["rows"], batch["exts"], strict=True):
                best = Tails([f"|{e}".encode() for e in exts]).firsts([row["head"].encode() for row in own], [row["many"] for row in own])
                out = [(row[by], row["many"], h, exts[i]) for row, some in zip(own, best, strict=True) for h, i in some]
                yield pd.DataFrame(out, columns=[by, "many", "h", "ext"])

    found = homes.select("rows").crossJoin(F.broadcast(exts.select("exts"))).mapInPandas(run, f"{by} {kind}, many int, h long, ext {ext_kind}")
    firsts = found.groupBy(by).agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "ext"))), 1, F.first("many")).alias("c"))
    return firsts.select(by, F.explode("c.ext").alias("ext"))


def random_states(prefixes: DataFrame, ext_links: DataFrame, seed: int) -> DataFrame:
    """(prefix, ext): one external for 60 % of prefixes, two for 30 %, three for 10 %."""
    u = uniform(seed, "prefix")
    return _chosen(prefixes.select("prefix").distinct(), ext_links, seed + 1, "prefix", F.when(u < 0.6, 1).when(u < 0.9, 2).otherwise(3))


#: By the number of distinct states wanted, the chance that a prefix takes the first one.
STATE_CHANCES = {10: 0.7, 20: 0.45, 30: 0.31, 40: 0.24, 50: 0.19, 60: 0.16, 70: 0.14, 80: 0.12, 90: 0.105, 100: 0.095}


def pooled_states(prefixes: DataFrame, ext_links: DataFrame, states: int, seed: int) -> DataFrame:
    """(prefix, ext): prefixes share about so many distinct states (10, 20, ... 100); which one they take is geometric.

    A state has 1 to 4 externals, with shares 0.3, 0.3, 0.2 and 0.2. States are drawn by their number, so that only
    those which a prefix takes come into being.
    """
    if states not in STATE_CHANCES:
        raise ValueError(f"states must be one of {sorted(STATE_CHANCES)}")
    state = F.floor(F.ln(uniform(seed, "prefix")) / math.log(1 - STATE_CHANCES[states])).cast("int")
    u = uniform(seed + 2, "state")
    many = F.when(u < 0.3, 1).when(u < 0.6, 2).when(u < 0.8, 3).otherwise(4)
    taken = prefixes.select("prefix", state.alias("state"))
    drawn = _chosen(taken.select("state").distinct(), ext_links, seed + 3, "state", many)
    return taken.join(drawn, "state").select("prefix", "ext")


def _cells(sources: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(src, prefix, _n): every source beside every prefix, which is the matrix itself; _n is the number of sources."""
    few = F.broadcast(sources.select("src").distinct().agg(F.array_sort(F.collect_list("src")).alias("_all")))
    return spread(prefixes.select("prefix"), "prefix").crossJoin(few).select("prefix", F.explode("_all").alias("src"), F.size("_all").alias("_n"))


def gravity(sources: DataFrame, prefixes: DataFrame, seed: int, repulsion: Draw, attraction: Draw, friction: Draw, invert_friction: bool = False, renormalise_attraction: bool = False) -> DataFrame:
    """(src, prefix, demand): repulsion of the source times attraction of the prefix, over (inverted: times) their
    friction, times sources over prefixes. Renormalised, prefixes have the shares of traffic that attraction gives them."""
    rep, att, fri = repulsion(seed, "src"), attraction(seed + 1, "prefix"), friction(seed + 2, "src", "prefix")
    # What depends on the source or the prefix alone is drawn before they meet.
    few = F.broadcast(sources.select("src").distinct().select("src", rep.alias("rep")).agg(F.array_sort(F.collect_list(F.struct("src", "rep"))).alias("_all")))
    rows = spread(prefixes.select("prefix"), "prefix").withColumn("att", att).crossJoin(few)
    cells = rows.select("prefix", "att", F.explode("_all").alias("c"), F.size("_all").alias("_n")).select("prefix", "att", "c.src", "c.rep", "_n")
    scale = F.col("_n") / F.lit(max(prefixes.count(), 1))
    demand = cells.select("src", "prefix", (F.col("rep") * F.col("att") * (fri if invert_friction else 1 / fri) * scale).alias("demand"), "att")
    if not renormalise_attraction:
        return demand.drop("att")
    # Drawn once, then read for the sums and for the result.
    demand = checkpointed(demand)
    return renormalised(demand.drop("att"), demand.groupBy("prefix").agg(F.first("att").alias("attraction")))


def iid(sources: DataFrame, prefixes: DataFrame, seed: int, distribution: Draw) -> DataFrame:
    """(src, prefix, demand): one draw for each cell."""
    return _cells(sources, prefixes).select("src", "prefix", distribution(seed, "src", "prefix").alias("demand"))


def all_pairs(routers: DataFrame, seed: int, repulsion: Draw, attraction: Draw, friction: Draw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traffic between all routers: one external and one prefix for each router (of its number), demand (src, prefix,
    demand) as repulsion times attraction times friction, ext_links (ext, router), and the state (prefix, ext)."""
    ext_links = routers.select(F.col("router_id").alias("ext"), F.col("router_id").alias("router"))
    cells = _cells(routers.select(F.col("router_id").alias("src")), routers.select(F.col("router_id").cast("long").alias("prefix")))
    product = repulsion(seed, "src") * attraction(seed + 1, "prefix") * friction(seed + 2, "src", "prefix")
    return cells.select("src", "prefix", product.alias("demand")), ext_links, ext_links.select(F.col("ext").cast("long").alias("prefix"), "ext")


def renormalised(demand: DataFrame, attraction: DataFrame) -> DataFrame:
    """Demand scaled so that each prefix's share of the total is its share of all attraction (prefix, attraction)."""
    total = demand.agg(F.sum("demand").alias("_total"))
    all_att = attraction.agg(F.sum("attraction").alias("_att"))
    sums = demand.groupBy("prefix").agg(F.sum("demand").alias("_sum"))
    factor = sums.join(attraction, "prefix").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_att)).select("prefix", (F.col("attraction") / F.col("_att") * F.col("_total") / F.col("_sum")).alias("_f"))
    return demand.join(factor, "prefix").select("src", "prefix", (F.col("demand") * F.col("_f")).alias("demand"))


def parse_edges(df: DataFrame, text: str = "edges", key: str = "graph") -> DataFrame:
    """(key, src, dst, weight, src_id, dst_id) from strings "a:b:cost;...": no loops, the first of repeated pairs, and
    ids of nodes in the order in which a string names them (loops and repeats name them as well)."""
    parts = df.select(key, F.posexplode(F.split(F.col(text), ";")).alias("at", "e")).where("e <> ''").select(key, "at", F.split("e", ":").alias("p"))
    rows = parts.select(key, "at", F.element_at("p", 1).alias("src"), F.element_at("p", 2).alias("dst"), F.element_at("p", 3).cast("long").alias("weight"))
    named = rows.select(key, (2 * F.col("at")).alias("at"), F.col("src").alias("node")).union(rows.select(key, 2 * F.col("at") + 1, "dst"))
    first = named.groupBy(key, "node").agg(F.min("at").alias("at"))
    ids = first.select(key, "node", (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("id"))
    edges = rows.where("src <> dst").groupBy(key, "src", "dst").agg(F.min_by("weight", "at").alias("weight"))
    end = lambda name: ids.select(key, F.col("node").alias(name), F.col("id").alias(f"{name}_id"))
    return edges.join(end("src"), [key, "src"]).join(end("dst"), [key, "dst"]).select(key, "src", "dst", "weight", "src_id", "dst_id")
