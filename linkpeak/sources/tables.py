"""A network, its traffic and its rules, from the star-schema tables; the SQL twins of these are in plans/oracles.py."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """The domain relations of one input folder, each a lazy DataFrame."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def routers(self) -> DataFrame:
        """(router_id, name, region)"""
        return self.read("nation").select(F.col("n_nationkey").alias("router_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))

    @cached_property
    def links(self) -> DataFrame:
        """(edge_id, src, dst, weight): a ring over all routers and spokes from the first router of each region, both ways."""
        r = self.routers
        n = r.count()
        ring = r.select(F.col("router_id").alias("a"), ((F.col("router_id") + 1) % n).alias("b"), (1 + F.col("router_id") % 3).alias("weight"))
        hubs = r.groupBy("region").agg(F.min("router_id").alias("a"))
        spokes = r.join(F.broadcast(hubs), "region").where("router_id <> a").select("a", F.col("router_id").alias("b"), (2 + F.col("router_id") % 2).alias("weight"))
        one_way = ring.union(spokes)
        both = one_way.union(one_way.select("b", "a", "weight")).where("a <> b")
        pairs = both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("weight").cast("long").alias("weight"))
        # One row for each link of the topology, so that a window over all of them is small.
        return pairs.select((F.row_number().over(Window.orderBy("src", "dst")) - 1).alias("edge_id"), "src", "dst", "weight")

    @cached_property
    def ext_links(self) -> DataFrame:
        """(ext, router): external routers and the border router each hangs on."""
        return self.read("supplier").select(F.col("s_suppkey").alias("ext"), F.col("s_nationkey").alias("router"))

    @cached_property
    def borders(self) -> DataFrame:
        """(root): routers with an external link."""
        return self.ext_links.select(F.col("router").alias("root")).distinct()

    @cached_property
    def demand(self) -> DataFrame:
        """(src, prefix, demand), unique by (src, prefix), demand above 0."""
        items = self.read("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders, customers = self.read("orders").select("o_orderkey", "o_custkey"), self.read("customer").select("c_custkey", "c_nationkey")
        # Orders, not their many items, are matched with customers; items are dealt by prefix once, for these sums and for all that follow by prefix.
        placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
        rows = items.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select("src", F.col("l_partkey").alias("prefix"), "l_quantity")
        return rows.repartition("prefix").groupBy("src", "prefix").agg(F.sum("l_quantity").alias("demand")).where("demand > 0")

    @cached_property
    def route_state(self) -> DataFrame:
        """(prefix, egress): the two border routers that most of a prefix is supplied from."""
        rows = self.read("lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(self.ext_links, F.col("l_suppkey") == F.col("ext"))
        # Dealt by prefix once, for the sums and the ranks.
        dealt = rows.select(F.col("l_partkey").alias("prefix"), F.col("router").alias("egress"), "l_quantity").repartition("prefix")
        sums = dealt.groupBy("prefix", "egress").agg(F.sum("l_quantity").alias("q"))
        rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("q"), "egress"))
        return sums.withColumn("_r", rank).where("_r <= 2").select("prefix", "egress")

    @cached_property
    def states(self) -> DataFrame:
        """(prefix, egresses): the sorted current egresses of each prefix."""
        return self.route_state.groupBy("prefix").agg(F.array_sort(F.collect_set("egress")).alias("egresses"))

    @cached_property
    def rules(self) -> DataFrame:
        """(prefix, kind): what may change about a prefix: its egress, its ingress or both."""
        size = F.col("p_size") % 10
        return self.read("part").select(F.col("p_partkey").alias("prefix"), F.when(size == 0, "ingress").when(size == 5, "both").otherwise("egress").alias("kind"))

    @cached_property
    def local_prefs(self) -> DataFrame:
        """(egress, local_pref): the preference values that announcements at a border router may carry."""
        return self.read("supplier").select(F.col("s_nationkey").alias("egress"), (100 + 50 * (F.col("s_suppkey") % 3)).alias("local_pref")).distinct()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may fall back to a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="linkpeak-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpointed(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage is cut, and the planner knows its size.
    Tables ``done`` from earlier calls are deleted then: nothing may read them any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linkpeak-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    for old in done:
        if gone := old.__dict__.get("_stored"):
            target = spark._jvm.org.apache.hadoop.fs.Path(gone)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return out
