"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source, ranked there, and ordered over all sources by
their fractional rank ``(rank + 1/2) / rows of the source``. Cutting that order into equal runs gives
every shard the mixture of the whole, and row counts that differ by one at most.

Only narrow rows are ordered: a locator, the source and hashes. They are dealt by ranges of the order's keys, the
locator last, so that neither a hot source nor rows that are all alike meet in one task; a row's place is its place
in its range plus the rows of the ranges before. Whole rows move once, when they meet their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, materialize, table

#: Columns that tell the rows of a table apart.
LOCATOR = ("_linkpeak_file", "_linkpeak_row")


def located(files: DataFrame) -> DataFrame:
    """files, as read by spark.read without anything done to it, with LOCATOR: a hash of the file's path, and the row's number."""
    return files.select("*", F.xxhash64("_metadata.file_path").alias(LOCATOR[0]), F.col("_metadata.row_index").alias(LOCATOR[1]))


def _numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows, written, with their place (from 0) in the order of all rows; order must tell all rows apart."""
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(many, *order).withColumn("_range", F.spark_partition_id()))
    # One row for each range, so for each task: their running sum is small.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_in", inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_in"))
    return materialize(placed.drop("_range", "_before", "_in"), dealt)


def interleaved_shards(docs: DataFrame, n_shards: int, source: str = "source", keys: tuple[str, ...] = ("doc_id",), seed: int = 7, locator: tuple[str, ...] | None = None) -> DataFrame:
    """docs with ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    keys seed the shuffle; a hash of the whole row breaks their ties, and what it leaves open are rows that are the
    same. locator names columns of docs that tell its rows apart and are stable; they are dropped. Without them docs
    is written once with row numbers. Null sources are one source, null keys are values like any other, texts may
    have any length (only their hashes are sorted), and an empty table stays empty. Columns shard and slot of docs,
    or one named like LOCATOR, are an error; all other names are free.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    if clash := [c for c in docs.columns if c in {"shard", "slot", *LOCATOR} and c not in (locator or ())]:
        raise ValueError(f"columns already there: {clash}")
    columns = [c for c in docs.columns if c not in (locator or ())]
    if locator is None:
        locator = LOCATOR[1:]
        docs = materialize(docs.withColumn(locator[0], F.monotonically_increasing_id()))
    place = [f"_l{i}" for i in range(len(locator))]
    narrow = docs.select(
        *[F.col(c).alias(p) for c, p in zip(locator, place, strict=True)],
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_s"),
        F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]).alias("_u"),
        F.xxhash64(*[F.col(c) for c in columns]).alias("_h"),
    )
    ranked = _numbered(narrow, ["_s", "_u", "_h", *place], "_at")
    sources = materialize(ranked.groupBy("_s").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    total = sources.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    ranked = ranked.join(sources, "_s").withColumn("_frac", (F.col("_at") - F.col("_first") + 0.5) / F.col("_n")).drop("_at", "_first", "_n")
    placed = _numbered(ranked.withColumn("_t", F.xxhash64(F.lit(seed), "_s")), ["_frac", "_t", "_s", "_u", "_h", *place], "_at")
    discard(sources)
    # Exact integer cut: shard s holds the places from ceil(s * total / n) on.
    shard = F.expr(f"(_at * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"((({n_shards}L - 1) + _shard * {max(total, 1)}L) div {n_shards}L)")
    places = placed.withColumn("_shard", shard).select(*[F.col(p).alias(c) for c, p in zip(locator, place, strict=True)], F.col("_shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot"))
    return docs.join(places, list(locator)).select(*columns, "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``rows``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = interleaved_shards(docs, 40, keys=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
