"""A corpus pipeline of five stages; each gets what the one before kept, written as Parquet and read again.

All stages but the last return the columns of documents. Stages judge their own input: the classifier learns
from the labelled rows of its documents, statistics and groups are those of the rows that reach a stage.
Null and empty texts pass the classifier on their score like others, have no near copies and no benchmark
items, and add no words to the mixture. Texts may have any length; of rows that tie the smaller id or the hash of the row decides, and
rows that repeat stay together or go together, but for near copies, where one row stays. Empty tables pass through. Columns named shard or
slot are an error, told before the first stage; other names are free.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkpeak.llm import decontamination, jaccard, mixing, quality, sharding
from linkpeak.llm.common import remove, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.good_rows(docs, trees)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles reach a similarity of 0.8: that of the smallest id."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (0 to 39) and their slot in it. Rows of files have a locator already."""
    if "_metadata" in docs._jdf.queryExecution().analyzed().metadataOutput().mkString(" "):
        return sharding.interleaved_shards(sharding.located(docs), 40, locator=sharding.LOCATOR)
    return sharding.interleaved_shards(docs, 40)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: No SQL trains a classifier; tests hold run() against a brute-force version of the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    if clash := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
