"""Labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, label): at most ``limit`` labelled rows that ``keep`` allows, those of the smallest key hashes.

    The labelled keys are bounded by limit (8 bytes each and one for the label), so they are broadcast and
    the texts of the other documents never move. A key with several texts gives one row, that of the smallest
    text hash; a key with several labels has the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & keep).groupBy(key).agg(F.max(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(limit)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    return rows.groupBy(key).agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_label").alias("label")).select("text", "label")
