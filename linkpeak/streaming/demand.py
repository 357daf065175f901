"""Demand that arrives as a stream: the traffic matrix of each time window, for the batch analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_demand(rows: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, src, prefix, demand) for each window of a stream or table of (time, src, prefix, demand).

    On a stream, rows that come later than ``late`` behind the newest are left out, and a window is given out once it is closed.
    """
    sums = rows.withWatermark(time, late).groupBy(F.window(time, length), "src", "prefix").agg(F.sum("demand").alias("demand"))
    return sums.select(F.col("window.start").alias("start"), "src", "prefix", "demand")
