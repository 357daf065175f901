"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: what stands between the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may fall back to a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="linkpeak-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Spark's settings for the rows and the bytes that go to Python at once.
AT_ONCE, BYTES_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, *done: DataFrame, at_once: int | None = None, bytes_at_once: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, a lost executor
    costs nothing, and the planner knows the true size when it chooses between broadcast and shuffle.
    Tables ``done`` are deleted then: nothing may read them any more. at_once, bytes_at_once: so many rows at most,
    and so many bytes or one row more, go to Python at once meanwhile, where rows may be large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkpeak-{uuid.uuid4().hex}"
    before, bytes_before = spark.conf.get(AT_ONCE), spark.conf.get(BYTES_AT_ONCE)
    try:
        if at_once:
            spark.conf.set(AT_ONCE, str(min(at_once, int(before)) if int(before) > 0 else at_once))
        if bytes_at_once:
            spark.conf.set(BYTES_AT_ONCE, str(bytes_at_once))
        df.write.parquet(path)
    finally:
        spark.conf.set(AT_ONCE, before)
        if bytes_at_once:
            spark.conf.set(BYTES_AT_ONCE, bytes_before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from materialize(); other DataFrames are left alone."""
    for df in tables:
        if path := df.__dict__.get("_stored"):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1 and so on, and the new name of each: working columns, whose names start with
    "_", can then clash with none."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unmasked(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The columns of a masked DataFrame under their own names, but those that ``more`` replaces, and then these."""
    return df.select(*[F.col(new).alias(old) for old, new in names.items() if old not in more], *more)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash01(*cols: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that the seed and the columns decide."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def join_texts(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on key (null meets null) and text_hash, and keeps those of left."""
    other = right.withColumnsRenamed({"key": "_key", "text_hash": "_hash"})
    return left.join(other, F.col("key").eqNullSafe(F.col("_key")) & (F.col("text_hash") == F.col("_hash")), how).drop("_key", "_hash")
