"""Exact top-k inner products by distributed histogram selection.

Vectors are packed into blocks of some thousand rows. Every block of queries meets every block of
candidates, one matrix product each; that is the work any exact search has. No scores are kept: each
pass scores the blocks anew and sums up, for each query, a histogram of its scores inside the window that
holds the k-th highest one. The window shrinks to one bin a pass until it is a single score, the k-th value.
A last pass keeps what lies above it and, of the scores equal to it, the smallest ids, at most k rows for
each query and block, so that ties of any number stay small. A window over those few rows sets the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkpeak.llm.common import materialize, table

#: Rows of a block; with float64 vectors of some hundred components a block takes a few MB.
BLOCK = 2048
#: Bins a pass. Scores are integers, so a range of 2**30 takes 3 passes.
BINS = 1024


def _blocks(part: Iterator[pd.DataFrame], dim: int, scale: float) -> Iterator[pd.DataFrame]:
    ids, rows = [], []

    def packed() -> pd.DataFrame:
        mat = np.zeros((len(ids), dim), dtype=np.float64)
        for i, row in enumerate(rows):
            mat[i, : len(row)] = row
        mat = np.floor(scale * mat)
        # Integers of up to 53 bits; most fit into 2 bytes.
        kind = np.int16 if np.abs(mat).max(initial=0) < 2**15 else np.float64
        key = np.array(ids, dtype=np.int64)
        return pd.DataFrame({"home": [int(key[0] % 1_000_003)], "ids": [key.tobytes()], "wide": [kind is np.float64], "mat": [mat.astype(kind).tobytes()]})

    for batch in part:
        for vec_id, vector in zip(batch["vec_id"], batch["vector"], strict=True):
            ids.append(vec_id)
            rows.append(np.asarray(vector, dtype=np.float64))
            if len(ids) == BLOCK:
                yield packed()
                ids, rows = [], []
    if ids:
        yield packed()


def _unpack(ids: bytes, wide: bool, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(ids, dtype=np.int64)
    return key, np.frombuffer(mat, dtype=np.float64 if wide else np.int16).reshape(len(key), -1).astype(np.float64)


def _scored(part: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of blocks: its row, query ids, candidate ids, and scores with -inf for a query's own row."""
    for batch in part:
        for row in batch.itertuples(index=False):
            qid, q = _unpack(row.q_ids, row.q_wide, row.q_mat)
            cid, c = _unpack(row.ids, row.wide, row.mat)
            scores = q @ c.T
            scores[qid[:, None] == cid[None, :]] = -np.inf
            yield row, qid, cid, scores


def _histogram(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row, qid, _, scores in _scored(part):
        lo, width = np.frombuffer(row.lo, dtype=np.float64)[:, None], np.frombuffer(row.width, dtype=np.float64)[:, None]
        at = np.floor((scores - lo) / width)
        inside = (at >= 0) & (at < BINS)
        q, _ = np.nonzero(inside)
        flat, counts = np.unique(q * BINS + at[inside].astype(np.int64), return_counts=True)
        yield pd.DataFrame({"query_id": qid[flat // BINS], "bin": (flat % BINS).astype(np.int32), "n": counts.astype(np.int64)})


def _survivors(k: int):
    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, qid, cid, scores in _scored(part):
            kth = np.frombuffer(row.lo, dtype=np.float64)[:, None]
            q, c = np.nonzero(scores >= kth)
            found = pd.DataFrame({"query_id": qid[q], "vec_id": cid[c], "score": scores[q, c].astype(np.int64)})
            found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            yield found[found.groupby("query_id").cumcount() < k]

    return run


def _range(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in part:
        for row in batch.itertuples(index=False):
            _, m = _unpack(row.ids, row.wide, row.mat)
            yield pd.DataFrame({"norm": [float(np.sqrt((m * m).sum(axis=1)).max(initial=0))]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * component).

    vectors and queries have vec_id long and vector array<double>. Rows with a null id, a null vector or a
    component that is null or not finite take no part. A query's own id is no candidate of it. Shorter
    vectors count as padded with zeros; empty ones score 0. Ties go to the smaller vec_id; a candidate row
    that repeats is ranked as often as it occurs, a query that repeats is answered once (of different vectors under
    one id by the smallest). Vectors may have any length. Scores must stay below 2**53, what doubles hold exactly;
    vectors so large that they might not are an error. Other columns,
    whatever their names, are not looked at. Empty tables give no rows.
    """
    whole = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors, queries = vectors.where(whole).select("vec_id", "vector"), queries.where(whole).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    dim = vectors.select(F.size("vector").alias("d")).union(queries.select(F.size("vector").alias("d"))).agg(F.max("d")).first()[0] or 0
    kind = "home long, ids binary, wide boolean, mat binary"
    pack = lambda df: materialize(df.mapInPandas(lambda part: _blocks(part, dim, scale), kind))
    groups = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = pack(vectors.repartition(groups, "vec_id")).withColumn("home", F.pmod("home", F.lit(groups)))
    asked = pack(queries.repartition(groups, "vec_id").coalesce(max(1, groups // 8)))
    # No score is beyond the product of the largest norms, so the first window holds them all.
    norms = [df.mapInPandas(_range, "norm double").agg(F.max("norm")).first()[0] or 0.0 for df in (blocks, asked)]
    reach = float(np.ceil(norms[0] * norms[1])) + 1
    if reach > 2**53:
        raise ValueError("scores may pass 2**53; use a smaller scale")
    width = 1.0
    while width * BINS < 2 * reach + 1:
        width *= BINS
    ids = asked.select(F.explode(_ids_of("ids")).alias("query_id"))
    windows = materialize(ids.select("query_id", F.lit(-reach).alias("lo"), F.lit(width).alias("width"), F.lit(k).cast("long").alias("need")))
    while True:
        pairs = _pairs(asked, blocks, windows, groups)
        bins = pairs.mapInPandas(_histogram, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        hit = bins.withColumn("upto", F.sum("n").over(down)).join(windows.select("query_id", "need"), "query_id").where("upto >= need")
        hit = hit.groupBy("query_id").agg(F.max(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))).alias("hit"))
        # A query with fewer than k candidates has no such bin: it keeps everything from its window's low end on.
        found = windows.join(hit, "query_id", "left")
        step = F.greatest(F.lit(1.0), F.col("width") / BINS)
        windows = materialize(
            found.select(
                "query_id",
                F.when(F.col("hit").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("hit.bin") * F.col("width")).alias("lo"),
                F.when(F.col("hit").isNull() | (F.col("width") == 1), F.lit(1.0)).otherwise(step).alias("width"),
                F.coalesce("hit.need", "need").alias("need"),
            )
        )
        if width == 1:
            break
        width /= BINS
    kept = _pairs(asked, blocks, windows, groups).mapInPandas(_survivors(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ids_of(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: np.frombuffer(x, dtype=np.int64))


def _pairs(asked: DataFrame, blocks: DataFrame, windows: DataFrame, groups: int) -> DataFrame:
    """Each block of queries, with its windows, beside each block of candidates."""
    state = asked.select(F.col("ids").alias("q_ids"), F.posexplode(_ids_of("ids")).alias("at", "query_id")).join(windows, "query_id")
    state = state.groupBy("q_ids").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "width"))).alias("w"))
    q = asked.select(F.col("ids").alias("q_ids"), F.col("wide").alias("q_wide"), F.col("mat").alias("q_mat")).join(state, "q_ids")
    q = q.select("q_ids", "q_wide", "q_mat", _doubles(F.col("w.lo")).alias("lo"), _doubles(F.col("w.width")).alias("width"))
    q = q.withColumn("home", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return q.join(blocks, "home")


@F.pandas_udf(T.BinaryType())
def _doubles(values: pd.Series) -> pd.Series:
    return values.map(lambda x: np.asarray(x, dtype=np.float64).tobytes())


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
