"""Centroid clustering with Elkan's bounds, exact to the last tie.

Vectors are packed into blocks of some thousand rows, which stay where they are: a round reads the blocks, assigns
their vectors and writes the blocks again, with no shuffle. With each vector stands its cluster, an upper bound of the distance
to that centroid, and a lower bound of the distance to every centroid. When centroids move, bounds move by as much; a
vector whose upper bound lies below half the way to the nearest other centroid, or below its own lower bounds, is not
compared. Bounds are 4-byte floats, rounded away from the side that could prune too much, and prune only where they
are strictly apart, so that a tie is always compared. Compared distances are integers. Sums of a block's clusters are
integers too, one row for each block and cluster; Spark adds them up. Only the centroids, k vectors, pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, materialize, table

#: Rows of a block.
BLOCK = 2048
#: Squared distances must stay below this, so that doubles and sums of blocks hold them exactly.
MOST = 2**53
_BLOCKS = "ids binary, mat binary"
_STATE = "ids binary, mat binary, state binary, sums array<struct<cluster:int,n:long,inertia:long,total:array<long>>>"


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(vector) == dim, F.lit(False)) & F.coalesce(finite, F.lit(False))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, integers."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


class Bounds:
    """The vectors of a block with their clusters and bounds."""

    def __init__(self, mat: np.ndarray, k: int, state: bytes | None = None):
        n = len(mat)
        self.mat = mat
        if state is None:
            self.cluster, self.upper, self.lower = np.zeros(n, dtype=np.int32), np.full(n, np.inf, dtype=np.float32), np.zeros((n, k), dtype=np.float32)
        else:
            part = np.frombuffer(state, dtype=np.float32).reshape(n, k + 2).copy()
            self.cluster, self.upper, self.lower = part[:, 0].view(np.int32).copy(), part[:, 1].copy(), part[:, 2:]

    def packed(self) -> bytes:
        return np.hstack([self.cluster[:, None].view(np.float32), self.upper[:, None], self.lower]).astype(np.float32, copy=False).tobytes()

    def moved(self, by: np.ndarray) -> None:
        """Centroids have moved by these distances (not less than the true ones)."""
        self.upper = _up(self.upper.astype(np.float64) + by[self.cluster])
        self.lower = _down(self.lower.astype(np.float64) - by)

    def assign(self, centroids: np.ndarray, half: np.ndarray) -> int:
        """Moves each vector to its nearest centroid, of equal ones the first; half: half the distances between centroids
        (not more than the true ones), infinite on the diagonal. Gives the number of distances computed."""
        open_rows = np.flatnonzero(~(self.upper < half.min(axis=1)[self.cluster]))
        done = len(open_rows)
        mat, at, lower = self.mat[open_rows], self.cluster[open_rows], self.lower[open_rows]
        best = squares(mat, centroids[at])
        near = np.sqrt(best.astype(np.float64))
        upper = _up(near)
        lower[np.arange(len(at)), at] = _down(near)
        for j in range(len(centroids)):
            rows = np.flatnonzero((at != j) & ~(upper < lower[:, j]) & ~(upper < half[at, j]))
            if not len(rows):
                continue
            done += len(rows)
            d = squares(mat[rows], centroids[j])
            root = np.sqrt(d.astype(np.float64))
            lower[rows, j] = _down(root)
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            rows = rows[nearer]
            at[rows], best[rows], upper[rows] = j, d[nearer], _up(root[nearer])
        self.cluster[open_rows], self.upper[open_rows], self.lower[open_rows] = at, upper, lower
        return done


def _gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, rounded down; infinite from one to itself."""
    half = np.full((len(centroids), len(centroids)), np.inf, dtype=np.float32)
    for j, c in enumerate(centroids):
        half[:, j] = _down(np.sqrt(squares(centroids, c).astype(np.float64)) / 2)
    np.fill_diagonal(half, np.inf)
    return half


def _pack(dim: int):
    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            for start in range(0, len(batch), BLOCK):
                rows = batch.iloc[start : start + BLOCK]
                mat = np.array([np.asarray(v, dtype=np.int64) for v in rows["vector"]]).reshape(len(rows), dim)
                ids = pd.array(rows["vec_id"], dtype="Int64")
                yield pd.DataFrame({"ids": [ids.fillna(0).to_numpy(dtype=np.int64).tobytes() + ids.isna().tobytes()], "mat": [mat.astype(np.int32).tobytes()]})

    return run


def _round(centroids: np.ndarray, by: np.ndarray | None, dim: int):
    """A round over blocks: bounds move by ``by`` (None: the first round), vectors are assigned, clusters summed up."""

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = _gaps(centroids)
        for batch in part:
            for row in batch.itertuples(index=False):
                mat = np.frombuffer(row.mat, dtype=np.int32).reshape(-1, dim).astype(np.int64)
                block = Bounds(mat, len(centroids), None if by is None else row.state)
                if by is not None:
                    block.moved(by)
                block.assign(centroids, half)
                order = np.argsort(block.cluster, kind="stable")
                found, first, n = np.unique(block.cluster[order], return_index=True, return_counts=True)
                totals = np.add.reduceat(mat[order], first, axis=0) if len(first) else mat
                costs = np.add.reduceat(squares(mat[order], centroids[block.cluster[order]]), first) if len(first) else n
                sums = [{"cluster": int(c), "n": int(m), "inertia": int(i), "total": t.tolist()} for c, m, i, t in zip(found, n, costs, totals, strict=True)]
                yield pd.DataFrame({"ids": [row.ids], "mat": [row.mat], "state": [block.packed()], "sums": [sums]})

    return run


def _members(centroids: np.ndarray, dim: int):
    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            for row in batch.itertuples(index=False):
                mat = np.frombuffer(row.mat, dtype=np.int32).reshape(-1, dim).astype(np.int64)
                n = len(mat)
                ids = pd.array(np.frombuffer(row.ids[: 8 * n], dtype=np.int64), dtype="Int64")
                ids[np.frombuffer(row.ids[8 * n :], dtype=bool)] = pd.NA
                cluster = Bounds(mat, len(centroids), row.state).cluster
                yield pd.DataFrame({"vec_id": ids, "cluster": cluster, "distance": squares(mat, centroids[cluster])})

    return run


def elkan(vectors: DataFrame, first: DataFrame, dim: int, rounds: int) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) after ``rounds`` rounds of assignment and
    means, and one assignment more.

    vectors: vec_id, vector of dim integers in doubles (no null among them); first: centroids (cluster 0 to k - 1, vector).
    Distances are squared; of equal distances the smaller number wins. Means are floored; a centroid without
    vectors stays. Rows that repeat, and null ids, count like any others. Without vectors there are no rows. The k
    centroids pass the driver: k times dim integers. Vectors so far apart that a squared distance could pass 2**53 are an
    error. Other columns are left out.
    """
    reach = vectors.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    if dim * (2 * reach) ** 2 >= MOST:
        raise ValueError("squared distances may pass 2**53; use a smaller scale")
    at = first.orderBy("cluster").collect()
    if not at:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["vector"] for r in at]).astype(np.int64).reshape(len(at), dim)
    blocks = materialize(vectors.select("vec_id", "vector").mapInPandas(_pack(dim), _BLOCKS))
    by = None
    for step in range(rounds + 1):
        blocks = materialize(blocks.mapInPandas(_round(centroids, by, dim), _STATE), blocks)
        each = blocks.select(F.inline("sums"))
        if step == rounds:
            break
        sums = each.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)])
        new = centroids.copy()
        for r in sums.collect():
            new[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(dim)]
        by = np.nextafter(np.sqrt(squares(new, centroids).astype(np.float64)), np.inf)
        centroids = new
    costs = each.groupBy("cluster").agg(F.sum("inertia").alias("cluster_inertia"))
    costs = costs.crossJoin(F.broadcast(costs.agg(F.sum("cluster_inertia").alias("inertia"))))
    names = vectors.sparkSession.createDataFrame([(j, ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())], "cluster int, _text string")
    named = costs.join(names, "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2("_text", 256).alias("centroid_sha256"))
    # One row for each of the k centroids.
    return blocks.mapInPandas(_members(centroids, dim), "vec_id long, cluster int, distance long").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2) -> DataFrame:
    """elkan() over the usable vectors of df, each component x as floor(scale * x). The first centroids are the k vectors
    of the smallest sha256 of "seed:key", those of one key by their components, those without a key last."""
    integers = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    # A comparison of doubles up to 2**53 is exact; larger ones are an error anyway.
    kept = materialize(df.where(usable(F.col(vector), dim)).select(F.col(key).cast("long").alias("vec_id"), _wide_floor(integers, F.col(vector), scale).alias("vector")))
    hashed = kept.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    chosen = hashed.orderBy(F.asc_nulls_last("_h"), "vector").limit(k)
    rows = [r["vector"] for r in chosen.select("vector").collect()]
    first = df.sparkSession.createDataFrame(list(enumerate(rows)), "cluster int, vector array<double>")
    out = elkan(kept, first, dim, rounds)
    discard(kept)
    return out


def _wide_floor(integers: Column, vector: Column, scale: float) -> Column:
    """floor() of Spark gives a long; components beyond it stay as they are, to be an error later."""
    far = F.exists(vector, lambda x: F.abs(x.cast("double")) * scale >= 2.0**53)
    return F.when(far, F.transform(vector, lambda x: x.cast("double") * scale)).otherwise(integers)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all embeddings, five rounds."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    distance = "list_inner_product(v.e, v.e) + list_inner_product(c.e, c.e) - 2 * list_inner_product(v.e, c.e)"
    parts = [
        """v AS (SELECT row_number() OVER (ORDER BY vec_id, e) AS row, vec_id, e FROM (
  SELECT vec_id, [CAST(floor(256 * x::DOUBLE) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0))""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS cluster, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT v.row, min([CAST({distance} AS BIGINT), c.cluster]) AS d FROM v, c{i} c GROUP BY v.row)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT d.d[2] AS cluster, t.i, sum(v.e[t.i])::BIGINT AS s, count(*) AS n FROM d{i} d JOIN v ON v.row = d.row CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t GROUP BY 1, 2)")
            mean = "list((s - ((s % n) + n) % n) // n ORDER BY i)"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT cluster, {mean} AS e FROM s{i} GROUP BY 1) m ON m.cluster = c.cluster)")
    parts.append(f"r AS (SELECT v.vec_id, CAST(d.d[2] AS INTEGER) AS cluster, d.d[1] AS distance FROM d{rounds} d JOIN v ON v.row = d.row)")
    return (
        "WITH "
        + ", ".join(parts)
        + f""" SELECT r.vec_id, r.cluster, r.distance, CAST(sum(r.distance) OVER (PARTITION BY r.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(r.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM r JOIN c{rounds} c ON c.cluster = r.cluster"""
    )


OP13_SQL = _sql()
