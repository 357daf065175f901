"""Centroid clustering against plain k-means in Python integers, and its bounds against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from linkpeak.llm import clusters, registry
from tests.compare import connect, duck_rows, spark_rows

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, vector string, distance double"


def plain(rows, k, rounds, dim=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, text(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in out:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in out]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_same_clusters_as_plain_kmeans(spark):
    draw = random.Random(5)
    vectors = [[draw.choice([-0.5, 0.0, 0.25, 0.5, draw.gauss(0, 0.2)]) for _ in range(64)] for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[7]) for i in range(200, 330)] + [(3, vectors[3]), (3, vectors[4]), (None, vectors[9]), (None, vectors[1])]
    rows += [(400, None), (401, []), (402, [0.1] * 63), (403, [0.1] * 65), (404, [None] + [0.1] * 63), (405, [float("nan")] * 64), (406, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 1, "x", "y", 0.5) for i, v in rows], SCHEMA)
    for k, rounds in ((40, 5), (7, 0), (1, 2)):
        assert order(clusters.cluster_vectors(df.repartition(5), k=k, rounds=rounds).collect()) == order(plain(rows, k, rounds))
    assert order(clusters.cluster_vectors(df.limit(3).coalesce(1), k=40).select("vec_id", "distance").collect()) == [(0, 0), (1, 0), (2, 0)]


def test_nothing_and_too_much(spark):
    assert clusters.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="2\\*\\*53"):
        clusters.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, 1, "", "", 0.0)], SCHEMA)).count()


def test_bounds_keep_ties_and_skip_distances():
    draw = np.random.default_rng(3)
    centres = draw.integers(-200, 200, (12, 8))
    mat = centres[draw.integers(0, 12, 3000)] + draw.integers(-6, 7, (3000, 8))
    mat[:500] = draw.integers(-2, 3, (500, 8)) * 50
    now = np.vstack([centres[:9], centres[:1], mat[:2]]).astype(np.int64)
    block, by, counts = clusters.Bounds(mat, len(now)), None, []
    for _ in range(6):
        if by is not None:
            block = clusters.Bounds(mat, len(now), block.packed())
            block.moved(by)
        counts.append(block.assign(now, clusters._gaps(now)))
        far = ((mat[:, None, :] - now[None]) ** 2).sum(axis=2)
        assert np.array_equal(block.cluster, far.argmin(axis=1))
        assert (block.upper.astype(float) ** 2 >= far.min(axis=1)).all()
        assert (block.lower.astype(float) ** 2 <= far + 1e-9).all()
        new = np.array([mat[block.cluster == j].sum(axis=0) // max(1, (block.cluster == j).sum()) if (block.cluster == j).any() else now[j] for j in range(len(now))])
        by = np.nextafter(np.sqrt(clusters.squares(new, now).astype(float)), np.inf)
        now = new
    assert counts[-1] < 0.2 * mat.shape[0] * len(now)


def test_query_matches_sql(spark):
    assert spark_rows(registry.queries()["op13_clusters"](spark, "/root/testdata/sf0.001")) == duck_rows(connect("sf0.001"), registry.oracle_sql()["op13_clusters"])
