"""Clashing column names, very long texts and repeated rows, for operators whose own tests have none."""

import random

import pytest
from pyspark.sql import functions as F

from linkpeak.llm import jaccard, licenses, mixing, pii, quality, sharding, topk, toxicity
from tests.llm.conftest import words

CLASHES = ["words", "spans", "kind", "base", "hits", "normal", "key", "text_hash", "body", "label", "x", "score", "template", "rate", "ids", "mat"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(12)
    long = words(draw, 200_000)
    out = [None, "", "mail a.b@c.org now", "call +44 20 7946 0958 or", f"{words(draw, 30)} released under the MIT license {words(draw, 9)}"]
    return [*out, long + " under the mit license and x@y.org", long + " changed end", words(draw, 50), out[2], out[4]]


@pytest.fixture(scope="module")
def frames(spark, texts):
    plain = spark.createDataFrame([(i, t, "s0" if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    plain = plain.union(plain.where("doc_id IN (2, 4, 7)"))
    return plain, plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("find", [pii.find, licenses.scan])
def test_other_columns_are_not_looked_at(frames, find):
    plain, clashing = (find(df) for df in frames)
    assert rows(plain[0]) == rows(clashing[0])
    assert rows(plain[1]) == rows(clashing[1])
    assert plain[0].count() == 13


def test_long_texts_are_read_to_their_end(frames):
    plain, clashing = frames
    seen, _ = licenses.scan(plain)
    base = {r["key"]: [b["label"] for b in r["base"]] for r in seen.collect()}
    assert base[4] == base[5] == base[9] == ["mit"]
    assert base[6] == []
    assert {r["doc_id"]: r["size"] for r in mixing.mix(clashing).collect()}[5] == 200_006
    found = {r["key"]: r["component"] for r in jaccard.similar_groups(plain, 3, 90).collect()}
    assert found[5] == found[6] == 5
    shards = sharding.interleaved_shards(clashing, 5).collect()
    assert sorted(r["shard"] for r in shards) == sorted(i * 5 // 13 for i in range(13))
    assert {"words", "mat", "shard", "slot"} <= set(shards[0].asDict())


def test_repeated_rows_score_alike(spark, frames, texts):
    _, clashing = frames
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    trees, machine = quality.train(clashing, labels), toxicity.train(clashing, labels)
    for scored in (quality.score_quality(clashing, trees), toxicity.score_toxicity(clashing, machine)):
        assert sorted(scored.columns) == sorted(clashing.columns)
        by_text = {}
        for r in scored.collect():
            by_text.setdefault(r["text"] or "", set()).add(r["score"])
            assert 0 <= r["score"] <= 1
            assert r["words"] == 0
        assert all(len(scores) == 1 for scores in by_text.values())


def test_top_k_beside_clashing_columns(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, -0.5 * i]) for i in range(30)], "vec_id long, vector array<double>")
    more = vectors.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("ids", "mat", "home", "lo", "width", "rank", "query_id"))])
    assert rows(topk.top_k(vectors, vectors.where("vec_id % 5 = 0"), 4)) == rows(topk.top_k(more, more.where("vec_id % 5 = 0"), 4))
