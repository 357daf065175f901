"""The pipeline's stages on the smallest tables, each against a brute-force version of its decisions."""

import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkpeak.llm import quality
from tests.compare import DATA
from tests.llm.test_corpus_operators import groups_of

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        steps.append(docs.collect())
    whole, good, single, clean, mixed, sharded = steps

    trees = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = trees.score(quality.features(pd.Series([r["text"] for r in whole])))
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r, s in zip(whole, scores, strict=True) if s >= 0.5)

    groups = groups_of([(r["doc_id"], r["text"], None) for r in good], 5, 80)
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, (_, c) in groups.items() if i == c)

    # No item of the tables has fewer than five words.
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    leaks = {r["doc_id"] for r in single for s in items if len(s & shingles(r["text"])) >= 0.8 * len(s)}
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in single if r["doc_id"] not in leaks)

    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 2
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert words(mixed) == pytest.approx(1.5 * words(clean), rel=0.1)
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in clean}

    assert Counter(tuple(r)[: len(columns)] if sharded[0].__fields__[: len(columns)] == columns else tuple(r[c] for c in columns) for r in sharded) == Counter(tuple(r) for r in mixed)
    sizes = Counter(r["shard"] for r in sharded)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1


def test_run_on_odd_and_empty_tables(spark, docs, corpus, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given = docs.withColumns({"label": F.lit(1), "_u": F.lit("u"), "rate": F.lit(2), "_key": F.lit(3)})
    given.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*given.columns, "shard", "slot"]
    rows = out.collect()
    assert {(r["doc_id"], r["text"]) for r in rows} <= {(i, t) for i, t, _ in corpus}
    assert {(r["label"], r["_u"], r["rate"], r["_key"], r["size"], r["score"]) for r in rows} == {(1, "u", 2, 3, 1, 0.5)}
    assert sorted(sum(([n] for n in Counter(r["shard"] for r in rows).values()), []))[-1] <= len(rows) // 40 + 1
    given.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
