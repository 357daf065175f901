"""Contexts against a graph in plain Python, spans over words, bounds of the labelled sample, common shingles, names in the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkpeak.llm import decontamination, mixing, pii, toxicity
from tests.llm.conftest import words

FIELDS = "key long, text_hash long, start int, stop int, value string, before2 string, before string, after string, kind string"


def contexts_of(row):
    out = []
    if row["before2"] and row["before"]:
        out.append(f"2 {row['before2']} {row['before']}")
    if row["before"] and row["before"][-1] in ":=#":
        out.append(f"1 {row['before']}")
    if row["before"] and row["after"]:
        out.append(f"b {row['before']} _ {row['after']}")
    return out


def bootstrapped(rows, seeds, confidence, tolerance):
    """The same fixed point over dictionaries."""
    kind_of = {}
    for r in rows:
        for p in contexts_of(r):
            known = kind_of.setdefault(p, {})
            known[r["value"]] = max(filter(None, (known.get(r["value"]), r["kind"])), default=None)
    kind_of = {p: values for p, values in kind_of.items() if len(values) >= seeds}
    scores, worth = None, {}
    while True:
        count = {}
        for p, values in kind_of.items():
            for v, kind in values.items():
                for of in {kind} if kind else {o for (w, o) in worth if w == v and scored(worth[v, o], p) >= confidence}:
                    count[p, of] = count.get((p, of), 0) + 1
        of_pattern = {}
        for (p, of), n in count.items():
            if n >= seeds:
                of_pattern[p] = max(of_pattern.get(p, (0, "")), (n, of))
        new = {}
        for p, (_, of) in of_pattern.items():
            each = [1.0 if kind == of else 0.0 if kind else scored(worth.get((v, of)), p) for v, kind in kind_of[p].items()]
            new[p, of] = sum(each) / len(each)
        if scores is not None and new.keys() == scores.keys() and all(abs(new[x] - scores[x]) <= tolerance for x in new):
            break
        scores, worth = new, {}
        for (p, of), score in new.items():
            for v, kind in kind_of[p].items():
                if kind is None:
                    worth.setdefault((v, of), []).append((score, p))
    strong = {p: (s, of) for (p, of), s in new.items() if s >= confidence}
    hits = {}
    for r in rows:
        if r["kind"] is None:
            found = [strong[p] for p in contexts_of(r) if p in strong]
            if found:
                hits[r["key"], r["text_hash"], r["start"], r["stop"]] = max(found)[1]
    return hits


def scored(known, pattern):
    """The best score of an instance's other patterns."""
    return max((s for s, p in known or [] if p != pattern), default=0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_contexts_reach_the_same_fixed_point(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(500):
        kind = draw.choice([None, None, "email", "email", "phone"])
        family = draw.randint(0, 3)
        value = f"{kind or 'x'}{draw.randint(0, 25)}" if kind else f"u{family}{draw.randint(0, 12)}"
        ctx = [draw.choice(["", f"a{family}", f"c{draw.randint(0, 2)}"]), draw.choice([f"mail{family % 2}:", f"id{family}=", f"b{draw.randint(0, 2)}", ""]), draw.choice(["", f"z{family}"])]
        rows.append({"key": i, "text_hash": i, "start": 0, "stop": 5, "value": value, "before2": ctx[0], "before": ctx[1], "after": ctx[2], "kind": kind})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], FIELDS)
    found = {(r["key"], r["text_hash"], r["start"], r["stop"]): r["kind"] for r in pii.bootstrap(df, seeds=3, confidence=0.55).collect()}
    assert found == bootstrapped(rows, 3, 0.55, 1e-3)
    assert found
    with pytest.raises(RuntimeError, match="still move"):
        pii.bootstrap(df, rounds=1, seeds=3)


def test_each_word_gets_the_first_span_over_it(spark):
    draw = random.Random(4)
    words_of, at = [], 0
    for _ in range(400):
        at += draw.randint(1, 4)
        words_of.append((at, at + 3))
        at += 3
    spans = [(k, b, b + draw.randint(1, 9)) for k in ("email", "ip", "card") for b in sorted(draw.sample(range(at), 60))]
    kind = "id int, words array<struct<start:int,stop:int>>, spans array<struct<kind:string,b:int,e:int>>"
    df = spark.createDataFrame([(1, words_of, spans), (2, words_of[:1], []), (3, words_of[:17], spans[:3])], kind)
    for r in df.select("words", "spans", pii.tagged().alias("t")).collect():
        over = [next(((s["kind"], s["b"]) for s in r["spans"] if s["b"] < w["stop"] and s["e"] > w["start"]), None) for w in r["words"]]
        assert [x["span"] and (x["span"]["kind"], x["span"]["b"]) for x in r["t"]] == over


def test_very_many_spans_in_one_text(spark):
    text = " ".join(f"word user{i}@mail{i}.com next" for i in range(5000))
    base, _ = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert base.select(F.size("email")).first()[0] == 5000


def test_labelled_sample_is_bounded_by_its_terms(spark):
    rows = [(i, f"{'bad' if i % 4 == 0 else 'good'} " + " ".join(f"w{i}x{j}" for j in range(200 if i % 5 else 5000))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i, _ in rows], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    machine = toxicity.train(docs, labels, cells=60_000)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, machine).collect()}
    assert sum((scores[i] >= 0.5) == (i % 4 == 0) for i, _ in rows) >= 198


def test_items_with_common_shingles_are_found(spark):
    draw = random.Random(6)
    common = words(draw, 30)
    items = [(i, f"{common} {words(draw, 12)}") for i in range(40)] + [(100, common)]
    docs = [(i, f"{words(draw, 50)} {items[i][1]} {words(draw, 50)}") for i in range(0, 40, 7)] + [(200, f"x {common} y"), (201, words(draw, 100))]
    found = decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    expected = {(d, i) for d, t in docs for i, x in items if len(cut(x) & cut(t)) >= 0.8 * len(cut(x))}
    assert {(r["key"], r["item"]) for r in found.collect()} == expected
    assert len(expected) > 10


def test_pipeline_refuses_its_own_columns_at_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, shard int").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ValueError, match="shard"):
        corpus_pipeline.run(spark, str(tmp_path))


def test_rates_solve_the_dual_of_each_source(docs):
    """Exponentially tilted rates, cut off at the cap, that give each source its target of words: the tilt by bisection."""
    by_source = {}
    for r in mixing.mix(docs).collect():
        by_source.setdefault(r["source"], []).append(r)
    for rows in by_source.values():
        size = np.array([r["size"] for r in rows], dtype=float)
        target, z = rows[0]["target"], size / (size.sum() / len(size))
        rate = lambda tilt, z=z: np.minimum(2.0, np.exp(np.minimum(tilt * z, 50.0)))
        low, high = -50.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (size * rate(middle)).sum() < target else (low, middle)
        expected = np.full(len(size), 2.0) if target >= 2 * size.sum() * (1 - 1e-12) else rate(low)
        some = size > 0
        assert [r["rate"] for r in rows if r["size"]] == pytest.approx(expected[some].tolist(), rel=2e-3)
