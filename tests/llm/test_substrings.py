"""Removal of repeated passages against all windows of all texts, and its index against counting."""

import random
import tracemalloc
import uuid

import numpy as np
import pytest

from linkpeak.llm import registry, substrings
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.conftest import words

SCHEMA = "doc_id long, text string, kept string, th long, doc long"


def brute(rows, window):
    first = {}
    split = [(substrings.NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, _), (doc, w) in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (doc, s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    passage = [words(draw, n) for n in (20, 25, 60, 19)]
    out = [(None, None), (1, ""), (2, " \n\t "), (3, "one"), (4, passage[0]), (5, passage[0]), (6, passage[3]), (7, passage[3])]
    for i in range(150):
        parts = [words(draw, draw.choice([0, 3, 15, 80])) for _ in range(4)]
        for p in draw.sample(passage, draw.randint(0, 2)):
            parts.insert(draw.randint(0, 4), p)
        out.append((draw.choice([10 + i, 10 + i, 10 + i, 40, None]), draw.choice([" ", "\n", "  "]).join(parts)))
    out += [out[20]] * 3 + [(900 + i, "a " * 30 + "b " * (i % 3)) for i in range(20)] + [(None, "a b " * 40), (-5, "a b " * 50), (2000, words(draw, 20000) + " " + passage[2])]
    # One passage, a different word on both sides of each copy.
    out += [(3000 + i, f"x{i} {passage[1]} y{i}") for i in range(60)]
    return out


@pytest.mark.parametrize(("window", "crowd"), [(20, substrings.CROWD), (20, 3), (5, 10), (1, 2), (33, 50)])
def test_same_as_all_windows(spark, rows, window, crowd):
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(6)
    out = substrings.without_repeats(df, window=window, crowd=crowd)
    assert out.columns == ["doc_id", "text", "th", "doc", "n_words", "n_removed", "kept"]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=repr) == brute(rows, window)


def test_nothing(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, None, "k", 1, 2)], SCHEMA)
    assert [(r["n_words"], r["kept"]) for r in substrings.without_repeats(one).collect()] == [(0, "")]
    with pytest.raises(ValueError, match="window"):
        substrings.without_repeats(one, window=0)


def test_stream_waits_for_no_more_than_a_crowd():
    import pandas as pd

    draw = np.random.default_rng(1)
    table = np.stack([draw.integers(0, 6, 400), draw.integers(0, 9, 400), draw.integers(0, 20, 400), draw.integers(0, 3, 400), draw.integers(0, 2, 400) * substrings.TAG + 20], axis=1)
    rows = pd.DataFrame(table[np.lexsort(table.T[::-1])], columns=["mh", "sh", "doc", "start", "tag"]).assign(copy=False)
    whole = pd.concat(substrings._sorted_out(10_000)(iter([rows])))
    for size, crowd in ((7, 10_000), (1, 10_000), (50, 2), (3, 4)):
        parts = pd.concat(substrings._sorted_out(crowd)(iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)])))
        key = ["mh", "doc", "th", "a", "b"]
        assert sorted(map(tuple, parts[parts.kind > 0][key].to_numpy())) == sorted(map(tuple, whole[whole.kind > 0][key].to_numpy()))
        assert sorted(map(tuple, parts[parts.kind == 0][key].to_numpy())) == sorted(map(tuple, whole[whole.kind == 0][key].to_numpy()))
        assert (parts.kind == 2).any() == (crowd < 100)


def test_index_finds_the_first_place_of_each_window():
    draw = np.random.default_rng(0)
    for _ in range(60):
        window, letters = int(draw.integers(1, 8)), int(draw.integers(1, 6))
        parts = [draw.integers(0, letters, int(draw.integers(window, 3 * window + 3))).astype(np.uint64) for _ in range(int(draw.integers(1, 30)))]
        place = draw.permutation(1000)[: len(parts)] * 100
        first = {}
        for p, at in zip(parts, place, strict=True):
            for i in range(len(p) - window + 1):
                first[tuple(p[i : i + window])] = min(first.get(tuple(p[i : i + window]), 1 << 60), at + i)
        index = substrings.FMIndex(parts, place, window)
        late = index.repeated()
        for p, at, start in zip(parts, place, index.start, strict=True):
            assert [bool(x) for x in late[start : start + len(p) - window + 1]] == [first[tuple(p[i : i + window])] < at + i for i in range(len(p) - window + 1)]


def test_wavelet_tree_counts():
    draw = np.random.default_rng(4)
    seq = np.unique(np.minimum(draw.zipf(1.3, 3000), 400), return_inverse=True)[1]
    symbol, at = draw.integers(0, seq.max() + 1, 500), draw.integers(0, 3001, 500)
    tree = substrings.WaveletTree(seq)
    assert tree.rank(symbol, at).tolist() == [int((seq[:j] == c).sum()) for c, j in zip(symbol, at, strict=True)]
    share = np.bincount(seq) / len(seq)
    assert sum(8 * len(level[0]) * 8 for level in tree.levels) <= len(seq) * (1 - (share * np.log2(share)).sum()) + 128 * len(tree.levels)


def test_index_takes_few_bytes_a_word():
    draw = np.random.default_rng(3)
    vocabulary = draw.integers(0, 1 << 62, 3000).astype(np.uint64)
    parts = [vocabulary[draw.integers(0, 3000, 26)] for _ in range(1500)]
    parts += [np.where(np.arange(26) == i % 26, vocabulary[i], p) for i, p in enumerate(parts)]
    n = sum(map(len, parts))
    tracemalloc.start()
    try:
        substrings.FMIndex(parts, np.arange(len(parts)) << 32, 20).repeated()
        assert tracemalloc.get_traced_memory()[1] < 100 * n
    finally:
        tracemalloc.stop()


def test_texts_go_to_python_in_small_batches(spark, monkeypatch, tmp_path):
    folder, most = str(tmp_path), 4 << 20

    def noted(step, run, column):
        def seen(part):
            for batch in part:
                with open(f"{folder}/{step}-{uuid.uuid4().hex}", "w") as f:
                    f.write(str(int(batch[column].str.len().sum())))
                yield batch

        return lambda part: run(seen(part))

    for step in ("_written", "_spelled"):
        monkeypatch.setattr(substrings, step, lambda *a, step=step, made=getattr(substrings, step): noted(step, made(*a), "text"))
    monkeypatch.setattr(substrings, "_kept", noted("_kept", substrings._kept, "_text"))
    draw = random.Random(5)
    passage = [words(draw, 30) for _ in range(40)]
    body = words(draw, 1500)
    rows = [(i, f"{i} {body[i:]} {passage[i % 40]} {i} {passage[i % 39]}") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(1).write.parquet(f"{folder}/sf/documents.parquet")
    before = spark.conf.get(setting := "spark.sql.execution.arrow.maxBytesPerBatch")
    out = registry.queries()["op12_substrings"](spark, f"{folder}/sf")
    assert out.count() == len(rows)
    assert spark.conf.get(setting) == before
    total = sum(len(t) for _, t in rows)
    for step in ("_written", "_spelled", "_kept"):
        sizes = [int(p.read_text()) for p in tmp_path.glob(f"{step}-*")]
        assert sum(sizes) >= (total if step != "_spelled" else most), step
        assert max(sizes) <= most + max(len(t) for _, t in rows), step


def test_query_matches_sql(spark):
    assert spark_rows(registry.queries()["op12_substrings"](spark, "/root/testdata/sf0.001")) == duck_rows(connect("sf0.001"), registry.oracle_sql()["op12_substrings"])
