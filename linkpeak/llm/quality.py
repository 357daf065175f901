"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text need one pass over it. The trees are grown on the driver from a bounded sample of
labelled rows, with histograms of binned statistics, and flattened into arrays: a tree of depth d is 2**d - 1
splits and 2**d leaves, so that numpy walks all rows of a batch down all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import table
from linkpeak.llm.training import crc_remainder, labelled_sample

#: At most so many labelled rows are learned from.
MAX_LABELLED = 20_000
N_FEATURES = 20

_LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL = (np.zeros(256) for _ in range(5))
for _i in range(256):
    _c = chr(_i)
    _LETTER[_i] = (_i >= 128) or _c.isalpha()
    _UPPER[_i] = _i < 128 and _c.isupper()
    _DIGIT[_i] = _i < 128 and _c.isdigit()
    _SPACE[_i] = _i == 32 or 9 <= _i <= 13
    _SYMBOL[_i] = _i < 128 and not (_LETTER[_i] or _DIGIT[_i] or _SPACE[_i])
_PLAIN = set(b".,;:!?'\"()-")


def statistics(text: str | None) -> np.ndarray:
    """What the trees look at: lengths, shares of kinds of characters, repetition of words, pairs and lines."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    out = np.zeros(N_FEATURES)
    n, size = len(words), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out[0], out[1] = np.log1p(len(raw)), np.log1p(n)
    out[2], out[3], out[4], out[5] = counts @ _LETTER / size, counts @ _UPPER / size, counts @ _DIGIT / size, counts @ _SYMBOL / size
    strange = counts * _SYMBOL
    strange[list(_PLAIN)] = 0
    out[6], out[7] = strange.sum() / size, strange.max() / size
    share = counts[counts > 0] / size
    out[8] = -(share * np.log(share)).sum()
    lines = raw.split(b"\n")
    out[9], out[10] = np.log1p(len(lines)), len(set(lines)) / len(lines)
    out[11] = counts[33] / size
    out[12] = counts[46] / max(n, 1)
    if n:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        seen = Counter(words)
        out[13], out[14] = lengths.mean(), lengths.std()
        out[15], out[16] = len(seen) / np.sqrt(n), max(seen.values()) / n
        out[17] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        out[18] = len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)
        out[19] = (lengths <= 3).mean()
    return out


def features(texts: pd.Series) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))


class Trees:
    """Boosted trees of one depth, as arrays: split feature and threshold by tree and node, value by tree and leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, splits = self.feature.shape
        rows = np.arange(len(x))[:, None]
        each = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(int(np.log2(splits + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[each, node]] > self.threshold[each, node])
        return 1 / (1 + np.exp(-np.clip(self.start + self.value[each, node - splits].sum(axis=1), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Fits trees to labels of 0 and 1; the two classes weigh alike. Without rows of both classes every score is their share."""
    splits = 2**depth - 1
    feature, threshold, value = np.zeros((trees, splits), dtype=np.int64), np.full((trees, splits), np.inf), np.zeros((trees, splits + 1))
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Trees(feature, threshold, value, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total, n = np.zeros(len(y)), x.shape[1]
    flat = binned + np.arange(n) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (n * bins) + flat).ravel()
            g, h = (np.bincount(slot, weights=np.repeat(v, n), minlength=width * n * bins).reshape(width, n, bins).cumsum(axis=2) for v in (grad, hess))
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            gain[(h < least) | (h_all - h < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - splits
        g, h = (np.bincount(leaf, weights=v, minlength=splits + 1) for v in (grad, hess))
        value[t] = -rate * g / (h + l2)
        total += value[t][leaf]
    return Trees(feature, threshold, value, 0.0)


def _learned(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in part:
        yield pd.DataFrame({"x": list(features(batch["text"])), "label": batch["label"].astype("int64")})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", modulus: int = 3, held_out: int = 1, limit: int = MAX_LABELLED) -> Trees:
    """Trees from labelled rows whose crc32 remainder is not held_out."""
    keep = crc_remainder(F.col(key), modulus) != held_out
    rows = labelled_sample(docs, labels, label, keep, limit, text, key).mapInPandas(_learned, "x array<double>, label long").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, N_FEATURES))
    # Rows come in any order; a fixed one makes reruns agree.
    order = np.lexsort(x.T)
    return grow(x[order], rows["label"].to_numpy(dtype=np.float64)[order])


def score_udf(trees: Trees):
    """The probability of label 1 for a column of texts. Null texts score like empty ones; texts may have any length and
    are read whole."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(features(texts)))

    return score


def score_quality(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with ``score``, the probability of label 1; it replaces a column of that name, all others stay.

    Each row is scored alone, so that repeated rows agree; an empty table stays empty.
    """
    return docs.withColumn("score", score_udf(trees)(F.col(text)))


def good_rows(docs: DataFrame, trees: Trees, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, as they are, that score least or more."""
    return docs.where(score_udf(trees)(F.col(text)) >= least)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs, trees)
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
