"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed words. The machine gives each term a weight and a short vector, and scores a
document by the weights plus the inner products of all pairs of vectors, so that two terms together can count for
more (or less) than each alone, also where neither tells anything by itself. The sum over pairs costs one pass: half
of the squared sum less the sum of squares. No term is selected by its effect: all slots that three or more labelled
texts hold are fitted together, since what fewer texts hold cannot be told from chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, materialize, table
from linkpeak.llm.training import crc_remainder, labelled_sample

#: At most so many labelled rows are learned from.
MAX_LABELLED = 20_000
#: And from so many of their terms at most (4 bytes each on the driver): rows in order of the hash of their terms, as far as they fit.
MAX_CELLS = 12_000_000
#: Terms are hashed to so many slots; length of a term's vector.
SLOTS, RANK = 1 << 22, 8
#: So many epochs without a gain end the fit of vectors.
PATIENCE = 12
#: Slots that fewer labelled texts hold have no weight.
LEAST = 3

_EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def terms(text: str | None) -> np.ndarray:
    """Slots of the distinct words: lower-cased, without symbols at their ends."""
    words = {_EDGES.sub("", w) for w in set((text or "").lower().split())}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) % SLOTS for w in words if w), dtype=np.int64))


class Machine:
    def __init__(self, slots: np.ndarray, weight: np.ndarray, vector: np.ndarray, bias: float):
        self.slots, self.weight, self.vector, self.bias = slots, weight, vector, bias

    def score(self, texts: pd.Series) -> np.ndarray:
        """Probability of label 1 for each text; one without known terms gets that of the bias alone."""
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            found = terms(text)
            at = np.searchsorted(self.slots, found)
            at = at[self.slots[np.minimum(at, len(self.slots) - 1)] == found] if len(self.slots) else at[:0]
            if len(at):
                v = self.vector[at]
                out[i] += self.weight[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return _logistic(out)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _batches(rows: np.ndarray, term: np.ndarray, starts: np.ndarray, size: int) -> list[tuple]:
    """(rows, the terms that occur in them, place of each cell's row, place of each cell's term) of each batch."""
    out = []
    for first in range(0, len(rows), size):
        some = rows[first : first + size]
        cells = [term[starts[r] : starts[r + 1]] for r in some]
        used, place = np.unique(np.concatenate(cells), return_inverse=True) if len(cells) else (term[:0], term[:0])
        # Places take 4 bytes each, as all cells of the sample are held at once.
        out.append((some, used, np.repeat(np.arange(len(some), dtype=np.int32), [len(c) for c in cells]), place.astype(np.int32)))
    return out


def _raw(batch: tuple, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and the sums of vectors, of a batch's rows."""
    some, used, row, place = batch
    vectors = v[used]
    sums = np.stack([np.bincount(row, weights=vectors[place, f], minlength=len(some)) for f in range(RANK)], axis=1)
    squares = np.bincount(row, weights=(vectors**2).sum(axis=1)[place], minlength=len(some))
    return bias + np.bincount(row, weights=w[used][place], minlength=len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def _shrunk(w: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    return np.sign(w) * np.maximum(np.abs(w) - by, 0)


def _weights(batch: tuple, y: np.ndarray, balance: np.ndarray, w: np.ndarray, bias: float, penalty: float, steps: int = 100, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights alone, from w on, by AdaGrad over all rows; the penalty on their absolute values keeps most at zero."""
    some, used, row, place = batch
    w, seen, seen_b = w.copy(), np.ones(len(w)), 1.0
    for _ in range(steps):
        err = balance[some] * (_logistic(bias + np.bincount(row, weights=w[used][place], minlength=len(some))) - y[some])
        g = np.bincount(place, weights=err[row], minlength=len(used))
        seen[used] += g**2
        seen_b += err.sum() ** 2
        step = rate / np.sqrt(seen[used])
        moved = _shrunk(w[used] - step * g, step * penalty)
        still = np.abs(moved - w[used]).max(initial=0.0) < 1e-3
        w[used] = moved
        bias -= rate * err.sum() / np.sqrt(seen_b)
        if still:
            break
    return w, bias


def _vectors(batches: list[tuple], y: np.ndarray, balance: np.ndarray, w: np.ndarray, bias: float, penalty: float, epochs: int, rate: float = 0.1, l2: float = 5.0, seed: int = 5) -> Iterator[tuple]:
    """(w, v, bias) after each epoch of AdaGrad over batches: weights, from w on, and vectors together."""
    draw = np.random.default_rng(seed)
    w, v, m = w.copy(), draw.normal(0, 0.03, (len(w), RANK)), len(w)
    seen_w, seen_v, seen_b = np.ones(m), np.ones((m, RANK)), 1.0
    rows = sum(len(some) for some, *_ in batches)
    for _ in range(epochs):
        for b in draw.permutation(len(batches)):
            some, used, row, place = batches[b]
            z, sums = _raw(batches[b], w, v, bias)
            err = balance[some] * (_logistic(z) - y[some])
            own = np.bincount(place, weights=err[row], minlength=len(used))
            cross = err[:, None] * sums
            g_v = np.stack([np.bincount(place, weights=cross[row, f], minlength=len(used)) for f in range(RANK)], axis=1) - own[:, None] * v[used] + l2 * v[used]
            seen_w[used] += own**2
            seen_v[used] += g_v**2
            seen_b += err.sum() ** 2
            step = rate / np.sqrt(seen_w[used])
            w[used] = _shrunk(w[used] - step * own, step * penalty * len(some) / rows)
            v[used] -= rate * g_v / np.sqrt(seen_v[used])
            bias -= rate * err.sum() / np.sqrt(seen_b)
        yield w, v, bias


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = 30, penalties: tuple[float, ...] = (0.3, 0.15, 0.08, 0.04), size: int = 256, seed: int = 5) -> Machine:
    """The machine that predicts a tenth of the rows best; it is fitted on the others.

    Weights come first, under penalties that are shares of the one which leaves none; then weights and vectors, all of
    them, for as many epochs as the held-out tenth gains by. Rows that repeat terms and label count once. The two
    classes are in balance. Without both classes every score is their share.
    """
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Machine(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, RANK)), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    once = {(xxhash.xxh3_128_digest(d.tobytes()), t): i for i, (d, t) in enumerate(zip(docs, y, strict=True))}
    docs, y = [docs[i] for i in once.values()], y[list(once.values())]
    slots, count = np.unique(np.concatenate(docs), return_counts=True)
    slots = slots[count >= LEAST]
    docs = [np.searchsorted(slots, np.intersect1d(d, slots, assume_unique=True)).astype(np.int32) for d in docs]
    starts, term = np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.concatenate(docs)
    del docs, once
    share = y.mean()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    order = np.random.default_rng(seed).permutation(len(y))
    test, train = order[: len(y) // 10], order[len(y) // 10 :]
    (held,), (whole,) = _batches(test, term, starts, max(1, len(test))) or [None], _batches(train, term, starts, len(train))
    still = np.zeros((len(slots), RANK))
    best, model, chosen = np.inf, None, 0.0

    def better(w: np.ndarray, v: np.ndarray, bias: float) -> bool:
        nonlocal best, model
        loss = 0.0
        if held is not None:
            p = np.clip(_logistic(_raw(held, w, v, bias)[0]), 1e-6, 1 - 1e-6)
            loss = -(balance[held[0]] * (y[held[0]] * np.log(p) + (1 - y[held[0]]) * np.log(1 - p))).sum()
        if model is not None and loss >= best:
            return False
        best, model = loss, (w.copy(), v.copy(), bias)
        return True

    some, used, row, place = whole
    top = np.abs(np.bincount(place, weights=(balance[some] * (0.5 - y[some]))[row], minlength=len(used))).max(initial=0.0)
    w, bias = np.zeros(len(slots)), 0.0
    for part in penalties:
        w, bias = _weights(whole, y, balance, w, bias, part * top)
        if better(w, still, bias):
            chosen = part * top
    # The penalty has also made the weights that it left too small; those are fitted once more, under hardly any.
    start, _, bias = model
    inside = (start != 0)[used][place]
    w, bias = _weights((some, used, row[inside], place[inside]), y, balance, start, bias, chosen / 20)
    better(w, still, bias)
    start, _, bias = model
    del whole, some, used, row, place, inside
    waited = 0
    for w, v, b in _vectors(_batches(train, term, starts, size), y, balance, start, bias, chosen, epochs, seed=seed):
        waited = 0 if better(w, v, b) else waited + 1
        if waited == PATIENCE:
            break
    return Machine(slots.astype(np.int64), *model)


def _learned(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in part:
        yield pd.DataFrame({"terms": [terms(t) for t in batch["text"]], "label": batch["label"].astype("int64")})


def _packed(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in part:
        yield pd.DataFrame({"terms": [np.sort(np.asarray(t, dtype=np.int32)).tobytes() for t in batch["terms"]], "label": batch["label"]})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", modulus: int = 5, held_out: int = 0, limit: int = MAX_LABELLED, cells: int = MAX_CELLS) -> Machine:
    """A machine from labelled rows whose crc32 remainder is not held_out: at most ``limit`` rows with ``cells`` terms in all, so that what
    the driver holds is bounded however long texts are. Spark counts the slots; the driver gets those of each row that
    LEAST rows hold, 4 bytes each."""
    keep = crc_remainder(F.col(key), modulus) != held_out
    rows = materialize(labelled_sample(docs, labels, label, keep, limit, text, key).mapInPandas(_learned, "terms array<long>, label long").withColumn("row", F.monotonically_increasing_id()))
    if (rows.agg(F.sum(F.size("terms"))).first()[0] or 0) > cells:
        # One row for each of at most ``limit`` labelled rows.
        upto = F.sum("n").over(Window.orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        fits = rows.select("row", F.size("terms").alias("n"), F.xxhash64("terms", "label").alias("h")).withColumn("upto", upto).where(F.col("upto") <= cells).select("row")
        rows = materialize(rows.join(fits, "row", "left_semi"), rows)
    held = rows.select("row", F.explode("terms").alias("slot"))
    often = held.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("slot")
    lists = held.join(often, "slot").groupBy("row").agg(F.collect_list("slot").alias("terms"))
    packed = rows.select("row", "label").join(lists, "row", "left").select(F.coalesce("terms", F.array().cast("array<long>")).alias("terms"), "label")
    got = packed.mapInPandas(_packed, "terms binary, label long").toPandas()
    discard(rows)
    # Rows come in any order; a fixed one makes reruns agree.
    order = sorted(range(len(got)), key=lambda i: (got["terms"].iloc[i], got["label"].iloc[i]))
    found, y = [np.frombuffer(got["terms"].iloc[i], dtype=np.int32) for i in order], got["label"].to_numpy(dtype=np.float64)[order]
    return fit(found, y)


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with ``score``, the probability of label 1; it replaces a column of that name.

    Null texts score like empty ones; texts may have any length and are read whole; each row is scored alone, so that
    repeated rows agree; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score(texts))

    return docs.withColumn("score", score(F.col(text)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, machine)
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
