"""URL filters: rules first, then a logistic regression on hashed character n-grams of host and path.

The model learns from a small table of labelled URLs, given as rows or that of url_labels.csv beside this module. It
is a weight vector of fixed length, so every task can carry it; scoring is a sum over the n-grams of each URL that no
rule decides.
"""

from __future__ import annotations

import csv
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import table

#: Length of the weight vector.
DIMS = 1 << 13
#: At most so many labelled rows are learned from, those of the smallest hashes.
MAX_LABELLED = 100_000

#: (verdict, host, start of the path); the longest host + path that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without "://"."""
    after = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, like "org/", and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        name, verdict = F.when(fits, on + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Slots of the 3- to 5-grams of "^host$" and of the path; each slot once."""
    found = {zlib.crc32(f"{tag}{text[i : i + n]}".encode()) % DIMS for tag, text in (("h", f"^{host}$"), ("p", f"{path}$")) for n in (3, 4, 5) for i in range(max(1, len(text) - n + 1))}
    return np.fromiter(found, dtype=np.int64)


def labelled_urls(path: str | Path = Path(__file__).with_name("url_labels.csv")) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) of a small table with columns url and block."""
    with open(path, encoding="utf-8", newline="") as lines:
        rows = [(re.fullmatch(r"[^:]*://([^/?#]*)([^?#]*).*", r["url"]).groups(), int(r["block"])) for r in csv.DictReader(lines)]
    return [(host.lower(), rest, block) for (host, rest), block in rows]


def fit(rows: list[tuple[str, str, int]], steps: int = 300, rate: float = 0.5, l2: float = 1e-4, good: float = 0.65) -> np.ndarray:
    """Weights (DIMS, then the bias) by AdaGrad over the whole table. Rows to allow have the share ``good`` of all
    weight: to block a good page is worse than to let a bad one through. Repeated rows count
    once, and the order of rows plays no part; without rows every URL scores 0.5."""
    rows = sorted(set(rows), key=lambda r: (zlib.crc32(f"{r[0]} {r[1]}".encode()), r))[:MAX_LABELLED]
    if not rows:
        return np.zeros(DIMS + 1)
    slots = [grams(h, p) for h, p, _ in rows]
    at, label = np.repeat(np.arange(len(rows)), [len(s) for s in slots]), np.array([y for *_, y in rows], dtype=np.float64)
    slot = np.concatenate(slots)
    value = 1 / np.sqrt(np.bincount(at, minlength=len(rows)))[at]
    share = np.where(label == 1, (1 - good) / max(label.sum(), 1), good / max((1 - label).sum(), 1))
    w, bias, seen, seen_bias = np.zeros(DIMS), 0.0, np.full(DIMS, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(at, weights=w[slot] * value, minlength=len(rows)) + bias)))
        err = share * (p - label)
        grad = np.bincount(slot, weights=err[at] * value, minlength=DIMS) + l2 * w
        seen += grad**2
        seen_bias += err.sum() ** 2
        w -= rate * grad / np.sqrt(seen)
        bias -= rate * err.sum() / np.sqrt(seen_bias)
    return np.append(w, bias)


def score_udf(weights: np.ndarray):
    """Probability (0 to 1) that a (host, path) is to be blocked; null for a null host. Without host and path it is
    that of the empty URL."""

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        def one(h: str | None, p: str) -> float | None:
            if h is None:
                return None
            s = grams(h, p)
            return 1 / (1 + np.exp(-(weights[s].sum() / np.sqrt(len(s)) + weights[-1])))

        return pd.Series([one(h, p) for h, p in zip(host, path, strict=True)], dtype="float64")

    return score


def filter_urls(pages: DataFrame, url: str = "url", rows: list[tuple[str, str, int]] | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score and verdict (allow or block); these replace columns of the same names, all
    other columns stay. score is null where a rule decides.

    Null URLs and URLs without "://" have an empty host and path; no rule fits them and the model decides. URLs may
    have any length. Each row is judged alone, so that repeats get the same verdict; an empty table stays empty.
    """
    weights = fit(labelled_urls() if rows is None else rows)
    link = F.col(url)
    host, path = split_url(link)
    out = pages.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # The three columns come at once, so that none of them replaces one that another reads.
    out = out.withColumns({"score": score_udf(weights)(F.when(name.isNull(), F.col("host")), "path"), "rule": name, "verdict": verdict})
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
