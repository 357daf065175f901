"""Licence scans with a positional index of rare words.

Templates are whole licence texts and short notices, with phrases that must stand in a match (and, to tell versions
apart, some that must not). A file is looked up by the rarest of the licence words it holds, by inverse document
frequency over the whole corpus: their places in a template and in the file tell where the template would start. Two
of them that agree on that within a tolerance for inserted and lost words make a place a candidate. The two rarest
words of a template's first phrase are always looked up, and they stand at the same distance in any match, so that
none is missed. Each candidate is then compared by pairs of neighbouring words, and the phrases are verified.

All of it is DataFrame work: one pass over the texts counts words and notes which template words they
hold; only files with all words of a template's phrases are read again.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import join_texts, lower_ascii, materialize, table

#: What stands between words: every ASCII character but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrase and label of the base scan.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def license_templates(path: str | Path = Path(__file__).with_name("license_texts.txt")) -> list[tuple[str, str, list[str], list[str]]]:
    """(label, words, phrases that must stand in a match, phrases that must not) of each record of a file."""
    plain = lambda text: " ".join(re.split(GAP, text.lower())).strip()
    out = []
    for record in re.split(r"^== ", Path(path).read_text(encoding="utf-8"), flags=re.MULTILINE)[1:]:
        label, *lines = record.strip().split("\n")
        must, never = ([plain(x[2:]) for x in lines if x.startswith(sign)] for sign in ("+ ", "- "))
        out.append((label.strip(), plain(" ".join(x for x in lines if not x.startswith(("+ ", "- ")))), must, never))
    return out


def normal_words(text: Column) -> Column:
    """The words in order, one space around each; two spaces where there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(normal: Column, n_words: Column, phrase: str, label: str) -> Column:
    """(label, n, first, last): how often phrase stands in a text from normal_words(), and at which words (from 0)."""
    pieces = F.split(normal, f"(?<= ){phrase}(?= )", -1)
    first = _spaces(F.element_at(pieces, 1)) - 1
    last = n_words - (_spaces(F.element_at(pieces, -1)) - 1) - (phrase.count(" ") + 1)
    return F.struct(F.lit(label).alias("label"), (F.size(pieces) - 1).cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))


def _base(normal: Column, hits: Column, n_words: Column, base: tuple[tuple[str, str], ...]) -> Column:
    """The places of each base phrase that occurs; only texts that hold all words of a phrase are searched."""
    lowered = lower_ascii(normal)
    found = []
    for phrase, label in base:
        words = sorted(set(phrase.split()))
        worth = F.size(F.array_intersect(hits, F.array(*[F.lit(w) for w in words]))) == len(words)
        found.append(F.when(worth & F.contains(lowered, F.lit(f" {phrase} ")), phrase_places(lowered, n_words, phrase, label)))
    return F.array_compact(F.array(*found))


def _pairs(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    ahead = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(ahead, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def scan(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    templates: list | None = None,
    base: tuple[tuple[str, str], ...] = BASE,
    rare: int = 6,
    least: float = 0.6,
) -> tuple[DataFrame, DataFrame]:
    """Two DataFrames: (key, text_hash, n_words, base: array of (label, n, first, last)) with one row for each
    row of docs, and (key, text_hash, label, first_word, score): about where the method finds a template, and the
    share of its pairs of neighbouring words that stand there.

    Null texts count as empty: no words, no places; texts may have any length. Rows that repeat key and text repeat
    their base row; their method rows come once. A null key is a key like any other. Other columns, whatever their
    names, are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = [(t, label, words.split(), must, never, sorted({w for phrase in must for w in phrase.split()})) for t, (label, words, must, never) in enumerate(license_templates() if templates is None else templates)]
    vocabulary = sorted({w for row in rows for w in row[2]} | {w for phrase, _ in base for w in phrase.split()})
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), normal_words(F.col(text)).alias("normal"))
    parsed = source.withColumn("words", F.split(F.lower("normal"), " ")).withColumn("hits", F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])))
    n_words = F.when(F.col("normal") == "  ", 0).otherwise(F.size("words") - 2).cast("long")
    seen = materialize(parsed.select("key", "text_hash", n_words.alias("n_words"), _base(F.col("normal"), F.col("hits"), n_words, base).alias("base"), "hits"))

    # One row for each word of the templates; the templates are a small fixed list, by rarity in the corpus.
    frequency = {r["word"]: r["df"] for r in seen.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    rarity = lambda words: sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
    known, postings = [], []
    for t, label, words, must, never, needed in rows:
        slack = max(4, len(words) // 5)
        known.append((t, label, words, must, never, needed, rarity(needed)[0], rarity(must[0].split())[:2], rarity(words), slack))
        postings += [(t, w, at) for at, w in enumerate(words)]
    shape = "template int, label string, template_words array<string>, must array<string>, never array<string>, needed array<string>, anchor string, leads array<string>, by_rarity array<string>, slack int"
    known = F.broadcast(spark.createDataFrame(known, shape))
    postings = F.broadcast(spark.createDataFrame(postings, "template int, word string, place int"))

    # A file must hold all words of the phrases; the rarest of them is looked up, the others are compared.
    likely = seen.select("key", "text_hash", "hits", F.explode("hits").alias("anchor")).join(known, "anchor").where(F.size(F.array_except("needed", "hits")) == 0)
    best = F.slice(F.filter("by_rarity", lambda w: F.array_contains("hits", w)), 1, rare)
    likely = materialize(likely.select("key", "text_hash", "template", F.array_union("leads", best).alias("chosen")).distinct())
    wanted = likely.select("key", "text_hash").distinct()
    files = join_texts(source, wanted, "left_semi").select("key", "text_hash", F.split(lower_ascii(F.col("normal")), " ").alias("words")).dropDuplicates(["key", "text_hash"])
    files = materialize(files)

    asked = likely.groupBy("key", "text_hash").agg(F.collect_list(F.struct("template", "chosen")).alias("asked"))
    told = join_texts(files, asked)
    words = F.array_distinct(F.flatten(F.transform("asked", lambda a: a["chosen"])))
    spots = told.withColumn("any", words).select("key", "text_hash", "asked", F.explode(F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("any", w), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())).alias("x"))
    spots = spots.select("key", "text_hash", "x.*", F.explode("asked").alias("a")).where(F.array_contains("a.chosen", F.col("word")))
    spots = spots.select("key", "text_hash", "at", "word", F.col("a.template").alias("template")).join(postings, ["template", "word"]).join(known.select("template", "slack"), "template")
    # Starts that differ by slack at most share a bin of one of two ways to cut.
    spots = spots.withColumn("start", F.col("at") - F.col("place")).withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    spots = spots.groupBy("key", "text_hash", "template", "way", F.floor((F.col("start") + F.col("way") * F.col("slack")) / (2 * F.col("slack"))).alias("bin")).agg(F.countDistinct("word").alias("n"), F.min("start").alias("start")).where("n >= 2")
    spots = spots.select("key", "text_hash", "template", "start").distinct().join(known, "template")
    told = join_texts(files.withColumnRenamed("words", "file"), spots)
    # The first element of a split is what stands before the first word: the empty string.
    here = F.slice("file", F.greatest(F.col("start") - F.col("slack"), F.lit(1)), F.size("template_words") + 4 * F.col("slack"))
    told = told.withColumn("here", here).withColumn("line", F.concat(F.lit(" "), F.array_join("here", " "), F.lit(" ")))
    holds = lambda phrase: F.contains("line", F.concat(F.lit(" "), phrase, F.lit(" ")))
    pairs = _pairs(F.col("template_words"))
    told = told.withColumns({"score": F.size(F.array_intersect(pairs, _pairs(F.col("here")))) / F.size(pairs), "whole": F.forall("must", holds) & ~F.exists("never", holds)})
    method = told.where(F.col("whole") & (F.col("score") >= least)).select("key", "text_hash", "label", F.greatest(F.col("start") - 1, F.lit(0)).alias("first_word"), "score")
    return seen.drop("hits"), materialize(method.distinct(), likely, files)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen, method = scan(docs)
    added = materialize(method.groupBy("key", "text_hash").agg(F.collect_set("label").alias("found"), F.max("score").alias("score")), method)
    out = join_texts(seen, added, "left")
    labels = F.transform("base", lambda b: b["label"])
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return out.select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
