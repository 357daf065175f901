"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document when at least ``threshold`` of its distinct shingles (five words) stand there; an
item of fewer words is one shingle of its own length, and so is found inside long documents as well. Items are
partitioned by size: by their number of words below five, else by the power of two of their number of shingles. The
sketch of an item are its ``k`` smallest shingle hashes, and k grows with the size so that a contained item must
share one of them: of n shingles at most ``floor((1 - threshold) * n)`` may be missing, and k is one more. That holds for any k
shingles of an item, so those that more than ``COMMON`` items have come last: boilerplate of many items leads to none of them. Documents
may be far longer than items, so they have no sketch: for each partition, those of their shingle hashes up to the
partition's largest sketch value are looked up in it. The larger the items, the smaller that value: of 200 shingles
the 41 smallest are a fifth of all. Candidates are then verified with the exact shingle sets, all items of a document at once.

Everything is DataFrame work. Sketches and candidates are written tables, so the planner knows their sizes
when it chooses between broadcast and shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import join_texts, masked, materialize, table, unmasked

#: Words of a shingle.
N = 5
#: Shingles of more items than that are common.
COMMON = 16


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words``: the words of text, lower-cased."""
    return df.withColumn("words", F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), ""))


def _places(n: int) -> Column:
    """Places at which a shingle of n words of the column ``words`` starts."""
    return F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(n: int = N) -> Column:
    """A hash for each shingle of the column ``words``, in the order of the text."""
    return F.transform(_places(n), lambda i: F.xxhash64(*[F.try_element_at("words", i + k) for k in range(n)]))


def shingle_texts(n: int = N) -> Column:
    """The distinct shingles of the column ``words`` as text."""
    return F.array_distinct(F.transform(_places(n), lambda i: F.array_join(F.slice("words", i, n), " ")))


def _own(shingles: Callable[[int], Column]) -> Column:
    """shingles(n) with n the number of words, N at most."""
    out = shingles(N)
    for n in range(1, N):
        out = F.when(F.size("words") == n, shingles(n)).otherwise(out)
    return out


def _asked(hashes: str, part: int, top: int) -> Column:
    """What a document looks up in a partition: (class, hash) of the hashes up to its largest sketch value."""
    return F.transform(F.filter(hashes, lambda h: h <= top), lambda h: F.struct(F.lit(part).alias("class"), h.alias("hash")))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, text_hash, item, containment): each item with at least threshold of its shingles in a document.

    docs has key and text, items has item_key and text. Null and empty texts match nothing; texts may have any
    length. Rows that repeat key and text give their pairs once, items that repeat id and text too. Other columns,
    whatever their names, are not looked at. Empty tables give no rows.
    """
    parts = with_words(items.select(F.col(item_key).alias("item"), F.col("text").alias("item_text")), "item_text").dropDuplicates(["item", "item_text"])
    parts = parts.where(F.size("words") > 0).select("item", F.xxhash64("item_text").alias("item_hash"), F.size("words").alias("n_words"), _own(shingle_texts).alias("shingles"), F.array_sort(F.array_distinct(_own(shingle_hashes))).alias("hashes"))
    # Partitions: minus the number of words, or the power of two of the number of shingles.
    by_size = F.when(F.col("n_words") < N, -F.col("n_words")).otherwise(F.floor(F.log2(F.size("hashes").cast("double"))))
    parts = materialize(parts.withColumn("class", by_size.cast("int")))
    k = F.floor(F.size("hashes") * (1 - threshold) + 1e-9).cast("int") + 1
    each = parts.select("item", "item_hash", "class", k.alias("k"), F.explode("hashes").alias("hash"))
    common = each.groupBy("class", "hash").agg(F.count("*").alias("_n")).where(F.col("_n") > COMMON).select("class", "hash", F.lit(True).alias("_common"))
    ranked = each.join(common, ["class", "hash"], "left").groupBy("item", "item_hash", "class", "k").agg(F.array_sort(F.collect_list(F.struct(F.col("_common").isNotNull().alias("c"), "hash"))).alias("r"))
    sketch = materialize(ranked.select("item", "item_hash", "class", F.explode(F.slice("r", 1, F.col("k"))["hash"]).alias("hash")))
    # One row for each partition, some dozens at most.
    tops = sketch.groupBy("class").agg(F.max("hash").alias("top")).orderBy("class").collect()

    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("body"))
    length = {r["class"]: -r["class"] if r["class"] < 0 else N for r in tops}
    hashed = with_words(source, "body").withColumns({f"h{n}": shingle_hashes(n) for n in sorted({N, *length.values()})})
    asked = [_asked(f"h{length[r['class']]}", r["class"], r["top"]) for r in tops]
    none = F.array().cast("array<struct<class:int,hash:bigint>>")
    probes = hashed.select("key", "text_hash", F.explode(F.flatten(F.array(none, *asked))).alias("probe")).select("key", "text_hash", "probe.*")
    found = materialize(probes.join(sketch, ["class", "hash"]).select("key", "text_hash", "item", "item_hash").distinct(), sketch)

    wanted = found.select("key", "text_hash").distinct()
    texts = with_words(join_texts(source, wanted, "left_semi").dropDuplicates(["key", "text_hash"]), "body")
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")) if any(c < 0 for c in length) else F.lit("")
    texts = texts.select("key", "text_hash", shingle_texts().alias("doc_shingles"), spaced.alias("doc_words"))
    own = found.join(parts.select("item", "item_hash", "n_words", "shingles"), ["item", "item_hash"]).groupBy("key", "text_hash").agg(F.collect_list(F.struct("item", "n_words", "shingles")).alias("items"))

    def share(i: Column) -> Column:
        short = F.contains("doc_words", F.concat(F.lit(" "), F.element_at(i["shingles"], 1), F.lit(" "))).cast("double")
        return F.when(i["n_words"] < N, short).otherwise(F.size(F.array_intersect(i["shingles"], "doc_shingles")) / F.size(i["shingles"]))

    pairs = join_texts(texts, own).select("key", "text_hash", F.inline(F.transform("items", lambda i: F.struct(i["item"].alias("item"), share(i).alias("containment")))))
    return pairs.where(F.col("containment") >= threshold).select("key", "text_hash", "item", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that contain an item; the columns of docs may have any names."""
    leaks = materialize(contained(docs, items, threshold, text, key).select(F.col("key").alias("_key"), F.col("text_hash").alias("_text")).distinct())
    given, names = masked(docs)
    return unmasked(given.join(leaks, F.col(names[key]).eqNullSafe(F.col("_key")) & (F.xxhash64(names[text]) == F.col("_text")), "left_anti"), names)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = contained(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return pairs.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.round("containment", 6).alias("containment"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') if x <> ''] AS words FROM documents
), b AS (
  SELECT item_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') if x <> ''] AS words FROM benchmark
), lengths AS (SELECT DISTINCT least(len(words), 5) AS n FROM b WHERE len(words) > 0
), d AS (
  SELECT DISTINCT doc_id, n, unnest([array_to_string(words[i:i + n - 1], ' ') for i in range(1, len(words) - n + 2)]) AS s FROM w, lengths WHERE len(words) >= n
), i AS (
  SELECT DISTINCT item_id, n, unnest([array_to_string(words[i:i + n - 1], ' ') for i in range(1, len(words) - n + 2)]) AS s
  FROM (SELECT item_id, words, least(len(words), 5) AS n FROM b WHERE len(words) > 0)
), c AS (SELECT item_id, count(*) AS all_n FROM i GROUP BY item_id)
SELECT doc_id, item_id, round(count(*) / any_value(all_n), 6) AS containment
FROM d JOIN i USING (n, s) JOIN c USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(all_n) >= 0.8
"""
