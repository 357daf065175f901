"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets link when their Jaccard similarity reaches a threshold; then they differ in at most H elements, by
their sizes. Hash values of shingles are dealt into segments by range, with a number of segments for each
band of sizes. Of more than H whole segments one at least holds the same in both sets, so equal segment
contents are the index. A segment may be used in three ways, and the cheapest allocation is chosen for
each band by its cost, signatures and chance matches:

* skipped: segments of few elements match by chance, so larger ones are taken in their place;
* exact: its contents are one signature, worth one difference;
* one-deletion: its contents and all its contents less one element are signatures, worth two differences.

Documents with equal sets, by 128 bits, are one class, and classes are joined. A bucket of classes with the same signature
is linked to its smallest class first, and then, while it holds more than one component, to other classes of
it. Only classes of components that still differ are compared with each other, large buckets by blocks, under a
bound that no link can miss: parities of elements by 512 hash slots differ in at most H slots. What passes is
verified with the exact sets. So all links between components are found, and a group of near copies costs no pairs
of all with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, masked, materialize, table, unmasked
from linkpeak.llm.components import components

#: Slots of the parity sketch, 64 to a long.
SKETCH = 8
#: Up to this size bands grow by 1 / threshold, from it on by 2.
FINE = 256
#: What comparing two classes that match by chance costs, in signatures.
PAIR_COST = 0.02
#: Classes of a block, where the classes of a large bucket are compared by blocks.
BUCKET = 2000
#: So many classes to verify, of 40 bytes each, are broadcast to the texts; of more, texts are shuffled.
SENT = 800_000
#: Turns in which buckets of several components are tried with one class each, before all of them are compared.
PIVOTS = 4
#: Texts or pairs of sets that go to Python at once: a set may take hundreds of kilobytes.
AT_ONCE = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, computed once each; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of n words; fewer words are one shingle. A-Z are lower-cased and
    words stand between ASCII spaces, as bytes.lower() and bytes.split() have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    m = min(n, len(h))
    many = len(h) - m + 1
    acc = np.full(many, m, dtype=np.uint64)
    for k in range(m):
        acc = acc * _MIX + h[k : k + many]
    return np.unique(_mixed(acc))


def max_difference(sizes: int | Column, percent: int) -> int | Column:
    """The most elements in which linked sets of so many elements together differ: floor(sizes * (1 - t) / (1 + t))."""
    return sizes * (100 - percent) // (100 + percent) if isinstance(sizes, int) else F.floor(sizes * (100 - percent) / (100 + percent) + 1e-9)


@lru_cache
def band_edges(percent: int, top: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] < top:
        last = edges[-1]
        edges.append(max(last + 1, -(-last * 100 // percent)) if last < FINE else 2 * last)
    return edges


def _poisson_below(q: int, mean: float) -> float:
    return sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(q))


@lru_cache
def allocation(low: int, high: int, percent: int, population: int) -> tuple[str, int, int]:
    """("none" | "exact" | "deletion", segments, least size of a segment that is used) for sizes low to high - 1."""
    h = max_difference(2 * (high - 1), percent)
    if h == 0:
        return "none", 0, 0
    options = []
    parts = h // 2 + 1
    tiny = _poisson_below(2, low / parts)
    options.append((parts + high + PAIR_COST * population * parts * tiny**2, ("deletion", parts, 0)))
    for q in (2, 3, 4):
        for share in (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15):
            m = int(share * high) + 1
            if m < (high - 1) * (100 - percent) // percent + 2:
                continue
            short = 0.0
            for size in (low, high - 1):
                need, p = size * (100 - percent) // percent + 1, 1 - _poisson_below(q, size / m)
                mean, sd = (m - 1) * p, math.sqrt(max((m - 1) * p * (1 - p), 1e-9))
                short = max(short, 0.5 * math.erfc((mean - need) / sd / math.sqrt(2)))
            chance = m * (short * math.exp(-low / m)) ** 2 + m * math.exp(-low / m * 2) * (low / m / 50) ** (2 * q)
            options.append((high * (100 - percent) / percent + short * m + PAIR_COST * population * chance, ("exact", m, q)))
    return min(options)[1]


def signatures(tokens: np.ndarray, percent: int, population: int) -> np.ndarray:
    """The signatures of a set: those of its own band, and of the next one if a linked set may lie there."""
    size, edges = len(tokens), band_edges(percent)
    if not size:
        return tokens
    band = int(np.searchsorted(edges, size, side="right")) - 1
    out = []
    values = _mixed(tokens + _MIX)
    for b in (band, band + 1):
        if b > band and size * 100 < edges[b] * percent:
            continue
        # Linked sets of the band below come down to percent of this band's low end.
        low = max(1, edges[b] * percent // 100) if b else 1
        kind, m, least = allocation(low, edges[b + 1], percent, population)
        if kind == "none":
            continue
        # Segments are ranges of hash values; their contents are summed up, so that order plays no part.
        segment = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(segment, minlength=m)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
        ends = np.cumsum(counts)
        content = sums[ends] - sums[ends - counts]
        tag = _mixed(np.arange(m, dtype=np.uint64) + np.uint64(b << 40))
        if kind == "exact":
            need = size * (100 - percent) // percent + 1
            use = np.nonzero(counts[:-1] >= least)[0][:need]
            # Without enough large segments all are used, small ones too.
            out.append(_mixed(content + tag)[use if len(use) == need else slice(None)])
        else:
            out.append(_mixed(content + tag))
            out.append(_mixed(content[segment] - values + tag[segment]))
    return np.unique(np.concatenate(out)) if out else tokens[:0]


def _sketch(tokens: np.ndarray) -> np.ndarray:
    slot = (_mixed(tokens ^ _MIX) >> np.uint64(64 - 9)).astype(np.int64)
    parity = np.bincount(slot, minlength=64 * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _print_of(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits that tell sets apart; the first half is cut to ``bits``."""
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "big", signed=True) >> (64 - bits), int.from_bytes(d[8:], "big", signed=True)


def _scanned(n: int, percent: int, population: int, bits: int):
    """One pass over the texts: sizes, fingerprints, sketches and signatures of their sets."""

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            # Small pieces, so that a task never holds the sets of many texts at once.
            for start in range(0, len(batch), 200):
                piece = batch.iloc[start : start + 200]
                sets = [shingle_set(t, n) for t in piece["text"]]
                both = np.array([_print_of(s, bits) for s in sets], dtype=np.int64).reshape(-1, 2)
                sketch = np.stack([_sketch(s) for s in sets])
                sigs = [signatures(s, percent, population).view(np.int64) for s in sets]
                yield pd.DataFrame({"id": piece["id"].to_numpy(), "bare": piece["bare"].to_numpy(), "size": np.array([len(s) for s in sets], dtype=np.int64), "print": both[:, 0], "check": both[:, 1], "text_hash": piece["text_hash"].to_numpy()} | {f"s{i}": sketch[:, i] for i in range(SKETCH)} | {"sigs": sigs})

    return run


def _tokens(n: int, bits: int):
    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            sets = [shingle_set(t, n) for t in batch["text"]]
            same = [_print_of(s, bits) == (p, c) for s, p, c in zip(sets, batch["print"], batch["check"], strict=True)]
            yield pd.DataFrame({"node": batch["node"], "tokens": [s.tobytes() for s in sets]})[np.array(same, dtype=bool)]
            # What Arrow holds of batches that are done would count beside the next ones.
            pa.default_memory_pool().release_unused()

    return run


def _linked(percent: int):
    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            keep = []
            for a, b in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]
            pa.default_memory_pool().release_unused()

    return run


class _Join:
    """Classes of documents with equal sets, and the links between them. Tables are deleted as soon as they are read no more."""

    def __init__(self, docs: DataFrame, n: int, percent: int, text: str, key: str, bits: int = 64):
        self.docs, self.n, self.percent, self.bits = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")), n, percent, bits
        shape = "id long, bare boolean, size long, print long, check long, text_hash long, " + ", ".join(f"s{i} long" for i in range(SKETCH)) + ", sigs array<long>"
        population = max(1, self.docs.count() // 20)
        # A null among keys would turn them all into floating-point numbers in Python, so they come as two columns.
        given = self.docs.select(F.coalesce("key", F.lit(0)).alias("id"), F.col("key").isNull().alias("bare"), "text", "text_hash")
        scanned = materialize(given.mapInPandas(_scanned(n, percent, population, bits), shape), at_once=AT_ONCE)
        self.scanned = scanned
        sketch = [F.first(f"s{i}").alias(f"s{i}") for i in range(SKETCH)]
        rows = scanned.withColumn("key", F.when(~F.col("bare"), F.col("id")))
        grouped = rows.where("size > 0").groupBy("print", "check").agg(F.min("key").alias("rep"), F.coalesce(F.min_by("text_hash", "key"), F.min("text_hash")).alias("rep_hash"), F.first("size").alias("size"), *sketch)
        self.classes = materialize(grouped.withColumn("node", F.col("print")))
        rows = rows.withColumn("node", F.col("print"))
        # Sets of different fingerprints but the same first half: all but one get another number. That is next to never.
        turn, moved = 0, None
        while (clash := materialize(self.classes.groupBy("node").agg(F.count("*").alias("_n"), F.min(F.struct("print", "check")).alias("_stays")).where("_n > 1"))).limit(1).count():
            turn += 1
            other = self.classes.join(clash, "node", "left").withColumn("_goes", F.col("_n").isNotNull() & (F.struct("print", "check") != F.col("_stays")))
            self.classes = materialize(other.withColumn("node", F.when(F.col("_goes"), F.xxhash64(F.lit(turn), "print", "check")).otherwise(F.col("node"))).drop("_n", "_stays", "_goes"), self.classes, clash)
        discard(clash)
        if turn:
            moved = self.classes.where("node <> print").select("print", "check", F.col("node").alias("_node"))
            rows = rows.join(moved, ["print", "check"], "left").withColumn("node", F.coalesce("_node", "node")).drop("_node")
        self.rows = rows

    def candidates(self) -> DataFrame:
        """(sig, hub, node): the members of each bucket of two classes or more, and its smallest class."""
        found = self.rows.select("node", F.explode("sigs").alias("sig"))
        buckets = materialize(found.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("_top")).where("hub <> _top").select("sig", "hub"))
        return materialize(found.join(buckets, "sig").groupBy("sig", "hub", "node").agg(F.lit(1).alias("_one")).drop("_one"), buckets)

    def near(self, a: str, b: str) -> Column:
        """Whether the classes a and b may link, by sizes."""
        x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
        return (x * 100 >= y * self.percent) & (y * 100 >= x * self.percent)

    def bound(self, a: str, b: str) -> Column:
        """Whether the classes a and b may link, by sizes and sketches."""
        apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
        return self.near(a, b) & (apart <= max_difference(F.col(f"{a}.size") + F.col(f"{b}.size"), self.percent))

    def verified(self, pairs: DataFrame, bounded: bool = False) -> DataFrame:
        """The pairs (a, b) of classes that link."""
        if not bounded:
            x, y = self.classes.alias("x"), self.classes.alias("y")
            pairs = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(self.bound("x", "y")).select("a", "b")
        pairs = materialize(pairs)
        nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(self.classes.select("node", "print", "check", "rep", "rep_hash"), "node"))
        nodes = F.broadcast(nodes) if (written := nodes).count() <= SENT else nodes
        # Only one text of each class is needed: that of its representative's key and hash. Where no row has a key,
        # copies meet as well, so that they are made one first. Sets of another fingerprint are left out.
        keyed = self.docs.where("key IS NOT NULL").join(nodes, (F.col("key") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("node", "print", "check", "text")
        bare = written.where("rep IS NULL")
        if bare.limit(1).count():
            copies = self.docs.where("key IS NULL").join(bare, F.col("text_hash") == F.col("rep_hash")).groupBy("node", "print", "check", "text").agg(F.lit(1).alias("_one")).drop("_one")
            keyed = keyed.union(copies)
        tokens = keyed.mapInPandas(_tokens(self.n, self.bits), "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))
        tokens = materialize(tokens, written, at_once=AT_ONCE)
        left, right = tokens.withColumnsRenamed({"node": "a", "tokens": "left"}), tokens.withColumnsRenamed({"node": "b", "tokens": "right"})
        return materialize(pairs.join(left, "a").join(right, "b").mapInPandas(_linked(self.percent), "a long, b long"), pairs, tokens, at_once=AT_ONCE)

    def links(self) -> DataFrame:
        """(node, label) of every class that links with another; label is the smallest node of the component."""
        members = self.candidates()
        # One candidate each: the smallest hub. Most near copies are in one component after that.
        first = members.where("node <> hub").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
        edges = self.verified(first)
        labels = components(edges)
        # Buckets of several components: another class of the bucket in each turn, against all that are not with it yet.
        for turn in range(PIVOTS):
            rest = self._mixed(members, labels)
            pivot = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("_h"), "node", "label", "size"))
            pivots = materialize(rest.groupBy("sig").agg(pivot.alias("p")).select("sig", "p.*"))
            found = self.verified(self._pairs(rest, pivots, F.col("x.label") != F.col("y.label")))
            discard(rest, pivots)
            if not found.limit(1).count():
                discard(found)
                break
            edges = materialize(edges.union(found), edges, found)
            discard(labels)
            labels = components(edges)
        # What may link of any two components of a bucket is compared, so that none is missed.
        rest = self._mixed(members, labels, SKETCH)
        found = self.verified(self._blocks(rest), bounded=True)
        discard(members, rest)
        if found.limit(1).count():
            whole = materialize(edges.union(found), edges)
            discard(labels)
            labels = components(whole)
            discard(whole)
        discard(edges, found)
        return labels

    def labelled(self) -> DataFrame:
        """(node, rep, label) of every class, written."""
        labels = self.links()
        return materialize(self.classes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")), labels)

    def done(self) -> None:
        """Deletes what the join has written; its rows cannot be read any more."""
        discard(self.scanned, self.classes)

    def _mixed(self, members: DataFrame, labels: DataFrame, sketch: int = 0) -> DataFrame:
        """(sig, node, label, many, size) of the buckets that hold more than one component, with sketch where asked."""
        named = members.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        mixed = materialize(named.groupBy("sig").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("many")).where("_a <> _b").select("sig", "many"))
        return materialize(named.join(mixed, "sig").join(self.classes.select("node", "size", *[f"s{i}" for i in range(sketch)]), "node"), mixed)

    def _pairs(self, left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & apart & self.near("x", "y"))
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def _blocks(self, rest: DataFrame) -> DataFrame:
        """The pairs of each bucket's members of different components that may link. Large buckets are cut into blocks
        of some BUCKET classes, and each two blocks meet by a key of their own, so that no key is hot."""
        cut = F.ceil(F.col("many") / BUCKET).cast("int")
        own = F.pmod(F.xxhash64(F.lit(99), "node"), cut).cast("int")
        dealt = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
        x = dealt.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
        left, right = x.where("own = one").alias("x"), x.where("own = two").alias("y")
        meet = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.one") == F.col("y.one")) & (F.col("x.two") == F.col("y.two"))
        # Within one block each pair comes once; of two blocks both orders of labels are needed.
        apart = (F.col("x.label") != F.col("y.label")) & ((F.col("x.one") != F.col("x.two")) | (F.col("x.label") < F.col("y.label")))
        return left.join(right, meet & apart & self.bound("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """(key, size, component), one row for each row of docs: the number of its distinct shingles of n words, and
    the smallest key that links of at least percent / 100 reach, its own included.

    Null and empty texts have size 0 and link with nothing. Texts may have any length. Rows that share a key count as
    linked if their texts are alike; of rows with one key and different texts each goes with its own text. Null keys
    are never reported as a component while a row of the component has a key. Keys are integers of 64 bits; other
    columns of docs, whatever their names, are not looked at. An empty table stays empty. ``bits`` shortens the
    numbers of sets, for tests of what happens when two agree.
    """
    join = _Join(docs, n, percent, text, key, bits)
    labelled = join.labelled()
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    named = labelled.join(smallest, "label").select("node", "component")
    out = join.rows.select("key", "size", "node").join(named, "node", "left")
    out = materialize(out.select("key", "size", F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("key")).alias("component")), labelled)
    join.done()
    return out


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, but one only of each component: that of the smallest key (null comes last), of rows of one
    key that of the smallest hash of its text, then of the whole row. Null and empty texts stay, each row of them.
    Columns may have any names; an empty table stays empty.
    """
    join = _Join(docs, n, percent, text, key)
    labelled = join.labelled()
    rows = join.rows.where("size > 0").join(labelled.select("node", "label"), "node")
    counted = rows.groupBy("label", "key", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("key").isNull().alias("_bare"), "key", "text_hash", "n")).alias("p")
    picks = materialize(counted.groupBy("label").agg(first).select("label", F.col("p.key").alias("_key"), F.col("p.text_hash").alias("_hash"), F.col("p.n").alias("_n")), labelled)
    join.done()
    picks = picks.withColumnRenamed("label", "_label")
    given, names = masked(docs)
    body, own = F.col(names[text]), F.col(names[key]).cast("long")
    wordless = ~F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    meets = own.eqNullSafe(F.col("_key")) & (F.xxhash64(body) == F.col("_hash")) & ~wordless
    out = given.where(wordless).union(given.join(picks.where("_n = 1"), meets, "left_semi"))
    repeated = picks.where("_n > 1")
    if repeated.limit(1).count():
        # Of rows of one key and text; what the row hash leaves open are rows that are the same.
        row = F.min_by(F.struct(*given.columns), F.xxhash64(*given.columns)).alias("_row")
        out = out.union(given.join(repeated, meets).groupBy("_label").agg(row).select("_row.*"))
    return unmasked(out, names)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    found = similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)
    return found.select(F.col("key").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


#: Every two documents that share a shingle are compared, so this is for small tables of unique ids.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(words[i:i + 2], ' ') for i in range(1, greatest(len(words) - 2, 1) + 1)]) AS g FROM w WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
