"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

The base finds e-mail and IP addresses, payment cards and phone numbers. What it finds seeds the method, and so do
secrets that their form gives away (hexadecimal runs of 32 or more with letters and digits), a kind that only the
method has. The words around a seed make a lexical pattern (one or two words before, or one before and one after), and
any run of words that hold a digit or an @ can be an instance of a pattern; the words of a base span are one
instance. On the graph of patterns and instances of the whole corpus, scores run to and fro: a pattern is
worth the mean score of its instances, an instance the best of its other patterns, seeds keep 1. Instances
of patterns of a high score and enough different seeds are personal data of the patterns' kind, and seeds of
further patterns, round by round until no score moves; their spans are added under the kind's name with "ctx_" before it.

Everything is DataFrame work. Only texts with a digit or an @ are searched, and the graph has one row for
each pattern and instance, so that common contexts and copies are counted, not repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, join_texts, materialize, table

#: The kinds in their order, with patterns that match what the plain ones match, without any backtracking
#: that grows with the square of a text or with a deep stack: greedy runs that could give nothing back are
#: possessive, and a match starts at the start of its run, or where the last match ended.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Seeds that the method adds to those of the base.
SEEDS = (("secret", r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"),)
#: Words that hold a digit or an @.
DIGIT_WORD = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
SPAN = "array<struct<start:int,stop:int,value:string>>"


def gaps(found: Column, between: Column) -> Column:
    """(gap, len, value) of each match, from the matches and the pieces of text between them."""
    pairs = F.zip_with(found, between, lambda v, b: F.struct(F.length(b).alias("gap"), F.length(v).alias("len"), v.alias("value")))
    return F.filter(pairs, lambda s: s["value"].isNotNull())


def located(spans: Column) -> Column:
    """(start, stop, value) from the column of (gap, len, value); code points, stop exclusive.

    Running sums go by runs of 256, so that a text with very many matches costs no square of their number.
    """
    run = 256
    runs = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / run).cast("int"))
    whole = F.transform(runs, lambda r: F.aggregate(F.slice(spans, r * run + 1, run), F.lit(0), lambda a, s: a + s["gap"] + s["len"]))
    ahead = F.aggregate(whole, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def step(acc: Column, s: Column) -> Column:
        start = acc["end"] + s["gap"]
        stop = start + s["len"]
        return F.struct(stop.alias("end"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), s["value"].alias("value")))).alias("out"))

    def inside(r: Column, base: Column) -> Column:
        return F.aggregate(F.slice(spans, r * run + 1, run), F.struct(base.alias("end"), F.array().cast(SPAN).alias("out")), step)["out"]

    each = F.zip_with(runs, F.slice(ahead, 1, F.size(runs)), inside)
    return F.when(F.size(spans) > 0, F.flatten(each)).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the check sum: every second one from the right counts double, less 9 if above 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("b"), s["stop"].alias("e")))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def _short(value: Column) -> Column:
    """A value to compare with others: very long ones by their hash."""
    return F.when(F.length(value) > 200, F.sha2(value, 256)).otherwise(value)


def context(spans: Column, between: Column) -> Column:
    """spans (from located()) with before2, before and after: the words beside them, lower-cased; joined: whether
    only spaces part a span from the one before.

    between: the pieces around the spans; the whole words beside a span count, at any distance. A match starts at
    the start of a word only, so that a piece is read once.
    """
    word, gap = r"[^\x20\x09-\x0D]++", r"[\x20\x09-\x0D]++"
    start = r"(?<![^\x20\x09-\x0D])"

    def around(s: Column, i: Column) -> Column:
        ahead, behind = F.get(between, i), F.get(between, i + 1)
        found = lambda text, pattern: _short(F.lower(F.regexp_extract(text, pattern, 1)))
        return F.struct(
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            s["value"].alias("value"),
            found(ahead, f"{start}({word}){gap}{word}{gap}\\z").alias("before2"),
            found(ahead, f"{start}({word}){gap}\\z").alias("before"),
            found(behind, f"\\A{gap}({word})").alias("after"),
            ahead.rlike(f"\\A{gap}\\z").alias("joined"),
        )

    return F.transform(spans, around)


def tagged() -> Column:
    """The column words with span: the first span of the column spans (kind, b, e) that overlaps a word, by order of kinds.

    Words come by runs, as many as a run has words; each run first takes the spans that overlap it. So a text costs its
    words to the power of 1.5 at most, and not words times spans.
    """
    run = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size("words"))).cast("int"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words"), run), lambda at: F.slice("words", at, run))
    over = lambda spans, start, stop: F.filter(spans, lambda s: (s["b"] < stop) & (s["e"] > start))
    near = F.transform(runs, lambda r: over("spans", r[0]["start"], F.element_at(r, -1)["stop"]))
    return F.flatten(F.zip_with(runs, near, lambda r, spans: F.transform(r, lambda w: w.withField("span", F.get(over(spans, w["start"], w["stop"]), F.lit(0))))))


def instances() -> Column:
    """The column words (from context(), with span: the base span over a word, if any) as instances: the words of
    one base span, or a run of adjacent words without one. The context is that around the whole."""
    size = F.size("words")

    def begins(i: Column) -> Column:
        w, p = F.get("words", i), F.get("words", i - 1)
        return (i == 0) | ~F.when(w["span"].isNull() & p["span"].isNull(), w["joined"]).otherwise(F.coalesce(w["span"] == p["span"], F.lit(False)))

    def whole(s: Column, e: Column) -> Column:
        first, last = F.get("words", s), F.get("words", e)
        value = F.array_join(F.transform(F.slice("words", s + 1, e - s + 1), lambda w: w["value"]), " ")
        return F.struct(first["start"].alias("start"), last["stop"].alias("stop"), value.alias("value"), first["before2"].alias("before2"), first["before"].alias("before"), last["after"].alias("after"), first["span"]["kind"].alias("kind"))

    places = F.sequence(F.lit(0), size - 1)
    return F.zip_with(F.filter(places, begins), F.filter(places, lambda i: (i == size - 1) | begins(i + 1)), whole)


def bootstrap(candidates: DataFrame, rounds: int = 100, seeds: int = 5, confidence: float = 0.8, tolerance: float = 1e-3) -> DataFrame:
    """candidates with ``kind`` null found to be personal data: their rows, with the kind of their best pattern.

    candidates: key, text_hash, start, stop, value, before2, before, after, kind (null: not a seed). A
    pattern needs as many different seed values of its kind as ``seeds`` says; after the first round, values
    that its other patterns find with confidence count as well. A pattern's own score never makes it better. Scores run
    until no pattern appears or goes and none moves by more than tolerance; if that takes more than ``rounds`` it is an error.
    """
    patterns = F.array(
        F.when((F.col("before2") != "") & (F.col("before") != ""), F.concat_ws(" ", F.lit("2"), "before2", "before")),
        F.when(F.col("before").rlike("[:=#]$"), F.concat_ws(" ", F.lit("1"), "before")),
        F.when((F.col("before") != "") & (F.col("after") != ""), F.concat_ws(" ", F.lit("b"), "before", F.lit("_"), "after")),
    )
    value = _short(F.col("value")).alias("value")
    edges = candidates.select(F.explode(F.array_compact(patterns)).alias("pattern"), value, "kind")
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    # Patterns of fewer values can never have enough seeds.
    often = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= seeds).select("pattern")
    edges = materialize(edges.join(often, "pattern"))
    base = edges.where("kind IS NOT NULL").select("pattern", F.col("kind").alias("of"))
    own = F.when(F.col("kind") == F.col("of"), 1.0).when(F.col("kind").isNotNull(), 0.0)
    worth = F.when(F.col("by") != F.col("pattern"), F.col("best")).otherwise(F.col("second"))
    found, scores = None, None
    for _ in range(rounds):
        known = base if found is None else base.union(edges.where("kind IS NULL").join(found, "value").where(worth >= confidence).select("pattern", "of"))
        seeded = known.groupBy("pattern", "of").agg(F.count("*").alias("n_seeds")).where(F.col("n_seeds") >= seeds)
        kinds = seeded.groupBy("pattern").agg(F.max(F.struct("n_seeds", "of"))["of"].alias("of"))
        graph = materialize(edges.join(kinds, "pattern"), *((graph,) if found is not None else ()))
        each = graph.withColumn("worth", own) if found is None else graph.join(found, ["value", "of"], "left").withColumn("worth", F.coalesce(own, worth))
        last, scores = scores, materialize(each.groupBy("pattern", "of").agg(F.avg(F.coalesce("worth", F.lit(0.0))).alias("score")))
        if last is not None:
            both = scores.join(last.withColumnRenamed("score", "_last"), ["pattern", "of"], "full")
            still = not both.where(F.coalesce(F.abs(F.col("score") - F.col("_last")) > tolerance, F.lit(True))).limit(1).count()
            discard(last)
            if still:
                break
        ranked = materialize(graph.where("kind IS NULL").join(scores.select("pattern", "score"), "pattern"))
        top = ranked.groupBy("value", "of").agg(F.max(F.struct("score", "pattern")).alias("t")).select("value", "of", F.col("t.score").alias("best"), F.col("t.pattern").alias("by"))
        second = F.max(F.when(F.col("pattern") != F.col("by"), F.col("score"))).alias("second")
        found = materialize(ranked.join(top, ["value", "of"]).groupBy("value", "of", "best", "by").agg(second), ranked, *((found,) if found is not None else ()))
    else:
        raise RuntimeError(f"scores of patterns still move after {rounds} rounds")
    strong = materialize(scores.where(F.col("score") >= confidence).select("pattern", F.col("of").alias("found"), "score"))
    open_rows = candidates.where("kind IS NULL").select("*", F.explode(F.array_compact(patterns)).alias("pattern"))
    hit = open_rows.join(strong, "pattern").groupBy("key", "text_hash", "start", "stop").agg(F.max(F.struct("score", "found"))["found"].alias("kind"))
    return hit


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Two DataFrames: (key, text_hash, email, ip, card, phone, secret), arrays of (start, stop, value), one row for each
    row of docs, and (key, text_hash, kind, start, stop): what contexts add, none of it overlapping another span.

    Null texts count as empty; texts may have any length. Rows that repeat key and text repeat their base row; their
    added rows come once. Other columns of docs, whatever their names, are not looked at. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), body.alias("body"))
    rows = rows.withColumn("worth", F.col("body").rlike("[0-9@]"))
    needs = {"email": F.contains("body", F.lit("@")), "phone": F.contains("body", F.lit("+"))}
    searched = [*PATTERNS, *SEEDS, ("words", DIGIT_WORD)]
    for part, cut in (("f", lambda p: F.regexp_extract_all("body", F.lit(p), 0)), ("b", lambda p: F.split("body", p, -1))):
        rows = rows.withColumns({f"{part}_{kind}": F.when(F.col("worth") & needs.get(kind, F.lit(True)), cut(p)).otherwise(F.array().cast("array<string>")) for kind, p in searched})
    rows = rows.withColumns({f"z_{kind}": gaps(F.col(f"f_{kind}"), F.col(f"b_{kind}")) for kind, _ in searched})
    rows = rows.withColumns({f"s_{kind}": located(F.col(f"z_{kind}")) for kind, _ in searched})
    base = [_kept(kind, F.col(f"s_{kind}")).alias(kind) for kind, _ in (*PATTERNS, *SEEDS)]
    rows = rows.select("key", "text_hash", *base, context(F.col("s_words"), F.col("b_words")).alias("words"))
    spans = F.concat(*[_named(kind) for kind, _ in (*PATTERNS, *SEEDS)]).cast("array<struct<kind:string,b:int,e:int>>")
    seen = materialize(rows.select("*", spans.alias("spans")))

    marked = materialize(seen.where(F.size("words") > 0).select("key", "text_hash", tagged().alias("words")))
    named = materialize(marked.select("key", "text_hash", F.explode(instances()).alias("w")).select("key", "text_hash", "w.*"))
    return seen.drop("words", "spans"), bootstrap(named)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    seen, added = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    order = F.sort_array(F.collect_list(F.struct("kind", "start", "stop")))
    more = materialize(added.groupBy("key", "text_hash").agg(order.alias("more")))
    out = join_texts(seen, more, "left")
    names, seeds = [kind for kind, _ in PATTERNS], [kind for kind, _ in SEEDS]
    base = F.concat(*[_joined(kind, F.col(kind)) for kind in names])
    extra = F.transform("more", lambda s: F.concat_ws(":", F.concat(F.lit("ctx_"), s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    every = F.concat(base, *[_joined(kind, F.col(kind)) for kind in seeds], F.coalesce(extra, F.array().cast("array<string>")))
    return out.select(
        F.col("key").alias("doc_id"),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in (*names, *seeds)],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"),
        F.size(every).cast("long").alias("n_spans"),
    )
