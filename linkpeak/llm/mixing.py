"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Of all rates that give each source its
target number of words, and of which none is above ``cap``, those with the least relative entropy to
"one copy each" are exponentially tilted: ``rate = min(cap, exp(lambda * size / mean size))`` with one
multiplier per source. The multipliers solve the convex dual by Newton's method. Documents of one source
and size share a rate, so each step sums over counts by (source, size) and never over single documents;
a bracket around each multiplier makes the steps safe where the cap flattens the dual.

Rates become copies by one rule: ``floor(rate)`` copies, and one more where ``hash / fraction`` lies under
a limit near 1. The limit of each source is found by histograms over that ratio, refined twice, so that
the words taken miss the target by about the size of one document. Nothing is sorted over a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkpeak.llm.common import WORD, discard, hash01, masked, materialize, table, unmasked

#: Bins of each of the three histograms, one inside the other, that locate the limit of a source.
BINS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null becomes "n", a name gets an "s" before it."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def capped_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target`` to rows (skey, weight, source_size): share of all sizes by weight, at most cap times
    the source's size; what stands above is shared again by weight until none is above.

    In the order of cap * size / weight the capped sources come first, so that running sums find them.
    """
    order = Window.orderBy("_ratio", "skey")
    upto, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.col("source_size") * F.lit(float(cap))
    ranked = sources.withColumn("_most", most).withColumn("_ratio", F.col("_most") / F.col("weight"))
    ranked = ranked.withColumns({"_all": F.sum("source_size").over(every) * F.lit(float(share)), "_below": F.coalesce(F.sum("_most").over(upto), F.lit(0.0)), "_rest": F.sum("weight").over(rest)})
    ranked = ranked.withColumn("_capped", F.col("_ratio") * F.col("_rest") + F.col("_below") <= F.col("_all"))
    level = (F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_most"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(every)
    return ranked.withColumn("target", F.when(F.col("_capped"), F.col("_most")).otherwise(level * F.col("weight"))).select(*sources.columns, "target")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(skey, weight, source_size, n, squares, target); sources by code point, null last, take the weights in turn.

    There is one row per source here; its few windows run over sources, not documents.
    """
    sums = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    return capped_targets(sums.withColumn("weight", weight).drop("source"), share, cap)


def _rate(cap: float, z: Column, full: Column, tilt: Column) -> Column:
    return F.when(full, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(tilt * z, F.lit(50.0)))))


def balance(sizes: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-4, max_steps: int = 40) -> DataFrame:
    """targets with ``tilt``, the multiplier of each source, and ``full`` where every document is at the cap."""
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9))
    # The first multiplier is right if all documents are as long as the one of the average word.
    start = F.try_divide(F.ln(F.try_divide("target", "source_size")), F.try_divide("squares", F.col("source_size") * mean))
    state = materialize(targets.select("*", mean.alias("mean"), (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"), F.coalesce(start, F.lit(0.0)).alias("tilt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
    counts = materialize(sizes.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("_c")))
    # Sums of decimals do not depend on the order of rows, so that reruns agree to the last digit.
    exact = lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")
    for _ in range(max_steps):
        z = F.col("size") / F.col("mean")
        words = F.col("_c") * F.col("size") * _rate(cap, z, F.col("full"), F.col("tilt"))
        slope = F.when((F.exp(F.least(F.col("tilt") * z, F.lit(50.0))) < cap) & ~F.col("full"), words * z).otherwise(0.0)
        sums = counts.join(state.select("skey", "mean", "full", "tilt"), "skey").groupBy("skey").agg(exact(words).alias("_words"), exact(slope).alias("_slope"))
        state = state.join(sums, "skey", "left").withColumn("_miss", F.coalesce(F.col("_words"), F.lit(0.0)) - F.col("target"))
        done = F.col("full") | (F.abs("_miss") <= tolerance * F.greatest(F.col("target"), F.lit(1.0)))
        state = state.withColumns({"_done": done, "lo": F.when(F.col("_miss") < 0, F.col("tilt")).otherwise(F.col("lo")), "hi": F.when(F.col("_miss") > 0, F.col("tilt")).otherwise(F.col("hi"))})
        newton = F.col("tilt") - F.try_divide("_miss", "_slope")
        # Without a bracket yet, a step at most doubles the distance from 0; with one, a step outside is a bisection.
        low, high = F.coalesce("lo", F.least(F.lit(-1.0), 2 * F.col("tilt"))), F.coalesce("hi", F.greatest(F.lit(1.0), 2 * F.col("tilt")))
        step = F.when((newton > low) & (newton < high), newton).when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (low + high) / 2).otherwise(F.when(F.col("_miss") < 0, high).otherwise(low))
        state = state.withColumn("tilt", F.when(F.col("_done"), F.col("tilt")).otherwise(step))
        state = materialize(state.select(*targets.columns, "mean", "full", "tilt", "lo", "hi", "_done"))
        if not state.where(~F.col("_done")).limit(1).count():
            break
        state = state.drop("_done")
    else:
        raise RuntimeError(f"no balance after {max_steps} steps")
    discard(counts)
    return state.select(*targets.columns, "mean", "full", "tilt")


def _with_priority(rows: DataFrame, cap: float) -> DataFrame:
    """Adds whole copies ``_whole`` and ``_p``, in (0, 1), in whose order documents get one more; null: never."""
    rows = rows.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(cap, F.col("size") / F.col("mean"), F.col("full"), F.col("tilt"))))
    rows = rows.withColumn("_whole", F.floor("rate")).withColumn("_part", F.col("rate") - F.col("_whole"))
    ratio = F.col("_u") / F.col("_part")
    return rows.withColumn("_p", F.when((F.col("_part") > 0) & (F.col("size") > 0), ratio / (1 + ratio)))


def extra_limits(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(skey, limit): documents whose _p is under limit get one copy more. rows: skey, size, _whole, _p."""
    whole = rows.groupBy("skey").agg(F.sum(F.col("size") * F.col("_whole")).alias("_given"))
    found = materialize(state.join(whole, "skey").select("skey", (F.col("target") - F.col("_given")).alias("_need"), F.lit(0.0).alias("_lo"), F.lit(1.0).alias("_width")))
    parts = rows.where(F.col("_p").isNotNull()).select("skey", "size", "_p")
    for _ in range(3):
        at = F.floor((F.col("_p") - F.col("_lo")) / F.col("_width") * BINS).cast("int")
        bins = parts.join(found, "skey").where((F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_lo") + F.col("_width"))).groupBy("skey", at.alias("_bin")).agg(F.sum("size").alias("_words"))
        run = Window.partitionBy("skey").orderBy("_bin")
        sums = bins.withColumn("_upto", F.sum("_words").over(run)).join(found, "skey")
        # The first bin that passes the need; where none does, the place behind the last bin.
        hit = sums.groupBy("skey").agg(
            F.min(F.when(F.col("_upto") > F.col("_need"), F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("_below"), "_words"))).alias("_hit"),
            F.max("_upto").alias("_whole_sum"),
        )
        step = F.col("_width") / BINS
        found = found.join(hit, "skey", "left").select(
            "skey",
            F.when(F.col("_hit").isNotNull(), F.col("_need") - F.col("_hit._below")).otherwise(F.col("_need") - F.coalesce("_whole_sum", F.lit(0))).alias("_need"),
            F.when(F.col("_hit").isNotNull(), F.col("_lo") + F.col("_hit._bin") * step).otherwise(F.col("_lo") + F.col("_width")).alias("_lo"),
            F.when(F.col("_hit").isNotNull(), step).otherwise(F.lit(0.0)).alias("_width"),
            F.coalesce("_hit._words", F.lit(0)).alias("_last"),
        )
        found = materialize(found)
        last, found = found, found.drop("_last")
    # Of the last bin take all or nothing, whichever comes nearer.
    return last.select("skey", F.when(F.col("_need") * 2 > F.col("_last"), F.col("_lo") + F.col("_width")).otherwise(F.col("_lo")).alias("limit"))


def _rated(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 11, text: str = "text", source: str = "source", key: str = "doc_id") -> tuple[DataFrame, dict[str, str]]:
    """docs, masked, with the columns that mix() adds, and the masked names."""
    given, names = masked(docs)
    own = F.col(names[source])
    sized = given.withColumns({"size": word_count(F.col(names[text])), "skey": source_key(own)}).withColumn("_u", hash01(F.col(names[key]), "size", "skey", seed=seed))
    narrow = materialize(sized.select(own.alias("source"), "skey", "size", "_u"))
    state = materialize(balance(narrow, materialize(source_targets(narrow, list(weights), share, cap)), cap))
    limits = materialize(extra_limits(_with_priority(narrow.join(state.drop("weight", "n", "squares"), "skey"), cap), state))
    rates = materialize(state.join(limits, "skey").select("skey", "source_size", "target", "mean", "full", "tilt", "limit"), narrow)
    copies = F.col("_whole") + F.when(F.col("_p") < F.col("limit"), 1).otherwise(0)
    return _with_priority(sized.join(rates, "skey"), cap).withColumn("copies", copies.cast("long")), names


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target, rate and copies (long); see the module for the method, and _rated() for
    the options: weights of the sources in turn, share of all sizes, cap, seed, and the names of columns.

    Targets come from all rows. Null texts have size 0 and, like empty ones, one copy that adds no words; texts may
    have any length. Null sources are one source. Rows with equal key, source and size fare alike. An empty table
    stays empty. Added columns replace columns of docs of the same names; all other columns stay, whatever their names.
    """
    out, names = _rated(docs, **options)
    return unmasked(out, names, "size", "source_size", "target", "rate", "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as often as it has copies, with the columns of docs as they are."""
    out, names = _rated(docs, **options)
    return unmasked(out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mixture takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
