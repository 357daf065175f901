"""Repeated passages of a fixed number of words, by matching statistics over compressed FM-indexes.

Equal windows must meet in one shard, so shards are by content. A window's anchor is its group of GRAM words with the
smallest hash, the leftmost of equal ones. Neighbouring windows with one anchor are a segment, which holds their
words and no other window. So segments of equal windows have equal anchors, and go to the shard of their anchor:

1. A pass over the texts writes hashes of each segment's anchor and contents. Of equal segments only the first one matters:
   a later one has nothing but windows that start earlier elsewhere. Tasks tell this of what they hold themselves before anything moves.
2. Rows are dealt by anchor and sorted, and a stream over them finds later copies, and the first ones of anchors with
   several different segments. Anchors that one segment has are done with.
3. Those first ones get their words from the texts. A shard's index is the Burrows-Wheeler transform of its segments under a
   wavelet tree in the shape of a Shannon code. All segments stream through it from right to left, one backward search step a
   word; a match that grows beyond the window is cut back to it. The suffix interval of each window
   gives the first place of its words, and windows that are not there are reported.

An anchor with more than CROWD different segments would make its shard too large. Their windows are grouped by 128 bits of
their words instead, with partial sums before the shuffle. Words are told apart by 64-bit hashes: a wrong match would need two windows of which all
other words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, masked, materialize, table, unmasked

#: Words of an anchor; characters of texts that are worked on at once; words of a shard; most segments of an anchor in a shard.
GRAM, SLICE, SHARD, CROWD = 6, 1 << 20, 250_000, 20_000
#: Bytes of texts that go to Python at once.
BATCH = 4 << 20
#: The low bits of a text's hash give way to the words of a segment.
TAG = 1 << 10
#: Documents without an id come before all others.
NO_ID = -(1 << 63)
_COPY, _OPEN, _CROWDED = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15


class _Words(dict):
    """Hashes of words, computed once each; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII spaces, as bytes.split() has them."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Spans:
    """Hashes of any spans of a sequence, from running sums of a polynomial modulo 2**64."""

    up = down = np.ones(1, dtype=np.uint64)

    def __init__(self, h: np.ndarray):
        if len(_Spans.up) <= len(h):
            many = 2 * len(h) + 1
            _Spans.up = np.cumprod(np.r_[np.uint64(1), np.full(many, _BASE, dtype=np.uint64)])
            _Spans.down = np.cumprod(np.r_[np.uint64(1), np.full(many, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(h * _Spans.up[: len(h)])]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _Spans.down[start])


def segments(h: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, start, words, anchor, contents) of the segments of documents whose words stand one after the other in h."""
    if len(h) < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    gram = min(GRAM, window)
    spans, places = _Spans(h), np.arange(len(h) - gram + 1)
    value, at, width, whole = spans.of(places, places + gram), places, 1, window - gram + 1
    while width < whole:
        step = min(width, whole - width)
        at = np.where(value[step:] < value[:-step], at[step:], at[:-step])
        value, width = np.minimum(value[step:], value[:-step]), width + step
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(of[: len(value)] == of[window - 1 :])
    if not len(inside):
        return segments(h[:0], sizes[:0], window)
    begins = np.flatnonzero(np.r_[True, (at[inside][1:] != at[inside][:-1]) | (np.diff(inside) > 1)])
    first, many = inside[begins], np.diff(np.r_[begins, len(inside)])
    words = many + window - 1
    start = first - (np.cumsum(sizes) - sizes)[of[first]]
    return of[first], start, words, value[first], spans.of(first, first + words)


def _kinds(mh: np.ndarray, sh: np.ndarray, doc: np.ndarray, start: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: whether each is the first of its segment (so is another text at the very same place of the
    same id), and whether it is a later copy. Rows that repeat are neither."""
    new = np.r_[True, (mh[1:] != mh[:-1]) | (sh[1:] != sh[:-1])]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(mh)), 0))
    tie = (doc == doc[lead]) & (start == start[lead])
    again = np.r_[False, tie[1:] & ~new[1:] & (tag[1:] == tag[:-1])]
    return new | (tie & ~again), ~tie


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ROWS = "copy boolean, mh long, sh long, doc long, start int, tag long"


def _written(window: int):
    """Rows of segments; copies within a slice of texts are told already, as ranges of words, dealt by document."""

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            texts = batch["text"].tolist()
            for low, high in _slices(texts):
                words = [hashes_of(words_of(t)) for t in texts[low:high]]
                of, start, many, anchor, contents = segments(np.concatenate(words), np.array([len(w) for w in words]), window)
                if not len(of):
                    continue
                doc, th = batch["doc"].to_numpy()[low:high][of], batch["th"].to_numpy()[low:high][of]
                rows = [anchor.view(np.int64), contents.view(np.int64), doc, start, th + many]
                order = np.lexsort(rows[::-1])
                first, copy = _kinds(*(x[order] for x in rows))
                kept = order[first]
                yield pd.DataFrame({"copy": False, "mh": rows[0][kept], "sh": rows[1][kept], "doc": doc[kept], "start": start[kept].astype(np.int32), "tag": rows[4][kept]})
                late = np.sort(order[copy])  # by document and start again
                if len(late):
                    begin, end = start[late], start[late] + many[late]
                    new = np.flatnonzero(np.r_[True, (of[late][1:] != of[late][:-1]) | (begin[1:] > end[:-1])])
                    lead, last = late[new], np.r_[new[1:], len(late)] - 1
                    yield pd.DataFrame({"copy": True, "mh": _mixed(th[lead].view(np.uint64)).view(np.int64), "sh": end[last], "doc": doc[lead], "start": begin[new].astype(np.int32), "tag": th[lead]})

    return run


_FOUND = "kind int, mh long, doc long, th long, a int, b int"


def _sorted_out(crowd: int):
    """Copies, and first segments of anchors that have several, from rows in order. No more than ``crowd`` rows wait."""

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = waiting = np.zeros((5, 0), dtype=np.int64)
        crowded = None

        def told(kind, rows: np.ndarray) -> pd.DataFrame:
            size = rows[4] & (TAG - 1)
            return pd.DataFrame({"kind": kind, "mh": rows[0], "doc": rows[2], "th": rows[4] - size, "a": rows[3].astype(np.int32), "b": (rows[3] + size).astype(np.int32)})

        def open_ones(rows: np.ndarray) -> pd.DataFrame:
            _, at, n = np.unique(rows[0], return_inverse=True, return_counts=True)
            kind = np.where(n[at] > crowd, _CROWDED, _OPEN)
            if crowded is not None:
                kind[rows[0] == crowded] = _CROWDED
            some = (n[at] > 1) | (kind == _CROWDED)
            return told(kind[some], rows[:, some])

        for batch in part:
            early = batch["copy"].to_numpy()
            if early.any():
                done = batch[early]
                yield pd.DataFrame({"kind": _COPY, "mh": 0, "doc": done["doc"], "th": done["tag"], "a": done["start"], "b": done["sh"].astype(np.int32)})
            rows = batch.loc[~early, ["mh", "sh", "doc", "start", "tag"]].to_numpy(dtype=np.int64).T
            if not rows.shape[1]:
                continue
            whole = np.hstack([before, rows])
            first, copy = _kinds(*whole)
            first[: before.shape[1]] = copy[: before.shape[1]] = False
            if copy.any():
                yield told(_COPY, whole[:, copy])
            # The first and the last row of the last segment say how the next batch goes on.
            lead = np.flatnonzero((whole[0] == whole[0, -1]) & (whole[1] == whole[1, -1]))[0]
            before = whole[:, [lead, -1]]
            firsts = np.hstack([waiting, whole[:, first]])
            last = firsts[0] == whole[0, -1]
            if not last.all():
                yield open_ones(firsts[:, ~last])
            waiting = firsts[:, last]
            if crowded == whole[0, -1] or waiting.shape[1] > crowd:
                crowded = whole[0, -1]
                yield open_ones(waiting)
                waiting = waiting[:, :0]
        if waiting.shape[1]:
            yield open_ones(waiting)

    return run


_SPELLED = "kind int, key long, more long, doc long, th long, a int, words binary"


def _spelled(window: int, shards: int):
    """The words of open segments, beside their shard; windows of crowded ones by their hashes."""

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in part:
            out = []
            for row in batch.drop_duplicates(["doc", "th"]).itertuples(index=False):
                h = hashes_of(words_of(row.text))
                spans = None
                for mh, ab, kind in zip(row.mhs, row.places, row.kinds, strict=True):
                    a, b = int(ab) >> 32, int(ab) & 0xFFFFFFFF
                    if kind == _OPEN:
                        out.append((_OPEN, int(mh) % shards, 0, row.doc, row.th, a, h[a:b].tobytes()))
                        continue
                    spans = spans or (_Spans(h), _Spans(_mixed(h)))
                    at = np.arange(a, b - window + 1)
                    one, two = (s.of(at, at + window).view(np.int64) for s in spans)
                    out += [(_CROWDED, int(x), int(y), row.doc, row.th, int(p), None) for x, y, p in zip(one, two, at, strict=True)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _SPELLED.split(", ")])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SPELLED.split(", ")])

    return run


class WaveletTree:
    """Rank queries over a sequence of symbols 0, 1, ... that all occur, in the shape of a Shannon code: a symbol of share p takes
    ceil(-log2 p) bits. Levels are bit vectors of 64-bit words with running counts."""

    def __init__(self, seq: np.ndarray):
        count = np.bincount(seq)
        self.size = np.maximum(1, np.ceil(-np.log2(count / len(seq)) - 1e-9)).astype(np.int32)
        order = np.argsort(self.size, kind="stable")
        most = int(self.size.max())
        room = np.int64(1) << (most - self.size[order])
        self.code = np.zeros(len(count), dtype=np.int32)
        self.code[order] = (np.cumsum(room) - room) >> (most - self.size[order])
        self.levels = []
        for level in range(most):
            seq = seq[self.size[seq] > level]
            node = self.code[seq] >> (self.size[seq] - level)
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            by_name = np.argsort(node[starts])
            own = np.flatnonzero(self.size > level)
            base = np.zeros(len(count), dtype=np.int32)
            base[own] = starts[by_name][np.searchsorted(node[starts][by_name], self.code[own] >> (self.size[own] - level))]
            del node, starts
            bits = ((self.code[seq] >> (self.size[seq] - 1 - level)) & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            packed = np.pad(packed, (0, 8 - len(packed) % 8)).view(np.uint64)
            ones = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.uint32)
            self.levels.append((packed, ones, base, self._ones(packed, ones, base).astype(np.int32)))
            seq = np.concatenate([seq[~bits], seq[bits]])

    @staticmethod
    def _ones(packed: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        rest = packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return ones[block].astype(np.int64) + np.bitwise_count(rest)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        out, on, size = at.astype(np.int64).copy(), np.arange(len(at)), self.size[symbol]
        for level, (packed, ones, base, before) in enumerate(self.levels):
            on = on[size[on] > level]
            if not len(on):
                break
            c = symbol[on]
            set_bits = self._ones(packed, ones, base[c] + out[on]) - before[c]
            out[on] = np.where((self.code[c] >> (self.size[c] - 1 - level)) & 1, set_bits, out[on] - set_bits)
        return out


def _suffixes(symbols: np.ndarray, ends: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of symbols, of which the first ``ends`` are ends of segments, all different; and whether each suffix shares its
    first ``window`` symbols with the one before it. Ranks double the length that they tell apart; segments are short, so that few rounds do.
    Symbols, ranks and places have four bytes each."""
    n, rank, width = len(symbols), symbols, 1
    part, known = rank, 1
    while True:
        key = rank.astype(np.int64)
        key *= n + ends + 2
        key[:-width] += rank[width:]
        key[:-width] += 1
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = np.zeros(n, dtype=np.int32)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        del key
        rank = np.empty(n, dtype=np.int32)
        rank[order] = new
        width *= 2
        if width <= window:
            part, known = rank, width
        if new[-1] == n - 1 or width >= n:
            break
    a, b = order[:-1], order[1:]
    shift = window - known if width > window or known == window else 0
    if new[-1] == n - 1 and width <= window:
        return order, np.zeros(n, dtype=bool)
    same = (part[a] == part[b]) & (part[np.minimum(a + shift, n - 1)] == part[np.minimum(b + shift, n - 1)])
    return order, np.r_[False, same]


class FMIndex:
    """Segments (arrays of word hashes) as one index, with the first place at which each window of words starts. place: an
    integer for each segment's first word that grows by one a word."""

    def __init__(self, parts: list[np.ndarray], place: np.ndarray, window: int):
        self.window, sizes = window, np.array([len(p) for p in parts])
        names, symbol = np.unique(np.concatenate(parts), return_inverse=True)
        symbol = symbol.astype(np.int32)
        m, n = len(parts), int(sizes.sum()) + len(parts)
        self.size, self.start = sizes, np.cumsum(sizes + 1) - sizes - 1
        self.first = np.r_[0, m, m + np.cumsum(np.bincount(symbol, minlength=len(names)))[:-1]]
        ends = self.start + sizes
        word = np.ones(n, dtype=bool)
        word[ends] = False
        self.symbol = np.zeros(n, dtype=np.int32)
        self.symbol[word] = symbol + 1
        ranked = self.symbol + np.int32(m - 1)
        ranked[ends] = np.arange(m)
        del names, symbol, word
        order, same = _suffixes(ranked, m, window)
        del ranked
        before = self.symbol[order - 1]
        before[order == 0] = 0
        self.tree = WaveletTree(before)
        del before
        self.place = np.repeat(place - self.start, sizes + 1)
        self.place += np.arange(n)
        self.begin = np.flatnonzero(~same).astype(np.int32)
        self.group = np.cumsum(~same, dtype=np.int32) - np.int32(1)
        self.earliest = np.minimum.reduceat(self.place[order], self.begin)

    def repeated(self) -> np.ndarray:
        """Whether a window of words that starts earlier as well starts at each place of the index: all segments at once, each from its last word to its first."""
        out = np.zeros(len(self.symbol), dtype=bool)
        low, high = np.zeros(len(self.size), dtype=np.int64), np.full(len(self.size), len(self.symbol), dtype=np.int64)
        for matched in range(1, int(self.size.max()) + 1):
            on = np.flatnonzero(self.size >= matched)
            at = self.start[on] + self.size[on] - matched
            c = self.symbol[at]
            found = self.tree.rank(np.r_[c, c], np.r_[low[on], high[on]]) + np.r_[self.first[c], self.first[c]]
            low[on], high[on] = found[: len(on)], found[len(on) :]
            if matched >= self.window:
                # The match has the window's length or a word more: the interval of the window is the group around it.
                group = self.group[low[on]]
                low[on], high[on] = self.begin[group], np.r_[self.begin, len(self.symbol)][group + 1]
                out[at] = self.earliest[group] < self.place[at]
        return out


def _searched(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(w, dtype=np.uint64) for w in group["words"]]
        doc, th, a = (group[c].to_numpy() for c in ("doc", "th", "a"))
        _, rank = np.unique(doc, return_inverse=True)
        index = FMIndex(parts, (rank.astype(np.int64) << 32) + a, window)
        late = index.repeated()
        at = np.flatnonzero(late)
        of = np.searchsorted(index.start, at, side="right") - 1
        new = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (of[1:] != of[:-1])]) if len(at) else at
        last = np.r_[new[1:], len(at)] - 1 if len(at) else at
        seg = of[new]
        begin = a[seg] + at[new] - index.start[seg]
        return pd.DataFrame({"doc": doc[seg], "th": th[seg], "a": begin.astype(np.int32), "b": (begin + at[last] - at[new] + window).astype(np.int32)})

    return run


def _tagged(text: Column) -> Column:
    """A hash of the text that leaves the low bits free."""
    return F.xxhash64(text).bitwiseAND(F.lit(-TAG))


def repeated_ranges(docs: DataFrame, window: int = 20, crowd: int = CROWD) -> DataFrame:
    """(doc, th, a, b): ranges of words (b excluded) that windows which start earlier too cover. docs: doc long, th, text."""
    if not 1 <= window <= TAG // 2 - 1:
        raise ValueError(f"a window has 1 to {TAG // 2 - 1} words")
    dealt = docs.where("text IS NOT NULL").mapInPandas(_written(window), _ROWS).repartition("mh").sortWithinPartitions("mh", "sh", "doc", "start", "tag")
    found = materialize(dealt.mapInPandas(_sorted_out(crowd), _FOUND), bytes_at_once=BATCH)
    some = found.where(F.col("kind") != _COPY)
    place = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    lists = some.groupBy("doc", "th").agg(F.collect_list(F.struct("mh", place.alias("p"), "kind")).alias("x")).select("doc", "th", F.col("x.mh").alias("mhs"), F.col("x.p").alias("places"), F.col("x.kind").alias("kinds"))
    shards = max(1, -(-(found.where(F.col("kind") == _OPEN).agg(F.sum(F.col("b") - F.col("a"))).first()[0] or 0) // SHARD))
    spelled = materialize(docs.join(lists, ["doc", "th"]).select("doc", "th", "text", "mhs", "places", "kinds").mapInPandas(_spelled(window, shards), _SPELLED), bytes_at_once=BATCH)
    indexed = spelled.where(F.col("kind") == _OPEN).select("key", "doc", "th", "a", "words").groupBy("key").applyInPandas(_searched(window), "doc long, th long, a int, b int")
    crowded = spelled.where(F.col("kind") == _CROWDED).select("key", "more", "doc", "th", "a")
    earliest = crowded.groupBy("key", "more").agg(F.min(F.struct("doc", "a")).alias("_e"), F.count("*").alias("_n")).where("_n > 1")
    late = crowded.join(earliest, ["key", "more"]).where(F.struct("doc", "a") > F.col("_e")).select("doc", "th", "a", (F.col("a") + window).cast("int").alias("b"))
    out = materialize(found.where(F.col("kind") == _COPY).select("doc", "th", "a", "b").union(indexed).union(late), bytes_at_once=BATCH)
    discard(found, spelled)
    return out


def _kept(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in part:
        out = []
        for text, ranges in zip(batch["_text"], batch["_ranges"], strict=True):
            words = words_of(text)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if ranges is not None:
                both = np.asarray(ranges, dtype=np.int64)
                np.add.at(gone, both >> 32, 1)
                np.add.at(gone, both & 0xFFFFFFFF, -1)
            stay = np.cumsum(gone)[:-1] == 0
            kept = words if stay.all() else [w for w, s in zip(words, stay, strict=True) if s]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        more = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"], index=batch.index)
        yield pd.concat([batch.drop(columns=["_text", "_ranges"]), more], axis=1)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, crowd: int = CROWD) -> DataFrame:
    """The columns of docs with n_words, n_removed and kept: the words, joined by spaces, that no window of ``window`` words
    covers which also starts earlier, at a smaller key or earlier under the same one. Windows are judged on the input.

    Null texts have no words; texts of any length are whole; null keys come before all others. Rows that repeat, and texts
    under one key, are one document: places with the same key and number of words are the same place, none earlier than
    the other. Columns named like those added are replaced. Empty tables give empty ones. The last step is left to whoever reads the result:
    a table of long texts is best written by ``materialize(..., bytes_at_once=BATCH)``, so that few of them are in Python at once.
    """
    plain, names = masked(docs)
    doc = F.coalesce(F.col(names[key]).cast("long"), F.lit(NO_ID))
    body = F.col(names[text])
    ranges = repeated_ranges(plain.select(doc.alias("doc"), _tagged(body).alias("th"), body.alias("text")), window, crowd)
    lists = ranges.groupBy("doc", "th").agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))).alias("_ranges"))
    rows = plain.withColumns({"_doc": doc, "_th": _tagged(body)}).join(lists.withColumnsRenamed({"doc": "_doc", "th": "_th"}), ["_doc", "_th"], "left")
    rest = [c for c in plain.columns if docs.columns[int(c[1:])] not in ("n_words", "n_removed", "kept")]
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in rest) + ", n_words long, n_removed long, kept string"
    out = rows.select(*rest, body.alias("_text"), "_ranges").mapInPandas(_kept, schema)
    return unmasked(out, {old: new for old, new in names.items() if new in rest}, "n_words", "n_removed", "kept")


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words that have stood before."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return materialize(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), bytes_at_once=BATCH)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT row, doc, s, array_to_string(w[s:s + 19], ' ') AS win FROM (SELECT row, doc, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), late AS (
  SELECT row, s FROM (SELECT row, doc, s, min([doc, s]) OVER (PARTITION BY win) AS f FROM starts) WHERE f < [doc, s]
), gone AS (SELECT DISTINCT row, s + o AS at_word FROM late, range(20) r(o)),
g AS (SELECT row, count(*) AS n, list(at_word) AS l FROM gone GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g.l IS NULL THEN d.w ELSE (SELECT coalesce(list(x ORDER BY i), []) FROM (SELECT unnest(d.w) AS x, unnest(range(1, len(d.w) + 1)) AS i) WHERE NOT list_contains(g.l, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.row = d.row
"""
