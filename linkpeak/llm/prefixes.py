"""The prefix tree of conversations, by an external mergesort that carries common prefixes.

A turn becomes a token of 40 bytes, the SHA-256 of its role and text and the length of the text, and a conversation the
string of its tokens. Spark's range exchange deals conversations by (tokens, id) into ranges of bounded size, so that
thousands of equal conversations may span ranges. A range is sorted by runs, each with the number of tokens that a
row shares with the row before it (its LCP). A loser tree merges the runs: whoever shares more with the last row wins
without any comparison, and others are compared from the first token that they might not share. The merged
stream feeds a stack of open nodes, the path of the last row; a row closes what lies below its LCP, and closed nodes
are finished.

Only nodes on the path of a range's first or last row may go on in other ranges. Their parts are joined by
groups of FAN neighbouring ranges, level after level, as each group has such paths of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkpeak.llm.common import discard, materialize, table

#: Bytes of a token; rows of a run; bytes of tokens in a range; ranges that are joined at once; nodes to broadcast at most.
TOKEN, RUN, RANGE, FAN, FEW = 40, 8192, 64 << 20, 256, 200_000
_NODE = "kind int, id binary, parent binary, part int, first boolean, last boolean, bytes long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]
_CONTRACT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_FINISHED, _PATH, _ENDS = 0, 1, 2
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def token(role: Column, text: Column) -> Column:
    """A turn as 40 bytes; null counts as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def _joined(tokens: Column) -> Column:
    return F.unhex(F.array_join(F.transform(tokens, F.hex), ""))


def _sorted_turns(turns: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens) in order of turn, null first; equal turns by their tokens."""
    return turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "token"))).alias("t")).select(*keys, F.col("t.token").alias("tokens"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens binary) of conversations as they are; turns: conv_id, turn, role, text. Rows without a conv_id
    take no part, repeated turns count as often as they stand there. A conversation must fit into a row, 40 bytes a turn."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", token(F.col("role"), F.col("text")).alias("token"))
    return _sorted_turns(rows, "conv_id").select("conv_id", _joined(F.col("tokens")).alias("tokens"))


def rebuilt_sequences(turns: DataFrame) -> DataFrame:
    """The same where the first h turns are those of conversation c - c % 5, with h = crc32(c) % 9: the five
    conversations that share them are dealt to one place, so that they meet without a join."""
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    rows = turns.where("conv_id IS NOT NULL").select(base, "conv_id", "turn", token(F.col("role"), F.col("text")).alias("token"))
    own = _sorted_turns(rows.repartition("base"), "base", "conv_id")
    most = 8
    # Five conversations for each base, nine where ids below zero meet those above.
    fives = own.withColumn("head", F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("tokens", 1, most)), ignorenulls=True).over(Window.partitionBy("base")))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    head, tail = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h")), F.slice("tokens", F.col("h") + 1, F.size("tokens"))
    return fives.withColumn("h", h).select("conv_id", _joined(F.concat(head, tail)).alias("tokens"))


def common_tokens(a: bytes, b: bytes, start: int = 0) -> int:
    """Tokens that a and b share from the beginning; the first ``start`` are known to be equal."""
    at, end = start * TOKEN, min(len(a), len(b))
    while at < end and a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at // TOKEN


class Run:
    """Sorted rows (tokens, conv_id), each with what it shares with the one before, and a place among them. The current
    row's shared is meant against the last row of the merged stream."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.rows = sorted(rows)
        self.lcps = [0, *(common_tokens(a[0], b[0]) for a, b in zip(self.rows, self.rows[1:], strict=False))]
        self.at, self.shared = 0, 0

    def step(self) -> None:
        self.at += 1
        if self.at < len(self.rows):
            self.shared = self.lcps[self.at]

    @property
    def ended(self) -> bool:
        return self.at >= len(self.rows)


def _first(a: Run, b: Run) -> tuple[Run, Run]:
    """The run of the smaller row and the other one, whose shared is set against it."""
    if a.ended or b.ended:
        return (b, a) if a.ended else (a, b)
    if a.shared != b.shared:
        return (a, b) if a.shared > b.shared else (b, a)
    x, y = a.rows[a.at], b.rows[b.at]
    shared = common_tokens(x[0], y[0], a.shared)
    at = shared * TOKEN
    smaller = (x[0][at : at + TOKEN], x[1]) < (y[0][at : at + TOKEN], y[1])
    winner, loser = (a, b) if smaller else (b, a)
    loser.shared = shared
    return winner, loser


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, int]]:
    """(shared, tokens, conv_id) in order, by a loser tree: inner node i has the loser of its subtrees 2i and 2i + 1."""
    n = len(runs)
    losers: list[Run | None] = [None] * n

    def build(i: int) -> Run:
        if i >= n:
            return runs[i - n]
        winner, losers[i] = _first(build(2 * i), build(2 * i + 1))
        return winner

    if not n:
        return
    leaf = {id(run): i + n for i, run in enumerate(runs)}
    winner = build(1) if n > 1 else runs[0]
    while not winner.ended:
        row = winner.rows[winner.at]
        yield winner.shared, *row
        i = leaf[id(winner)] // 2
        winner.step()
        while i:
            winner, losers[i] = _first(winner, losers[i])
            i //= 2


class Node:
    __slots__ = ("bytes", "children", "conv", "ends", "first", "id", "kids", "leaves", "n", "saved", "token")

    def __init__(self, tok: bytes):
        self.token, self.bytes = tok, int.from_bytes(tok[-8:], "big")
        self.n = self.kids = self.leaves = self.saved = 0
        self.conv: int | None = None
        self.id: bytes | None = None
        self.first = False
        self.ends: list[int] = []
        self.children: list[list] = []

    def takes(self, child: Node) -> None:
        self.n += child.n
        self.conv = child.conv if self.conv is None else min(self.conv, child.conv)


def _named(parent: bytes, tok: bytes) -> bytes:
    return hashlib.sha256(parent + tok).digest()


def finished_nodes(rows: Iterator[tuple[int, bytes, int]], part: int) -> Iterator[list]:
    """Rows of _NODE from the merged rows of a range."""
    root = Node(b"")
    root.id, root.first = b"", True
    stack, begun = [root], False

    def path_rows(node: Node, parent: Node | None, depth: int, last: bool) -> Iterator[list]:
        yield [_PATH, node.id, None if parent is None else parent.id, part, node.first, last, node.bytes, node.conv, depth, None, node.n, node.kids, node.leaves, node.saved, None]
        if node.ends:
            yield [_ENDS, node.id, None, part, None, None, None, None, None, None, None, None, None, None, ",".join(map(str, node.ends))]
        for row in node.children:
            row[2] = node.id
            yield row

    def close(node: Node, parent: Node, depth: int) -> Iterator[list]:
        parent.takes(node)
        if node.first:
            yield from path_rows(node, parent, depth, False)
            return
        for row in node.children:
            row[9] = node.conv
            yield row
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.bytes
        parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else _NO_ENDS
        row = [_FINISHED, None, parent.id, part, None, None, None, node.conv, depth, None, node.n, node.kids, leaves, saved, ends]
        if parent.first:
            yield row
        else:
            parent.children.append(row)

    for shared, tokens, conv in rows:
        while len(stack) - 1 > shared:
            node = stack.pop()
            yield from close(node, stack[-1], len(stack))
        for at in range((len(stack) - 1) * TOKEN, len(tokens), TOKEN):
            node = Node(tokens[at : at + TOKEN])
            if not begun:
                node.first, node.id = True, _named(stack[-1].id, node.token)
            stack.append(node)
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends.append(conv)
        begun = True
    if begun:
        for parent, node in zip(stack, stack[1:], strict=False):
            node.id = _named(parent.id, node.token)
        while stack:
            node = stack.pop()
            if stack:
                stack[-1].takes(node)
            yield from path_rows(node, stack[-1] if stack else None, len(stack), True)


def _frames(rows: Iterator[list], most: int = 20_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pd.DataFrame(held, columns=_COLUMNS, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=_COLUMNS, dtype=object)


def _range(run_rows: int):
    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, number = [], 0
        for batch in part:
            for start in range(0, len(batch), run_rows):
                some = batch.iloc[start : start + run_rows]
                number = int(some["part"].iloc[0])
                runs.append(Run(list(zip(some["tokens"], some["conv_id"].tolist(), strict=True))))
        yield from _frames(finished_nodes(merged(runs), number))

    return run


def _joined_paths(top: bool, fan: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["part"].min(), group["part"].max()
        number = int(low) // fan
        nodes: dict[bytes, dict] = {}
        for row in group.to_dict("records"):
            first, last = bool(row["first"]) and row["part"] == low, bool(row["last"]) and row["part"] == high
            node = nodes.get(row["id"])
            if node is None:
                nodes[row["id"]] = row | {"first": first, "last": last}
                continue
            node["first"], node["last"] = node["first"] or first, node["last"] or last
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[c] += row[c]
        for node in sorted(nodes.values(), key=lambda x: -x["depth"]):
            node["part"] = number
            if not top and (node["first"] or node["last"]):
                continue
            node["kind"], node["n_leaves"] = _FINISHED, node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["bytes"]
            if node["depth"]:
                parent = nodes[node["parent"]]
                parent["n_children"] += 1
                parent["n_leaves"] += node["n_leaves"]
                parent["saved_tokens"] += node["saved_tokens"]
        return pd.DataFrame(list(nodes.values()), columns=_COLUMNS, dtype=object)

    return run


def _hashed_ends(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, ends_sha256) from chunks of text in order of (id, part)."""
    last, digest = None, None
    for batch in part:
        for name, text in zip(batch["id"], batch["ends"], strict=True):
            if name != last:
                if digest:
                    yield pd.DataFrame({"id": [last], "ends_sha256": [digest.hexdigest()]})
                last, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
    if digest:
        yield pd.DataFrame({"id": [last], "ends_sha256": [digest.hexdigest()]})


def prefix_tree(seqs: DataFrame, run_rows: int = RUN, fan: int = FAN) -> DataFrame:
    """A row for each distinct sequence of the first d turns: conv_id (its smallest member), depth d, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree, bytes of the node's own text times members
    less one) and ends_sha256 (of the ids of members with d turns).

    seqs: conv_id long, unique; tokens binary, from sequences() or rebuilt_sequences(). Conversations of any length, without turns, and
    any number of equal ones are whole; without conversations there is no node.
    """
    seqs = materialize(seqs.select("conv_id", "tokens"))
    size = seqs.agg(F.sum(F.octet_length("tokens") + 16)).first()[0] or 0
    parts = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    ranged = seqs.repartitionByRange(parts, "tokens", "conv_id").withColumn("part", F.spark_partition_id())
    found = materialize(ranged.mapInPandas(_range(run_rows), _NODE), seqs)
    open_paths, ready, done = found.where(F.col("kind") == _PATH), [], []
    most = (open_paths.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        joined = materialize(open_paths.groupBy(F.floor(F.col("part") / fan)).applyInPandas(_joined_paths(most <= fan, fan), _NODE))
        ready.append(joined.where(F.col("kind") == _FINISHED))
        done.append(joined)
        if most <= fan:
            break
        open_paths, most = joined.where(F.col("kind") == _PATH), -(-most // fan)
    paths = ready[0]
    for more in ready[1:]:
        paths = paths.union(more)
    ends = found.where(F.col("kind") == _ENDS).select("id", "part", "ends").repartition("id").sortWithinPartitions("id", "part").mapInPandas(_hashed_ends, "id binary, ends_sha256 string")
    paths = materialize(paths.join(ends, "id", "left").withColumn("ends", F.coalesce("ends_sha256", F.lit(_NO_ENDS))).select(*_COLUMNS), *done)
    nodes = found.where(F.col("kind") == _FINISHED).union(paths)
    names = paths.select(F.col("id").alias("_id"), F.col("conv_id").alias("_conv"))
    if paths.count() <= FEW:
        names = F.broadcast(names)
    out = nodes.join(names, F.col("parent") == F.col("_id"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv"))
    return out.withColumnRenamed("ends", "ends_sha256").select(*_CONTRACT)


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of all rebuilt conversations."""
    seqs = materialize(rebuilt_sequences(table(spark, sf_dir, "conversations")))
    out = prefix_tree(seqs)
    discard(seqs)
    return out


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, name, octet_length(encode(text)) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS pos FROM t
), bits AS (
  SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS c, 0 AS step FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (SELECT list(c ORDER BY i) AS c FROM bits WHERE step = 8),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [CAST(ascii(x) AS UBIGINT) for x in string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda a, b: xor(a // 256, c[(xor(a % 256, b) + 1)::BIGINT]))) % 9 AS BIGINT) AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_table
), turns AS (
  SELECT c.conv_id, n.pos, n.name, n.bytes FROM convs c JOIN n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce((SELECT max(m.pos) FROM n m WHERE m.conv_id = c.base), 0)) + n.pos - c.h, n.name, n.bytes FROM convs c JOIN n ON n.conv_id = c.conv_id AND n.pos > c.h
), paths AS (
  SELECT conv_id, pos AS depth, bytes, string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY 1),
nodes AS (
  SELECT p.path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.bytes) AS bytes,
    coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (l.depth = p.depth), '') AS ends
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY 1, 2
), kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT d.*, coalesce(k.n, 0) AS n_children FROM nodes d LEFT JOIN kids k ON k.path = d.path),
sums AS (
  SELECT left(d.path, 64 * u.up::BIGINT) AS path, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved
  FROM full_nodes d, unnest(range(d.depth + 1)) u(up) GROUP BY 1
)
SELECT d.conv_id, d.depth, p.conv_id AS parent_conv_id, d.n_convs, d.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(d.ends) AS ends_sha256
FROM full_nodes d JOIN sums s ON s.path = d.path LEFT JOIN nodes p ON d.depth > 0 AND p.path = left(d.path, length(d.path) - 64)
"""
