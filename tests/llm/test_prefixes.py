"""The prefix tree against one built from all prefixes, over many ranges, runs and levels."""

import hashlib
import random
import zlib

import pytest

from linkpeak.llm import prefixes, registry
from tests.compare import connect, duck_rows, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string, base long, token string, part int"


def turns_of(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            found.setdefault(conv, []).append((turn is not None, turn or 0, name, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def tree_of(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        saved[path] = saved.get(path, 0) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        if path:
            up = path[:-1]
            kids[up], leaves[up], saved[up] = kids.get(up, 0) + 1, leaves.get(up, 0) + leaves[path], saved.get(up, 0) + saved[path]
    text = lambda path: ",".join(map(str, sorted(ends.get(path, []))))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(text(p).encode()).hexdigest()) for p, m in members.items()
    )


def rows_of(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    out = []
    for c in range(400):
        if c % 3 == 0:
            turns = [("user", "hello"), ("assistant", "höw"), ("user", "now")][: draw.randint(1, 3)]
        else:
            turns = [(draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "", "ccc é"])) for _ in range(draw.randint(1, 7))]
        out += [(c, t, *turn) for t, turn in enumerate(turns)]
    out += [(1000, t, "user", "long " * (t % 3)) for t in range(300)] + [(1003, t, "user", "long " * (t % 3)) for t in range(260)]
    # Null turns, roles, texts and ids, turns that tie, repeated rows, a conversation of nulls, one of a long text.
    out += [(2001, None, None, None), (2001, None, None, None), (2001, 1, "user", None), (2001, 1, "user", "tie"), (2001, 1, "user", "tie"), (None, 1, "user", "no one"), (2006, 0, None, ""), (2010, 0, "user", "x" * 200_000)]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA).repartition(7)


@pytest.mark.parametrize(("parts", "run_rows", "fan"), [(8, 8192, 256), (8, 3, 2), (31, 2, 3), (1, 5, 256)])
def test_tree_of_rebuilt_conversations(spark, rows, frame, parts, run_rows, fan):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = rows_of(prefixes.prefix_tree(prefixes.rebuilt_sequences(frame), run_rows, fan))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == tree_of(rebuilt(turns_of(rows)))


def test_tree_of_conversations_as_they_are(rows, frame):
    assert rows_of(prefixes.prefix_tree(prefixes.sequences(frame), 10)) == tree_of(turns_of(rows))


def test_many_equal_and_no_conversations(spark):
    same = spark.range(3000).selectExpr("id AS conv_id", "explode(sequence(0L, 2L)) AS turn", "'user' AS role", "'same' AS text")
    found = rows_of(prefixes.prefix_tree(prefixes.sequences(same)))
    assert found == tree_of({c: [("user", "same")] * 3 for c in range(3000)})
    assert prefixes.prefix_tree(prefixes.rebuilt_sequences(spark.createDataFrame([], SCHEMA))).count() == 0


def test_loser_tree_carries_common_prefixes():
    draw = random.Random(2)
    word = [bytes([i]) * prefixes.TOKEN for i in range(3)]
    rows = [(b"".join(draw.choice(word) for _ in range(draw.randint(0, 6))), i) for i in range(500)]
    runs = [prefixes.Run(rows[i::7]) for i in range(7)] + [prefixes.Run([])]
    out = list(prefixes.merged(runs))
    assert [r[1:] for r in out] == sorted(rows)
    assert [r[0] for r in out] == [0] + [prefixes.common_tokens(a[1], b[1]) for a, b in zip(out, out[1:], strict=False)]


def test_query_matches_sql(spark):
    assert spark_rows(registry.queries()["op11_prefixes"](spark, "/root/testdata/sf0.001")) == duck_rows(connect("sf0.001"), registry.oracle_sql()["op11_prefixes"])
