import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from veilframe.llm import conversation_trie, oracles, queries

FIELDS = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def plain(turns):
    """``turns``: (role, text) pairs by conversation. Every node looks at every node."""
    found = defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            found[tuple(t[:d])].append(c)
    out, inner = [], {x[:-1] for x in found if x}
    leaf = lambda x: x not in inner
    for node, own in found.items():
        below = [x for x in found if x[: len(node)] == node]
        ends = sorted(c for c in own if len(turns[c]) == len(node))
        out.append((
            min(own), len(node), min(found[node[:-1]]) if node else None, len(own), sum(len(y) == len(node) + 1 and y[: len(node)] == node for y in found), sum(map(leaf, below)),
            sum((len(found[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df, ids=None):
    return sorted((tuple(r[f] for f in FIELDS) for r in conversation_trie.trie(df, ids).collect()), key=str)


def test_against_all_pairs_of_nodes(spark):
    draw = random.Random(2)
    turns = {c: [(draw.choice(["u", "a"]), draw.choice(["", "x", "yé"])) for _ in range(draw.choice([1, 2, 3, 9, 21]))] for c in [-4, *range(60)]}
    turns |= {c: turns[1] + [("u", str(c % 2))] for c in range(100, 130)}  # copies of two
    rows = [(c, i, *t, "clash") for c, x in turns.items() for i, t in enumerate(x)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    assert nodes(df) == plain(turns)
    ids = spark.createDataFrame([(999,), (998,), (1,), (None,)], "conv_id long")
    assert nodes(df, ids) == plain(turns | {998: [], 999: []})


def test_nulls_ties_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(1, None, None, None), (1, 0, "a", "x"), (1, 0, "a", "x"), (2, 3, "", ""), (2, 4, "a", "x"), (None, 1, "u", "lost")], schema)
    assert nodes(df) == plain({1: [("", ""), ("a", "x"), ("a", "x")], 2: [("", ""), ("a", "x")]})
    assert nodes(df.limit(0)) == [] and nodes(df.limit(0), spark.createDataFrame([(5,)], "conv_id long")) == plain({5: []})


def test_roles_and_texts_do_not_run_together(spark):
    df = spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "1:a", "b"), (4, 0, "1", ":ab")], "conv_id long, turn long, role string, text string")
    assert len(nodes(df)) == 5


def test_a_deep_conversation_and_long_texts(spark):
    deep = {1: [("u", str(i % 3)) for i in range(700)], 2: [("u", str(i % 3)) for i in range(650)] + [("u", "é" * 200_000)]}
    df = spark.createDataFrame([(c, i, *t) for c, x in deep.items() for i, t in enumerate(x)], "conv_id long, turn long, role string, text string")
    got = nodes(df)
    assert len(got) == 702 and max(r[1] for r in got) == 700
    top = next(r for r in got if r[1] == 0)
    assert top[3:7] == (2, 1, 2, 650)


def test_many_ends_go_as_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_CHARS", 50)
    df = spark.createDataFrame([(c, 0, "u", "same") for c in range(3000)], "conv_id long, turn long, role string, text string")
    (leaf,) = (r for r in nodes(df) if r[1] == 1)
    assert leaf[-1] == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest() and leaf[3] == 3000


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_against_sql(spark, scale):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{scale}/conversations.parquet'")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{scale}/pages.parquet'")
    for name in ("op13_conversation_trie", "op11_url_filters"):
        want = con.sql(oracles.SQL[name])
        got = queries.QUERIES[name](spark, f"/root/testdata/{scale}")
        assert sorted(want.columns) == sorted(got.columns)
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in got.collect())
