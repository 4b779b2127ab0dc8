import statistics

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import kd_sharding as K
from veilframe.llm.queries import op8_kd_sharding


def laws(rows, texts, n_shards, share=0.02):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sizes = [sum(r[1] for r in by[s]) for s in range(n_shards)]
    mean, most = sum(sizes) / n_shards, max(r[1] for r in rows)
    assert max(abs(x - mean) for x in sizes) <= max(share * mean, 2 * most)
    for s in by:
        assert sorted(r[4] for r in by[s]) == list(range(len(by[s])))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_kd_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    laws([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows], texts, 8, 0.1)


@pytest.mark.parametrize("node_rows", [10_000, 1500, 0])
def test_groups_stay_together_and_hot_ones_are_cut(spark, monkeypatch, node_rows):
    monkeypatch.setattr(K, "node_rows", lambda _: node_rows)
    rnd = random.Random(5)
    texts = ["hot passage " * 20] * 3000 + ["".join(rnd.choices("abcdé ", k=rnd.randint(1, 400))) for _ in range(3000)]
    texts += [t for t in texts[3000:3300] for _ in range(2)] + [None, "", ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, size string")
    rows = [tuple(r) for r in K.shard(df, 6).collect()]
    assert len(rows) == len(texts)
    laws(rows, texts, 6)
    where = defaultdict(set)
    for r in rows:
        where[texts[r[0]]].add(r[3])
    assert all(len(v) == 1 for t, v in where.items() if t != texts[0])


def test_few_rows_nulls_and_targets(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, "a")], "doc_id long, text string")
    assert sorted(r.slot for r in K.shard(df, 1).collect()) == [0, 1, 2]
    assert len(K.shard(df, 8).collect()) == 3
    assert K.shard(df.limit(0), 4).collect() == []
    many = spark.createDataFrame([(i, "word " * 20) for i in range(50)], "doc_id long, text string")
    assert len({r.shard for r in K.shards_for(many, 1200).collect()}) == 5


@pytest.mark.parametrize("node_rows", [10_000, 60, 0])
def test_cuts_against_plain_recursion(spark, monkeypatch, node_rows):
    """Shards, axes and all, of a small table without equal texts, by sorting; in one task, in two tiers and by bins alone."""
    monkeypatch.setattr(K, "node_rows", lambda _: node_rows)
    import random
    import zlib

    rnd = random.Random(4)
    texts = ["\n".join("é日a"[i % 3] * rnd.randint(1, 60) for _ in range(rnd.randint(1, 12))) for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.id: r.asDict() for r in K.measured(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert (rows[i]["size"], rows[i]["crc"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    spread = lambda ids, a: statistics.pstdev([rows[i][a] for i in ids])
    whole, want = {a: spread(rows, a) for a in K.AXES}, {}

    def split(ids, first, k, axes):
        if k == 1:
            want.update({i: (first, ">".join(axes)) for i in ids})
            return
        axis = max(K.AXES, key=lambda a: (round(spread(ids, a) / whole[a], 9), -K.AXES.index(a)))
        order = sorted(ids, key=lambda i: (rows[i][axis], rows[i]["crc"]))
        goal, below, n = sum(rows[i]["size"] for i in ids) * (k // 2) / k, 0, 0
        while below + rows[order[n]]["size"] < goal:
            below += rows[order[n]]["size"]
            n += 1
        n += goal - below >= rows[order[n]]["size"] / 2
        split(order[:n], first, k // 2, [*axes, axis])
        split(order[n:], first + k // 2, k - k // 2, [*axes, axis])

    split(list(rows), 0, 6, [])
    assert {r.doc_id: (r.shard, r.axes) for r in K.shard(df, 6).collect()} == want
    assert len({a for _, axes in want.values() for a in axes.split(">")}) >= 2


def test_ten_thousand_leaves_and_equal_spreads(spark):
    """Nearly as many shards as rows; two axes of equal spread are settled by their order."""
    assert [K.node_rows(n) for n in (10, 10**7, 10**10)] == [1 << 14, 50_000, 1 << 19]
    rows = spark.range(40_000).select("id", F.lit(100).cast("long").alias("size"), F.xxhash64("id").bitwiseAND(0xFFFFFFFF).alias("crc"), (F.col("id") * 7919 % 40_000).alias("by_size"), (F.col("id") * 7919 % 40_000).alias("by_density"), F.lit(0).cast("long").alias("by_lines"))
    got = K.leaves(rows, 10_000).groupBy("shard").agg(F.count("*").alias("n"), F.min("axes").alias("axes")).collect()
    assert len(got) == 10_000 and {r.n for r in got} == {4} and {a for r in got for a in r.axes.split(">")} == {"by_size"}


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000)] + [(i, "ab") for i in range(2, 12)], "doc_id long, text string")
    rows = K.shard(df, 2).collect()
    assert len(rows) == 11 and len({r.shard for r in rows if r.doc_id > 1}) == 1
