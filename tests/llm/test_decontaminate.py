import hashlib
import random
import re

import pytest

from veilframe.llm import decontaminate as D
from veilframe.llm.queries import op7_decontaminate

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_blocks_overlaps_and_offsets(spark, monkeypatch):
    rnd = random.Random(2)
    make = lambda n: " ".join(rnd.choice(["Ab", "b", "é-c", "D9", "x."]) for _ in range(n))
    items = [(str(i), make(rnd.randint(0, 6))) for i in range(12)] + [("n", None), ("", "ab b ab")]
    docs = [make(rnd.randint(0, 40)) for _ in range(60)] + [None, "", "AB, B! aB"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, items int")
    for limit in (5_000_000, 9):
        monkeypatch.setattr(D, "BLOCK_WORDS", limit)
        rows = D.scan(df, bench, window=3).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert (r.n_words, r.n_hit, r["items"]) == brute(docs[r.doc_id], items, 3)
            inside = [w for s in r.spans for w in words(docs[r.doc_id][s.start : s.end])]
            assert len(inside) == r.n_hit
    kept = D.scan(df, bench, window=3, keep_columns=True)
    assert kept.columns == ["doc_id", "text", *D.ADDED] and kept.count() == len(docs)
    assert D.scan(df, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


@pytest.mark.parametrize("few", [True, False])
def test_ten_blocks_find_what_one_does_with_one_automaton_a_stage(spark, monkeypatch, few):
    items = [(f"q{i:02}", " ".join(f"w{(7 * i + k) % 90}" for k in range(12))) for i in range(40)] + [(None, "w1 w2"), ("dup", "w1 w2"), ("none", None)]
    docs = [(i, " ".join(f"w{(7 * (i % 50) + k) % 90}" for k in range(i % 30))) for i in range(200)] + [(None, None), (7, ""), (7, "w1 W2, w3")] + [(1000 + i, "w1 w2 " * 30) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(i, t, "x", "clash") for i, t in docs], "doc_id long, text string, digest string, `all runs` string")
    read = lambda: sorted(map(str, D.scan(df, bench, window=5, keep_columns=True).collect()))
    want = read()
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    monkeypatch.setattr(D, "small", lambda _: few)
    assert len(list(D._blocks(bench, "item_id", "text"))) >= 10
    assert read() == want
    plan = D.scan(df, bench, window=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_query(spark, sf_dir):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert min(len(words(t)) for _, t in items) >= 10
    for r in op7_decontaminate(spark, sf_dir).collect():
        w, hit, found = words(docs[r.doc_id]), set(), set()
        for i in range(len(w) - 9):
            if names := windows.get(tuple(w[i : i + 10])):
                hit.update(range(i, i + 10))
                found |= names
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
