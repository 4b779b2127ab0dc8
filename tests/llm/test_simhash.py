import random
import re

import numpy as np
import pytest
import xxhash

from veilframe.llm import simhash as S
from veilframe.llm.components import components
from veilframe.llm.queries import op4_simhash

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(points, pairs):
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def close_pairs(points, radius):
    bits = np.array(points, np.int64)
    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count((bits[i] ^ bits[i + 1 :]).view(np.uint64)) <= radius):
            yield points[i], points[i + 1 + int(j)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: plain_print(t) for d, t in docs.items()}
    rows = op4_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    pairs = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in rows} == plain_roots(docs, pairs)


def test_boundaries_prune_and_no_pair_is_lost(spark, monkeypatch):
    """6000 scattered points in shards of some hundreds: few of all pairs meet, within shards fewer are compared, and every close pair meets."""
    monkeypatch.setattr(S, "SHARD_POINTS", 500)
    rnd = random.Random(9)
    points = sorted({signed(rnd.getrandbits(64)) for _ in range(6000)})
    points += [signed((p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64)) & (1 << 64) - 1) for p in points[:300]]
    points = sorted(set(points))
    for trees in (256, 1):
        monkeypatch.setattr(S, "ONE_TREE", trees)
        members = {}
        for r in S.shards(spark.createDataFrame([(p, p) for p in points], "node long, fp long"), 3).collect():
            members.setdefault(tuple(r.shard), set()).add(r.node)
        sizes = [len(m) for m in members.values()]
        assert max(sizes) <= 500 and sum(n * n for n in sizes) < 0.4 * len(points) ** 2
        assert all(any(a in m and b in m for m in members.values()) for a, b in close_pairs(points, 3))
        compared = 0
        for m in members.values():
            shard = S._Shard(np.array(sorted(m), np.int64).view(np.uint64), None, 3, 0)
            list(shard.within(np.arange(len(m))))
            compared += shard.compared
        assert compared < 0.35 * len(points) ** 2


@pytest.mark.parametrize("limit,trees", [(4096, 256), (40, 256), (40, 1)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, limit, trees):
    """A dense ball, chains and scattered points; a low limit forces division in Spark, by whole distances and by halves."""
    monkeypatch.setattr(S, "SHARD_POINTS", limit)
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    points = {centre}
    for _ in range(500):
        x = centre
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            x ^= 1 << b
        points.add(x)
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(5):
            points.add(x)
            for b in rnd.sample(range(64), 3):
                x ^= 1 << b
    points |= {rnd.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 7, 15}
    points = sorted(signed(p) for p in points)
    monkeypatch.setattr(S, "ONE_TREE", trees)
    placed = S.shards(spark.createDataFrame([(p, p) for p in points], "node long, fp long"), 3)
    links = S.links(placed, radius=3)
    got = {r.node: r.root for r in components(links).collect()}
    assert {p: got.get(p, p) for p in points} == plain_roots(points, close_pairs(points, 3))


@pytest.mark.parametrize("nodes", [0, 300_000])
def test_components_of_a_long_chain_a_star_and_odd_rows(spark, monkeypatch, nodes):
    monkeypatch.setattr("veilframe.llm.components.BROADCAST_ROWS", nodes)  # dealt out, or by broadcast
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7, None), (1001, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_nulls_empty_long_and_repeated(spark):
    long = "word " * 200_000
    rows = [(3, None, 1), (2, "", 1), (9, " \t", 1), (None, "a b", 1), (4, "A B", 1), (4, "A B", 1), (5, long, 1), (6, long.upper(), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()), key=repr)
    assert {x[2] for x in got if x[1] == "0" * 16} == {2}
    assert {x[2] for x in got if x[0] in (5, 6)} == {5}
    assert [x[2] for x in got if x[0] in (None, 4)] == [4, 4, 4]
    assert S.near_duplicates(df.limit(0)).collect() == []


def own_words(rnd, n):
    return [f"w{rnd.randint(0, 100_000)}" for _ in range(n)]


def test_a_shared_refrain_does_not_merge(spark):
    """Different texts with one much-repeated line: Jaccard of the shingle sets about 0.05."""
    rnd = random.Random(5)
    rows = []
    for times, length in ((30, 20), (40, 8), (100, 12)):
        line = " ".join(own_words(rnd, length))
        rows += [" ".join(own_words(rnd, 200)) + "\n" + "\n".join([line] * times) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.distinct_documents(df).collect()) == list(range(len(rows)))


def test_links_are_exact_on_both_sides_of_the_bound(spark):
    """Copies whose changed tail leaves a similarity of about 0.75 stay; what goes has 0.8 and more."""
    rnd = random.Random(6)
    some = lambda n: rnd.choices([f"w{k}" for k in range(200)], [1 / (k + 1) for k in range(200)], k=n)
    rows = []
    for k in range(40):
        base = some(400)
        rows.append((10 * k, base))
        rows += [(10 * k + n, base[: 400 - cut] + some(cut)) for n, cut in ((1, 57), (2, 36), (3, 8))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    left = {r.doc_id for r in S.distinct_documents(df).collect()}
    assert all(max(like(i, j) for j in sets if j != i and j // 10 == i // 10) >= 0.8 for i in set(sets) - left)
    assert len([i for i in left if i % 10 == 3]) <= 2


def test_short_copies_are_all_found(spark, monkeypatch):
    """Texts of 6 to 100 words, each with a word appended, one in capitals and one with a word changed, against brute force."""
    monkeypatch.setattr(S, "FREQUENT", 3)
    rnd = random.Random(7)
    rows = []
    for n in (1, 6, 7, 8, 9, 10, 12, 15, 20, 30, 40, 60, 80, 100):
        for _ in range(8):
            base = own_words(rnd, n)
            other = list(base)
            other[rnd.randrange(n)] = "changed"
            rows += [" ".join(w) for w in (base, [*base, "more"], [w.upper() for w in base], other)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t in rows for w in [t.lower().split()]]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i for i, root in plain_roots(range(len(rows)), pairs).items() if i == root}
    got = {r.doc_id for r in S.distinct_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == want


def test_copies_of_a_point_do_not_grow_with_the_table(spark, monkeypatch):
    """A table of 8 times the points, in 8 times the shards, has as many copies of each: 4, one for each quarter of the bits; and a close pair meets in one of them."""
    monkeypatch.setattr(S, "SHARD_POINTS", 200)
    rnd = random.Random(10)
    points = sorted({signed(rnd.getrandbits(64)) for _ in range(9600)})
    for some in (points[:1200], points):
        near = [signed((p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64)) & (1 << 64) - 1) for p in some[:200]]
        rows = [(p, p) for p in sorted({*some, *near})]
        placed = S.shards(spark.createDataFrame(rows, "node long, fp long"), 3).collect()
        assert len(placed) <= 4.2 * len(rows)
        where = {}
        for r in placed:
            where.setdefault(r.node, set()).add(tuple(r.shard))
        assert all(where[p] & where[q] for p, q in zip(some, near))


def test_a_frequent_passage_makes_few_pairs_of_short_texts(spark):
    """Texts of one passage and a few own words, 70 to 90 % alike: each similar pair once, and hardly any of those that own words keep apart."""
    rnd = random.Random(11)
    passage, texts = own_words(rnd, 60), []
    for k in range(120):  # most share 51 of 61 shingles with no own one in common
        own = own_words(rnd, 9 if k % 4 else 3)
        texts.append(own + passage)
    for k in range(30):
        other = list(passage)
        for at in rnd.sample(range(60), 1):
            other[at] = f"changed{k}"
        texts.append(other)
    sets = [np.unique(S.shingle_hashes(" ".join(t), 5)) for t in texts]
    like = lambda i, j: (c := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - c)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like(i, j) >= 0.8}
    prefix, _ = S._prefixes(spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, few binary"), 0.8)
    got = [(r.a, r.b) for r in S.short_pairs(prefix, 0.8, spark.createDataFrame([], "node long, label long")).collect()]
    assert want and want <= set(got) and len(got) == len(set(got))
    assert len(got) <= 1.2 * len(want) < 0.4 * len(sets) ** 2 / 2
