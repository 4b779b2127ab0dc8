"""Each stage on its own input, against a plain version."""

import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from test_decontaminate import words

import corpus_pipeline
from veilframe.llm import line_dedup, quality_classifier, queries


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    folder, docs, frames = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    frames.append(docs)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        frames.append(docs)
    return frames


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_columns(staged):
    assert all(f.schema == staged[0].schema for f in staged[1:-1])
    assert staged[-1].columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_classifier_keeps_what_a_plain_score_keeps(spark, sf_dir, staged):
    docs = texts(staged[0])
    ratings = {r.doc_id: 0 if r.toxic else 1 + r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    pairs = sorted((g, quality_classifier.features(docs[i]).tolist()) for i, g in ratings.items())
    model = quality_classifier.fit_rows([quality_classifier.np.array(p) for _, p in pairs], quality_classifier.np.array([g for g, _ in pairs]))
    score = {i: model.weights[quality_classifier.features(t)].sum() for i, t in docs.items()}
    kept = {i for i, s in score.items() if model.at_least([s])[0, -1] >= queries.LEAST_TAIL}
    assert texts(staged[1]) == {i: docs[i] for i in kept}


def plain_spans(words, least):
    """From each line with words the shortest run of ``least`` words on, and back: (first, end), by trying all."""
    runs = set()
    for i, n in enumerate(words):
        if n:
            on = next(((i, e) for e in range(i + 1, len(words) + 1) if sum(words[i:e]) >= least), None)
            back = next(((b, i + 1) for b in range(i, -1, -1) if sum(words[b : i + 1]) >= least), None)
            runs |= {r for r in (on, back) if r}
    return sorted(runs)


def plain_line_dedup(before, least=line_dedup.MIN_WORDS):
    """Ids with unique texts: chunks and runs of lines that came before, in the order of ids and places, go."""
    chunks_seen, runs_seen, out = set(), {}, {}
    for i in sorted(before):
        lines = before[i].split("\n")
        words, gone, at = [len(x.split()) for x in lines], set(), 0
        for chunk in line_dedup.chunks(before[i]) if before[i] else []:
            body, counts = tuple(chunk), words[at : at + len(chunk)]
            if sum(n > 0 for n in counts) >= 2 or sum(counts) >= least:
                if body in chunks_seen:
                    gone |= set(range(at, at + len(chunk)))
                chunks_seen.add(body)
            at += len(chunk)
        for first, end in plain_spans(words, least):
            run = tuple(lines[first:end])
            if run not in runs_seen:
                runs_seen[run] = i, first
            else:
                doc, place = runs_seen[run]
                gone |= set(range(max(first, place + len(run)) if doc == i else first, end))
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or left.strip(" "):
            out[i] = left
    return out


def test_line_dedup_is_the_plain_one(staged):
    before = texts(staged[1])
    assert texts(staged[2]) == plain_line_dedup(before)
    assert all(r.n_chars == len(r.text) for r in staged[2].collect() if r.text != before[r.doc_id])


def test_near_copies_leave_one_each(staged):
    before, after = texts(staged[2]), texts(staged[3])
    assert after.items() <= before.items()
    sets = {i: shingles(t) for i, t in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    gone = set(before) - set(after)
    assert all(max(like(i, j) for j in before if j != i) >= 0.65 for i in gone)
    kept = sorted(after)
    assert not [(a, b) for n, a in enumerate(kept) for b in kept[n + 1 :] if like(a, b) >= 0.9]


def test_planted_near_copies(spark):
    import random

    rnd = random.Random(0)
    base = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(150, 500))) for _ in range(40)]
    rows = list(enumerate(base))
    for k, text in enumerate(base[:20]):
        for copy in range(5):
            w = text.split()
            for _ in range(max(1, len(w) // 200)):
                w[rnd.randrange(len(w))] = "edited"
            rows.append((1000 + 10 * k + copy, " ".join(w)))
    rows += [(5000, base[0]), (5000, base[0]), (5001, None), (5002, None), (5003, "")]
    df = spark.createDataFrame([(i, t, "fp0") for i, t in rows], "doc_id long, text string, id string")
    out = sorted(r.doc_id for r in corpus_pipeline.simhash.distinct_documents(df).collect())
    assert out[:40] == list(range(40)) and len(out) in (41, 42) and out[40] > 5000


def test_benchmark_is_gone(spark, sf_dir, staged):
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    assert texts(staged[4]) == {i: t for i, t in texts(staged[3]).items() if not hit(t)}


def test_ids_are_the_librarys(staged):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain, before = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), texts(staged[4])
    rows = staged[5].collect()
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        ids = plain.encode_ordinary(before[r.doc_id])
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []


def test_nulls_and_clashing_columns_in_each_stage(spark, sf_dir):
    """Columns named as the operators' own results keep their values; null and empty texts and ids do no harm."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["tail_probability", "expected_grade", "n_chunks_removed", "n_lines_removed", "n_words", "n_hit", "items", "spans", "_text_hash", "fp0", "id", "key", "column 1"]
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(None, None), (7_000_001, None), (7_000_002, ""), (7_000_003, " \n "), (7_000_003, " \n ")], "doc_id long, text string")
    docs = base.unionByName(odd, allowMissingColumns=True).select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir).collect()
        assert rows and all(r[n] == f"{n}{r.doc_id or 0}" for r in rows for n in names), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == docs.count() and all(r.n_tokens == 0 for r in last if r.doc_id in (None, 7_000_001, 7_000_002))


def test_run_leaves_the_last_stage_only(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_each_stage_on_planted_cases(spark, sf_dir):
    """Near copies of 0.8 and more by length and kind of edit: how many of the copies go."""
    import random

    rnd, rows, kinds = random.Random(11), [], {}
    vocabulary, weights = [f"w{k}" for k in range(5000)], [1 / (k + 10) for k in range(5000)]
    for n in (120, 200, 400, 800):
        for k in range(25):
            base, at = rnd.choices(vocabulary, weights, k=n), len(rows)
            scattered, appended = list(base), base + rnd.choices(vocabulary, weights, k=n // 20)
            for _ in range(max(1, n // 100)):
                scattered[rnd.randrange(n)] = "edited"
            rows += [(at, " ".join(base)), (at + 1, " ".join(scattered)), (at + 2, " ".join(appended)), (at + 3, " ".join(base).upper())]
            kinds |= {at + 1: "scattered", at + 2: "appended", at + 3: "capitals"}
    left = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()}
    assert {i for i, _ in rows} - set(kinds) <= left
    for kind, least in (("capitals", 1.0), ("scattered", 0.9), ("appended", 0.9)):
        of = [i for i in kinds if kinds[i] == kind]
        assert sum(i not in left for i in of) >= least * len(of), (kind, sum(i not in left for i in of), len(of))
