import re
from collections import Counter

from veilframe.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def check(df):
    for r in Q.apply_rules(df).collect():
        yield r, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_edge_texts(spark):
    texts = [None, "", " \t\n", "a b c d e a b c d e", "x " * 50, "a b  c # <|>", "l one\nl one\n\n \nl one", "the cat of a\x0bb\x0cc\r\nd é😀 " * 400, "A, the of and to in is it that with."]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")
    for r, got in check(df):
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = list(check(docs))
    assert len(rows) == len(texts)
    for r, got in rows:
        assert got == brute(texts[r.doc_id])


def test_table_compiles_and_empty_input(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.apply_rules(df).collect() == []
    strict = (Q.Rule("n_lines", least=2),)
    kept = Q.apply_rules(spark.createDataFrame([(1, "one of the lines " * 1), (2, "the a b c d e f\n of x y z w q")], "doc_id long, text string"), strict).collect()
    assert {r.doc_id: r.failed_rules for r in kept} == {1: ["n_lines"], 2: []}
