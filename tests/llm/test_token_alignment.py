import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilframe.llm import queries, token_alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain(texts, tokenizers):
    """Whole texts, groups by common ends, all links written out."""
    a, b = tokenizers
    letters = token_alignment.byte_letters()
    names = {n: bytes(letters[c] for c in t) if n != 50256 else t.encode() for t, n in a.get_vocab().items()}
    spelt = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, holding = [], defaultdict(int)
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or not (b"".join(names[i] for i in x) == (" " + text).encode() == b"".join(map(spelt, y))):
            rows.append((0, 0, 0, []))
            continue
        ea, eb = list(accumulate(len(names[i]) for i in x)), list(accumulate(len(spelt(i)) for i in y))
        common = sorted(set(ea) & set(eb))
        groups = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(((x, ea), (y, eb))):
            for i, e in zip(ids, ends):
                groups[bisect_left(common, e)][side].append(i)
        rows.append((len(x), len(y), groups, [(p, q) for g, h in groups for p in g for q in h]))
        for pair in set(rows[-1][3]):
            holding[pair] += 1
    most = [Counter(), Counter()]
    for pair, n in holding.items():
        for side in (0, 1):
            most[side][pair[side]] = max(most[side][pair[side]], n)
    out = []
    for n_a, n_b, groups, linked in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups) if groups else ""
        out.append((n_a, n_b, len(groups) if groups else 0, len(linked), *(sum(holding[p] == most[s][p[s]] for p in linked) for s in (0, 1)), sum(holding[p] for p in linked), text))
    return out


def answers(df, **named):
    return [tuple(r)[1:] for r in sorted(token_alignment.align(df, *FILES, **named).collect(), key=lambda r: r.doc_id)]


HOSTILE = [
    None, "", " ", "   ", "a", " a", "a ", "a  ", "  a   b\n c", "a  b", "x\n\n  y \t z", "<|endoftext|> <s></s> <unk>", "▁", "a▁ b", "▁ ▁", "ﬁ ½ Å", "日本語のテキスト です", "👩‍👩‍👧 é é", "\x00\x1c \x85 z",
    "don't we'll I'M", "0x0A <0x0A>", "a" * 3000, "ab" * 1500 + " " + "​" * 40, "=" * 500 + "\t" * 60 + " " * 90 + "end", "the cat", "the cat", "ſ 𝒳𝒴 " * 30]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    draw = random.Random(3)
    letters = "ab é\n\t 日.'▁😀  x0"
    return HOSTILE + docs + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("rows", [300_000, 20])
def test_against_whole_texts(spark, texts, tokenizers, monkeypatch, rows):
    monkeypatch.setattr(token_alignment, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    assert answers(df) == plain(texts, tokenizers)


def test_small_bounds_change_nothing(texts, tokenizers, monkeypatch):
    for k, v in {"MOST_LINKS": 32, "SPAN_CHARS": 100, "LARGE_GROUP": 3}.items():
        monkeypatch.setattr(token_alignment, k, v)
    encoder, holding, parts = token_alignment.Encoder(*(open(p, "rb").read() for p in FILES)), Counter(), []
    want = plain(texts, tokenizers)
    found = [x for k in range(0, len(texts), 7) for x in token_alignment.align_texts(encoder, texts[k : k + 7], False)]
    for x, (n_a, n_b, n_groups, n_links, *_, text) in zip(found, want, strict=True):
        assert (*x.numbers.tolist(), x.groups) == (n_a, n_b, n_groups, n_links, text)
        mine = list(x.links())
        keys = [k for ks, _ in mine for k in ks.tolist()]
        assert mine and len(keys) == len(set(keys)) and sum(int(n.sum()) for _, n in mine) == n_links and all(len(ks) <= 32 for ks, _ in mine)
        holding.update(keys)
        parts += mine
    assert max(len(list(x.links())) for x in found) > 3
    assert sum(holding[k] * int(m) for ks, n in parts for k, m in zip(ks.tolist(), n)) == sum(w[6] for w in want)


def test_texts_are_cut_where_neither_has_a_token_across(monkeypatch):
    monkeypatch.setattr(token_alignment, "SPAN_CHARS", 2)
    encoder = token_alignment.Encoder(*(open(p, "rb").read() for p in FILES))
    assert encoder.divided and list(encoder.spans("a b  c\n d ")) == [" a", " b", "  c\n d", " "]
    assert encoder.ranks is not None


def test_ranks_and_file_agree(texts):
    files = [open(p, "rb").read() for p in FILES]
    a, b = (token_alignment.Encoder(*files) for _ in range(2))
    b.ranks = None
    pair = lambda e: [None if x is None else [y.tolist() for y in x] for x in e.encoded([" " + t for t in texts if t])]
    assert pair(a) == pair(b)


def test_digests_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two"), ("k", "one two"), ("k", "one two"), ("z", None)], "doc_id string, text string")
    rows = token_alignment.align(df, *FILES).collect()
    texts = sorted(str((r.doc_id, r.n_links, r.count_sum, r.groups)) for r in rows)
    assert len(rows) == 4 and {r.count_sum for r in rows if r.n_a} == {3 * next(r.n_links for r in rows if r.n_a)}
    hashed = token_alignment.align(df, *FILES, digest=True).collect()
    assert {r.groups_sha256 for r in hashed} == {hashlib.sha256(rows[0].groups.encode()).hexdigest() if r.groups else "" for r in rows} and texts
    assert token_alignment.align(df.limit(0), *FILES).count() == 0


def test_the_query_covers_all_documents(spark, sf_dir, tokenizers):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, sf_dir).collect()}
    want = dict(zip(docs, plain(list(docs.values()), tokenizers)))
    assert set(got) == set(docs)
    for k, (n_a, n_b, n_groups, n_links, best_a, best_b, count_sum, text) in want.items():
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.n_best_b, r.count_sum) == (n_a, n_b, n_groups, n_links, best_a, best_b, count_sum)
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
