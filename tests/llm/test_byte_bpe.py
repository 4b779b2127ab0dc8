import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import byte_bpe
from veilframe.llm.queries import op2_byte_bpe

RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.Codec(RAW, P.PATTERN)


def ids(text):
    packed = CODEC.encode_packed(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_encodes_as_the_library_and_back(text):
    assert ids(text) == PLAIN.encode_ordinary(text)
    assert "".join(CODEC.decode_pieces(CODEC.encode_packed(text))) == text


def test_long_pieces_and_few_letters():
    rnd = random.Random(7)
    for alphabet in ("ab", "etaoin ", "=- \n", "é日 "):
        text = "".join(rnd.choice(alphabet) for _ in range(5000))
        assert ids(text) == PLAIN.encode_ordinary(text)
    assert len(ids("ab" * 200_000)) == len(PLAIN.encode_ordinary("ab" * 200_000))


def test_a_full_state_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 20)
    monkeypatch.setattr(byte_bpe, "MAX_WORDS", 3)
    small = byte_bpe.Codec(RAW, P.PATTERN)
    text = "the quick brown foxes jump over unbelievable lazy dogs, " * 3
    assert small.encode_packed(text) == CODEC.encode_packed(text)


def test_tables_trimmed_again_and_again(monkeypatch):
    for name, value in (("MAX_STATES", 50), ("MAX_WORDS", 4), ("SIDE_BYTES", 16), ("BLOCK_PIECES", 5), ("LONG_TEXT", 200), ("LONG_PIECE", 12), ("HELD_BYTES", 300)):
        monkeypatch.setattr(byte_bpe, name, value)
    small, rnd = byte_bpe.Codec(RAW, P.PATTERN), random.Random(3)
    for _ in range(20):
        text = " ".join("".join(rnd.choice("etaoinshrdé") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(0, 60))) + "ab" * rnd.randint(0, 2000)
        texts = [text, None, "", text[:50]]
        assert small.encode_texts(texts) == CODEC.encode_texts(texts)
        assert len(small.words) <= 4 and len(small.transducer._content) <= 1000


def test_fits_is_what_merging_both_gives():
    t, rnd = CODEC.transducer, random.Random(5)
    ids_ = sorted(t.entries)
    for n in (300, 3000, len(ids_)):
        for a, b in ((rnd.choice(ids_[:n]), rnd.choice(ids_[:n])) for _ in range(1500)):
            pair = [t.entries[a], t.entries[b]]
            assert t.fits(a, b) == (t._merged(b"".join(pair), len(t.length)) == pair)


@given(st.binary(max_size=40), st.lists(st.integers(1, 5)))
def test_utf8_machine_gives_what_one_call_gives(data, cuts):
    machine, out, at = byte_bpe.Utf8Machine(), "", 0
    for n in [*cuts, len(data)]:
        out += machine.feed(data[at : at + n])
        at += n
    assert out + machine.finish() == data.decode("utf-8", "replace")


def test_unknown_ids_and_broken_vocabularies_raise():
    with pytest.raises(KeyError):
        list(CODEC.decode_pieces(struct.pack("<I", 60_000)))
    with pytest.raises(ValueError):
        byte_bpe.Transducer({b"a": 0})


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (1, "", "y"), (2, "Hello wörld 😀", None), (2, "Hello wörld 😀", "q"), (None, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    vocabulary = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    encoded = byte_bpe.encode(df, *vocabulary)
    assert dict(encoded.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    back = sorted(((r.doc_id, r.text) for r in byte_bpe.decode(encoded, *vocabulary).collect()), key=repr)
    assert back == sorted(((a, b or "") for a, b, _ in rows), key=repr)
    assert byte_bpe.encode(df.limit(0), *vocabulary).collect() == []


def test_query_against_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_byte_bpe(spark, sf_dir).collect():
        tokens = PLAIN.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(tokens)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(tokens)}I", *tokens)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_what_a_worker_holds_at_a_time(spark, monkeypatch):
    """A batch of any size is coded in small pieces, so its texts, ids and decoded texts never stand in memory all at once."""
    import tracemalloc

    import pyarrow as pa

    draw, held = random.Random(3), {}
    words = ["".join(draw.choices("abcdefgh ", k=5)) for _ in range(500)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(3000)]
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.update(run=run))
    byte_bpe.transcode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 6 << 20
    for _ in held["run"](iter([batch.slice(0, 50)])):  # the tables
        pass
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in held["run"](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(texts) and peak < 20 << 20
