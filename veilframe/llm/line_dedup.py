"""Line dedup: content-defined chunks of lines, of which repeated ones are kept once.

Lines end at ``\\n``. A line's hash is the first 32 bits of its MD5; the rolling hash over a
line and the one before it ends a chunk where it divides by ``DIVISOR``, so that chunks of a
shared passage fall in step again after its first boundary, whatever stands before it. Chunks
of at least two lines with words, or of ``min_words`` words, count. Those found more than once
in the corpus are removed except where they come first by (id, text hash, place); texts of equal
hash and different bytes stay where they are.

With ``passages``, runs of whole lines of ``min_words`` words or more that came before go too, all
of their lines and wherever their chunks begin and end: from each line with words the shortest
such run onwards, and the shortest back, are looked up by a 128-bit BLAKE2 of their lines' own.
Any repeated run is covered by those inside it. Both rules look at the texts as given, and a line
that goes has its like earlier by (id, text hash, place), so the first of its kind stays. A run
that overlaps its first occurrence loses only what lies beyond that.

Plan: chunk hashes, some bytes each, are aggregated first; only texts of repeated hashes are
shuffled for the byte comparison, and only rows with something to remove get a list.

Defined cases: null and empty texts have no chunks and stay as they are; a text of which all is
removed becomes empty; rows equal in id and text count as one document; a null id comes first;
other columns pass through unless they clash with the added ``n_chunks_removed`` and
``n_lines_removed``, which replace them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shipping import bounded, map_batches, settle

DIVISOR, MIN_WORDS = 3, 50


def chunks(text: str) -> list[list[str]]:
    out, chunk, before = [], [], 0
    for line in text.split("\n"):
        here = int.from_bytes(hashlib.md5(line.encode()).digest()[:4], "big")
        chunk.append(line)
        if (31 * before + here) % DIVISOR == 0:
            out.append(chunk)
            chunk = []
        before = here
    return out + [chunk] * bool(chunk)


def _counted(chunk: list[str], min_words: int) -> bool:
    words = [len(line.encode().split()) for line in chunk]
    return sum(n > 0 for n in words) >= 2 or sum(words) >= min_words


def _chunk_rows(df: DataFrame, min_words: int, with_text: bool) -> DataFrame:
    """``at`` (id, text hash, chunk number), ``h`` (128-bit MD5 of the chunk) and, if asked for, its text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, number, digest, texts = [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for n, chunk in enumerate(chunks(text) if text else []):
                if _counted(chunk, min_words):
                    body = "\n".join(chunk)
                    rows.append(k)
                    number.append(n)
                    digest.append(hashlib.md5(body.encode()).digest())
                    texts.append(body)
        columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(digest, pa.binary())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=["key", "chunk", "h"] + ["body"] * with_text)

    kind = df.schema["key"].dataType.simpleString()
    return map_batches(df, run, f"key {kind}, chunk int, h binary" + ", body string" * with_text).select(
        F.struct("key", "chunk").alias("at"), "h", *["body"] * with_text)


def spans(text: str, min_words: int) -> list[tuple[int, int]]:
    """The shortest runs of lines of ``min_words`` words from each line with words on, and back, as (first, end)."""
    words = [len(line.encode().split()) for line in text.split("\n")]
    out, total, end = set(), 0, 0
    for begin, n in enumerate(words):
        while end < len(words) and total < min_words:
            total += words[end]
            end += 1
        if n and total >= min_words:
            out.add((begin, end))
        total -= n
    total = begin = 0
    for end, n in enumerate(words, 1):
        total += n
        while begin < end and total - words[begin] >= min_words:
            total -= words[begin]
            begin += 1
        if n and total >= min_words:
            out.add((begin, end))
    return sorted(out)


def _span_rows(df: DataFrame, min_words: int) -> DataFrame:
    """``at`` (id, text hash, first line), ``n`` lines and ``h`` of each run of ``spans``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, first, length, digest = [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            if not text or not (found := spans(text, min_words)):
                continue
            lines = [hashlib.blake2b(line.encode(), digest_size=16).digest() for line in text.split("\n")]
            for begin, end in found:
                rows.append(k)
                first.append(begin)
                length.append(end - begin)
                digest.append(hashlib.blake2b(b"".join(lines[begin:end]), digest_size=16).digest())
        columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(first, pa.int32()), pa.array(length, pa.int32()), pa.array(digest, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "line", "n", "h"])

    kind = df.schema["key"].dataType.simpleString()
    return map_batches(df, run, f"key {kind}, line int, n int, h binary").select(F.struct("key", "line").alias("at"), "n", "h")


def _repeated_spans(keyed: DataFrame, min_words: int) -> DataFrame:
    """``key`` and ``spans``, the (first, end) of its lines in runs that came before."""
    found = settle(_span_rows(keyed, min_words).distinct())
    few = settle(found.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min("at").alias("first")).filter("many > 1").select("h", "first"))
    begin = F.when(F.col("first.key").eqNullSafe(F.col("at.key")), F.greatest("at.line", F.col("first.line") + F.col("n"))).otherwise(F.col("at.line"))
    gone = found.join(bounded(few), "h").filter("at <> first").select(F.col("at.key").alias("key"), begin.alias("begin"), (F.col("at.line") + F.col("n")).alias("end"))
    return gone.filter("begin < end").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def without(text: str, cut: list[int] | None, gone: list[dict] | None) -> tuple[str, int, int]:
    """The text without the chunks numbered in ``cut`` and the lines of ``gone``, and how many chunks and lines went."""
    drop, at, n, kept = set(cut or ()), 0, 0, []
    lost = {k for s in gone or () for k in range(s["begin"], s["end"])}
    for k, chunk in enumerate(chunks(text)):
        left = [] if k in drop else [line for i, line in enumerate(chunk, at) if i not in lost]
        n += len(chunk) - len(left)
        at += len(chunk)
        kept += left
    return "\n".join(kept), len(drop), n


def dedup(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """The rows of ``df`` with repeated chunks (and runs of lines, with ``passages``) cut from ``text_col``, ``n_chunks_removed`` and ``n_lines_removed``."""
    df = df.drop("n_chunks_removed", "n_lines_removed")
    names = df.columns
    keyed = df.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = settle(_chunk_rows(keyed, min_words, False).distinct())
    repeated = settle(found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).filter("n > 1").select("h", "first"))
    few = bounded(repeated)
    bodies = _chunk_rows(keyed, min_words, True).join(few.select("h"), "h", "left_semi")
    same = settle(bodies.groupBy("h").agg((F.min("body") == F.max("body")).alias("same")).filter("same").select("h"))
    removed = settle(
        found.join(few, "h").filter("at <> first").join(bounded(same), "h", "left_semi")
        .groupBy("at.key").agg(F.array_sort(F.collect_list("at.chunk")).alias("cut")))
    removed = removed.withColumn("spans", F.lit(None).cast("array<struct<begin:int,end:int>>"))
    if passages:
        removed = settle(removed.drop("spans").join(_repeated_spans(keyed, min_words).withColumnRenamed("key", "_other"), F.col("key").eqNullSafe(F.col("_other")), "full").select(
            F.coalesce("key", "_other").alias("key"), "cut", "spans"))
    fresh = "_cut_key", "_cut", "_spans"
    marked = df.withColumn(fresh[0], F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text")))
    cut = bounded(removed).select(F.col("key").alias("_key"), F.col("cut").alias(fresh[1]), F.col("spans").alias(fresh[2]))
    joined = marked.join(cut, marked._cut_key.eqNullSafe(F.col("_key")), "left")
    plain = [n for n in names if n != text_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone, lines = [], [], []
        for text, cut, lost in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text, chunks_gone, lines_gone = without(text, cut, lost) if cut or lost else (text, 0, 0)
            texts.append(text)
            gone.append(chunks_gone)
            lines.append(lines_gone)
        return pa.RecordBatch.from_arrays([batch.column(3 + k) for k in range(len(plain))] + [pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(lines, pa.int64())],
                                          names=[*plain, text_col, "n_chunks_removed", "n_lines_removed"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in [*plain, text_col]) + ", n_chunks_removed long, n_lines_removed long"
    return map_batches(joined.select(f"`{text_col}`", *fresh[1:], *[f"`{n}`" for n in plain]), run, schema, text_at=0).select(
        *[f"`{n}`" for n in names], "n_chunks_removed", "n_lines_removed")
