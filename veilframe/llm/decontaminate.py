"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items, one scan per text.

Normal form: ASCII letters lower-cased; words are runs of ASCII letters and digits and of
characters beyond ASCII. An item's windows are its runs of ``window`` words; an item of fewer
words is one window, an item of none has no window. The automaton reads word numbers, so a
scan costs a step per word, whatever the number of items. A word inside an occurrence is hit;
runs of hit words are mapped back to character offsets of the original text.

The items are a test set that the driver reads in blocks of ``BLOCK_WORDS`` words; each block
is one broadcast automaton. A set beyond one block takes a job a block: what a block finds is kept by the digest of the
text, in the checkpoint folder, before the next block is read, so a worker has one automaton at a time however many
there are, the driver one block, and nothing is left out.

Defined cases: null and empty texts have no words and no hits; a null item id is written as
the empty string; rows with equal item ids count as one item; repeated documents get equal
results; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import SALTS
from veilframe.llm.shipping import keep, map_batches, settle, small

#: Some 1.1 KB of a worker a word: a block's automaton takes about 230 MB.
WINDOW, BLOCK_WORDS = 10, 200_000
ADDED = ("n_words", "n_hit", "items", "spans")
#: On lower-cased UTF-8 bytes; every byte of a character beyond ASCII belongs to a word.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, words in items:
            row = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for at in range(max(1, len(row) - window + 1)):
                if row:
                    owners[tuple(row[at : at + window])].add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, names in owners.items():
            self.machine.add_word(run, (len(run), frozenset(names)))
        if owners:
            self.machine.make_automaton()
        self.any = bool(owners)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs (first, last + 1) of hit words, and the items with an occurrence."""
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.any or not words:
            return runs, found
        number = self.numbers.get
        for last, (size, names) in self.machine.iter(tuple([number(w, 0) for w in words])):
            first, found = last + 1 - size, found | names if not names <= found else found
            while runs and runs[-1][1] >= first:  # ends come in order, starts need not
                first = min(first, runs.pop()[0])
            runs.append((first, last + 1))
        return runs, found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and out[-1][1] >= first:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets of runs of words in the original text."""
    if not runs:
        return []
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    spans, chars, seen = [], 0, 0
    for first, end in runs:
        pair = []
        for byte in (at[first][0], at[end - 1][1]):
            chars += len(raw[seen:byte].decode())
            seen = byte
            pair.append(chars)
        spans.append({"start": pair[0], "end": pair[1]})
    return spans


def _automaton(name: str, block, window: int) -> Automaton:
    return keep(f"{__name__} {name}", window, lambda: Automaton(block.value, window))  # one block's automaton at a time


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    block, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")), f"`{text_col}`").toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


def scan(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` of the original text.

    With ``keep_columns`` all columns of ``df`` stay; the added ones replace columns of their names.
    """
    picked = df.drop(*ADDED) if keep_columns else df.select(f"`{id_col}`", f"`{text_col}`")
    names, at = picked.columns, picked.columns.index(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    added = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    blocks = _blocks(benchmark, item_col, item_text_col)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        shared, name = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def once(batch: pa.RecordBatch) -> pa.RecordBatch:
            machine, texts, scanned = _automaton(name, shared, window), batch.column(at).to_pylist(), []
            for text in texts:
                words = words_of(text)
                scanned.append((*machine.scan(words), len(words)))
            return _figures(batch, names, texts, scanned)

        now = map_batches(picked, once, f"{kinds}, {added}", text_at=at)
        return now if keep_columns else now.select(f"`{id_col}`", *ADDED)

    aside = picked.toDF(*[f"column {i}" for i in range(len(names))])  # names that no result has
    digest = F.unhex(F.sha2(F.col(f"`column {at}`"), 256))
    texts, found = aside.select(digest.alias("digest"), F.col(f"`column {at}`").alias("text")).filter("text is not null"), []
    for n, block in enumerate(chain([block, after], blocks)):
        found.append(settle(_hits(texts, block, window).dropDuplicates(["digest"]).withColumn("block", F.lit(n))))  # a text's copies all find the same
    hits = settle(reduce(DataFrame.unionByName, found).groupBy("digest").agg(  # at most a row a block
        F.flatten(F.collect_list("runs")).alias("all runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("all items")))
    keyed = aside.withColumn("digest of text", digest).withColumn("salt of row", F.monotonically_increasing_id())
    renamed = hits.withColumnRenamed("digest", "digest of text")
    joined = keyed.join(F.broadcast(renamed), "digest of text", "left") if small(hits) else _met(keyed, renamed)
    met = joined.select(*[F.col(f"`{c}`") for c in aside.columns], "all runs", "all items")

    def together(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, runs, items = (batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1))
        scanned = [(merged([*zip(r[::2], r[1::2])]) if r else [], i or [], len(words_of(t))) for t, r, i in zip(texts, runs, items)]
        return _figures(batch, names, texts, scanned)

    now = map_batches(met, together, f"{kinds}, {added}", text_at=at)
    return now if keep_columns else now.select(f"`{id_col}`", *ADDED)


def _hits(texts: DataFrame, block: list, window: int) -> DataFrame:
    """``digest``, ``runs`` (first, end, first, end, ...) and ``items`` of the texts that hold something of the block."""
    shared, name = texts.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, at, runs, items = _automaton(name, shared, window), [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            pairs, names = machine.scan(words_of(text))
            if pairs:
                at.append(i)
                runs.append([x for pair in pairs for x in pair])
                items.append(sorted(names))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int32())), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["digest", "runs", "items"])

    return map_batches(texts, run, "digest binary, runs array<int>, items array<string>")


def _met(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with their text's hits; the copies of a text are dealt out."""
    salt = F.pmod(F.col("salt of row"), F.lit(SALTS)).cast("int")
    copies = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("salt", salt).join(copies, ["digest of text", "salt"], "left").drop("salt")


def _figures(batch: pa.RecordBatch, names: list[str], texts: list[str | None], scanned: list[tuple]) -> pa.RecordBatch:
    """The batch's first columns with what was found in each text: runs of hit words, items, number of words."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [
        pa.array([n for *_, n in scanned], pa.int64()), pa.array([sum(b - a for a, b in pairs) for pairs, _, _ in scanned], pa.int64()),
        pa.array([sorted(items) for _, items, _ in scanned], pa.list_(pa.string())), pa.array([offsets(t, pairs) for t, (pairs, _, _) in zip(texts, scanned)], span)]
    return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, *ADDED])
