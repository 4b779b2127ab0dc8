"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids stand for each other.

A text is encoded with a leading space by a byte-level BPE (A) and as it is by a piece model (B), which adds that
space; no special tokens, whose strings are ordinary text. Byte offsets where tokens of both end cut the tokens into
groups, found by merging their cumulative ends, two sorted runs, a position in each. All A-B pairs of a group are linked.
Spark counts in how many documents each pair of ids is linked, and joins these counts and the maxima of each side back.

Byte-level BPE whose ids are in the order of its merges is run by its ranks, which is quicker; others as their file says.

Memory: texts are encoded and merged in spans of ``SPAN_CHARS``. A longer text goes span by span: both tokenizers divide it at
a space after a character that is no white space (that the piece model has no piece with a space inside is looked up), so no
token reaches over it and both end there. Only a stretch without any space is held whole. A document of over ``MOST_LINKS`` linked pairs leaves them in several rows, divided by A's id. The encoded table is
written once, to the folder that the cluster shares, and read by what counts and by what joins. Counts of the most
frequent pairs are broadcast (at most ``BROADCAST_ROWS`` rows of them), the others, each in few documents, are met by a shuffle.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from space and text, have no tokens:
zeros, an empty group text. Rows of equal ids or texts each give a row and count as a document each; an id is passed
through, null or not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm.shipping import BROADCAST_ROWS, enter, keep, pieces, settle, ship, written

#: Characters of text that are encoded and merged at once, and linked pairs of a row.
SPAN_CHARS, MOST_LINKS = 1 << 17, 1 << 20
#: Fixed: how byte-level tokenizers cut a text before they merge.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Links of a group from which on its equal ids are counted before they are paired.
LARGE_GROUP = 4096
DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups string"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_CUT = re.compile(r"(?<=\S) ")


def by_ranks(file: bytes, spelt: list[bytes]) -> tiktoken.Encoding | None:
    """A byte-level BPE file as ranks, if its ids are 256 bytes and then its merges in order, and nothing else is done to a text."""
    said = json.loads(file)
    model, cut = said["model"], said.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    plain = model.get("type", "BPE") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not said.get("normalizer") and not said.get("truncation")
    if not plain or [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))) or sorted(spelt[:256]) != [bytes([i]) for i in range(256)]:
        return None
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks={t: i for i, t in enumerate(spelt[: 256 + len(merges)])}, special_tokens={})


class Encoder:
    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_buffer(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        letters, ids = byte_letters(), self.a.get_vocab()
        bytes_a = [b""] * (max(ids.values()) + 1)
        for token, n in ids.items():
            bytes_a[n] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.ranks = by_ranks(file_a, bytes_a)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.spelt = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        self.sizes = [np.array([len(x) for x in y], np.int64) for y in (bytes_a, bytes_b)]
        #: An id's digits followed by nothing, a comma, a bar or a semicolon.
        self.digits = pa.array([f"{n}{end}" for end in ("", ",", "|", ";") for n in range(max(len(bytes_a), len(bytes_b)))], pa.large_string())
        self.divided = not any("▁" in p.lstrip("▁") for p in names)

    def spans(self, text: str) -> Iterator[str]:
        """Space and text, cut at spaces that follow no white space, about every ``SPAN_CHARS``."""
        text, start = " " + text, 0
        while self.divided and len(text) - start > SPAN_CHARS and (cut := _CUT.search(text, start + SPAN_CHARS)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A and B ids of each text, which begins with a space; none where the joined tokens are not the text."""
        ids_a = [self.ranks.encode_ordinary(t) for t in texts] if self.ranks else [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        sides, same = [], np.ones(len(texts), bool)
        raw = [t.encode() for t in texts]
        for ids, spelt, sizes in zip((ids_a, self.b.encode([t[1:] for t in texts], num_threads=1)), self.spelt, self.sizes):
            flat, cuts = np.fromiter(chain.from_iterable(ids), np.int64), np.cumsum([0, *map(len, ids)])
            joined, at = memoryview(spelt.take(pa.array(flat)).buffers()[2] or b"").cast("B"), np.concatenate([[0], np.cumsum(sizes[flat])])[cuts].tolist()
            same &= np.array([joined[i:j] == r for i, j, r in zip(at, at[1:], raw)], bool)
            sides.append([flat[i:j] for i, j in zip(cuts, cuts[1:])])
        return [pair if ok else None for *pair, ok in zip(*sides, same)]


class Aligned:
    """A document's figures as its spans come in: numbers, a digest or the text of its groups, and linked pairs (A id << 32 | B id) with how often."""

    def __init__(self, digest: bool):
        self.numbers, self.text, self.hash = np.zeros(4, np.int64), [], hashlib.sha256() if digest else None
        self.keys, self.times, self.many = [], [], []

    def add(self, numbers: np.ndarray, text: memoryview, keys: np.ndarray, times: np.ndarray) -> None:
        later = bool(self.numbers[2])  # a part of one text
        self.numbers += numbers
        if self.hash:
            self.hash.update(b";" * later)
            self.hash.update(text)
        else:
            self.text.append(bytes(text))
        self.keys.append(keys)
        self.times.append(times)

    @property
    def groups(self) -> str:
        return self.hash.hexdigest() if self.hash and self.numbers[2] else b";".join(self.text).decode()

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs, each once, in parts of bounded size that share none; at least one part."""
        keys, times = (self.keys[0], self.times[0]) if len(self.keys) == 1 else _summed(np.concatenate([*self.keys, _NONE]), np.concatenate([*self.times, _NONE]))
        parts = sum(len(x) * len(y) for x, _, y, _ in self.many) // MOST_LINKS + 1
        for part in range(parts):  # pairs of an A id are all in one part
            at, n = keys, times
            if parts > 1 or self.many:
                mine = (keys >> 32) % parts == part
                at, n = [keys[mine]], [times[mine]]
                for x, n_x, y, n_y in self.many:
                    own = x % parts == part
                    at.append(((x[own] << 32)[:, None] | y).ravel())
                    n.append((n_x[own][:, None] * n_y).ravel())
                at, n = _summed(np.concatenate(at), np.concatenate(n))
            for k in range(0, max(len(at), 1), MOST_LINKS):
                yield at[k : k + MOST_LINKS], n[k : k + MOST_LINKS]


_NONE = np.zeros(0, np.int64)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(at), np.int64)
    np.add.at(total, place, times)
    return at, total


def merge(span: list[tuple[Aligned, tuple[np.ndarray, np.ndarray]]], encoder: Encoder) -> None:
    """Align the tokens of some documents, or of parts of one, and add what is found to each."""
    docs = len(span)
    a, b = (np.concatenate([ids[side] for _, ids in span]) for side in (0, 1))
    of_a, of_b = (np.repeat(np.arange(docs), [len(ids[side]) for _, ids in span]) for side in (0, 1))
    end_a, end_b = np.cumsum(encoder.sizes[0][a]), np.cumsum(encoder.sizes[1][b])
    # two sorted runs: of each end its position in the other run, and whether they meet there
    last_a, last_b = end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n_groups = int(last_a.sum())
    n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    group_doc, product = of_a[last_a], n_a * n_b

    # the text: in each group the A tokens, then the B tokens, each with what follows it
    v, n = len(encoder.digits) // 4, len(a) + len(b)
    codes = np.empty(n, np.int64)
    end = np.ones(len(b), np.int64)
    end[last_b] = 3
    final = np.searchsorted(of_b, np.arange(docs), "right") - 1
    end[final] = 0
    codes[np.arange(len(a)) + from_b[group_a]] = a + v * (1 + last_a)
    codes[np.arange(len(b)) + (from_a + n_a)[group_b]] = b + v * end
    said = encoder.digits.take(pa.array(codes))
    ends_at = np.frombuffer(said.buffers()[1], np.int64)[: n + 1]
    text, cuts = memoryview(said.buffers()[2]), np.cumsum([0, *(len(x) + len(y) for _, (x, y) in span)]).tolist()

    # links: every A token with every B token of its group; large groups by their distinct ids
    small = product <= LARGE_GROUP
    take = np.flatnonzero(small[group_a])
    times = n_b[group_a[take]]
    left = np.repeat(take, times)
    right = np.repeat(from_b[group_a[take]], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    keys, counts = np.unique(of_a[left] << 42 | a[left] << 21 | b[right], return_counts=True)
    more: list[tuple[int, np.ndarray, np.ndarray]] = []
    for g in np.flatnonzero(~small).tolist():
        x, n_x = np.unique(a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
        y, n_y = np.unique(b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
        if len(x) * len(y) > MOST_LINKS // 16:
            span[group_doc[g]][0].many.append((x, n_x, y, n_y))
        else:
            more.append((int(group_doc[g]), ((x << 32)[:, None] | y).ravel(), (n_x[:, None] * n_y).ravel()))
    doc_of_key, keys = keys >> 42, (keys >> 21 & 0x1FFFFF) << 32 | keys & 0x1FFFFF
    key_cuts = np.searchsorted(doc_of_key, np.arange(docs + 1)).tolist()
    numbers = np.stack([np.bincount(of_a, minlength=docs), np.bincount(of_b, minlength=docs), np.bincount(group_doc, minlength=docs), np.bincount(group_doc, product, docs).astype(np.int64)], 1)
    for i, (aligned, _) in enumerate(span):
        own = slice(key_cuts[i], key_cuts[i + 1])
        aligned.add(numbers[i], text[int(ends_at[cuts[i]]) : int(ends_at[cuts[i + 1]])], keys[own].copy(), counts[own].astype(np.int64))
    for i, at, n_at in more:
        span[i][0].keys.append(at)
        span[i][0].times.append(n_at)


def align_texts(encoder: Encoder, texts: list[str | None], digest: bool) -> Iterator[Aligned]:
    """In order, some texts or a part of one at a time."""
    waiting: list[str | None] = []

    def together() -> Iterator[Aligned]:
        ids = iter(encoder.encoded([" " + t for t in waiting if t]))
        found = [(Aligned(digest), next(ids) if t else None) for t in waiting]
        if span := [x for x in found if x[1]]:
            merge(span, encoder)
        yield from (x for x, _ in found)
        waiting.clear()

    for text in texts:
        if text and len(text) > SPAN_CHARS:
            yield from together()
            now = Aligned(digest)
            for part in encoder.spans(text):
                (ids,) = encoder.encoded([part])
                if not ids:
                    now = Aligned(digest)
                    break
                merge([(now, ids)], encoder)
            yield now
            continue
        waiting.append(text)
        if sum(map(len, filter(None, waiting))) > SPAN_CHARS:
            yield from together()
    yield from together()


def _encode(df: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """``row``, the id, the document's figures (null in further rows of the same document) and ``links``."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (path_a, path_b)))
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        encoder = keep(__name__, (path_a, path_b), lambda: Encoder(*shared.value))
        for whole in batches:
            for batch in (x for y in pieces(whole, 2) for x in (y.slice(i, 200) for i in range(0, y.num_rows, 200))):
                at, figures, held, size = [], [], [], 0
                for i, found in enumerate(align_texts(encoder, batch.column(2).to_pylist(), digest)):
                    own = (*found.numbers.tolist(), found.groups)
                    for part in found.links():
                        at.append(i)
                        figures.append(own)
                        own = (None,) * 5
                        held.append(part)
                        size += len(part[0])
                        if size > MOST_LINKS:
                            yield _batch(batch, at, figures, held, pair)
                            at, figures, held, size = [], [], [], 0
                if at:
                    yield _batch(batch, at, figures, held, pair)

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"row long, id {kind}, {DOCUMENT}, links array<struct<a:int,b:int,n:long>>")


def _batch(batch: pa.RecordBatch, at: list, figures: list, held: list, pair: pa.DataType) -> pa.RecordBatch:
    sizes = [len(k) for k, _ in held]
    keys, n = np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held])
    flat = pa.StructArray.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], fields=list(pair))
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
    numbers = [pa.array(c, pa.int64()) for c in list(zip(*figures))[:4]]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *numbers, pa.array([f[4] for f in figures], pa.string()), listed],
        names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def pair_counts(coded: DataFrame) -> DataFrame:
    """Each linked pair of ids with the documents that hold it (``docs``), and whether that is the most of its A id or B id."""
    counts = settle(coded.select(F.inline("links")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")))
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("docs").alias("most")), side).withColumn(f"best_{side}", F.col("docs") == F.col("most")).drop("most")
    return settle(counts.select("a", "b", "docs", "best_a", "best_b"))


def _least_frequent(counts: DataFrame) -> int:
    """The documents from which on pairs are few enough to broadcast; 0 if all are."""
    by_size = counts.groupBy(F.floor(F.log2("docs")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 63 rows
    rows = 0
    for r in sorted(by_size, key=lambda r: -r.power):
        rows += r.n
        if rows > BROADCAST_ROWS:
            return 2 ** (r.power + 1)
    return 0


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` and ``n_best_b`` (links whose count is their A or B id's highest), ``count_sum`` and ``groups``.

    ``path_a``: a tokenizer file of byte-level BPE, ``path_b``: a piece model; both are read here and sent to the
    workers. ``digest``: ``groups_sha256`` in place of the groups' text, of which it is the SHA-256; empty without tokens.
    """
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    coded = written(_encode(docs, path_a, path_b, digest), "alignment")
    counts = pair_counts(coded)
    least = _least_frequent(counts)
    linked = coded.select("row", F.inline("links"))
    met = linked.join(F.broadcast(counts.filter(F.col("docs") >= least)), ["a", "b"], "left" if least else "inner")  # rows counted above
    if least:
        rare = met.filter("docs is null").select("row", "a", "b", "n").join(counts.filter(F.col("docs") < least), ["a", "b"])
        met = met.filter("docs is not null").unionByName(rare)
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.col("docs")).alias("count_sum"), of("best_a").alias("n_best"), of("best_b").alias("n_best_b"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return coded.filter("n_a is not null").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("n_best_b"), none("count_sum"), F.col("groups").alias("groups_sha256" if digest else "groups"))
