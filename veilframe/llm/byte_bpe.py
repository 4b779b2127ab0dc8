"""Byte-level BPE: the merges compiled into a lazily determinised transducer, and a streaming decoder.

Encoding. For each position of a piece exactly one token can end there, given what stands
before; which of these tokens are used is known once later ones have joined up. A state holds
the starts still possible for tokens to come: how many bytes lie behind each, and the token
that ends at it. Reading a byte drops the starts whose bytes begin no vocabulary entry and
finds the one entry that ends at the new byte and fits the token before it; that id is the
transition's output. All possible starts lie within the longest entry, so the paths back from
them meet after bounded lookahead; what lies before that point is emitted. States are made
when first met and kept by their content; transitions are a hash table of flat arrays, through
which all new words of a block go side by side, a byte of each at a time. Of ``MAX_STATES``
states the half used last is kept, of ``MAX_WORDS`` words the half asked for most.

Two tokens fit beside each other if no pair across their boundary is joined while each is made
from its own parts. A piece that is itself an entry is that one token.

Decoding turns ids into bytes and feeds them to a UTF-8 state machine that carries the
unfinished character over from call to call.

Defined cases: null and empty texts encode to no ids and decode to the empty text; an id
outside the vocabulary raises; malformed bytes decode to U+FFFD as Python's ``replace`` does;
repeated rows get equal results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm.shipping import keep, map_batches

#: States of the transducer and memorised words that a worker keeps, for flat memory; results don't depend on them.
MAX_STATES, MAX_WORDS = 100_000, 100_000
#: Pieces encoded at a time, bytes of new ones that go side by side, and bytes from which a piece is read on its own and not kept.
BLOCK_PIECES, SIDE_BYTES, LONG_PIECE = 1 << 15, 1 << 17, 256
#: Bytes of a long piece after which what is settled is emitted, a few times the longest entry.
HELD_BYTES = 4096
#: Characters from which a text's pieces are not held all together, and ids that a decoder turns into text at a time.
LONG_TEXT, DECODE_IDS = 1 << 21, 1 << 16
_FREE = np.uint64((1 << 64) - 1)


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1 ... of n each, one run after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


class _Moves:
    """(state, byte) -> (next state, id of the token that ends at this byte), an open hash table of whole columns."""

    def __init__(self, slots: int = 1 << 12):
        self.keys, self.next, self.token = np.full(slots, _FREE), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.n, self.shift = 0, np.uint64(65 - slots.bit_length())

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, a free one if it is not there."""
        at = self._home(keys)
        there = self.keys[at]
        off = np.flatnonzero((there != keys) & (there != _FREE))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            there = self.keys[at[off]]
            off = off[(there != keys[off]) & (there != _FREE)]
        return at

    def add(self, keys: np.ndarray, to: np.ndarray, token: np.ndarray) -> None:
        """Distinct keys that are not there."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys != _FREE)
            keys, to, token = np.concatenate([self.keys[old], keys]), np.concatenate([self.next[old], to]), np.concatenate([self.token[old], token])
            self.__init__(1 << (3 * len(keys)).bit_length())
        self.n += len(keys)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            here = at[left]
            free = self.keys[here] == _FREE
            self.keys[here[free]] = keys[left[free]]
            done = self.keys[here] == keys[left]
            self.next[here[done]], self.token[here[done]] = to[left[done]], token[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.entries = {i: b for b, i in ranks.items()}
        if len(self.entries) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary gives each of its entries one id and has all 256 bytes")
        self.begins = {b[:n] for b in ranks for n in range(1, len(b))}
        self.length = np.zeros(max(self.entries) + 1, np.int64)
        self.length[list(self.entries)] = [len(b) for b in self.entries.values()]
        self._made_of: dict[int, tuple[int, ...]] = {}
        self._fits: dict[int, bool] = {}
        self._starts: dict[tuple, tuple] = {}  # equal pairs are one object
        self._states: dict[tuple, int] = {}  # (bytes since the earliest start, starts) -> number
        self._content: list[tuple] = []
        self._moves, self._near = _Moves(), {}
        self._round, self._used = 0, np.zeros(1 << 12, np.int64)  # the round in which each state was used last
        self.start = self._state(b"", ((0, None),))

    def _state(self, read: bytes, starts: tuple[tuple[int, int | None], ...]) -> int:
        n = self._states.setdefault((read, starts), len(self._content))
        if n == len(self._content):
            self._content.append((read, starts))
            if n == len(self._used):
                self._used = np.concatenate([self._used, np.zeros(n, np.int64)])
            self._used[n] = self._round
        return n

    def _trim(self) -> None:
        """Begin a round, in a full table with the half of the states used last."""
        self._round += 1
        if len(self._content) < MAX_STATES:
            return
        self._used[self.start] = self._round
        kept = np.sort(np.argsort(self._used[: len(self._content)], kind="stable")[-max(1, MAX_STATES // 2) :])
        number = np.full(len(self._content), -1)
        number[kept] = np.arange(len(kept))
        at = np.flatnonzero(self._moves.keys != _FREE)
        source, to, token = number[(self._moves.keys[at] >> np.uint64(8)).astype(np.int64)], number[self._moves.next[at]], self._moves.token[at]
        both = (source >= 0) & (to >= 0)
        keys = (source[both].astype(np.uint64) << np.uint64(8)) | (self._moves.keys[at][both] & np.uint64(255))
        self._content = [self._content[k] for k in kept.tolist()]
        self._states = {c: k for k, c in enumerate(self._content)}
        self._used[: len(kept)] = self._used[kept]
        self.start = int(number[self.start])
        self._moves, self._near = _Moves(), {}
        self._moves.add(keys, to[both].astype(np.int32), token[both])
        self._starts.clear()

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """The parts left when the pair of lowest rank is joined until none is under ``below``; for a few bytes only."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(a + b, below) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < below:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], below)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], below)
        return parts

    def made_of(self, token: int) -> tuple[int, ...]:
        """The two entries whose joining makes this one; itself for a byte; more, or one, for an entry that joining doesn't reach."""
        known = self._made_of.get(token)
        if known is None:
            parts = self._merged(self.entries[token], token)
            known = self._made_of[token] = tuple(self.ranks[p] for p in parts)
        return known

    def _reached(self, token: int) -> bool:
        return self.length[token] == 1 or len(self.made_of(token)) == 2

    def fits(self, left: int | None, right: int) -> bool:
        """Walk back through the making of both along their boundary; ranks are the times at which parts are joined."""
        pair = (-1 if left is None else left) << 32 | right
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > MAX_STATES // 2:
                self._fits.clear()
            known = self._fits[pair] = self._reached(right) and (left is None or self._reached(left) and self._apart(left, right))
        return known

    def _apart(self, x: int, y: int) -> bool:
        x_until = y_until = len(self.length)
        entries, ranks, one = self.entries, self.ranks, self.length
        while True:
            joined = ranks.get(entries[x] + entries[y])
            if joined is not None and joined < x_until and joined <= y_until:
                return False
            if one[y] > 1 and (y >= x or one[x] == 1):  # of two joined at the same rank the right one is the later
                y_until, y = y, self.made_of(y)[0]
            elif one[x] > 1:
                x_until, x = x, self.made_of(x)[-1]
            else:
                return True

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        before, old = self._content[state]
        read, starts, ends = before + bytes((byte,)), [], None
        for since, left in old:
            pending = read[len(read) - 1 - since :]
            if ends is None and (token := self.ranks.get(pending)) is not None and self.fits(left, token):
                ends = token
            if pending in self.begins:
                start = since + 1, left
                starts.append(self._starts.setdefault(start, start))
        if ends is None:
            raise ValueError("the vocabulary's ranks are not those of merges")
        starts.append(self._starts.setdefault((0, ends), (0, ends)))
        return self._state(read[len(read) - starts[0][0] :], tuple(starts)), ends

    def _advance(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state's next state and output on its byte; transitions not met before are made."""
        keys = (states.astype(np.uint64) << np.uint64(8)) | data
        at = self._moves.find(keys)
        new = self._moves.keys[at] == _FREE
        if new.any():
            unknown = np.unique(keys[new])
            made = np.array([self._step(k >> 8, k & 255) for k in unknown.tolist()], np.int32)
            self._moves.add(unknown, made[:, 0], made[:, 1])
            at = self._moves.find(keys)
        to = self._moves.next[at]
        self._used[to] = self._round
        return to, self._moves.token[at]

    def _side_by_side(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short pieces, of falling length, one after another, and how many each has."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first, data = np.cumsum(n) - n, np.frombuffer(b"".join(pieces), np.uint8)
        ends, used, states = np.zeros(len(data), np.int32), np.zeros(len(data), bool), np.full(len(n), self.start)
        for at in range(int(n[0])):
            here = first[: np.searchsorted(-n, -at)] + at
            states, ends[here] = self._advance(states[: len(here)], data[here])
        first, to = first.copy(), first + n
        begins = first
        while len(to):  # back along the tokens in use
            used[to - 1] = True
            to = to - self.length[ends[to - 1]]
            left = to > begins
            to, begins = to[left], begins[left]
        return ends[used], np.add.reduceat(used, first, dtype=np.int64)

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many pieces: all of them, each piece's first one's place, and how many it has."""
        first, n, ids, total = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64), [np.zeros(0, np.int32)], 0
        lone, short = [], []
        for k, piece in enumerate(pieces):
            if (token := self.ranks.get(piece)) is not None:
                first[k] = len(lone)
                lone.append(token)
            elif len(piece) < LONG_PIECE:
                short.append(k)
            else:
                n[k] = 0
        ids.append(np.array(lone, np.int32))
        total = len(lone)
        for k in np.flatnonzero(n == 0).tolist():
            ids.append(np.array(self.encode(pieces[k]), np.int32))
            first[k], n[k] = total, len(ids[-1])
            total += len(ids[-1])
        short.sort(key=lambda k: -len(pieces[k]))
        at = 0
        while at < len(short):
            self._trim()
            some = short[at : at + max(1, SIDE_BYTES // len(pieces[short[at]]))]
            at += len(some)
            found, each = self._side_by_side([pieces[k] for k in some])
            first[some], n[some] = total + np.cumsum(each) - each, each
            total += len(found)
            ids.append(found)
        return np.concatenate(ids), first, n

    def _settled(self, ends: list[int], starts: tuple[tuple[int, int | None], ...]) -> int:
        """Where the paths back from all possible starts meet: nothing before it can change."""
        open_ = {len(ends) - since for since, _ in starts}
        while len(open_) > 1:
            at = max(open_)
            open_ = open_ - {at} | {at - len(self.entries[ends[at - 1]])}
        return open_.pop()

    def _path(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(ends[at - 1])
            at -= len(self.entries[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece, read byte by byte; what is settled is emitted every ``HELD_BYTES``."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        self._trim()
        state, ends, out = self.start, [], []
        for at in range(0, len(piece), HELD_BYTES):
            if at:
                content = self._content[state]
                settled = self._settled(ends, content[1])
                out += self._path(ends, settled)
                del ends[:settled]
                self._trim()
                state = self._state(*content)
            for byte in piece[at : at + HELD_BYTES]:
                move = self._near.get((state, byte))
                if move is None:
                    move = self._near[state, byte] = tuple(int(x[0]) for x in self._advance(np.array([state]), np.array([byte], np.uint8)))
                state, token = move
                ends.append(token)
            if len(self._near) > MAX_STATES // 4:
                self._near.clear()
        return out + self._path(ends, len(ends))


class _Words(dict):
    """word -> its number; those not known yet wait in ``fresh``. Their ids lie side by side."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.fresh, self.words = transducer, [], []
        self.ids, self.first, self.n, self.asked = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words) + len(self.fresh)
        self.fresh.append(word)
        return n

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        number = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.fresh:
            ids, first, n = self.transducer.encode_all([w.encode() for w in self.fresh])
            self.first, self.n = np.concatenate([self.first, first + len(self.ids)]), np.concatenate([self.n, n])
            self.ids = np.concatenate([self.ids, ids])
            self.words += self.fresh
            self.fresh = []
        n = self.n[number]
        out = self.ids[_ragged(self.first[number], n)]
        self.asked = np.bincount(number, minlength=len(self.words)) + np.pad(self.asked, (0, len(self.words) - len(self.asked)))
        if len(self.words) > MAX_WORDS or len(self.ids) > 8 * MAX_WORDS:
            self._trim()
        return out, n

    def _trim(self) -> None:
        self.asked[self.n > LONG_PIECE // 4] = 0
        kept = np.sort(np.argsort(self.asked, kind="stable")[-max(1, MAX_WORDS // 2) :])
        kept = kept[self.asked[kept] > 0]
        self.words = [self.words[k] for k in kept.tolist()]
        self.clear()
        self.update(zip(self.words, range(len(self.words))))
        n = self.n[kept]
        self.ids, self.first, self.n, self.asked = self.ids[_ragged(self.first[kept], n)], np.cumsum(n) - n, n, self.asked[kept] // 2


class Codec:
    """A vocabulary's encoder and decoder."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.words = _Words(self.transducer)
        entries = [self.transducer.entries.get(i, b"") for i in range(len(self.transducer.length))]
        self._bytes, self._n = np.frombuffer(b"".join(entries), np.uint8), self.transducer.length
        self._first = np.cumsum(self._n) - self._n

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) < LONG_TEXT:
            yield self.split.findall(text)
            return
        found = (m[0] for m in self.split.finditer(text))
        while some := list(islice(found, BLOCK_PIECES)):
            yield some

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        pieces, marks = [], []

        def flush() -> None:
            ids, n = self.words.encode(pieces)
            ends, begin = np.concatenate([[0], np.cumsum(n)]), 0
            packed = memoryview(ids.astype("<u4").tobytes())
            for k, at in marks:
                end = 4 * int(ends[at])
                out[k].append(bytes(packed[begin:end]))
                begin = end
            pieces.clear()
            marks.clear()

        for k, text in enumerate(texts):
            for some in self._pieces(text) if text else ():
                pieces += some
                marks.append((k, len(pieces)))
                if len(pieces) >= BLOCK_PIECES:
                    flush()
        if pieces:
            flush()
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def encode_packed(self, text: str | None) -> bytes:
        return self.encode_texts([text])[0]

    def decode_pieces(self, packed: bytes) -> Iterator[str]:
        ids, machine = np.frombuffer(packed, "<u4"), Utf8Machine()
        for at in range(0, len(ids), DECODE_IDS):
            some = ids[at : at + DECODE_IDS]
            if some.max() >= len(self._n) or not self._n[some].all():
                raise KeyError(f"ids outside the vocabulary: {[i for i in some.tolist() if i not in self.transducer.entries][:5]}")
            yield machine.feed(self._bytes[_ragged(self._first[some], self._n[some])].tobytes())
        yield machine.finish()


#: Fixed values, of UTF-8 itself: lead bytes, how many bytes follow, and what the first of these may be.
_LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF),
          (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))
_OPENS = {lead: (n, low, high) for first, last, n, low, high in _LEADS for lead in range(first, last + 1)}
_DONE = (0, 0, 0)


class Utf8Machine:
    """Incremental UTF-8. ``state``: bytes that the open character still lacks, and the least and greatest that its next may be.

    A call steps through the bytes that end the character left open by the last one, and from
    the last lead on through those of the character that it leaves open; whole characters between are converted at once.
    """

    def __init__(self) -> None:
        self.state, self.held = _DONE, b""

    def _take(self, byte: int) -> bool:
        """One transition; False if the byte can't go on with the open character."""
        lacks, low, high = self.state
        if not lacks:
            self.state = _OPENS.get(byte, _DONE)
        elif not low <= byte <= high:
            return False
        else:
            self.state = (lacks - 1, 0x80, 0xBF) if lacks > 1 else _DONE
        return True

    def feed(self, data: bytes) -> str:
        at, out = 0, ""
        while self.state[0] and at < len(data):
            if not self._take(data[at]):
                break
            at += 1
        if self.state[0] and at == len(data):
            self.held += data
            return ""
        if self.held:
            out, self.held, self.state = (self.held + data[:at]).decode("utf-8", "replace"), b"", _DONE
        cut = len(data)
        for back in range(max(at, len(data) - 3), len(data)):
            self.state = _DONE
            if data[back] in _OPENS and all(map(self._take, data[back:])) and self.state[0]:
                cut = back
                break
        else:
            self.state = _DONE
        self.held = data[cut:]
        return out + data[at:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held, self.state = self.held, b"", _DONE
        return rest.decode("utf-8", "replace")


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary, kept from task to task."""
    return keep(__name__, hashlib.sha256(rank_file + pattern.encode()).hexdigest(), lambda: Codec(rank_file, pattern))


def _vocabulary(spark: SparkSession, path: str):
    """The rank file, read on the driver (about a megabyte) and broadcast: workers need no such path."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """``id_col`` and ``ids``: an array of integers, or their packed little-endian bytes."""
    rank_file = _vocabulary(df.sparkSession, path)
    picked = df.select(f"`{id_col}`", f"`{text_col}`")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(rank_file.value, pattern)
        ids = codec.encode_texts(batch.column(1).to_pylist())
        if packed:
            out = pa.array(ids, pa.binary())
        else:
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4")
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column(0), out], names=[id_col, "ids"])

    return map_batches(picked, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids {'binary' if packed else 'array<int>'}")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", keep_ids: bool = False) -> DataFrame:
    """``id_col``, ``text`` and, if asked for, the ids again; ids are packed bytes or an array of integers."""
    rank_file = _vocabulary(df.sparkSession, path)
    kinds = dict(df.dtypes)
    picked = df.select(f"`{id_col}`", f"`{ids_col}`")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(rank_file.value, pattern)
        texts = ["".join(codec.decode_pieces(x if isinstance(x, bytes) else np.array(x or [], "<u4").tobytes())) for x in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array(texts, pa.string())] + [batch.column(1)] * keep_ids
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "text"] + [ids_col] * keep_ids)

    return map_batches(picked, run, f"`{id_col}` {kinds[id_col]}, text string" + f", `{ids_col}` {kinds[ids_col]}" * keep_ids)


def transcode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``id_col``, ``ids`` (packed) and ``text``, decoded from these ids."""
    rank_file = _vocabulary(df.sparkSession, path)
    picked = df.select(f"`{id_col}`", f"`{text_col}`")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(rank_file.value, pattern)
        ids = codec.encode_texts(batch.column(1).to_pylist())
        texts = ["".join(codec.decode_pieces(x)) for x in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    return map_batches(picked, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids binary, text string")
