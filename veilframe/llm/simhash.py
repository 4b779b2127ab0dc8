"""SimHash near-duplicates: fingerprints linked by a sharded forest of vantage-point trees.

Fingerprint: ASCII letters lower-cased, words cut at ASCII white space, shingles of ``words``
words (a shorter text is one shingle), XXH64 with seed 42 of each; a bit is set where over half
of the shingles have it. Texts without words, null ones included, have fingerprint zero.

Search for all pairs within ``radius`` bits, exactly:

* Cells of more than ``SHARD_POINTS`` points are divided in Spark by vantage points of their own, as
  many at a time as their size asks for, up to a bound, each at the median distance of the cell: inner and outer points. By the
  triangle inequality no pair crosses but between points that lie within r of that boundary, so of
  the outer points only these are sent to the inner side as well.
* That overlap is a quarter of a cell, since whole distances lie close together, and a quarter again in each cell
  below: the copies of a point grow with a power of the table. Beyond ``ONE_TREE`` shards r + 1 trees take its place: a pair
  at most r bits apart agrees in one of r + 1 equal parts of its bits, and tree t divides by distance within
  part t, so such a pair is on one side of every boundary and nothing overlaps: r + 1 copies of a point in a table of any size. Every
  third round takes whole distances, where a part no longer tells points apart.
* A cell that neither divides, a dense ball, is dealt out in pieces, and each pair of pieces is a shard.
* Within a shard a local tree splits at the median distance from its vantage point, and only
  the points within r of that boundary are compared across it.

Shards return a spanning forest of their links, never all pairs; star contraction joins the
forests. Equal fingerprints are one point throughout, so a group of copies has no pairs.

Defined cases: repeated rows and ties share a component; ids may repeat; a component without
any id has a null id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.components import SALTS, components, contracted, salted_join
from veilframe.llm.shipping import bounded, enter, map_batches, settle, ship, small

SEED = 42
#: Points of a shard; larger cells are divided by vantage points. A local leaf compares all its points.
SHARD_POINTS, LEAF, ONE_TREE = 1 << 14, 128, 1
#: Vantage points of a cell in a round (twice as many where nothing overlaps), and the share of its points that a side may keep for a division to count as one.
AXES, KEPT = 6, 0.9
#: Hashes whose bits are unpacked at a time.
BLOCK = 1 << 15
#: Share of a sketch's allowed differences up to which an exact comparison could not refuse a pair.
SURE = 0.4
#: A word ends a segment where its hash divides by so much; least words of a segment that counts.
SEGMENT, SEGMENT_WORDS = 12, 8
#: Distinct shingles up to which a text's near copies are found exactly; documents of a shingle from which it is dealt out.
SHORT, FREQUENT = 100, 1000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    parts = (text or "").encode().lower().split()
    if len(parts) >= words:
        parts = map(b" ".join, zip(*(parts[k:] for k in range(words))))
    elif parts:
        parts = [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in parts], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, a signed long, per row."""
    picked = df.select(f"`{id_col}`", f"`{text_col}`")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = [majority(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    return map_batches(picked, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spanning(places_a: np.ndarray, places_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that connect what the pairs (i, j) connect."""
    if len(i) <= len(places_a) + len(places_b):
        return places_a[i], places_b[j]
    root = _roots(len(places_a) + len(places_b), i, j + len(places_a))
    every = np.concatenate([places_a, places_b])
    return every, every[root]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (i, j) of n places make a spanning forest of what they connect."""
    seen, a, b, out = _roots(n, i, j) == np.arange(n), np.concatenate([i, j]), np.concatenate([j, i]), [np.zeros(0, np.int64)]
    while len(at := np.flatnonzero(seen[a] & ~seen[b])):
        at = at[np.unique(b[at], return_index=True)[1]]
        seen[b[at]] = True
        out.append(at % len(i))
    return np.concatenate(out)


class _Shard:
    """Points of some shards: ``fp`` for the search and, if given, ``sketch`` (64-bit columns) to confirm what it finds. Points of one ``label`` are known to be connected."""

    def __init__(self, fp: np.ndarray, sketch: np.ndarray | None, radius: int, most: int, label: np.ndarray | None = None):
        self.fp, self.sketch, self.radius, self.most, self.label = fp, sketch, radius, most, label
        self.compared = 0  # pairs whose distance was taken

    def confirmed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.sketch is None:
            return np.ones(len(a), bool)
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), BLOCK):
            cut = slice(at, at + BLOCK)
            out[cut] = np.bitwise_count(self.sketch[a[cut]] ^ self.sketch[b[cut]]).sum(1, dtype=np.int64) <= self.most
        return out

    def few(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of confirmed pairs a spanning forest, of the likeliest ones as far as they go; with labels all pairs between these."""
        if self.label is not None:
            other = self.label[a] != self.label[b]
            return a[other], b[other]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return a, b
        places, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = at[: len(a)], at[len(a) :]
        sure = np.concatenate([np.bitwise_count(self.sketch[a[k : k + BLOCK]] ^ self.sketch[b[k : k + BLOCK]]).sum(1, dtype=np.int64) <= self.most * SURE for k in range(0, len(a), BLOCK)])
        tree = np.flatnonzero(sure)[_forest(i[sure], j[sure], len(places))]
        root = _roots(len(places), i[tree], j[tree])
        rest = np.flatnonzero(root[i] != root[j])
        kept = np.concatenate([tree, rest[_forest(root[i[rest]], root[j[rest]], len(places))]])
        return a[kept], b[kept]

    def across(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(a), 512):
            for to in range(0, len(b), 512):
                x, y = a[at : at + 512], b[to : to + 512]
                self.compared += len(x) * len(y)
                i, j = np.nonzero(np.bitwise_count(self.fp[x][:, None] ^ self.fp[y][None, :]) <= self.radius)
                good = self.confirmed(x[i], y[j])
                i, j = i[good], j[good]
                yield _spanning(x, y, i, j) if self.sketch is None else self.few(x[i], y[j])

    def within(self, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A vantage-point tree over these places, walked as it is built."""
        stack, r = [places], self.radius
        while stack:
            here = stack.pop()
            if len(here) > LEAF:
                away = np.bitwise_count(self.fp[here] ^ self.fp[here[0]])
                bound = int(np.median(away))
                if away.max() == bound:
                    bound -= 1
                inner, outer = here[away <= bound], here[away > bound]
                if len(inner) and len(outer):
                    stack += [inner, outer]
                    yield from self.across(here[(away <= bound) & (away > bound - r)], here[(away > bound) & (away <= bound + r)])
                    continue
            yield from self.across(here, here)


def shard_links(key: np.ndarray, side: np.ndarray, points: _Shard) -> tuple[np.ndarray, np.ndarray]:
    """Places that link the points of each shard (with sketches, pairs to be compared exactly); rows come sorted by ``key``. Side 0: among themselves; 1 and 2: across."""
    n = len(key)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(begins[1:], n)
    small = np.repeat(ends - begins <= LEAF, ends - begins) & (side == 0)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for gap in range(1, LEAF):
        i = np.flatnonzero(small[gap:] & (key[gap:] == key[:-gap]))
        if not len(i):
            break
        i = i[np.bitwise_count(points.fp[i] ^ points.fp[i + gap]) <= points.radius]
        i = i[points.confirmed(i, i + gap)]
        links.append((i, i + gap))
        points.compared += int(small[gap:].sum())
    for begin, end in zip(begins, ends):
        if not small[begin]:
            places = np.arange(begin, end)
            if side[begin] == 0:
                links += points.within(places)
            else:
                links += points.across(places[side[begin:end] == 1], places[side[begin:end] == 2])
    a, b = (np.concatenate([x[k] for x in links]).astype(np.int64) if links else np.zeros(0, np.int64) for k in (0, 1))
    if points.sketch is not None:
        return points.few(a, b)
    root = _roots(n, a, b)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _distance(fp, vantage, radius: int, whole: bool):
    """Hamming distance within the tree's part of the bits, or of all."""
    differ, width = fp.bitwiseXOR(vantage), 64 // (radius + 1)
    if whole:
        return F.bit_count(differ)
    masks = [((1 << width) - 1) << width * t for t in range(radius + 1)]  # bits that are left over are in no part: pairs agree in one all the same
    own = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    return F.bit_count(differ.bitwiseAND(F.get(own, F.col("tree") % (radius + 1))))


def _large(rows: DataFrame, axes: int) -> DataFrame:
    """The cells of more than ``SHARD_POINTS`` points: their size and ``axes`` vantage points, members of the cell, by a hash that differs from that of the cell above."""
    return settle(rows.groupBy("tree", "cell").agg(
        F.count(F.lit(1)).alias("n"), *[F.min_by("fp", F.xxhash64("fp", F.lit(k), "cell")).alias(f"v{k}") for k in range(axes)]).filter(F.col("n") > SHARD_POINTS))


def _crossed(sides, own):
    """Numbers of the cells below: each of ``sides``, with each of a further division's own sides."""
    return F.flatten(F.transform(sides, lambda s: F.transform(own, lambda x: 2 * s + x)))


def _divided(rows: DataFrame, large: DataFrame, radius: int, whole: bool, mark) -> tuple[DataFrame, DataFrame]:
    """The rows of the large cells in the cells below: each point on its side of each boundary, those just outside on the inner one too. And the cells that whole distances do not divide, whose rows are left out. ``mark``: for tables of a row per large cell, for broadcast if these are few."""
    cell, bound = ["tree", "cell"], radius if whole else 0
    axes = len(large.columns) - 3
    away = [_distance(F.col("fp"), F.col(f"v{k}"), radius, whole) for k in range(axes)]
    asked = F.least(F.lit(axes), F.greatest(F.lit(1), F.ceil(F.log(F.col("n") / SHARD_POINTS) / float(np.log(1.5))))).cast("int")
    each = rows.join(large, cell).select(*cell, F.explode(F.slice(F.array(*[F.struct(F.lit(k).alias("axis"), d.alias("d")) for k, d in enumerate(away)]), F.lit(1), asked)).alias("at")).select(*cell, "at.*")
    counts = settle(each.groupBy(*cell, "axis", "d").agg(F.count(F.lit(1)).alias("n")))  # 65 distances at most
    axis = Window.partitionBy(*cell, "axis")
    upto = counts.withColumn("upto", F.sum("n").over(axis.orderBy("d"))).withColumn("of", F.sum("n").over(axis))
    nearest = F.min_by("d", F.struct(F.abs(2 * F.col("upto") - F.col("of")), "d"))  # a part has few distances: where nothing overlaps, the one that leaves the evener sides
    middle = upto.withColumn("middle", (F.min(F.when(2 * F.col("upto") >= F.col("of"), F.col("d"))) if bound else nearest).over(axis))
    cuts = middle.groupBy(*cell, "axis").agg(
        F.first("middle").alias("middle"), F.first("of").alias("of"), F.sum(F.when(F.col("d") <= F.col("middle") + bound, F.col("n"))).alias("inner"))
    cuts = cuts.withColumn("cut", F.when(F.col("inner") <= KEPT * F.col("of"), F.col("middle")).otherwise(64))  # at 64 bits all are inner: no division
    cuts = cuts.withColumn("cut", F.when(F.col("of") > SHARD_POINTS * F.pow(F.lit(1.5), F.col("axis")), F.col("cut")).otherwise(64))
    known = settle(large.drop("n").join(cuts.groupBy(*cell).agg(*[F.coalesce(F.max(F.when(F.col("axis") == k, F.col("cut"))), F.lit(64)).alias(f"c{k}") for k in range(axes)]), cell))
    uncut = F.least(*[F.col(f"c{k}") for k in range(axes)]) == 64
    stuck = known.filter(uncut if whole else F.lit(False)).select(*cell)
    known = mark(known.filter(~uncut) if whole else known)
    sides = F.array(F.lit(0) if bound else sum((F.when(d > F.col(f"c{k}"), 1 << k).otherwise(0) for k, d in enumerate(away)), F.lit(0)))
    for k, d in enumerate(away if bound else ()):
        own = F.when(d <= F.col(f"c{k}"), F.array(F.lit(0))).when(d <= F.col(f"c{k}") + bound, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
        sides = _crossed(sides, own)
    below = F.transform(sides, lambda s: F.concat_ws(".", "cell", s.cast("string")))
    rest = [c for c in rows.columns if c != "cell"]
    return settle(rows.join(known, cell).select(*rest, F.explode(below).alias("cell"))), stuck


def _in_tree(column: str, tree: int):
    return F.transform(column, lambda x: F.struct(F.lit(tree).alias("tree"), x.alias("fp")))


def shards(points: DataFrame, radius: int = 3) -> DataFrame:
    """``shard``, ``side``, ``fp`` and ``node``: each point in every shard that may hold a partner.

    ``points``: distinct ``node`` (long), fingerprint columns, of which any may bring two points together, each with its
    like, and perhaps ``segments``, an array of more, any of which may meet any.
    """
    prints = [c for c in points.columns if c not in ("node", "segments")]
    parts = points.limit(SHARD_POINTS * ONE_TREE + 1).count() > SHARD_POINTS * ONE_TREE
    trees = range(radius + 1 if parts else 1)
    at = F.array(*[F.struct(F.lit((radius + 1) * k + t).alias("tree"), F.col(c).alias("fp")) for k, c in enumerate(prints) for t in trees])
    if "segments" in points.columns:
        at = F.concat(at, *[_in_tree("segments", (radius + 1) * len(prints) + t) for t in trees])
    rows = points.select("node", F.explode(at).alias("at")).select("node", "at.*", F.lit("").alias("cell"))
    alone = F.lit("").alias("pieces"), F.lit(0).alias("side")
    done, turn, whole = [], 1, not parts
    while not (large := _large(rows, AXES if whole else 2 * AXES)).isEmpty():  # a division leaves KEPT of a cell together at most
        mark = F.broadcast if small(large) else (lambda df: df)
        done.append(rows.join(mark(large.select("tree", "cell")), ["tree", "cell"], "left_anti").select("*", *alone))
        below, stuck = _divided(rows, mark(large), radius, whole, mark)
        balls = large.join(stuck, ["tree", "cell"], "left_semi")
        if not balls.isEmpty():
            done.append(_pieces(rows, balls))
        turn += 1
        rows, whole = below, not parts or turn % 3 == 0
    done.append(rows.select("*", *alone))
    columns = [F.struct("tree", "cell", "pieces").alias("shard"), "side", "fp", "node"]
    out = done[0].select(*columns)
    for d in done[1:]:
        out = out.unionByName(d.select(*columns))
    return out


def _pieces(rows: DataFrame, balls: DataFrame) -> DataFrame:
    """The points of cells that do not divide, in pieces: a shard for each pair of these."""
    sizes = balls.select("tree", "cell", F.ceil(F.col("n") / SHARD_POINTS).cast("int").alias("k"))
    dealt = rows.join(bounded(sizes), ["tree", "cell"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    name = lambda p, q: F.format_string("%06d-%06d", F.least(p, q), F.greatest(p, q))
    to = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda p: F.struct(
        name(p, F.col("piece")).alias("pieces"), F.when(p == F.col("piece"), 0).when(F.col("piece") < p, 1).otherwise(2).alias("side")))
    return dealt.select("node", "tree", "fp", "cell", F.explode(to).alias("to")).select("node", "tree", "fp", "cell", "to.*")


def links(placed: DataFrame, known: DataFrame | None = None, radius: int = 3, most: int = 0) -> DataFrame:
    """``a`` and ``b``, nodes: links that connect exactly the points within ``radius`` bits of each other, directly or by others.

    ``placed``: :func:`shards`. ``known``, if given: ``node`` and ``sketch``, packed bits of which at most ``most`` may
    differ; then every link is a pair that was compared: a forest of them for each shard or, with a column
    ``label``, all pairs of unequal labels.
    """
    ship(placed.sparkSession)
    sketched, labelled = known is not None, known is not None and "label" in known.columns
    if known is not None:
        placed = placed.join(known.select("node", "sketch", *["label"] * labelled), "node")
    dealt = placed.withColumn("key", F.xxhash64("shard")).repartition("key").sortWithinPartitions("key", "shard").select(
        F.concat_ws(":", F.col("shard.tree"), F.col("shard.cell"), F.col("shard.pieces")).alias("shard"), "side", "fp", "node", *["sketch"] * sketched, *["label"] * labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        held: list[pa.RecordBatch] = []

        def solved(rows: pa.Table) -> pa.RecordBatch:
            shard, node, sketch = rows.column("shard").combine_chunks(), rows.column("node").to_numpy(), None
            change = pc.not_equal(shard.slice(1), shard.slice(0, max(len(shard) - 1, 0)))
            key = np.concatenate([[0], np.cumsum(change.to_numpy(zero_copy_only=False))]) if len(shard) else np.zeros(0, int)
            if sketched:
                sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
            a, b = shard_links(key, rows.column("side").to_numpy(), _Shard(rows.column("fp").to_numpy().view(np.uint64), sketch, radius, most, rows.column("label").to_numpy() if labelled else None))
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for batch in batches:  # whole shards at a time: the last one may go on in the next batch
            if not batch.num_rows:
                continue
            names = batch.column(0)
            last = names[len(names) - 1]
            first_of_last = int(np.argmax(pc.equal(names, last).to_numpy(zero_copy_only=False)))
            if first_of_last == 0 and held and held[-1].column(0)[len(held[-1]) - 1] == last:
                held.append(batch)
                continue
            if held or first_of_last:
                yield solved(pa.Table.from_batches([*held, batch.slice(0, first_of_last)]))
            held = [batch.slice(first_of_last)]
        if held:
            yield solved(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").filter("a <> b")


def _rooted(points: DataFrame, roots: DataFrame, least: str) -> DataFrame:
    """``node`` and ``least_of_root``, the least value of ``least`` in its component."""
    known = points.select("node", least).join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "node", least, F.coalesce("root", "node").alias("root"))
    named = known.groupBy("root").agg(F.min(least).alias("least_of_root"))
    return settle(salted_join(known.select("node", "root"), named, "root", "node").select("node", "least_of_root"))


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the least id of the row's component."""
    marked = settle(fingerprints(df, words, id_col, text_col))
    points = settle(marked.groupBy(F.col("fp").alias("node")).agg(F.min(f"`{id_col}`").alias("least_id")))
    roots = components(links(shards(points.select("node", F.col("node").alias("fp")), radius), radius=radius))
    named = _rooted(points, roots, "least_id")
    return marked.join(named, marked.fp == named.node).select(
        f"`{id_col}`", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least_of_root").alias("component_id"))


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th of several independent hashes derived from one (a multiply-xorshift mixer)."""
    x = hashes + np.uint64((n * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_prints(single: np.ndarray, most: int) -> list[int]:
    """SimHashes of the ``most`` segments of least hash; ``single``: hashes of the words.

    Segments begin after words that their own hashes choose, so an edit changes those it lies in and no
    others, and texts that share most segments share some of the least ones, however long they are.
    """
    ends = np.flatnonzero(single % np.uint64(SEGMENT) == 0)
    if len(ends) < 2:
        return []
    name, n = np.add.reduceat(_mixed(single, 99), ends + 1 - (ends + 1 == len(single)))[:-1], np.diff(ends)
    long = np.flatnonzero(n >= SEGMENT_WORDS)
    least = long[np.unique(_mixed(name[long], 98), return_index=True)[1][:most]]
    return [majority(single[ends[k] + 1 : ends[k + 1] + 1]) for k in least.tolist()]


def sketches(df: DataFrame, words: int, prints: int, parts: int, short: int, segments: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``node`` (hash of the text), ``fp0`` ... of all its words and ``segments`` of some of them to search by, and ``sketch`` of 64 * ``parts`` bits of the distinct shingles, and these themselves if ``short`` at most (``few``, null for others and texts without words)."""
    picked = df.select(f"`{id_col}`", f"`{text_col}`", F.xxhash64(f"`{text_col}`").alias("node"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, packed, few, some = [], [], [], []
        for text in batch.column(1).to_pylist():
            single, shingle = shingle_hashes(text, 1), np.unique(shingle_hashes(text, words))
            fps.append([majority(_mixed(single, k)) for k in range(prints)])
            packed.append(np.array([majority(_mixed(shingle, k)) for k in range(parts)], np.int64).tobytes())
            few.append(shingle.tobytes() if 0 < len(shingle) <= short else None)
            some.append(segment_prints(single, segments) if len(shingle) > SHORT else [])
        columns = [pa.array([f[k] for f in fps], pa.int64()) for k in range(prints)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, pa.array(packed, pa.binary()), pa.array(few, pa.binary()), pa.array(some, pa.list_(pa.int64()))],
                                          names=[id_col, "node", *[f"fp{k}" for k in range(prints)], "sketch", "few", "segments"])

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, node long, " + "".join(f"fp{k} long, " for k in range(prints)) + "sketch binary, few binary, segments array<long>"
    return map_batches(picked, run, schema)


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node`` and ``shingles``, the sorted distinct hashes as packed bytes, for rows of ``node`` and ``text``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return map_batches(texts.select("node", "text"), run, "node long, shingles binary")


def similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b``) whose texts' shingle sets have a Jaccard similarity of ``similarity`` or more, exactly.

    ``texts``: ``node`` and ``text``; only those of the pairs are shuffled.
    """
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    named = settle(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    sets = settle(_shingle_sets(texts.join(bounded(named), "node", "left_semi"), words).groupBy("node").agg(F.first("shingles").alias("shingles")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(common >= similarity * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long", text_at=2)


def _prefixes(points: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of ``points`` (``node``, ``few``: packed shingle hashes) ``node``, ``n``, ``h``, ``many`` and ``at``, how many shingles of the set come before: what decides about each distinct set, and ``same`` and ``node`` of points of equal sets.

    Sets of n and m shingles of similarity j share one of the first n - ceil(j n) + 1 in any order
    common to all; rare ones come first here, so that a shingle of many texts seldom counts.
    """
    known = settle(points.filter("few is not null").select("node", "few", F.min("node").over(Window.partitionBy("few")).alias("same")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        n = np.array([len(x) for x in sets], np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["node", "n", "h"])

    held = settle(map_batches(known.filter("node = same").select("node", "few"), run, "node long, n int, h long"))
    many = settle(held.groupBy("h").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9).cast("int") + 1
    ranked = held.join(bounded(many), "h", "left").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("many", F.lit(1)).alias("many"), "h"))).alias("all"))
    prefix = settle(ranked.select("node", "n", F.posexplode(F.slice("all", 1, first)).alias("at", "x")).select("node", "n", "x.h", "x.many", "at").filter("many > 1"))
    return prefix, known.filter("node <> same").select("same", "node")


def short_pairs(prefix: DataFrame, similarity: float, label: DataFrame | None = None) -> DataFrame:
    """``a`` and ``b``: texts that share a shingle of their prefixes and may have the similarity.

    Without labels a star for each shingle; with ``label`` (``node``, ``label``) all pairs of unequal
    labels that may have it, once each: at the first shingle that both prefixes hold. No more than this one and what comes after it
    in the shorter rest is common to such a pair, which refuses most of a group that shares one passage and little else, before a row is made.
    """
    size = F.least("na", "nb") + 1e-9 >= similarity * F.greatest("na", "nb")
    if label is None:
        star = prefix.groupBy("h").agg(F.min(F.struct("node", "n")).alias("to"))
        return salted_join(prefix.select("node", "n", "h"), star, "h", "node").select(F.col("to.node").alias("a"), F.col("to.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")).filter(size & (F.col("a") != F.col("b"))).select("a", "b")
    named = prefix.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = settle(named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("h"))
    held = named.join(bounded(mixed), "h", "left_semi").groupBy("node", "n", "label").agg(F.array_sort(F.collect_list(F.struct("at", "h", "many"))).alias("all"))
    named = held.select("node", "n", "label", F.col("all.h").alias("every"), F.explode("all").alias("x")).select("node", "n", "label", "every", "x.*")
    salt = F.when(F.col("many") > FREQUENT, F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.sequence(F.lit(0), F.when(F.col("many") > FREQUENT, SALTS - 1).otherwise(0))
    side = lambda x: [F.col(c).alias(f"{to}{x}") for c, to in (("n", "n"), ("label", "l"), ("at", "at_"), ("every", "every_"))]
    left = named.select(F.col("node").alias("a"), *side("a"), "h", salt.alias("salt"))
    right = named.select(F.col("node").alias("b"), *side("b"), "h", F.explode(salts).alias("salt"))
    common = F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b")) + 1e-9 >= similarity / (1 + similarity) * (F.col("na") + F.col("nb"))
    once = F.get(F.array_intersect("every_a", "every_b"), F.lit(0)) == F.col("h")
    return left.join(right, ["h", "salt"]).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & size & common & once).select("a", "b")


def _alike(points: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int, most: int) -> DataFrame:
    """``node`` and ``root``: components of all links of the similarity that the searches find.

    First a forest of candidates is compared, a few for each text, which connects what a large group of
    near copies has in common; then every candidate pair of texts that this has left apart.
    """
    prints = [c for c in points.columns if c.startswith("fp")]
    prefix, equal = _prefixes(points, similarity)
    groups = settle(points.groupBy(*prints, "sketch").agg(F.min(F.struct("node", "segments")).alias("first"), F.count(F.lit(1)).alias("n")).select(*prints, "sketch", "first.*", "n"))
    twins = points.select("node", F.xxhash64(*prints, "sketch").alias("key")).join(
        bounded(settle(groups.filter("n > 1").select(F.xxhash64(*prints, "sketch").alias("key"), F.col("node").alias("first")))), "key").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    search, placed = groups.select("node", "sketch"), settle(shards(groups.drop("n", "sketch"), radius))
    stars = short_pairs(prefix, similarity).unionByName(equal.toDF("a", "b")).unionByName(twins)
    linked = settle(similar(links(placed, search, radius, most).unionByName(stars), texts, words, similarity))
    near = contracted(linked, 2)  # whoever is not yet under one label is only compared once more
    label = settle(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    named = search.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = settle(links(placed, named, radius, most).unionByName(short_pairs(prefix, similarity, label)).distinct())
    return components(near if rest.isEmpty() else near.unionByName(similar(rest, texts, words, similarity)))


def distinct_documents(df: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, prints: int = 1, parts: int = 8, slack: float = 2.0, segments: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row of least (id, text hash) stays.

    Texts link if the Jaccard similarity of their shingle sets is ``similarity`` or more. The
    vantage-point search finds the candidates by fingerprints of single words, which edits change
    least, of the whole text and of a few of its segments, which most edits leave alone; sketches of the sets thin them out (sets of similarity j meet at cosine 2j / (1 + j), and SimHash
    bits differ with probability angle / pi; ``slack`` standard deviations are allowed for), and
    what is left is compared exactly. Few words make few bits steady: pairs of which one text has at most ``SHORT``
    distinct shingles are found by the shingles themselves, all of them. Equal
    texts are one point, by a 64-bit hash. Of rows equal in id and text one stays.
    """
    marked = settle(sketches(df, words, prints, parts, int(SHORT / similarity), segments, id_col, text_col).withColumnRenamed(id_col, "id"))
    first = [F.first(c).alias(c) for c in marked.columns if c not in ("id", "node")]
    points = settle(marked.groupBy("node").agg(F.min("id").alias("least"), *first))
    differ = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most = int(64 * parts * differ + slack * np.sqrt(64 * parts * differ * (1 - differ)))
    texts = df.select(F.xxhash64(f"`{text_col}`").alias("node"), F.col(f"`{text_col}`").alias("text"))
    roots = _alike(points, texts, words, similarity, radius, most)
    named = _rooted(points.select("node", F.struct("least", "node").alias("least")), roots, "least")
    keys = marked.select("id", "node").groupBy("id", "node").agg(F.count(F.lit(1)).alias("n"))
    repeated = settle(keys.filter("n > 1").select(F.col("id").alias("_gone_id"), F.col("node").alias("_gone_node")))
    gone = settle(keys.join(named, "node").filter(~(F.col("id").eqNullSafe(F.col("least_of_root.least")) & (F.col("node") == F.col("least_of_root.node")))).select(F.col("id").alias("_gone_id"), F.col("node").alias("_gone_node")))
    held = df.withColumn("_text_hash", F.xxhash64(f"`{text_col}`"))
    here = F.col(f"`{id_col}`").eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_node"))
    kept = held.join(bounded(gone), here, "left_anti")
    if not repeated.isEmpty():
        order = Window.partitionBy(f"`{id_col}`", "_text_hash").orderBy(F.lit(0))
        twice = kept.join(bounded(repeated), here, "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        kept = kept.join(bounded(repeated), here, "left_anti").unionByName(twice)
    return kept.drop("_text_hash")
