"""Conversation prefix trie: which beginnings conversations share, and what is saved by keeping each once.

A node of depth d is a sequence of d turns (role, text) with which some conversation begins; the root has none.
Nodes are named by digests: a turn by its own, a beginning of n turns by combining, for 1, 2, 4 ... turns, the digest
of the last so many turns with that of as many before. Every node knows its parent's digest, so the trie is a table of edges.

What a node's subtree holds is added up by pointer jumping: in round k each node hands its sum to the ancestor 2^k above it and
then points to the ancestor's ancestor, so a depth of n takes log2(n) rounds, not n. A round is an
aggregation with map-side combining, a join of unique keys and a join in which frequent keys (a node below
which a third of all conversations lies) are looked up by broadcast; it goes to the checkpoint folder.

``ends_sha256`` is a digest of ids in order. The ids are sorted by ranges, so a node where very many
conversations end is divided among tasks, each of which writes its ids as few pieces of text; one stream reads a node's pieces.

Defined cases: turns are ordered by turn (null first), then role, then text, so ties and repeated rows have an order; null roles and
texts are empty; rows without an id belong to no conversation and are left out; a conversation without turns ends at
the root; an empty table has no nodes, not even a root; long texts are read once, for their digests; other columns are ignored. A conversation's
turns are one task's sorted stream, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.shipping import settle, ship

#: Characters of ids in a piece of text.
PIECE_CHARS = 1 << 16


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def placed(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id``, ``place`` from 1 on, ``role`` and ``text`` of every row with an id."""
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).filter("id is not null")
    return rows.select("id", F.row_number().over(Window.partitionBy("id").orderBy("turn", "role", "text")).alias("place"), "role", "text")


def sharing(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: c begins with the first h turns of conversation c - c % 100, h = crc32(c) % 6, and goes on with its own after its first h; and all ids."""
    rows = settle(placed(conversations).withColumn("h", F.crc32(F.col("id").cast("string")) % 6))
    ids = rows.select("id", "h").distinct()
    first = rows.filter("id % 100 = 0 and place <= 5").select(F.col("id").alias("base"), "place", "role", "text")
    borrowed = ids.withColumn("base", F.expr("id - id % 100")).join(first, "base").filter("place <= h")
    own = rows.filter("place > h").select("id", "place", "role", "text")
    return own.unionByName(borrowed.select("id", "place", "role", "text")).select(F.col("id").alias("conv_id"), F.col("place").alias("turn"), "role", "text"), ids.select(F.col("id").alias("conv_id"))


def members(df: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, int]:
    """Per conversation and depth: ``id``, ``depth``, ``node``, ``parent`` (null for the root), ``chars`` of the last text and whether the conversation ``ends`` there; and the greatest depth.

    ``ids``: conversations that may have no turns.
    """
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    turns = settle(placed(df, id_col, turn_col, role_col, text_col).select("id", "place", F.length("text").cast("long").alias("chars"), _digest(F.encode(said, "UTF-8")).alias("node")))
    depth = turns.agg(F.max("place")).first()[0] or 0
    in_order = Window.partitionBy("id").orderBy("place")
    keyed, reach = turns, 1
    while reach < depth:
        before = F.lag("node", reach).over(in_order)
        keyed = keyed.withColumn("before", before).withColumn("node", F.when(F.col("before").isNull(), F.col("node")).otherwise(_digest("before", "node")))
        reach *= 2
    root = F.lit(b"")
    deep = keyed.select(
        "id", F.col("place").cast("long").alias("depth"), "node", F.coalesce(F.lag("node").over(in_order), root).alias("parent"), "chars", F.lead("place").over(in_order).isNull().alias("ends"))
    every = turns.select("id", F.lit(False).alias("ends"))
    if ids is not None:
        every = every.unionByName(ids.select(F.col(f"`{id_col}`").alias("id"), F.lit(True).alias("ends")).filter("id is not null"))
    tops = every.groupBy("id").agg(F.min("ends").alias("ends")).select(
        "id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "ends")
    return settle(deep.unionByName(tops)), depth


def looked_up(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """An inner join of ``rows``, ``total`` at most, with ``values``, which has a row per key. Keys of many rows, 10,000 keys at most, are broadcast with their values; the others' rows are shuffled."""
    frequent = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(256, total // 10_000)).select(key)
    few = rows.join(F.broadcast(values.join(F.broadcast(frequent), key)), key)
    return few.unionByName(rows.join(F.broadcast(frequent), key, "left_anti").join(values, key))


def rolled_up(nodes: DataFrame, depth: int, total: int, *values: str) -> DataFrame:
    """``node`` and, of each value, the sum over its subtree, itself included; ``nodes``, ``total`` of them, have node, parent and the values."""
    now, reach = nodes.select("node", F.col("parent").alias("jump"), *values), 1
    while reach <= depth:
        below = now.filter("jump is not null").groupBy(F.col("jump").alias("node")).agg(*[F.sum(v).alias(f"{v} below") for v in values])
        far = looked_up(now.filter("jump is not null").select("node", "jump"), now.select(F.col("node").alias("jump"), F.col("jump").alias("next")), "jump", total).select("node", "next")
        now = settle(now.drop("jump").join(below, "node", "left").join(far, "node", "left").select(
            "node", F.col("next").alias("jump"), *[(F.col(v) + F.coalesce(f"{v} below", F.lit(0).cast("long"))).alias(v) for v in values]))
        reach *= 2
    return now.drop("jump")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (node, id, its text): pieces (node, first id, ids joined by commas)."""
    node, first, held, size = None, None, [], 0
    for batch in batches:
        nodes, firsts, texts = [], [], []
        for n, i, t in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (n != node or size > PIECE_CHARS):
                nodes.append(node), firsts.append(first), texts.append(",".join(held))
                held, size = [], 0
            if not held:
                node, first = n, i
            held.append(t)
            size += len(t) + 1
        kind = batch.column(1).type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(firsts, kind), pa.array(texts, pa.string())], names=["node", "first", "ids"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], kind), pa.array([",".join(held)], pa.string())], names=["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted pieces: each node's digest."""
    node, running = None, None
    for batch in batches:
        nodes, digests = [], []
        for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if running is not None and n == node:
                running.update(b"," + text.encode())
                continue
            if running is not None:
                nodes.append(node), digests.append(running.hexdigest())
            node, running = n, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the conversations (``node``, ``id``) that end there; few nodes have none and are left out."""
    ship(ends.sparkSession)
    kind = ends.schema["id"].dataType.simpleString()
    sorted_ids = ends.repartitionByRange("node", "id").sortWithinPartitions("node", "id").select("node", "id", F.col("id").cast("string").alias("text"))
    pieces = sorted_ids.mapInArrow(_pieces, f"node binary, first {kind}, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(df: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node: ``node`` and ``parent`` (digests, as in :func:`members`), the least id that begins with it, ``depth``, the parent's least id, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    found, depth = members(df, ids, id_col, turn_col, role_col, text_col)
    each = settle(found.groupBy("node", "parent", "depth", "chars").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_convs")))
    children = each.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(each.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    total = nodes.count()
    sums = rolled_up(own, depth, total, "n_leaves", "saved_tokens")
    above = looked_up(nodes.filter("parent is not null").select("node", "parent"), nodes.select(F.col("node").alias("parent"), F.col("id").alias("parent id")), "parent", total).select("node", "parent id")
    ends = ends_digests(found.filter("ends").select("node", "id"))
    return nodes.join(sums, "node").join(above, "node", "left").join(ends, "node", "left").select(
        "node", "parent", F.col("id").alias(id_col), "depth", F.col("parent id").alias(f"parent_{id_col}"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
