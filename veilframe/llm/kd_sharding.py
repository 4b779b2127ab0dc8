"""Sharding by a k-d tree: nodes split at weighted medians along their widest dimension until leaves reach the target.

A row's weight is its text's UTF-8 bytes plus one. Its coordinates are metadata that the text decides:
size, bytes per character (its script) and lines; so equal texts, which form a group, have equal places.
The widest dimension of a node is that whose spread is the greatest part of the whole table's, the first of equals.
A node for k leaves, so many as its bytes are targets, is split for floor(k/2) and the rest, at the key where the left side has its
share of the node's bytes. A key is a coordinate followed by the CRC-32, which only breaks ties, so cuts pass between
groups; only a group of more than ``LOOSE`` of a leaf's bytes is itself cut, along hashed ids.

Two tiers. Nodes of over ``node_rows`` rows are split together, level by level: their medians are found without sorting, each pass one
aggregation into ``BINS`` bins in all, to one of its bins each time. The driver holds these nodes, whose number goes with the rows, not
with the shards, and the bins; what is broadcast has a row for each node. A node of fewer rows is one task's, which sorts its
narrow rows and splits them down to the leaves. Texts are read once; later passes read narrow checkpointed tables.

Defined cases: a null text has no bytes and weight 1, the CRC-32 of the empty text; null and
repeated ids get slots like others; with fewer groups than leaves some shards stay empty; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.shipping import bounded, settle, ship

BINS, LOOSE = 1 << 15, 0.002
AXES = ("by_size", "by_density", "by_lines")


def node_rows(total: int) -> int:
    """Rows, of some 100 bytes, that one task splits: a 200th of all, for many tasks, but neither trifles nor more than a task holds with ease."""
    return min(max(total // 200, 1 << 14), 1 << 19)


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ``size``, ``crc`` and a 31-bit coordinate for each axis."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.length(text).alias("chars"), (F.length(text) - F.length(F.replace(text, F.lit("\n")))).alias("lines"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    unit = lambda c: F.least(F.greatest((c * (1 << 31)).cast("long"), F.lit(0)), F.lit((1 << 31) - 1))
    return rows.select(
        "id", "size", "crc", unit(F.log2("size") / 32).alias("by_size"), unit(F.col("size") / (F.col("chars") + 1) / 5).alias("by_density"), unit(F.log2(F.col("lines") + 1) / 32).alias("by_lines"))


def _cuts(rows: DataFrame, goals: dict[int, tuple[float, float]]) -> dict[int, tuple[int, int, int, int, int]]:
    """Where running weight reaches each node's goal.

    ``rows``: node, key (0 .. 2^63 - 1), size; ``goals``: node -> (goal, bytes that need no further
    narrowing). Returns node -> (lo, hi, below, at, n): the last bracket, the bytes of smaller keys,
    and the bytes and rows of the bracket's. The driver sees the bins, ``BINS`` in all, not the rows.
    """
    open_ = {r.node: (r.lo, r.hi, 0) for r in rows.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
    done: dict[int, tuple[int, int, int, int, int]] = {}
    while open_:
        steps = {node: (hi - lo) // max(2, BINS // len(open_)) + 1 for node, (lo, hi, _) in open_.items()}
        brackets = rows.sparkSession.createDataFrame([(n, lo, hi, steps[n]) for n, (lo, hi, _) in open_.items()], "node int, lo long, hi long, step long")
        inside = rows.join(F.broadcast(brackets), "node").filter("key between lo and hi")
        bins = inside.groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("at"), F.count(F.lit(1)).alias("n")).collect()
        by_node: dict[int, list] = {}
        for r in sorted(bins, key=lambda r: (r.node, r.bin)):
            by_node.setdefault(r.node, []).append(r)
        for node, found in by_node.items():
            lo, hi, below = open_.pop(node)
            for r in found:
                if below + r["at"] >= goals[node][0] or r is found[-1]:
                    break
                below += r["at"]
            low = lo + r.bin * steps[node]
            high = min(hi, low + steps[node] - 1)
            if high > low and r["at"] > goals[node][1]:
                open_[node] = low, high, below
            else:
                done[node] = low, high, below, r["at"], r.n
    return done


def _spreads(rows: DataFrame) -> dict[str, float]:
    """The whole table's spread along each axis, the unit of the nodes' ones."""
    found = rows.agg(*[F.stddev_pop(a).alias(a) for a in AXES]).first()
    return {a: found[a] or 1.0 for a in AXES}


def _level(rows: DataFrame, nodes: dict[int, int], whole: dict[str, float]) -> DataFrame:
    """For each node of several leaves the axis and cut that halve it: node, half, axis, cut, and up to which hashed id a hot group goes left."""
    spark = rows.sparkSession
    spread = [F.struct(F.round(F.coalesce(F.stddev_pop(a), F.lit(0.0)) / whole[a], 9).alias("s"), F.lit(-i).alias("axis")) for i, a in enumerate(AXES)]
    several = spark.createDataFrame([(n,) for n, k in nodes.items() if k > 1], "node int")
    found = rows.join(F.broadcast(several), "node").groupBy("node").agg(F.sum("size").alias("total"), (-F.array_max(F.array(*spread))["axis"]).alias("axis")).collect()
    axes = {r.node: r.axis for r in found}
    goals = {r.node: (r.total * (nodes[r.node] // 2) / nodes[r.node], LOOSE / 4 * r.total / nodes[r.node]) for r in found}
    chosen = spark.createDataFrame(list(axes.items()), "node int, axis int")
    keyed = settle(rows.join(F.broadcast(chosen), "node").select("node", "id", "size", _key().alias("key")))
    cut, inner = {}, {}
    for node, (lo, hi, below, at, n) in _cuts(keyed, goals).items():
        goal, fine = goals[node]
        if lo == hi and n > 1 and at > 4 * fine:
            cut[node], inner[node] = lo, (goal - below, fine)
        else:
            cut[node] = lo - 1 if goal - below < at / 2 else hi
    id_cut = {}
    if inner:
        hot = spark.createDataFrame([(n, cut[n]) for n in inner], "node int, cut long")
        group = keyed.join(F.broadcast(hot), "node").filter("key = cut").select("node", _id_key().alias("key"), "size")
        id_cut = {n: hi for n, (_, hi, *_) in _cuts(group, inner).items()}
    return spark.createDataFrame([(n, nodes[n] // 2, axes[n], c, id_cut.get(n)) for n, c in cut.items()], "node int, half int, axis int, cut long, id_cut long")


def _key() -> Column:
    axis = F.when(F.col("axis") == 0, F.col(AXES[0]))
    for i, a in enumerate(AXES[1:], 1):
        axis = axis.when(F.col("axis") == i, F.col(a))
    return F.shiftleft(axis, 32).bitwiseOR(F.col("crc"))


def _id_key() -> Column:
    return F.shiftrightunsigned(F.xxhash64("id"), 1)


def _split(axes: list[np.ndarray], sizes: np.ndarray, crc: np.ndarray, hashed: np.ndarray, whole: list[float], first: int, k: int) -> tuple[np.ndarray, list[str]]:
    """Leaf and axes of each of a node's rows: the same rule, by sorting."""
    leaf, names = np.empty(len(sizes), np.int32), [""] * len(sizes)
    stack = [(np.arange(len(sizes)), first, k, "")]
    while stack:
        rows, first, k, said = stack.pop()
        if k == 1 or not len(rows):
            leaf[rows] = first
            for i in rows.tolist():
                names[i] = said
            continue
        axis = int(np.argmax([round(float(np.std(a[rows])) / w, 9) for a, w in zip(axes, whole)]))
        key, weight = axes[axis][rows] << 32 | crc[rows], sizes[rows]
        order = np.argsort(key, kind="stable")
        key, goal = key[order], weight.sum() * (k // 2) / k
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at = np.add.reduceat(weight[order], begins)
        below = np.cumsum(at) - at
        group = min(int(np.searchsorted(below + at, goal)), len(at) - 1)  # the group in which the goal lies
        end = begins[group + 1] if group + 1 < len(begins) else len(rows)
        rest, fine = goal - below[group], LOOSE / 4 * weight.sum() / k
        if end - begins[group] > 1 and at[group] > 4 * fine:
            inside = order[begins[group] : end]
            inside = inside[np.argsort(hashed[rows[inside]], kind="stable")]
            upto = np.cumsum(weight[inside])
            n = int(np.searchsorted(upto, rest))
            n += n < len(upto) and rest - (upto[n] - weight[inside[n]]) >= weight[inside[n]] / 2
            order, cut = np.concatenate([order[: begins[group]], inside, order[end:]]), begins[group] + n
        else:
            cut = begins[group] if rest < at[group] / 2 else end
        said = f"{said}>{AXES[axis]}" if said else AXES[axis]
        stack += [(rows[order[:cut]], first, k // 2, said), (rows[order[cut:]], first + k // 2, k - k // 2, said)]
    return leaf, names


def _subtrees(rows: DataFrame, nodes: dict[int, int], whole: dict[str, float]) -> DataFrame:
    """``rows`` of nodes that a task can hold, split down to their leaves."""
    spark = rows.sparkSession
    ship(spark)
    known = spark.createDataFrame(list(nodes.items()), "node int, leaves int")
    unit, columns = [whole[a] for a in AXES], rows.columns

    def split(table: pa.Table) -> pa.Table:
        of = lambda name: table.column(name).to_numpy()
        leaf, names = _split([of(a) for a in AXES], of("size"), of("crc"), of("hashed"), unit, int(of("node")[0]), int(of("leaves")[0]))
        above = table.column("axes").to_pylist()
        done = table.set_column(table.column_names.index("node"), "node", pa.array(leaf, pa.int32()))
        return done.set_column(table.column_names.index("axes"), "axes", pa.array([">".join(filter(None, x)) for x in zip(above, names)], pa.string())).select(columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.join(F.broadcast(known), "node").withColumn("hashed", _id_key()).groupBy("node").applyInArrow(split, kinds)


def leaves(rows: DataFrame, n_leaves: int) -> DataFrame:
    """``rows`` of :func:`measured` with ``shard``, 0 .. ``n_leaves`` - 1, and ``axes``, those of the cuts down to it."""
    nodes = {0: n_leaves}  # a node is the number of its first leaf
    rows, whole, done, most = rows.withColumns({"node": F.lit(0), "axes": F.lit("")}), _spreads(rows), [], None
    while nodes:
        counted = {r.node: r.n for r in rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
        most = node_rows(sum(counted.values())) if most is None else most
        nodes = {n: k for n, k in nodes.items() if n in counted}
        small = {n: k for n, k in nodes.items() if k == 1 or counted[n] <= most}
        if one := [n for n, k in small.items() if k == 1]:
            done.append(rows.join(F.broadcast(rows.sparkSession.createDataFrame([(n,) for n in one], "node int")), "node").select(*rows.columns))
        if some := {n: k for n, k in small.items() if k > 1}:
            done.append(_subtrees(rows, some, whole).select(*rows.columns))
        nodes = {n: k for n, k in nodes.items() if n not in small}
        if not nodes:
            break
        cuts = _level(rows, nodes, whole)
        key = _key()
        goes = (key > F.col("cut")) | (F.col("id_cut").isNotNull() & (key == F.col("cut")) & (_id_key() > F.col("id_cut")))
        names = [c for c in rows.columns if c not in ("node", "axes")]
        of_axis = F.element_at(F.array(*[F.lit(a) for a in AXES]), F.col("axis") + 1)
        down = F.concat_ws(">", F.when(F.col("axes") != "", F.col("axes")), of_axis).alias("axes")
        rows = settle(rows.join(F.broadcast(cuts), "node").select(*names, down, F.when(goes, F.col("node") + F.col("half")).otherwise(F.col("node")).alias("node")))
        nodes = {m: j for n, k in nodes.items() for m, j in ((n, k // 2), (n + k // 2, k - k // 2))}
    found = rows.limit(0) if not done else reduce(DataFrame.unionByName, done)
    return found.withColumnRenamed("node", "shard")


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers within each shard: ranks within the partitions of the checkpointed rows, which no key makes large, plus these partitions' running counts."""
    dealt = settle(rows).select("*", F.spark_partition_id().alias("bucket"), F.monotonically_increasing_id().alias("place"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place"))
    return dealt.withColumn("rank", rank).join(bounded(offsets), ["shard", "bucket"]).withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long")).drop("offset", "rank", "bucket", "place")


def shards_for(df: DataFrame, target_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`shard`, with as many leaves as bring each to ``target_bytes`` or less, on average."""
    rows = settle(measured(df, id_col, text_col))
    total = rows.agg(F.sum("size")).first()[0] or 0
    return _slots(leaves(rows, max(1, -(-total // target_bytes)))).select(F.col("id").alias(id_col), "size", "crc", "shard", "slot", "axes")


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``crc``, ``shard`` (int), ``slot`` (long) and ``axes`` for each row of ``df``."""
    return _slots(leaves(settle(measured(df, id_col, text_col)), n_shards)).select(F.col("id").alias(id_col), "size", "crc", "shard", "slot", "axes")
