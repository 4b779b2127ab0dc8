"""Connected components of an edge table by alternating star contraction.

Large star: every node hands its greater neighbours to the least node it knows. Small star:
every node hands itself and its smaller neighbours to the least of them. Both keep the
components, and the edges end as stars around each component's least node. A round costs two
aggregations with map-side combining and two joins, by broadcast if the nodes are counted few and else
with a hub's rows dealt out; rounds grow with the logarithm of the longest chain. Each round's edges go to the
checkpoint folder, so a lost executor costs one round at most.

Nulls in either column, loops and repeated edges are dropped; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from veilframe.llm.shipping import BROADCAST_ROWS, settle


def _directed(edges: DataFrame) -> DataFrame:
    """Once each, from the greater to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()


#: Pieces in which the rows of a node, perhaps a hub with a third of all edges, meet their node's least.
SALTS = 16


def salted_join(rows: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """An inner join on ``key``, unique in ``small``, that deals a key's rows out by ``by``."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def _with_least(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Rows with their node's least; of ``few`` nodes, counted, a row of two numbers each is broadcast and nothing is dealt out."""
    return rows.join(F.broadcast(least), "a") if few else salted_join(rows, least, "a", "b")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return _directed(_with_least(both.filter("b > a"), least, few).select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = _with_least(edges, least, few).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _directed(moved.unionByName(least.select("a", F.col("least").alias("b"))))


def _surveyed(edges: DataFrame) -> tuple[bool, bool]:
    """Whether the edges are stars, every node either below one other or a centre, and whether their nodes are few numbers."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("centre")))
    each = ends.groupBy("node").agg((F.sum("below") + F.max("centre")).alias("roles"))
    found = each.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("roles") > 1).alias("between")).first()
    return found["between"] == 0, found["nodes"] <= BROADCAST_ROWS and all(isinstance(f.dataType, NumericType) for f in edges.schema)


def contracted(edges: DataFrame, rounds: int) -> DataFrame:
    """``a`` and ``b`` after some rounds, fewer if they are stars before: the same components, their edges nearer to stars; nodes of one ``b`` are in one component."""
    now = settle(_directed(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"))))
    for _ in range(rounds):
        stars, few = _surveyed(now)
        if stars:
            break
        now = settle(_small_star(_large_star(now, few), few))
    return now


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node but the roots."""
    now = settle(_directed(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"))))
    for n in range(max_rounds + 1):
        stars, few = _surveyed(now)
        if stars:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if n < max_rounds:
            now = settle(_small_star(_large_star(now, few), few))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
