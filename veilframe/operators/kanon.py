"""k-anonymity of a whole-number attribute: the least bin width at which no bin is smaller than k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.columns import bin_label


def running_sums(rows: DataFrame) -> DataFrame:
    """``a`` and ``upto``, the sum of ``n`` over all up to ``a``: within each ``block``, plus the sums of the blocks before; about as many blocks as a block has rows."""
    within = F.sum("n").over(Window.partitionBy("block").orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy("block").agg(F.sum("n").alias("n"))
    before = sums.select("block").join(F.broadcast(sums.toDF("earlier", "n")), F.col("earlier") < F.col("block")).groupBy("block").agg(F.sum("n").alias("before"))  # the root of the domain's size
    return rows.withColumn("within", within).join(F.broadcast(before), "block", "left").select("a", (F.col("within") + F.coalesce("before", F.lit(0))).alias("upto"))


def width_table(hist: DataFrame, k: int, value: str, least: int = 0) -> DataFrame:
    """``width``, one row: of a histogram whose domain begins at ``least``.

    Positions 1 .. mx fall into mx div r bins of r, the last with what is left over; position 0 is in
    none. The first r without a bin of fewer than k, empty ones aside, wins; if it makes a single bin,
    or k is the total, the width is mx. If none does it is mx + 1. A k beyond the total, or below 1,
    gives -1.
    """
    at = hist.select((F.col(f"`{value}`") - least).cast("long").alias("a"), F.col("Count").alias("n"))
    whole = at.agg(F.max("a").alias("mx"), F.sum("n").alias("total"))
    tries = whole.select("mx", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mx") + 1)).alias("r"))
    # running sums over the domain, a row per value: a bin of any width is the difference of two, mx ln mx bins in all
    domain = whole.select(F.explode(F.sequence(F.lit(0).cast("long"), "mx")).alias("a"), F.ceil(F.sqrt(F.col("mx") + 1)).alias("long")).join(at.filter("a >= 1").groupBy("a").agg(F.sum("n").alias("n")), "a", "left")
    upto = running_sums(domain.select("a", F.floor(F.col("a") / F.col("long")).alias("block"), F.coalesce("n", F.lit(0)).alias("n")))
    edges = tries.filter("r <= mx").select("mx", "r", F.explode(F.expr("sequence(0L, mx div r - 1)")).alias("bin")).select(
        "r", (F.col("bin") * F.col("r")).alias("low"), F.when(F.col("bin") == F.expr("mx div r - 1"), F.col("mx")).otherwise((F.col("bin") + 1) * F.col("r")).alias("high"))
    bins = edges.join(upto.toDF("low", "before"), "low").join(upto.toDF("high", "upto"), "high").select("r", (F.col("upto") - F.col("before")).alias("c"))
    bad = bins.filter((F.col("c") > 0) & (F.col("c") < k)).select("r").distinct()
    first = tries.join(bad, "r", "left_anti").agg(F.min("r").alias("w"))
    return whole.join(first).select(
        F.when((F.lit(k) > F.col("total")) | (F.lit(k) <= 0), F.lit(-1))
        .when((F.lit(k) == F.col("total")) | (F.expr("mx div w") == 1), F.col("mx")).otherwise(F.col("w")).cast("long").alias("width"))


def width(hist: DataFrame, k: int, value: str, least: int = 0) -> int:
    """The one number of :func:`width_table`, from a histogram of a row per value of the domain."""
    found = width_table(hist, k, value, least).first()["width"]
    if found is None or found < 1:
        raise ValueError(f"no width makes groups of {k}")
    return found


def assign(df: DataFrame, value: str, bins: int, least: int, most: int, strict: bool = False, keep: bool = False) -> DataFrame:
    """``<value> Bin`` in place of the value. ``strict`` folds the remainder into the last bin, as the search does, so that k holds."""
    out = df.withColumn(f"{value} Bin", bin_label(F.col(f"`{value}`"), bins, least, most - 2 if strict else most, fold=strict))
    return out if keep else out.drop(value)
