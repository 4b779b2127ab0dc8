"""Grouped accumulators and queries: mergeable, partially aggregated before each exchange, null keys dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from veilframe.functions.columns import clip_lower, clip_upper, ratio
from veilframe.sources.shared import settled

GRAIN = ("HAT", "Date", "license_plate")


def accumulate(df: DataFrame, value: str, keys: Sequence[str] = GRAIN) -> DataFrame:
    """Sum, count and maximum of ``value`` per group; the sum of nulls alone is 0, their maximum null."""
    v = F.col(f"`{value}`")
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias("output_attribute_sum"), F.count(v).alias("output_attribute_count"), F.max(v).alias("output_attribute_max"))


def observed(df: DataFrame, seen: dict[str, Observation] | None, name: str, distinct: Sequence[str] = ()) -> DataFrame:
    """The frame, whose rows and about how many distinct values are counted under ``name`` by the first action that reads it: none of their own."""
    if seen is None:
        return df
    seen[name] = Observation(name)
    return df.observe(seen[name], F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(f"`{c}`").alias(f"distinct {c}") for c in distinct])


def supported(grain: DataFrame, per_day: float, tile: str = "HAT", date: str = "Date") -> DataFrame:
    """Rows of tiles whose plates, counted per day and summed, reach ``per_day`` times the number of days in the frame.

    The grain, which is aggregated, goes to the checkpoint folder when this is called: raw rows are read once, a
    later call sees files that came since, and nothing stays in executors' memory.
    """
    grain = settled(grain)
    daily = grain.groupBy(tile, date).agg(F.count(F.lit(1)).alias("n"))
    days = daily.agg((F.count_distinct(date) * per_day).alias("least"))
    kept = daily.groupBy(tile).agg(F.sum("n").alias("n")).join(F.broadcast(days), F.col("n") >= F.col("least")).select(tile)  # one row of days
    return grain.join(kept, tile, "left_semi")


def bounded(df: DataFrame, row: str, per_tile: int, tiles: int, salt: str, tile: str = "HAT", plate: str = "license_plate") -> DataFrame:
    """At most ``per_tile`` rows a plate and tile and ``tiles`` tiles a plate: those of least salted digest, of the tile's name and of the column ``row``.

    The least few are kept in each task before the exchange and again after it, so a plate with half of all rows is no
    large task, and any split of the rows keeps the same ones. Rows without plate or tile are left out.
    """
    rows = df.dropna(subset=[tile, plate])
    digest = lambda *columns: F.sha2(F.concat_ws("|", F.lit(salt), *[F.col(f"`{c}`").cast("string") for c in columns]), 256)
    least = lambda of, keys, n: of.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("digest"))).filter(F.col("at") <= n).drop("at", "digest")
    chosen = least(rows.select(plate, tile).distinct().withColumn("digest", digest(plate, tile)), [plate], tiles)
    return least(rows.join(chosen, [plate, tile], "left_semi").withColumn("digest", digest(row)), [plate, tile], per_tile)


def mean_query(grain: DataFrame, tile: str = "HAT", plate: str = "license_plate") -> DataFrame:
    """Mean per tile, with what its sensitivity needs: the most observations of a plate in the tile."""
    by_plate = grain.groupBy(tile, plate).agg(F.sum("output_attribute_sum").alias("s"), F.sum("output_attribute_count").alias("c"))
    return by_plate.groupBy(tile).agg(
        F.sum("c").alias("sum_of_counts"), F.sum("s").alias("sum_of_sums"), F.max("c").alias("max_of_sum_of_counts_per_lp"),
    ).withColumn("query_output", ratio(F.col("sum_of_sums"), F.col("sum_of_counts")))


def count_query(grain: DataFrame, threshold: float, tile: str = "HAT", date: str = "Date") -> DataFrame:
    """Mean over a tile's days of the plates whose maximum exceeds ``threshold``."""
    daily = grain.groupBy(tile, date).agg(F.count_if(F.col("output_attribute_max") > threshold).alias("n"))
    return daily.groupBy(tile).agg(F.avg("n").alias("query_output"))


def time_range(grain: DataFrame, date: str = "Date") -> DataFrame:
    return grain.agg((F.datediff(F.max(date), F.min(date)) + 1).cast("long").alias("time_range"))


def category_mean(df: DataFrame, group: str, value: str, most: float, least: float | None = None) -> DataFrame:
    """Per group sum, count and mean of the values other than 0, those over ``most`` as ``most`` and, if given, under ``least`` as ``least``; nulls count nowhere but keep their group."""
    v = clip_upper(F.col(f"`{value}`"), most)
    v = v if least is None else clip_lower(v, least)
    rows = df.filter(~F.col(f"`{value}`").eqNullSafe(F.lit(0))).dropna(subset=[group])
    sums = rows.groupBy(group).agg(F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias("sum"), F.count(v).alias("count"))
    return sums.withColumn("query_output", ratio(F.col("sum"), F.col("count")))


def category_count(df: DataFrame, group: str, value: str, selected: str) -> DataFrame:
    """Per group the rows whose ``value`` is the selected one."""
    return df.filter(F.col(f"`{value}`") == selected).dropna(subset=[group]).groupBy(group).agg(F.count(F.lit(1)).alias("query_output"))


def histogram(df: DataFrame, value: str, least: int, most: int) -> DataFrame:
    """``value`` and ``Count`` for each whole number from ``least`` to ``most - 2``, zeros included; other values are left out."""
    domain = df.sparkSession.range(least, most - 1).select(F.col("id").alias(value))
    counts = df.filter(F.col(f"`{value}`").between(least, most - 2)).groupBy(F.col(f"`{value}`").cast("long").alias(value)).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("Count"))
