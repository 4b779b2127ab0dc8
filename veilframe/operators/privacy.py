"""Differential privacy: Laplace mechanisms for counts and means, error tables, and post-processing.

Noise is drawn once: materialise a noised frame before more than one action reads it, or each
read publishes another answer; noise by :func:`secret` is the same at each read. The sensitivity of tile means depends on the data, so they are
not differentially private in the strict sense; it is kept because results are to match.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.columns import clip_lower, drawn_uniform, full_uniform, hex_uniform, hmac_sha256, laplace, ratio, round_half_even, seeded_uniform, two_sided_geometric

Uniform = Callable[[str], Column]


def fresh() -> Uniform:
    """Production noise."""
    return lambda _: drawn_uniform()


def keyed(seed: str, key: str) -> Uniform:
    """Test noise that a row's key and the noise's name decide."""
    return lambda name: seeded_uniform(f"{seed}|{name}", F.col(f"`{key}`").cast("string"))


def secret(key: bytes, query: str, *columns: str) -> Uniform:
    """Noise that a secret key, the query's name, the noise's name and a row's columns decide: a second read publishes the same answer, and nobody without the key can tell the noise."""

    def uniform(name: str) -> Column:
        return hex_uniform(hmac_sha256(key, F.concat(F.lit(f"{query}|{name}"), *[part for c in columns for part in (F.lit("|"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))])))

    return uniform


def epsilon_grid(spark: SparkSession, first: float, end: float, step: float) -> DataFrame:
    """``epsilon``: first, first + step, ... below ``end``, to two decimals."""
    n = max(0, -int(-((end - first) / step) // 1))
    return spark.range(n).select(F.round(first + F.col("id") * step, 2).alias("epsilon"))


def with_sensitivity(means: DataFrame, least: float, most: float) -> DataFrame:
    """Tile means with the change that one plate can make: its observations times the range, over all observations."""
    return means.withColumn("sensitivity", ratio(F.col("max_of_sum_of_counts_per_lp") * (most - least), F.col("sum_of_counts")))


def noised(df: DataFrame, scale: Column, uniform: Uniform, value: str = "query_output") -> DataFrame:
    """``noisy_output``: the value plus Laplace noise of ``scale``."""
    return df.withColumn("_u", uniform("noise")).withColumn("noisy_output", F.col(value) + laplace(F.col("_u"), scale)).drop("_u")


def noised_count(df: DataFrame, epsilon: float, uniform: Uniform) -> DataFrame:
    return noised(df, F.lit(1.0 / epsilon), uniform)


def noised_count_geometric(df: DataFrame, epsilon: float, uniform: Uniform, sensitivity: float = 1.0) -> DataFrame:
    """``noisy_output``: a whole count plus two-sided geometric noise; whole numbers have no low bits that could give the count away."""
    bound = df.withColumn("_u", uniform("noise"))
    return bound.withColumn("noisy_output", F.col("query_output").cast("long") + two_sided_geometric(F.col("_u"), math.exp(-epsilon / sensitivity))).drop("_u")


def noised_snapped(df: DataFrame, scale: Column, most: float, key: bytes, query: str, column: str, value: str = "query_output") -> DataFrame:
    """``noisy_output`` by the snapping mechanism: the value within [-most, most], plus Laplace noise from a full-precision uniform, rounded to a multiple of the power of two at or above ``scale`` and brought back into the range.

    The low bits of floating-point noise, which can give a value away, are gone; the price is a slightly greater epsilon, (1 + 12 most 2^-53) times it plus 2^-49 most / scale.
    """
    digest = hmac_sha256(key, F.concat(F.lit(f"{query}|snap|"), F.col(f"`{column}`").cast("string")))
    bound = df.withColumn("_d", digest).withColumn("_b", scale).withColumn("_l", F.pow(F.lit(2.0), F.ceil(F.log2("_b"))))
    sign = F.when(F.substring("_d", 64, 1).isin(*"01234567"), -1.0).otherwise(1.0)
    within = lambda c: F.greatest(F.least(c, F.lit(float(most))), F.lit(-float(most)))
    noisy = within(F.col(value)) + sign * F.col("_b") * F.ln(full_uniform(F.col("_d")))
    return bound.withColumn("noisy_output", within(F.rint(noisy / F.col("_l")) * F.col("_l"))).drop("_d", "_b", "_l")


def noised_bounded_mean(df: DataFrame, epsilon: float, per_tile: int, tiles: int, least: float, most: float, uniform: Uniform) -> DataFrame:
    """Means of bounded contributions (``sum_of_sums``, ``sum_of_counts``) under noise whose scale no data decides.

    A plate is in ``tiles`` tiles at most and gives ``per_tile`` observations at most to each, so each tile gets epsilon / tiles, half of it for the sum.
    """
    part = epsilon / tiles / 2
    bound = df.withColumn("_s", uniform("sum")).withColumn("_c", uniform("count"))
    total = F.col("sum_of_sums") + laplace(F.col("_s"), per_tile * max(abs(least), abs(most)) / part)
    return bound.withColumn("noisy_output", ratio(total, F.col("sum_of_counts") + laplace(F.col("_c"), per_tile / part))).drop("_s", "_c")


def noised_tile_mean(df: DataFrame, epsilon: float, uniform: Uniform) -> DataFrame:
    return noised(df, F.col("sensitivity") / epsilon, uniform)


def noised_category_mean(df: DataFrame, epsilon: float, most: float, uniform: Uniform) -> DataFrame:
    """Half of epsilon for the sum, half for the count; the two true parts are dropped."""
    bound = df.withColumn("_s", uniform("sum")).withColumn("_c", uniform("count"))
    total = F.col("sum") + laplace(F.col("_s"), most / (epsilon / 2))
    count = F.col("count") + laplace(F.col("_c"), 1 / (epsilon / 2))
    return bound.withColumn("noisy_output", ratio(total, count)).drop("_s", "_c", "sum", "count")


def scale_table(df: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """``key``, ``epsilon`` and ``b``: each sensitivity over each epsilon; the grid is a few hundred rows."""
    return df.select(key, "sensitivity").crossJoin(F.broadcast(grid)).select(key, "epsilon", (F.col("sensitivity") / F.col("epsilon")).alias("b"))


def mean_scale(table: DataFrame) -> DataFrame:
    return table.groupBy("epsilon").agg(F.avg("b").alias("b"))


def count_scale(grid: DataFrame) -> DataFrame:
    return grid.select("epsilon", (1 / F.col("epsilon")).alias("b"))


def mean_error_analytic(df: DataFrame, grid: DataFrame, most: float, halved: bool = False) -> DataFrame:
    """Expected absolute error of a noised mean per epsilon, averaged over categories, where counts far exceed their noise.

    With a the sum's noise scale and c the mean times the count's, the error of (sum + A) / (count + C)
    is about |A - mean * C| / count, whose expectation is (a^2 + a c + c^2) / ((a + c) count).
    ``halved``: at the scales that the mechanism uses, not at whole epsilons.
    """
    part = F.col("epsilon") / (2 if halved else 1)
    a, c = most / part, F.abs(F.col("query_output")) / part
    error = ratio(a * a + a * c + c * c, (a + c) * F.col("count"))
    return df.crossJoin(F.broadcast(grid)).groupBy("epsilon").agg(F.avg(error).alias("mae"))


def mean_error_simulated(df: DataFrame, grid: DataFrame, most: float, draws: int = 1_000_000, seed: int | None = None, key: str | None = None) -> DataFrame:
    """The same by ``draws`` draws for each category (column ``key``, or the first) and epsilon.

    A draw's two noises of unit scale come from a digest of seed, category and draw number, so that any partitioning makes the
    same numbers; they serve all epsilons, which only scale them, and errors are summed where they are made.
    """
    digest = F.sha2(F.concat(F.lit(f"{secrets.token_hex(16) if seed is None else seed}|"), F.col(f"`{key or df.columns[0]}`").cast("string"), F.lit("|"), F.col("draw").cast("string")), 256)
    each = df.sparkSession.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(df)).withColumn("_d", digest)  # a row a category
    unit = each.withColumn("_s", hex_uniform(F.col("_d"))).withColumn("_c", hex_uniform(F.col("_d"), 14)).select(
        F.col("sum").cast("double").alias("s"), F.col("count").cast("double").alias("n"), F.col("query_output").alias("q"), (laplace(F.col("_s"), most)).alias("a"), laplace(F.col("_c"), 1.0).alias("c"))
    below = F.nullif(F.col("n") * F.col("epsilon") + F.col("c"), F.lit(0.0))
    error = F.abs((F.col("s") * F.col("epsilon") + F.col("a")) / below - F.col("q"))
    return unit.crossJoin(F.broadcast(grid)).groupBy("epsilon").agg(F.avg(error).alias("mae"))


def normalized_error(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Mean over groups of scale over true value, per epsilon."""
    return table.join(df.select(key, "query_output"), key).groupBy("epsilon").agg(F.avg(ratio(F.col("b"), F.col("query_output"))).alias("normalized_mae"))


def post_process(df: DataFrame, query: str) -> DataFrame:
    """Noisy output from 0 on, means to three decimals and counts to none, half to even."""
    if query not in ("mean", "count"):
        raise ValueError("query is mean or count")
    return df.withColumn("noisy_output", round_half_even(clip_lower(F.col("noisy_output"), 0.0), 3 if query == "mean" else 0))


def published(df: DataFrame, query: str, attribute: str, redact_true: bool = True) -> DataFrame:
    """Columns under their published names, without the true answers unless asked for."""
    named = df.withColumnRenamed("noisy_output", f"noisy {query} of {attribute}")
    return named.drop("query_output") if redact_true else named.withColumnRenamed("query_output", f"{query} of {attribute}")
