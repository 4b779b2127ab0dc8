"""Private answers from a stream: each window once, under a ledger of what has been spent.

Rows are gathered by window, tile and plate in keyed state until the watermark has passed the window's end; then the
window's answer is made in ``foreachBatch``. Its noise comes from a secret key, the release's name and the window, so a
batch that is run again, after a failure or a restart, writes the very same answer over itself. Before an answer is
written its epsilon is entered in the ledger, a folder with an entry per window and release: an entry that is there already is
the same release run again and spends nothing; a release that would take a window over the budget is refused.

Rows later than the watermark count nowhere; a window is released when later rows have come, not before. Times are the wall
clock's, as in the batch pipeline.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.config import Config
from veilframe.operators import aggregates, privacy
from veilframe.pipelines.anonymize import tiles

LEDGER = "window string, release string, epsilon double"


class OverBudget(RuntimeError):
    """A window's epsilon is spent."""


def windowed(stream: DataFrame, config: Config, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``window`` (its beginning, as text), tile, plate and the accumulated values, once the window is over."""
    clock = F.col(f"`{config.time}`").cast("timestamp_ntz").cast("timestamp")
    rows = tiles(stream.withColumn("event_time", clock).withWatermark("event_time", delay), config).dropna(subset=["HAT", "license_plate"])
    v = F.col(f"`{config.privacy.output_attribute}`")
    return rows.groupBy(F.window("event_time", width).alias("w"), "HAT", "license_plate").agg(
        F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias("output_attribute_sum"), F.count(v).alias("output_attribute_count"), F.max(v).alias("output_attribute_max"),
    ).select(F.date_format("w.start", "yyyy-MM-dd'T'HH-mm-ss").alias("window"), "HAT", "license_plate", "output_attribute_sum", "output_attribute_count", "output_attribute_max")


def spent(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").json(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def spend(spark: SparkSession, ledger: str, window: str, release: str, epsilon: float, budget: float) -> None:
    """Enter a release of a window, unless it is there; an error if that takes the window over its budget."""
    entries = {r.release: r.epsilon for r in spent(spark, ledger).filter(F.col("window") == window).collect()}  # a few releases
    if release in entries:
        if entries[release] != epsilon:
            raise OverBudget(f"{release} of {window} was released at another epsilon")
        return
    if sum(entries.values()) + epsilon > budget * (1 + 1e-9):
        raise OverBudget(f"{window}: {sum(entries.values())} of {budget} are spent, {release} asks for {epsilon}")
    spark.createDataFrame([(window, release, epsilon)], LEDGER).coalesce(1).write.mode("error").json(f"{ledger}/{window}/{release}")


def answers(rows: DataFrame, config: Config, key: bytes, release: str, window: str) -> DataFrame:
    """The noisy answers of one window's supported tiles."""
    p, uniform = config.privacy, privacy.secret(key, f"{release}|{window}", "HAT")
    enough = rows.groupBy("HAT").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= config.events_per_day).select("HAT")
    kept = rows.join(enough, "HAT", "left_semi").withColumn("Date", F.lit(window))
    if p.query == "mean":
        noisy = privacy.noised_tile_mean(privacy.with_sensitivity(aggregates.mean_query(kept), p.least, p.most), p.epsilon, uniform)
    else:
        noisy = privacy.noised_count(aggregates.count_query(kept, p.threshold), p.epsilon, uniform)
    return privacy.published(privacy.post_process(noisy, p.query).select("HAT", "query_output", "noisy_output"), p.query, p.output_attribute, p.redact_true)


def start(stream: DataFrame, config: Config, key: bytes, release: str, out: str, ledger: str, checkpoint: str, budget: float, width: str = "1 day", delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Release each window of the stream to ``out``/window=... as JSON lines; ``trigger`` as for ``writeStream.trigger``."""

    def publish(batch: DataFrame, _: int) -> None:
        for window in sorted(r.window for r in batch.select("window").distinct().collect()):  # those that ended since the last batch
            spend(batch.sparkSession, ledger, window, release, config.privacy.epsilon, budget)
            answers(batch.filter(F.col("window") == window), config, key, release, window).write.mode("overwrite").json(f"{out}/window={window}")

    writer = windowed(stream, config, width, delay).writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
