"""The spatio-temporal accumulator over a stream: mergeable state by tile, date and plate; noise is added once, to what has come in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilframe.config import Config
from veilframe.operators import aggregates
from veilframe.pipelines.anonymize import tiles


def accumulated(stream: DataFrame, config: Config) -> DataFrame:
    """Stateful sums of a stream of raw rows; write it in update or complete mode. Never noise it per trigger."""
    return aggregates.accumulate(tiles(stream, config), config.privacy.output_attribute)
