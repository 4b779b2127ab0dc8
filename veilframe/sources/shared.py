"""The folder that a cluster's executors share, and tables that cut the lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_folder(spark: SparkSession) -> None:
    """Leave the checkpoint folder that the cluster names; set a temporary one only where none is named and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilframe-"))


def settled(df: DataFrame) -> DataFrame:
    """The frame as it is now, in files: read as often as needed, computed once, and lost with no executor."""
    use_folder(df.sparkSession)
    return df.checkpoint(eager=True)
