"""Sources: JSON documents that hold an array of (nested) objects, JSON lines, Parquet; and flattening of nested columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilframe.sources import json_arrays


def flatten(df: DataFrame) -> DataFrame:
    """Structs become columns named by their dotted path; arrays stay as they are."""

    def leaves(schema: StructType, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))

    return df.select(*leaves(df.schema, ()))


#: Bytes of a JSON document from which on its array is read in ranges.
LARGE_DOCUMENT = 64 << 20


def read(spark: SparkSession, paths: str | Sequence[str], format: str = "json", schema: StructType | str | None = None, with_file: bool = False, large: int = LARGE_DOCUMENT) -> DataFrame:
    """All files as one flat frame; a column that one file lacks is null there.

    ``json``: a whole document per file, one task each, or, if one has over ``large`` bytes, arrays of objects in as many tasks as their
    bytes ask for; ``jsonl``: a row per line, splittable; ``parquet``. ``with_file`` adds ``file``, the scope of per-file duplicates.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if format == "json" and (spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0] or 0) > large:  # sizes alone are read
        found = json_arrays.read(spark, paths, schema)
        return flatten(found if with_file else found.drop("file"))
    reader = spark.read if schema is None else spark.read.schema(schema)
    if format == "json":
        df = reader.json(paths, multiLine=True)
    elif format == "jsonl":
        df = reader.json(paths)
    elif format == "parquet":
        df = spark.read.option("mergeSchema", "true").parquet(*paths)
    else:
        raise ValueError(f"unknown format {format}")
    names = [F.col(f"`{c}`") for c in df.columns]
    return flatten(df.select(*names, F.col("_metadata.file_path").alias("file")) if with_file else df)
