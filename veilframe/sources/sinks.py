"""Sinks: JSON lines, or single documents, arrays or keyed objects, written by the tasks in parts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from veilframe.config import Config
from veilframe.sources.shared import settled


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """Floating-point columns to ten decimals, as the published files have them."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if isinstance(kinds[c], (DoubleType, FloatType)) else F.col(f"`{c}`") for c in df.columns])


def write_lines(df: DataFrame, path: str) -> None:
    rounded(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _quoted(c: str) -> Column:
    """A value as a JSON string, for keys."""
    inner = F.to_json(F.array(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _object(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows in their order, with their number in ``name``: of settled partitions each is counted, and begins where those before it end."""
    rows = settled(df).withColumn("place in all", F.monotonically_increasing_id())
    part, within = F.shiftright("place in all", 33), F.col("place in all").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    starts, at = [], 0
    for r in sorted(counts, key=lambda r: r.part):
        starts.append((r.part, at))
        at += r.n
    begins = df.sparkSession.createDataFrame(starts, "`part of all` long, `begin of part` long")
    return rows.join(F.broadcast(begins), part == F.col("part of all")).withColumn(name, F.col("begin of part") + within).drop("place in all", "part of all", "begin of part")


def write_document(lines: DataFrame, path: str, begin: str, end: str) -> None:
    """One JSON document of the texts in ``value``, one a line, in their order (or that of ``number of line``, if they have it), at any size.

    Part files are written by the tasks and joined by the file system: appended by reference where it can do that,
    else copied from stream to stream. No row comes to the driver.
    """
    spark, parts = lines.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    comma = F.when(F.col("number of line") > 0, F.lit(",")).otherwise(F.lit(""))
    rows = lines if "number of line" in lines.columns else numbered(lines.select("value"), "number of line")
    rows.select(F.concat(comma, "value").alias("value")).write.text(parts)
    hadoop = spark._jvm.org.apache.hadoop
    fs, where = hadoop.fs.Path(parts).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.fs.Path(path)
    found = sorted((f.getPath() for f in fs.listStatus(hadoop.fs.Path(parts)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())

    def text(at, said: str) -> None:
        out = fs.create(at, True)
        out.write(bytearray(said.encode()))
        out.close()

    fs.setWriteChecksum(False)  # a local file system would write a hidden file of sums beside the document
    try:
        ends = hadoop.fs.Path(f"{parts}/end")
        text(where, begin)
        text(ends, end)
        array = spark._sc._gateway.new_array(hadoop.fs.Path, len(found) + 1)
        for i, p in enumerate([*found, ends]):
            array[i] = p
        fs.concat(where, array)
    except UnsupportedOperationException:
        out = fs.create(where, True)
        out.write(bytearray(begin.encode()))
        for p in found:
            part = fs.open(p)
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.write(bytearray(end.encode()))
        out.close()
    finally:
        fs.setWriteChecksum(True)
    fs.delete(hadoop.fs.Path(parts), True)


def write_records(df: DataFrame, path: str) -> None:
    """One array of objects."""
    write_document(rounded(df).select(_object(df.columns).alias("value")), path, "[", "]")


def write_by_row(df: DataFrame, path: str) -> None:
    """One object keyed by row number."""
    rows = numbered(rounded(df).select(_object(df.columns).alias("object")), "number of line")
    write_document(rows.select(F.concat(F.lit('"'), F.col("number of line").cast("string"), F.lit('": '), "object").alias("value"), "number of line"), path, "{", "}")


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """``{key: {column: value}}``, in the order of the key, null last; of a single other column ``{key: value}``."""
    rest = [c for c in df.columns if c != key]
    value = _object(rest)
    if len(rest) == 1:
        inner = F.to_json(F.array(F.col(f"`{rest[0]}`")), {"ignoreNullFields": "false"})
        value = F.substring(inner, F.lit(2), F.length(inner) - 2)
    ordered = rounded(df).orderBy(F.col(f"`{key}`").asc_nulls_last())
    write_document(ordered.select(F.concat(_quoted(key), F.lit(": "), value).alias("value")), path, "{", "}")


def write_table(df: DataFrame, key: str, path: str, column: str = "epsilon", value: str = "b") -> None:
    """A long error table as ``{key: {epsilon: b}}``; a key has a row per epsilon."""
    rows = rounded(df.select(key, column, value)).groupBy(F.col(f"`{key}`").cast("string").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col(f"`{column}`").alias("e"), F.col(f"`{value}`").alias("b")))).alias("t"))
    entries = F.map_from_entries(F.transform("t", lambda x: F.struct(x["e"].cast("string"), x["b"])))
    write_document(rows.orderBy("k").select(F.concat(_quoted("k"), F.lit(": "), F.to_json(entries)).alias("value")), path, "{", "}")


def publish(frames: dict[str, DataFrame], config: Config, folder: str) -> None:
    """The frames of a pipeline as single documents under their published names, each read once."""
    kind, query = config.data_type, config.privacy.query if config.privacy else ""
    group = "HAT" if kind == "spatioTemporal" else config.privacy.aggregate[0] if config.privacy else ""
    common = "_".join({"suppress": "suppression", "pseudonymize": "pseudonymization"}[o] for o in ("suppress", "pseudonymize") if o in config.operations)
    writers = {
        "anonymized": lambda df: write_records(df, f"{folder}/{common}.json"),
        "k_anonymous": lambda df: write_by_row(df, f"{folder}/medical_k_anon_full_dataset.json"),
        "k_counts": lambda df: write_by_row(df, f"{folder}/medical_k_anon_user_counts.json"),
        "errors_by_tile": lambda df: write_table(df, "HAT", f"{folder}/spatioTemporal_EpsVSMAEperHAT_{query}.json"),
        "errors": lambda df: write_by_key(df, "epsilon", f"{folder}/{kind}_EpsVSMAE_{query}.json"),
        "noisy": lambda df: write_by_key(df, group, f"{folder}/{kind}_noisyQueryOutput_{query}.json"),
    }
    for name, df in frames.items():
        writers[name](df)
