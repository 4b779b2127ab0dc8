"""What the Python-backed operators share: code on the workers, Arrow-batch mapping, checkpoints, table loading."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampType

#: Rows of a batch given to Python are handled in pieces of about so many bytes of text, so memory stays flat: a piece is there several times over, as Arrow, as Python objects and as results, on both sides of the pipe.
PIECE_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows, and bytes of all their values, up to which ``bounded`` broadcasts.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the workers once per application; the driver serves the archive, nobody reads a shared path.

    A session that has no bound of its own on the bytes of an Arrow batch gets one: rows of long
    texts would else be gathered by the ten thousand, on both sides of the pipe.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, PIECE_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_veilframe_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="veilframe-")) / "veilframe_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    sc._veilframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in ``column`` hold about PIECE_BYTES; a longer single text is a slice of its own."""
    sizes, start, held = batch.column(column).nbytes, 0, 0
    if sizes <= PIECE_BYTES:
        yield batch
        return
    nested = pa.types.is_list(batch.column(column).type)
    lengths = pc.fill_null((pc.list_value_length if nested else pc.binary_length)(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


_kept: dict = {}


def give_back() -> None:
    """Return freed memory to the system: the C library and Arrow's pool would keep it for the worker's life."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def enter(owner: str) -> None:
    """Free what another operator keeps in this worker: workers outlive stages, and their tables must not add up."""
    if _kept.get("owner") != owner:
        _kept.clear()
        _kept["owner"] = owner
        give_back()


def keep(owner: str, key, make: Callable):
    """What an operator keeps in a worker from batch to batch and task to task."""
    enter(owner)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_at: int = 1) -> DataFrame:
    """``mapInArrow`` of a function on one record batch, in pieces of bounded text."""
    ship(df.sparkSession)

    owner = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        for whole in batches:
            for batch in pieces(whole, text_at):
                yield function(batch)

    return df.mapInArrow(run, schema)


def folder_for(spark: SparkSession) -> str:
    """The shared place that the cluster names. Where none is named, a temporary folder if all tasks run on this machine (tests, notebooks); an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="veilframe-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, by whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> None:
    """Leave the cluster's checkpoint folder alone; set one only where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder_for(spark))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation of earlier rounds."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    tidy(spark)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: like ``settle``, for tables of many values, which files hold in a fraction of a checkpoint's bytes."""
    spark = df.sparkSession
    path = f"{folder_for(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def tidy(spark: SparkSession) -> None:
    """Spark frees shuffle files, broadcasts and compiled plans that nobody refers to when the driver collects its garbage, and its heap shrinks: each round begins with little."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame) -> bool:
    """Whether a checkpointed table's counted rows and bytes prove it small."""
    wide = [f.name for f in df.schema if not isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType, StringType, BinaryType))]
    plain_bytes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    size = F.lit(16 * len(df.columns)) + sum(plain_bytes, F.lit(0)) + (F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide]))) if wide else 0)
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return found["rows"] <= BROADCAST_ROWS and (found["bytes"] or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """A checkpointed table, marked for broadcast if it is proved small; beyond, joins shuffle."""
    return F.broadcast(df) if small(df) else df


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, however many others with clashing names there are."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
