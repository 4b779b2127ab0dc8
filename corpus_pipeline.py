"""A training corpus from ``documents``: five stages, each one operator over all that its predecessor kept.

Every stage is written as Parquet and read again as the next one's documents, so a stage starts
from files, not from a lineage; what its successor has read is removed. All but the last return the
columns of ``documents`` with the values they had, but for ``text`` and ``n_chars``, which follows the
text where a stage changes it: columns of any names, those of an operator's own results too, stand
aside meanwhile.

Defined cases, in all stages: an empty table gives no rows; a null id is an id like others and comes
first; extra columns and their nulls pass through. Each stage's docstring says what becomes of null,
empty and very long texts, ties and repeated rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import byte_bpe, decontaminate, line_dedup, queries, simhash
from veilframe.llm.shipping import folder_for, remove, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` makes of the documents, under names that none of its own results can have, with the columns of ``docs``."""
    held = {c: c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)}
    done = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()]))
    if "n_chars" in held and "n_lines_removed" in done.columns:
        own = F.col(f"`{held['n_chars']}`")
        done = done.withColumn(held["n_chars"], F.when(F.col("n_lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own))
    return done.select(*[F.col(f"`{n}`").alias(c) for c, n in held.items()])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic and poor documents go: those whose probability of the top grade is under the classifier's cut.

    A null text counts as empty; texts without words share one score, the thresholds' own, and stay or
    go together; whole texts are read however long; rows with equal texts fare alike, a score at the cut stays.
    """
    return _aside(docs, lambda d: queries.graded(spark, sf_dir, d).filter(F.col("tail_probability") >= queries.LEAST_TAIL))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that came before go, and runs of whole lines of 50 words or more; a document that had text and has none left goes with them.

    Null and empty texts have no lines and stay; the first by (id, text hash, place) stays, so of ties the
    one of least text hash; rows equal in id and text count as one document and fare alike; a text of any
    length is one row of a batch of its own.
    """
    return _aside(docs, lambda d: line_dedup.dedup(d, passages=True).filter((F.col("n_lines_removed") == 0) | (F.trim("text") != "")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    All null texts are one group, all empty ones and all of white space alone equal ones by their bytes;
    texts of fewer than five words are one shingle. The row of least (id, text hash) stays; of rows equal in both one stays.
    """
    return _aside(docs, lambda d: simhash.distinct_documents(d, words=5, similarity=0.8))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts have no words and stay; whole texts are scanned; repeated rows fare alike; an empty benchmark takes nothing.
    """
    return _aside(docs, lambda d: decontaminate.scan(d, table(spark, sf_dir, "benchmark"), keep_columns=True).filter("n_hit = 0"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the proof that they decode to it.

    Null and empty texts have no ids and the digest of no bytes; repeated rows each give a row; long texts are encoded piece by piece.
    """
    coded = byte_bpe.transcode(docs, *VOCABULARY)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]
#: The classifier is fitted by iteration, which SQL cannot express; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = f"{folder_for(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
