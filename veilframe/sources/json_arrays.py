"""Large JSON documents that are arrays of objects, read in as many tasks as their size asks for.

Spark's text reader cuts the files at ``}``, in byte ranges like any text. Whether such a place is inside a string,
and how deep, depends on all that came before, so a first pass sums each range up for both cases (it begins in a
string, or not): how it ends, how much deeper, and the least depth between. Chaining these sums, one small row a
range, gives every range its beginning; a second pass cuts the objects out. An object that a range's border
divides is put together from its fragments, which name the range where it began.

Exact for any content: braces, quotes and escapes in strings, nested arrays, objects longer than a range. Blanks around
elements do not matter; a document that is one object, not an array, is one row; an empty array has none. Elements that are no objects, and text
that ends within an object, are errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


def outside(piece: str, in_string: bool) -> tuple[str, bool]:
    """What of a piece is outside strings, and whether its end is inside one."""
    if in_string:
        end = _REST_OF_STRING.match(piece)
        if not end:
            return "", True
        piece = piece[end.end() :]
    bare = _STRING.sub('""', piece)
    cut = bare.replace('""', "  ").find('"')
    return (bare, False) if cut < 0 else (bare[:cut], True)


class Range:
    """A walk over the pieces of one byte range; each piece but a file's last was followed by ``}``."""

    def __init__(self, depth: int = 0, in_string: bool = False):
        self.depth, self.least, self.in_string = depth, None, in_string

    def step(self, piece: str) -> str:
        """Go to the end of the piece, its ``}`` included; gives what of it is outside strings."""
        bare, self.in_string = outside(piece, self.in_string)
        self.depth += bare.count("{") + bare.count("[") - bare.count("]")
        if not self.in_string:
            self.depth -= 1
            self.least = self.depth if self.least is None else min(self.least, self.depth)
        return bare


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its first character and, for both beginnings, how it ends, how much deeper, and the least depth at a ``}``."""
    at, first, walks = None, "", ()
    names = ["file", "block", "first", *(f"{n}{k}" for k in (0, 1) for n in ("ends", "deeper", "least"))]

    def row() -> pa.RecordBatch:
        ends = [x for w in walks for x in (w.in_string, w.depth, w.least)]
        kinds = [pa.string(), pa.int64(), pa.string()] + [pa.bool_(), pa.int64(), pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*at, first, *ends], kinds)], names=names)

    for batch in batches:
        for piece, *here in zip(*(c.to_pylist() for c in batch.columns)):
            if here != at:
                if at:
                    yield row()
                at, first, walks = here, "", (Range(), Range(in_string=True))
            first = first or piece.lstrip("﻿ \t\r\n")[:1]
            for w in walks:
                w.step(piece)
    if at:
        yield row()


def _beginnings(spark: SparkSession, pieces: DataFrame) -> dict[tuple[str, int], tuple[int, bool, int, int | None]]:
    """By range: the depth and whether in a string at its begin, the depth of the document's elements, and the range where its first object began if that is an earlier one.

    A row a range, of which Spark's own plan of the scan holds one too.
    """
    schema = "file string, block long, first string, " + ", ".join(f"ends{k} boolean, deeper{k} long, least{k} long" for k in (0, 1))
    found, now, out = sorted(pieces.mapInArrow(_summed, schema).collect(), key=lambda r: (r.file, r.block)), None, {}
    for r, after in zip(found, [*found[1:], None]):
        if now != r.file:
            now, depth, inside, base, owner = r.file, 0, False, int(r.first != "{"), None
        out[r.file, r.block] = depth, inside, base, owner
        ends, deeper, least = (r.ends1, r.deeper1, r.least1) if inside else (r.ends0, r.deeper0, r.least0)
        through = owner is not None and (least is None or depth + least > base)  # an object goes on through the whole range
        depth, inside = depth + deeper, ends
        owner = owner if through else r.block if depth > base or inside else None
        if (after is None or after.file != now) and (inside or depth > -base):  # what follows the last } counts as if one more did
            raise ValueError(f"{now} ends within an object")
    return out


def _cut(beginnings: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects (``owner`` null) and fragments of objects that a range's border divides (``owner``: the block where it began)."""
    at, walk, held, owner, base = None, None, [], None, 1

    def rows(made: list) -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 4, kinds)], names=["file", "block", "owner", "value"])

    def left() -> list:
        text = "".join(held)
        if walk.depth <= base and not walk.in_string and owner is None and not text.strip("﻿ \t\r\n,[]"):
            return []
        return [(*at, at[1] if owner is None else owner, text)]

    for batch in batches:
        made = []
        for piece, *here in zip(*(c.to_pylist() for c in batch.columns)):
            if here != at:
                if at:
                    made += left()
                at, held = here, []
                depth, inside, base, owner = beginnings[tuple(here)]
                walk = Range(depth, inside)
            if not held and owner is None and walk.depth <= base and not walk.in_string:  # between objects
                start = piece.find("{")
                between = piece if start < 0 else piece[:start]
                if between.strip("﻿ \t\r\n,[]"):
                    raise ValueError(f"{here[0]}: an element that is no object: {between.strip()[:40]}")
                walk.depth += between.count("[") - between.count("]")
                if walk.depth > base:
                    raise ValueError(f"{here[0]}: an element that is no object: an array")
                piece = "" if start < 0 else piece[start:]
                if start < 0:
                    continue
            walk.step(piece)
            held.append(piece + "}")
            if walk.depth == base and not walk.in_string:
                made.append((*here, owner, "".join(held)))
                held, owner = [], None
        yield rows(made)
    if at:
        yield rows(left())


def objects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file`` and ``value``, the text of each object of the arrays."""
    pieces = spark.read.text([paths] if isinstance(paths, str) else list(paths), lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    known = spark.sparkContext.broadcast(_beginnings(spark, pieces))
    cut = pieces.mapInArrow(lambda batches: _cut(known.value, batches), "file string, block long, owner long, value string")
    if not any(owner is not None for *_, owner in known.value.values()):
        return cut.filter("owner is null").select("file", "value")
    whole = cut.filter("owner is null").select("file", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))  # of one object
    text = F.array_join(F.transform(parts, lambda x: x["value"]), "")
    return whole.unionByName(cut.filter("owner is not null").groupBy("file", "owner").agg(text.alias("value")).select("file", "value"))


def inferred(values: DataFrame) -> str:
    """The type of all objects in ``value``, in one aggregation: kinds that differ become text, numbers with a fraction doubles."""
    found = values.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
    for theirs, ours in ((r"\bOBJECT<", "STRUCT<"), (r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE"), (r"\bVOID\b", "STRING"), (r"\bVARIANT\b", "STRING")):
        found = re.sub(theirs, ours, found)
    return found


def read(spark: SparkSession, paths: str | Sequence[str], schema=None, misfits: str | None = None) -> DataFrame:
    """The objects as columns, and ``file``. ``misfits`` names a column that keeps the text of objects that a given ``schema`` does not fit; no row is lost."""
    found = objects(spark, paths)
    kind = inferred(found) if schema is None else schema if isinstance(schema, str) and schema.upper().startswith("STRUCT<") else f"STRUCT<{schema}>" if isinstance(schema, str) else schema.simpleString()
    options = {"mode": "PERMISSIVE"}
    if misfits:
        kind, options["columnNameOfCorruptRecord"] = f"{kind[:-1]}, `{misfits}`: STRING>", misfits
    return found.select("file", F.from_json("value", kind, options).alias("o")).select("o.*", "file")
