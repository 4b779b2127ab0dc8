"""Row-wise transforms: suppression, pseudonyms, duplicates, time and place generalisation, filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from veilframe.functions.columns import hmac_sha256, tile


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """A misspelt name must not leave a column unprotected."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def suppress(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the listed columns; an unknown name is an error."""
    require(df, columns)
    return df.drop(*columns)


def pseudonymize(df: DataFrame, columns: Sequence[str], salt: str = "", separator: str = "", strict: bool = False, name: str = "Hashed Value", key: bytes = b"") -> DataFrame:
    """The columns give way to the SHA-256 of their values joined by ``separator`` and followed by ``salt``.

    Two columns are asked for. Without a separator "ab" + "c" meets "a" + "bc". A null value gives
    a null pseudonym, or an error if ``strict``. With a ``key`` the pseudonym is the HMAC-SHA-256 of any number of columns, each
    after its length, so that only who has the key can try values out, and no two rows of values meet.
    """
    require(df, columns)
    if not key and len(columns) != 2 or not columns:
        raise ValueError("a pseudonym is made of two columns, or with a key of any number")
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    if strict:
        values = [F.coalesce(c, F.raise_error(F.lit("null in a column of a pseudonym"))) for c in values]
    if key:
        said = F.concat(*[part for v in values for part in (F.length(v).cast("string"), F.lit(":"), v)], F.lit(salt))
        return df.withColumn(name, hmac_sha256(key, said)).drop(*columns)
    return df.withColumn(name, F.sha2(F.concat(values[0], F.lit(separator), values[1], F.lit(salt)), 256)).drop(*columns)


def row_digest(columns: Sequence[Column]) -> list[Column]:
    """Two 64-bit hashes of a row; equal rows have equal ones, and others hardly ever."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("veil"), *columns)]


def deduplicate(df: DataFrame, order_by: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """The first row, by ``order_by``, of those that agree in all columns but arrays and ``order_by``; within ``scope`` only, such as a file.

    Digests are counted first, so no text is shuffled for that. Rows of a digest of its own stay as they are; only rows of a
    repeated digest are compared, by all their columns, and copies among them go before the exchange, so a much repeated row is no large task.
    """
    require(df, [*order_by, *scope])
    keys = [f.name for f in df.schema if not isinstance(f.dataType, ArrayType) and f.name not in order_by]
    keys = list(dict.fromkeys([*scope, *keys]))
    rest = [c for c in df.columns if c not in keys]
    named = lambda names: [F.col(f"`{c}`") for c in names]
    high, low = row_digest(named(keys) or [F.lit(0)])
    hashed = df.withColumns({"digest high": high, "digest low": low})
    digest = ["digest high", "digest low"]
    repeated = hashed.groupBy(*digest).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*digest)
    alone = hashed.join(repeated, digest, "left_anti").select(*named(df.columns))
    first = F.min_by(F.struct(*named(rest)), F.struct(*named(order_by))).alias("first row")
    kept = hashed.join(repeated, digest, "left_semi").groupBy(*named(keys)).agg(first)
    return alone.unionByName(kept.select(*[F.col(f"`{c}`" if c in keys else f"`first row`.`{c}`").alias(c) for c in df.columns]))


def generalize_time(df: DataFrame, column: str, keep_time: bool = False) -> DataFrame:
    """``Date`` and ``Timeslot`` (hour), and ``Time`` if asked for, from the wall clock of a timestamp or its text, which goes."""
    require(df, [column])
    stamp = F.col(f"`{column}`").cast("timestamp_ntz")
    out = df.withColumn("Date", F.to_date(stamp)).withColumn("Timeslot", F.hour(stamp))
    if keep_time:
        out = out.withColumn("Time", F.date_format(stamp, "HH:mm:ss.SSSSSS"))
    return out.drop(column)


def filter_hours(df: DataFrame, first: int, last: int, column: str = "Timeslot") -> DataFrame:
    """Rows of the hours ``first`` to ``last``, both included."""
    return df.filter(F.col(column).between(first, last))


def coordinates(column: Column, is_text: bool) -> tuple[Column, Column]:
    """Longitude and latitude of a ``[lon, lat]`` array or of its text."""
    pair = F.from_json(column, "array<double>") if is_text else column
    return F.get(pair, F.lit(0)), F.get(pair, F.lit(1))


def grid_cell(lon: Column, lat: Column, resolution: int = 7) -> Column:
    """A cell of a plain degree grid whose equatorial area is that of a hexagon of the resolution; its names are its own."""
    side = round((510_072_000 / (2 + 120 * 7**resolution)) ** 0.5 / 111.32, 4)
    part = lambda c, shift: F.floor((c + shift) / F.lit(side)).cast("string")
    return F.concat(part(lat, 90.0), F.lit("_"), part(lon, 180.0))


#: Of the sphere that has the earth's surface, in km.
RADIUS, SURFACE = 6371.0072, 510_072_000.0


def _hexagons(resolution: int) -> tuple[float, int]:
    """Side in km, and how many lie around the equator: the side is fitted to a whole number of them."""
    side = (SURFACE / (2 + 120 * 7**resolution) * 2 / (3 * math.sqrt(3))) ** 0.5
    around = max(round(2 * math.pi * RADIUS / (math.sqrt(3) * side)), 1)
    return 2 * math.pi * RADIUS / (math.sqrt(3) * around), around


def _hex_name(resolution: int, q: Column, r: Column) -> Column:
    around = _hexagons(resolution)[1]
    return F.concat(F.lit(f"{resolution}x"), F.pmod(q, F.lit(around)).cast("string"), F.lit("x"), r.cast("string"))


def hex_cell(lon: Column, lat: Column, resolution: int = 7) -> Column:
    """A hexagon of a grid of our own over an equal-area projection: all have one area, and the grid closes at the 180th meridian. Its names, resolution x column x row, are no other system's."""
    side, _ = _hexagons(resolution)
    x, y = F.radians(lon) * RADIUS, F.sin(F.radians(lat)) * RADIUS
    q, r = (x * math.sqrt(3) / 3 - y / 3) / side, y * 2 / 3 / side
    # round all three of q, r and -q-r, and let the one that moved most follow from the others
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    return _hex_name(resolution, F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when((dr >= dq) & (dr > ds), -rq - rs).otherwise(rr).cast("long"))


def _hex_parts(cell: Column) -> tuple[Column, Column]:
    parts = F.split(cell, "x")
    return F.get(parts, F.lit(1)).cast("long"), F.get(parts, F.lit(2)).cast("long")


def _asin(sine: Column) -> Column:
    """The C library's arcsine, rounded as SQL engines round it, in Arrow batches. Java's is one unit off in a few values of a hundred, which moves a point that lies on an edge."""

    @F.pandas_udf("double")
    def angles(x: pd.Series) -> pd.Series:
        return x.map({v: math.asin(v) for v in x.dropna().unique().tolist()})

    return angles(sine)


def hex_centre(cell: Column, resolution: int = 7) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre; centres beyond a pole stand at it."""
    (q, r), (side, _) = _hex_parts(cell), _hexagons(resolution)
    lon = F.degrees((q + r / 2) * (math.sqrt(3) * side / RADIUS))
    return lon - 360 * F.floor((lon + 180) / 360), F.degrees(_asin(F.greatest(F.least(r * (1.5 * side / RADIUS), F.lit(1.0)), F.lit(-1.0))))


def hex_parent(cell: Column, resolution: int = 7) -> Column:
    """The cell of the next coarser resolution that holds the cell's centre. Of a centre on an edge, as one cell in 800 has it, the last bit of its coordinates decides."""
    return hex_cell(*hex_centre(cell, resolution), resolution - 1)


def hex_neighbours(cell: Column, resolution: int = 7) -> Column:
    """The cells around a cell; those that would lie wholly beyond a pole are left out."""
    q, r = _hex_parts(cell)
    side, _ = _hexagons(resolution)
    around = F.array(*[F.struct((q + i).alias("q"), (r + j).alias("r")) for i, j in ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))])
    return F.transform(F.filter(around, lambda c: F.abs(c["r"]) * (1.5 * side) < RADIUS + side), lambda c: _hex_name(resolution, c["q"], c["r"]))


def h3_cell(lon: Column, lat: Column, resolution: int = 7) -> Column:
    """A hexagon of the h3 library, which must be installed here and on the workers; in Arrow batches."""
    import h3

    index = getattr(h3, "latlng_to_cell", None) or h3.geo_to_h3

    @F.pandas_udf("string")
    def cells(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else index(b, a, resolution) for a, b in zip(x, y)], dtype=object)

    return cells(lon, lat)


INDEXERS = {"grid": grid_cell, "hex": hex_cell, "h3": h3_cell}


def generalize_place(df: DataFrame, column: str, resolution: int = 7, name: str = "h3index", indexer=grid_cell) -> DataFrame:
    """``name``: the cell of a coordinate pair, by ``indexer``, a function of longitude, latitude and resolution."""
    require(df, [column])
    lon, lat = coordinates(F.col(f"`{column}`"), not isinstance(df.schema[column].dataType, ArrayType))
    return df.withColumn(name, indexer(lon, lat, resolution)).drop(column)


def add_tile(df: DataFrame, hour: str = "Timeslot", cell: str = "h3index", name: str = "HAT") -> DataFrame:
    return df.withColumn(name, tile(F.col(hour), F.col(f"`{cell}`")))
