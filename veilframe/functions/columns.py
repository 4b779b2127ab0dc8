"""Pure Column -> Column building blocks with the null and rounding rules that the operators share."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_upper(c: Column, most: float) -> Column:
    """Values over ``most`` become ``most``; null stays null (``least`` would not)."""
    return F.when(c > most, F.lit(most)).otherwise(c)


def clip_lower(c: Column, least: float) -> Column:
    return F.when(c < least, F.lit(least)).otherwise(c)


def round_half_even(c: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.rint(c * scale) / scale


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def seeded_uniform(seed: str, key: Column) -> Column:
    """For tests only: a uniform value in (0, 1) that the key decides. Predictable noise protects nobody."""
    return hex_uniform(F.sha2(F.concat(F.lit(f"{seed}|"), key), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of the text's UTF-8 bytes (or of binary values), as lowercase hex; null of null."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def hex_uniform(digest: Column, first: int = 1) -> Column:
    """A value in (0, 1) from 13 hex digits, 52 bits."""
    return (F.conv(F.substring(digest, first, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def full_uniform(digest: Column) -> Column:
    """A value in (0, 1) as close to a real draw as doubles are: the leading zeros of 128 bits are its exponent, 52 further bits its fraction."""
    zeros = F.length(F.regexp_extract(F.substring(digest, 1, 32), "^(0*)", 1))
    lead = F.substring(digest, zeros + 1, F.lit(1))
    within = F.when(lead == "1", 3).when(lead.isin("2", "3"), 2).when(lead.isin("4", "5", "6", "7"), 1).otherwise(0)
    return F.pow(F.lit(2.0), -(4 * zeros + within + 1)) * (1 + F.conv(F.substring(digest, 33, 13), 16, 10).cast("long") / float(1 << 52))


def two_sided_geometric(uniform: Column, alpha: Column | float) -> Column:
    """A whole number k with probability (1 - alpha) / (1 + alpha) * alpha^|k|, by inversion; ``uniform`` should be bound beforehand."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    side = 1 - 2 * F.abs(uniform - 0.5)
    size = F.greatest(F.ceil(F.ln(side * (1 + alpha) / 2) / F.ln(alpha)) - 1, F.lit(0))
    return F.when(uniform < 0.5, -size).otherwise(size).cast("long")


def drawn_uniform(seed: int | None = None) -> Column:
    """A fresh draw per row in (0, 1): shifted off zero, where the noise would be infinite."""
    return (F.rand() if seed is None else F.rand(seed)) * (1 - 2.0**-53) + 2.0**-54


def laplace(uniform: Column, scale: Column | float) -> Column:
    """Inverse distribution function of Laplace noise; ``uniform`` should be a column bound beforehand, as it occurs twice."""
    centred = uniform - 0.5
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -scale * F.signum(centred) * F.ln(1 - 2 * F.abs(centred))


def tile(hour: Column, cell: Column) -> Column:
    """Hour-and-area tile: the hour without leading zero, a blank, the cell; null if either is."""
    return F.concat(hour.cast("string"), F.lit(" "), cell.cast("string"))


def bin_label(value: Column, width: int, least: int, most: int, fold: bool = False) -> Column:
    """The interval ``(lo, hi]`` of equal ``width`` from ``least`` on that holds the value; the lowest value belongs to the first.

    Null outside the edges. With ``fold`` the positions ``least + 1 .. most`` are cut into
    (most - least) div width bins, of which the last also takes what is left over.
    """
    last = -(-(most + width - least) // width) - 1
    number = F.greatest(F.ceil((value - least) / width), F.lit(1))
    high = least + number * width
    if fold:
        last = max((most - least) // width, 1)
        number = F.least(number, F.lit(last))
        high = F.when(number == last, F.lit(most)).otherwise(least + number * width)
    edge = F.lit(most) if fold else F.lit(least + last * width)
    low = least + (number - 1) * width
    text = F.when(number == 1, F.format_string("(%.3f, %.1f]", F.lit(least - 0.001), high.cast("double"))).otherwise(
        F.format_string("(%.1f, %.1f]", low.cast("double"), high.cast("double")))
    return F.when((value >= least) & (value <= edge), text)
