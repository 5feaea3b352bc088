"""Column functions: rounding for comparison, time in microseconds, intervals of confidence, bins and hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def r6(c: Column) -> Column:
    """Six decimals as SQL's round() gives them: scaled first, so that 64.0001595, whose double lies below it, goes down; F.round takes its shortest text."""
    return F.round(c * 1e6) / 1e6


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles as SQL divides them: by 0, infinite by both signs, or NaN for 0 / 0; null only where a side is."""
    return F.when(b != 0, F.try_divide(a, b)).otherwise(a * F.pow(b, F.lit(-1.0)))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Success rate and the bounds of its Wilson score interval; all null if n is 0."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    centre = p + z * z / (2 * m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    scale = 1 + z * z / m
    return p, (centre - half) / scale, (centre + half) / scale


def bin_of(x: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    """1 to n by equal widths from lo to hi; 0 below and n + 1 from hi on, but hi itself is in bin n."""
    lo, hi = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lo, hi))
    return F.when(x == hi, n).when(x < lo, 0).when(x > hi, n + 1).otherwise(F.floor((x - lo) / (hi - lo) * n) + 1).cast("long")


def hash_mod(c: Column, m: int) -> Column:
    """The first 8 hex digits of the MD5 of the value as text, modulo m."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % m


def text_key(c: Column) -> Column:
    """Digest of a text without regard to case and white space."""
    return F.md5(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))


def worst(severity: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (severity + 1).cast("int"))
