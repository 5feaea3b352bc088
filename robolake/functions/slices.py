"""Windows over hot keys: rows of a key with very many rows are dealt into slices of time, and what a slice must know of the time before is carried.

A key is hot from ``hot`` rows on. A count finds such keys first; where there is none, all rows are in slice 0, and windows are the plain ones over the keys, without any
other pass. Else the hot keys' table is joined, by broadcast if it has MOST rows at most; a hot key's
time is cut into as many equal slices as it has ``hot`` rows; other keys are one slice, 0, and nothing is carried for them.
Slices of a key are few, so windows over them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task takes in a window.
HOT = 2_000_000
#: Most hot keys that are broadcast.
MOST = 10_000
SLICE, GHOST = "__slice", "__ghost"
#: Mark of a slice column that is 0 throughout.
PLAIN = {"plain": True}


def _plain(rows: DataFrame) -> bool:
    return rows.schema[SLICE].metadata == PLAIN


def _named(df: DataFrame, keys: tuple[str, ...], *columns) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__slice_key{i}") for i, k in enumerate(keys)], *columns)


def _same(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__slice_key{i}")) for i, k in enumerate(keys)]


def sliced(df: DataFrame, keys: tuple[str, ...], at: str, hot: int = HOT) -> DataFrame:
    """df with the slice of each row: 0 for keys of up to ``hot`` rows, from 1 on by ``at``, a number such as microseconds, for others."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot).limit(MOST + 1).count()
    if not n:
        return df.select("*", F.lit(0).cast("long").alias(SLICE, metadata=PLAIN))
    span = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__lo"), F.max(at).alias("__hi")).filter(F.col("__n") > hot)
    named = _named(span, keys, "__n", "__lo", "__hi")
    rows = df.join(F.broadcast(named) if n <= MOST else named, _same(keys), "left")
    parts = F.ceil(F.col("__n") / hot)
    place = F.floor((F.col(at) - F.col("__lo")).cast("double") / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)) * parts)
    number = F.when(F.col("__n").isNull(), 0).otherwise(F.least(F.coalesce(place, F.lit(0)), parts - 1) + 1)
    return rows.withColumn(SLICE, number.cast("long")).select(*df.columns, SLICE)


def carried(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int) -> DataFrame:
    """Rows of sliced() and, as ghosts, in each slice after a key's first the last n rows before it.

    Windows that look back n rows then need no other slice; real() takes the ghosts out again.
    """
    if _plain(rows):
        return rows.withColumn(GHOST, F.lit(False))
    own = [c for c in rows.columns if c != SLICE]
    late = Window.partitionBy(*keys, SLICE).orderBy(*[F.desc(c) for c in order])
    tails = rows.filter(F.col(SLICE) > 0).withColumn("__r", F.row_number().over(late)).filter(F.col("__r") <= n)
    one = F.struct((-F.col("__r")).alias("o"), F.struct(*own).alias("row"))
    tails = tails.groupBy(*keys, SLICE).agg(F.sort_array(F.collect_list(one)).alias("__t"))
    before = F.flatten(F.collect_list("__t").over(Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(-n, -1)))
    ghosts = tails.withColumn("__b", before).select(SLICE, F.explode(F.expr(f"slice(__b, greatest(1, size(__b) - {n - 1}), {n})")).alias("__g"))
    return rows.withColumn(GHOST, F.lit(False)).unionByName(ghosts.select(SLICE, "__g.row.*", F.lit(True).alias(GHOST)))


def real(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col(GHOST)).drop(SLICE, GHOST)


def upto(rows: DataFrame, keys: tuple[str, ...], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """Rows of sliced() with, for each name, the sum or the largest of a column over the key's slices before, null in its first.

    Each is first taken in each slice, then over the slices before; the table of slices is joined by key and slice, as windows deal rows.
    """
    sums, tops = sums or {}, tops or {}
    each = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max(c).alias(n) for n, c in tops.items()]
    if _plain(rows):
        kinds = rows.limit(0).agg(*each).schema
        return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
    parts = rows.filter(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(*each)
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    over = [F.sum(n).over(w).alias(n) for n in sums] + [F.max(n).over(w).alias(n) for n in tops]
    before = _named(parts, keys, F.col(SLICE).alias("__slice_of"), *over)
    return rows.join(before, [*_same(keys), F.col(SLICE) == F.col("__slice_of")], "left").select(*rows.columns, *sums, *tops)
