"""Recurrences as prefix products: where the next state is a map of the last one, rows are composed in parallel instead of one after the other.

Rows are dealt by ranges of (key, order), so a key of any number of rows lies in as many slices as it fills. In a slice the maps are composed by
doubling: after k rounds a row's map covers the 2 ** k rows up to it, so the logarithm of the longest slice is enough. Then the slices' last maps are composed in the
same way, a row each, and what lies before a slice is put before its rows. All are window functions of the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robolake.functions.scratch import Rounds

SLICE = "__slice"
#: compose(later, earlier), both structs of one type.
Compose = Callable[[Column, Column], Column]


def affine(later: Column, earlier: Column) -> Column:
    """x -> a x + b."""
    return F.struct((later.a * earlier.a).alias("a"), (later.a * earlier.b + later.b).alias("b"))


def plane(later: Column, earlier: Column) -> Column:
    """(x, y) -> (a x + b y + e, c x + d y + f)."""
    row = lambda p, q, s: (
        later[p] * earlier.a + later[q] * earlier.c, later[p] * earlier.b + later[q] * earlier.d, later[p] * earlier.e + later[q] * earlier.f + later[s]
    )
    (a, b, e), (c, d, f) = row("a", "b", "e"), row("c", "d", "f")
    return F.struct(*[v.alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def fractional(later: Column, earlier: Column) -> Column:
    """p -> (a p + b) / (c p + d) for numbers that aren't negative; the four are only told up to a factor, and kept from growing."""
    a, b = later.a * earlier.a + later.b * earlier.c, later.a * earlier.b + later.b * earlier.d
    c, d = later.c * earlier.a + later.d * earlier.c, later.c * earlier.b + later.d * earlier.d
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(a, b, c, d))))  # a power of two, so nothing is rounded
    return F.struct(*[(v / size).alias(n) for n, v in zip("abcd", (a, b, c, d), strict=True)])


class Scan:
    """The rows of df in slices. order tells the rows of a key apart; a null key is a key."""

    def __init__(self, df: DataFrame, key: str, order: tuple[str, ...], rounds: Rounds):
        self.key, self.order, self.rounds = key, order, rounds
        self.rows = rounds.written(df.repartitionByRange(key, *order).withColumn(SLICE, F.spark_partition_id().cast("long")))
        sizes = self.rows.groupBy(key, SLICE).agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.groupBy(key).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("slices")).agg(F.max("n"), F.max("slices")).first()
        self.longest, self.most = (x or 0 for x in sizes)
        self.window = Window.partitionBy(key, SLICE).orderBy(*order)

    def prefix(self, rows: DataFrame, name: str, compose: Compose) -> DataFrame:
        """rows with column ``name``, a map, composed with those of all rows of its key before it, and f"{name}_before", those before its slice (null without any)."""
        rows = self.rounds.written(_doubled(rows, self.window, name, compose, self.longest))
        over = Window.partitionBy(self.key).orderBy(SLICE)
        last = rows.groupBy(self.key, SLICE).agg(F.max_by(name, F.struct(*self.order)).alias(name))
        last = _doubled(last, over, name, compose, self.most).withColumn("__before", F.lag(name).over(over))
        last = last.select(F.col(self.key).alias("__key"), F.col(SLICE).alias("__of"), F.col("__before").alias(f"{name}_before"))
        met = rows.join(last, F.col(self.key).eqNullSafe(F.col("__key")) & (F.col(SLICE) == F.col("__of"))).drop("__key", "__of")
        before = F.col(f"{name}_before")
        return met.withColumn(name, F.when(before.isNull(), F.col(name)).otherwise(compose(F.col(name), before)))


def _doubled(rows: DataFrame, window, name: str, compose: Compose, n: int) -> DataFrame:
    step = 1
    while step < n:
        rows = rows.withColumn("__earlier", F.lag(name, step).over(window))
        one = F.when(F.col("__earlier").isNull(), F.col(name)).otherwise(compose(F.col(name), F.col("__earlier")))
        rows = rows.withColumn(name, one).drop("__earlier")
        step *= 2
    return rows


def numbered(df: DataFrame, key: str, order: tuple[str, ...], rounds: Rounds) -> DataFrame:
    """df with __k, the number of a row in the order of its key, from 1, and __n, the rows of its key; no key is sorted in one task.

    Slices are counted, a row each, and what lies before a slice is added to the numbers in it. order tells the rows of a key apart.
    """
    scan = Scan(df, key, order, rounds)
    each = scan.rows.groupBy(key, SLICE).agg(F.count(F.lit(1)).alias("__size"))
    over = Window.partitionBy(key)
    before = F.sum("__size").over(over.orderBy(SLICE)) - F.col("__size")
    each = each.select(F.col(key).alias("__key"), F.col(SLICE).alias("__of"), before.alias("__before"), F.sum("__size").over(over).alias("__n"))
    met = scan.rows.join(each, F.col(key).eqNullSafe(F.col("__key")) & (F.col(SLICE) == F.col("__of")))
    return met.withColumn("__k", F.row_number().over(scan.window) + F.col("__before")).select(*df.columns, "__k", "__n")
