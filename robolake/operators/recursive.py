"""Operators whose next row needs the result of the last: filters and control loops as prefix products of maps, and a walk over rows for other steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robolake.functions.scans import SLICE, Scan, affine, fractional, plane
from robolake.functions.scratch import Rounds


def scan(
    df: DataFrame, key: str, order: tuple[str, ...], value: str, start: Callable[[], tuple],
    step: Callable[[tuple, float], tuple[tuple, tuple]], outputs: tuple[str, ...]
) -> DataFrame:
    """key, order and outputs for each row: step(state, value) gives the next state and the row's outputs; a null value comes as NaN."""
    cols = [key, *order]
    schema = df.select(*cols, *[F.lit(0.0).alias(o) for o in outputs]).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, begun = None, None, False
        for f in frames:
            rows = []
            for k, v in zip(f[key].tolist(), f[value].tolist(), strict=True):
                if not begun or k != last:
                    last, state, begun = k, start(), True
                state, out = step(state, v)
                rows.append(out)
            yield pd.concat([f[cols].reset_index(drop=True), pd.DataFrame(rows, columns=list(outputs), dtype="float64")], axis=1)

    return df.select(*cols, F.col(value).cast("double").alias(value)).repartition(key).sortWithinPartitions(*cols).mapInPandas(run, schema)


def kalman(df: DataFrame, key: str, order: tuple[str, ...], value: str, process: float, noise: float) -> DataFrame:
    """Scalar filter of a level that moves by variance ``process`` a step and is read with variance ``noise``: estimate and variance after each row.

    The first reading is the first estimate; before it the estimate is null and the variance 0. A missing reading leaves the estimate and adds to its variance.
    The variance is a linear-fractional map of the last one, from an infinite one at first; with it known, the estimate is an affine map of the last
    one. Both are prefix products, so a key may have any number of rows. The result is written.
    """
    q, r = float(process), float(noise)
    entries = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip("abcd", v, strict=True)])
    with Rounds(df.sparkSession) as rounds:
        z = F.col(value).cast("double")
        scan = Scan(df.select(key, *order, F.when(~F.isnan(z), z).alias("__z")), key, order, rounds)
        read = F.col("__z").isNotNull()
        rows = scan.rows.withColumn("__p", F.when(read, entries(r, r * q, 1.0, q + r)).otherwise(entries(1.0, q, 0.0, 1.0)))
        rows = scan.prefix(rows, "__p", fractional)  # applied to infinity, 1 / 0: the variance is a / c
        of = lambda m: F.when(F.col(m).isNotNull(), F.struct(f"{m}.a", f"{m}.c"))
        none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
        before = F.coalesce(F.lag(of("__p")).over(scan.window), of("__p_before"), none)
        rows = rows.withColumn("__last", before)
        u, v = F.col("__last.a"), F.col("__last.c")
        keep = F.try_divide(r * v, u + (q + r) * v)
        step = F.struct(keep.alias("a"), (F.try_divide(u + q * v, u + (q + r) * v) * F.col("__z")).alias("b"))
        rows = rows.withColumn("__x", F.when(read, step).otherwise(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))))
        rows = scan.prefix(rows.select(key, *order, SLICE, "__x", F.try_divide("__p.a", "__p.c").alias("__v")), "__x", affine)
        estimate = F.when(F.col("__v").isNotNull(), F.col("__x.b"))
        return rounds.result(rows.select(key, *order, estimate.alias("estimate"), F.coalesce("__v", F.lit(0.0)).alias("variance")))


def control_loop(df: DataFrame, key: str, order: tuple[str, ...], value: str, kp: float, ki: float, lag: float) -> DataFrame:
    """A plant of first order under proportional-integral control that follows the value: output and error of each step; a missing value holds the output and has no error.

    A step is an affine map of the output and the sum of errors, so rows are prefix products and a key may have any number of them. The result is written.
    """
    own = (1 - lag * (kp + ki + 1), lag * ki, -1.0, 1.0)
    with Rounds(df.sparkSession) as rounds:
        z = F.col(value).cast("double")
        scan = Scan(df.select(key, *order, F.when(~F.isnan(z), z).alias("__z")), key, order, rounds)
        ref = F.col("__z")
        step = F.struct(*[F.lit(x).alias(n) for n, x in zip("abcd", own, strict=True)], (lag * (kp + ki) * ref).alias("e"), ref.alias("f"))
        hold = F.struct(*[F.lit(x).alias(n) for n, x in zip("abcdef", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), strict=True)])
        rows = scan.prefix(scan.rows.withColumn("__m", F.when(ref.isNotNull(), step).otherwise(hold)), "__m", plane)
        return rounds.result(rows.select(key, *order, F.col("__m.e").alias("output"), (ref - F.col("__m.e")).alias("error")))
