"""User aggregates in two phases: a state of fixed size that tasks build, that merges by adding, and from which the answer is made.

Each task adds its rows to the states of their groups and hands these on; states are added up by (group, part) first and by group then, so that no task gets
more of them than the root of their number. What is shuffled is a state a group and task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that a task keeps before it hands them on.
HELD = 64
#: Parts into which the states of a group are dealt for the first merge.
PARTS = 64


def aggregate(
    df: DataFrame, by: str, inputs: tuple[str, ...], size: int, places: Callable[[list[np.ndarray]], np.ndarray],
    finish: Callable[[np.ndarray], tuple], results: str
) -> DataFrame:
    """by and ``results`` (names and types) for each group: places() says which of the state's ``size`` counters each row raises, -1 for none; finish() reads the counters.

    Rows with a null among the inputs count nothing; a group of such rows has counters of 0. A null group is a group.
    """
    kind = df.select(by).schema[0].dataType.simpleString()
    state = f"g {kind}, part int, counts binary"
    rows = df.select(F.col(by).alias("g"), F.spark_partition_id().alias("part"), *[F.col(c).cast("double").alias(f"i{k}") for k, c in enumerate(inputs)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        part, target = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            target = b.column(0).type
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            part = b.column(1)[0].as_py() % PARTS
            values = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[2:]]
            at = np.where(np.any(np.isnan(values), axis=0), -1, places(values))
            group = codes.indices.to_numpy(zero_copy_only=False)
            for k, g in enumerate(codes.dictionary.to_pylist()):
                mine = at[group == k]
                held[g] = held.get(g, 0) + np.bincount(mine[mine >= 0], minlength=size)
            if len(held) > HELD:
                yield _states(held, part, target)
                held = {}
        if held:
            yield _states(held, part, target)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = _sum(table)
        return pa.table({"g": table.column("g").slice(0, 1), "part": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    def end(key: tuple, table: pa.Table) -> pa.Table:
        told = finish(_sum(table))
        return pa.table([table.column("g").slice(0, 1), *[pa.array([v], t) for v, t in zip(told, types, strict=True)]], names=names)

    schema = df.select(F.col(by), *[F.lit(None).cast(r.split()[1]).alias(r.split()[0]) for r in results.split(", ")]).schema
    names = schema.names
    types = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.float64() for f in schema.fields[1:]]
    some = rows.mapInArrow(partial, state).groupBy("g", "part").applyInArrow(merge, state)
    return some.groupBy("g").applyInArrow(end, schema)


def _states(held: dict, part: int, kind: pa.DataType) -> pa.RecordBatch:
    counts = pa.array([v.astype(np.int64).tobytes() for v in held.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([part] * len(held), pa.int32()), counts], ["g", "part", "counts"])


def _sum(table: pa.Table) -> np.ndarray:
    total: np.ndarray | int = 0
    for b in table.column("counts"):
        total = total + np.frombuffer(b.as_buffer(), np.int64)
    return np.array(total)


def robust_line(df: DataFrame, by: str, x: str, y: str, xs: tuple[float, float], ys: tuple[float, float], nx: int = 32, ny: int = 512) -> DataFrame:
    """A line through each group that outliers don't move: n, scale and offset.

    Rows are counted on a grid of nx by ny equal cells over xs by ys, ends included; others don't count. Of each column of the grid the median of y, as the middle of its cell, stands
    for its rows; the scale is the median of the slopes between all pairs of columns, and the offset the median of what it leaves. With one column or none both are null.
    """
    dx, dy = (xs[1] - xs[0]) / nx, (ys[1] - ys[0]) / ny

    def places(values: list[np.ndarray]) -> np.ndarray:
        a, b = values
        inside = (a >= xs[0]) & (a <= xs[1]) & (b >= ys[0]) & (b <= ys[1])
        cell = lambda v, lo, d, n: np.minimum(np.floor((np.where(inside, v, lo) - lo) / d), n - 1).astype(np.int64)
        return np.where(inside, cell(a, xs[0], dx, nx) * ny + cell(b, ys[0], dy, ny), -1)

    def finish(counts: np.ndarray) -> tuple:
        grid = counts.reshape(nx, ny)
        total = grid.sum(1)
        there = np.flatnonzero(total)
        n = int(total.sum())
        if len(there) < 2:
            return n, None, None
        middle = (np.cumsum(grid[there], axis=1) * 2 >= total[there, None]).argmax(1)
        mx, my = xs[0] + (there + 0.5) * dx, ys[0] + (middle + 0.5) * dy
        a, b = np.triu_indices(len(there), 1)
        scale = float(np.median((my[b] - my[a]) / (mx[b] - mx[a])))
        return n, scale, float(np.median(my - scale * mx))

    return aggregate(df, by, (x, y), nx * ny, places, finish, "n bigint, scale double, offset double")
