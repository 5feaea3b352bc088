"""Connected components of a table of links: by alternating large and small stars, every round a written table, or at most FEW links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup

#: Up to so many links, 16 MB, one task joins them at once; more are joined by rounds over all tasks.
FEW = 1_000_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links a - b connect it with."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots(len(nodes), at[: len(u)], at[len(u) :])])], ["node", "component"])


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, tmp: Scratch, few: int = FEW) -> DataFrame:
    """links (u, v) -> node, component: the smallest node that can be reached, for every node with a link.

    Large star: each node hangs its larger neighbours on the smallest of its neighbours and itself. Small star: each
    node hangs its smaller neighbours, and itself, there. Both keep components whole, and the rounds, of which a
    component needs about the logarithm of its size, end when no link changes. A hub's links are never gathered:
    its smallest neighbour is an aggregate, and the hub is looked up as a hot key.
    """
    now = tmp.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    if now.count() <= few:
        return tmp.written(now.coalesce(1).mapInArrow(_at_once, "node long, component long"), "components")
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tmp.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "large")
        large = lookup(both, low, "u", "n").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tmp.written(large.distinct(), "large-star")
        low = tmp.written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small")
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        hung = lookup(large, low, "u", "n").select(F.explode(pairs).alias("p")).select("p.*")
        now = tmp.written(hung.filter("u <> v").distinct(), "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
