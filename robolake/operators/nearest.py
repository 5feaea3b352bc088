"""The most similar vectors of each of many queries, exactly: all pairs, in blocks that are multiplied as matrices.

Queries and vectors are packed into rows of a block each, and every pair of blocks is met by a join. A product in single precision leaves of a pair of blocks
the few pairs that may be among the first k by more than its error; their cosines are then summed in doubles, component by component, rounded, and ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from robolake.functions.scratch import Rounds, configured

#: Components of a block of vectors and of one of queries, about.
VALUES, QUERY_VALUES = 1 << 20, 1 << 18
#: Pairs of a query and a vector whose products are in memory at once.
PAIRS = 1 << 21
#: Ranges of a block whose largest products tell where the k-th may lie.
RANGES = 64
#: Of vectors whose length is beyond these the product in single precision says nothing.
SHORT, LONG = 1e-140, 1e140
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def packed(df: DataFrame, key: str, vec: str, most: int, rows: int | None = None) -> DataFrame:
    """id, keys, dim, v: blocks of vectors of one length, of some ``most`` components and at most so many rows; dim is -1 where a vector or a component is null."""
    kind, single = df.schema[key].dataType.simpleString(), df.schema[vec].dataType.simpleString() == "array<float>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def flushed(dim: int) -> pa.RecordBatch:
            nonlocal number
            keys, values = zip(*held.pop(dim), strict=True)
            number += 1
            keys = pa.concat_arrays(keys)
            cells = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([dim], pa.int32())]
            return pa.RecordBatch.from_arrays([*cells, pa.array([b"".join(values)], pa.binary())], ["id", "keys", "dim", "v"])

        for batch in batches:
            lists = batch["v"]
            dims = np.where(batch["sound"].to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), -1).to_numpy(), -1)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                step = max(1, min(rows or len(at), most // max(1, dim)))
                for some in (at[i : i + step] for i in range(0, len(at), step)):
                    values = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False) if dim > 0 else np.empty(0)
                    held.setdefault(int(dim), []).append((batch["k"].take(pa.array(some)), values.astype("<f4" if single else "<f8").tobytes()))
                    n = sum(len(k) for k, _ in held[int(dim)])
                    if n * max(1, dim) >= most or (rows and n >= rows):
                        yield flushed(int(dim))
        for dim in list(held):
            yield flushed(dim)

    sound = F.coalesce(~F.exists(F.col(vec), lambda x: x.isNull()), F.lit(False)).alias("sound")
    told = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vec).alias("v"), sound)
    return told.mapInArrow(pack, f"id long, keys array<{kind}>, dim int, v binary")


class Block:
    """Vectors in ascending order of their keys, in doubles, with their lengths and as units in single precision."""

    def __init__(self, keys: pa.Array, dim: int, v: bytes, kind: str):
        order = pc.sort_indices(keys)
        self.keys, self.dim = keys.take(order), dim
        if dim < 0:
            return
        x = np.frombuffer(v, kind).reshape(len(keys), dim)[order.to_numpy()].astype(np.float64)
        self.columns = np.ascontiguousarray(x.T)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(summed(self.columns, self.columns, ..., ...))
            self.units = (x / self.norm[:, None]).astype(np.float32)
        #: of these every cosine is no number
        self.never = ~np.isfinite(x).all(1) | ~x.any(1)
        self.extreme = ~self.never & ~((self.norm > SHORT) & (self.norm < LONG))
        self.units[self.never | self.extreme] = 0


def summed(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
    """Inner products of columns i of a and j of b, added in the order of the rows."""
    total = np.zeros(a.shape[1] if i is ... else len(i))
    for p, q in zip(a, b, strict=True):
        total += p[i] * q[j]
    return total


def six(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero."""
    y = x * 1e6
    whole = np.trunc(y)
    return (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 1e6


def ranks(rows: np.ndarray) -> np.ndarray:
    """The place of each of some sorted rows among its equals, from 0 on."""
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.empty(0, np.int64)
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))


def best(q: Block, v: Block, k: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(queries, vectors, cosines), places in the blocks, of pairs that may be among the first k of a query; cosines are None if they are null.

    floor holds for each query a cosine that k vectors of another key reach, and is raised.
    """
    first = pc.fill_null(pc.index_in(q.keys, value_set=v.keys), -1).to_numpy()
    last = len(v.keys) - 1 - pc.fill_null(pc.index_in(q.keys, value_set=v.keys.take(pa.array(np.arange(len(v.keys))[::-1]))), -1).to_numpy()
    own = lambda i, j: (first[i] >= 0) & (j >= first[i]) & (j <= last[i])
    width = np.where(first >= 0, last - first + 1, 0)

    def lowest(i: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of each of the queries i with the first k of the places, which are in order, that aren't its own."""
        some = places[: k + int(width.max(initial=0))]
        a, b = np.repeat(i, len(some)), np.tile(some, len(i))
        a, b = (c[~own(a, b)] for c in (a, b))
        kept = ranks(a) < k
        return a[kept], b[kept]

    every = np.arange(len(v.keys))
    if q.dim < 0 or v.dim != q.dim:
        yield *lowest(np.arange(len(q.keys)), every), None
        return
    margin = 2 * (q.dim + 8) * 2.0**-24 + 1.1e-6
    never, extreme, usual = (np.flatnonzero(m) for m in (v.never, v.extreme, ~(v.never | v.extreme)))
    step = max(1, PAIRS // len(v.keys))
    for start in range(0, len(q.keys), step):
        rows = np.arange(start, min(start + step, len(q.keys)))
        odd, wild = rows[q.never[rows]], rows[q.extreme[rows]]
        plain = rows[~(q.never[rows] | q.extreme[rows])]
        pairs = [lowest(odd, every), lowest(plain, never), lowest(wild, never)]
        pairs += [(np.repeat(i, len(j)), np.tile(j, len(i))) for i, j in ((plain, extreme), (wild, np.flatnonzero(~v.never)))]
        if len(plain) and len(usual):
            near = q.units[plain] @ v.units.T
            near[:, v.never | v.extreme] = -np.inf
            for i in np.flatnonzero(first[plain] >= 0):
                near[i, first[plain[i]] : last[plain[i]] + 1] = -np.inf
            n = near.shape[1]
            tops = near if n < RANGES * 4 or k > RANGES else near[:, : n // RANGES * RANGES].reshape(len(plain), RANGES, -1).max(2)
            least = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] >= k else np.full(len(plain), -np.inf)
            i, j = np.nonzero(near >= (np.maximum(least, floor[plain]) - margin).astype(np.float32)[:, None])
            pairs.append((plain[i], j))
        a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
        a, b = (c[~own(a, b)] for c in (a, b))
        with np.errstate(all="ignore"):
            cosine = six(summed(q.columns, v.columns, a, b) / (q.norm[a] * v.norm[b]))
        none = np.isnan(cosine)
        order = np.lexsort((b, -np.where(none, 0, cosine), ~none, a))
        a, b, cosine, none = (c[order] for c in (a, b, cosine, none))
        place = ranks(a)
        kept = (place < k) & (none | (cosine >= floor[a]))
        at = place == k - 1
        floor[a[at]] = np.maximum(floor[a[at]], np.where(none[at], np.inf, cosine[at]))
        yield a[kept], b[kept], cosine[kept]


def _meet(k: int, kinds: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        block = held = None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c: batch[c][r].as_py()  # noqa: B023, E731
                if held != (held := cell("id")):
                    block = Block(batch["keys"][r].values, cell("dim"), cell("v"), kinds[1])
                q = Block(batch["qkeys"][r].values, cell("qdim"), cell("qv"), kinds[0])
                floor = floors.setdefault(cell("qid"), np.full(len(q.keys), -np.inf))
                for a, b, cosine in best(q, block, k, floor):
                    told = pa.nulls(len(a), pa.float64()) if cosine is None else pa.array(cosine)
                    yield pa.RecordBatch.from_arrays([q.keys.take(pa.array(a)), block.keys.take(pa.array(b)), told], ["query", "neighbour", "cosine"])

    return meet


def top_similar(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, most: int = 10_000) -> DataFrame:
    """The k rows most similar by cosine to each query, itself excepted (ties by rounded cosine: smaller key; no number, as of zeros, before all, null last).

    Blocks of up to ``most`` queries are broadcast, after a count; of more, parts of about ``most`` meet each part of the vectors' blocks in a
    task of its own. Of a query at most k rows leave a pair of blocks. The result is written.
    """
    spark = vectors.sparkSession
    single = lambda df: "<f4" if df.schema[vec].dataType.simpleString() == "array<float>" else "<f8"
    with Rounds(spark) as rounds, configured(spark, SETTINGS):
        n = queries.count()
        held = vectors.agg(F.sum(F.greatest(F.size(vec), F.lit(1)))).first()[0] or 0
        v = rounds.written(packed(vectors.repartition(1 + held * 10 // (9 * VALUES), key), key, vec, VALUES))
        q = rounds.written(packed(queries, key, vec, QUERY_VALUES, most).toDF("qid", "qkeys", "qdim", "qv"))
        q = F.broadcast(q) if n <= most else q.repartition(-(-n // most)).hint("shuffle_replicate_nl")
        kinds = [df.schema[key].dataType.simpleString() for df in (queries, vectors)]
        pairs = v.crossJoin(q).mapInArrow(_meet(k, (single(queries), single(vectors))), f"query {kinds[0]}, neighbour {kinds[1]}, cosine double")
        w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
        ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return rounds.result(ranked.withColumn("rank", F.col("rank").cast("long")))
