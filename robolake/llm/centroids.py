"""Exact k-means over integer vectors with Hamerly's bounds.

Each vector keeps its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to every other one.
When centroids have moved, the upper bound grows by its centroid's drift and the lower one shrinks by the largest drift of the others. A vector whose
upper bound then lies below its lower one, or below half the way from its centroid to the next, stays where it is without any distance; otherwise
its own distance is made exact, and if that doesn't settle it, it is scanned against all centroids in exact integers, of equal distances the smaller
number. Bounds are rounded outwards, so they never settle what exact distances would settle otherwise.

A round is one pass without a shuffle: it reads the vectors with their bounds, writes them with the new ones into a table in the shared
folder, and adds for each task and cluster one row with the sum of its vectors. Only k centroids and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: Largest magnitude of a component: squared distances of vectors of up to 64 components then fit 63 bits.
MOST = 1 << 27
#: Bounds are rounded outwards by this share, far above the error of a square root or a sum of doubles.
SLACK = 1e-9
STATE = "id long, v binary, cluster int, upper double, lower double, total array<long>"
RESULT = "vec_id long, cluster int, distance long"


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, rows by centroids, exact: in doubles where all sums stay below 2 ** 53, else one centroid at a time."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * v.shape[1] * top * top < 1 << 53:
        f, g = v.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([np.square(v - one).sum(1) for one in c], axis=1)


class Centroids:
    """The centroids of a round, how far they are from each other, and how far they came from those of the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.at = now
        between = np.sqrt(squares(now, now).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(1) / 2 * (1 - SLACK)
        self.drift = np.zeros(len(now)) if before is None else np.sqrt(np.square(now - before).sum(1).astype(np.float64))
        first, second = np.argsort(-self.drift, kind="stable")[:2] if len(now) > 1 else (0, 0)
        self.others = np.full(len(now), self.drift[first])  # the largest drift of any other centroid
        self.others[first] = self.drift[second] if len(now) > 1 else 0.0

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, exact squared distance, and both bounds."""
        d = squares(v, self.at)
        near, rows = d.argmin(1), np.arange(len(v))
        own = d[rows, near]
        rest = d.astype(np.float64)
        rest[rows, near] = np.inf
        return near, own, np.sqrt(own.astype(np.float64)) * (1 + SLACK), np.sqrt(rest.min(1)) * (1 - SLACK)

    def own(self, v: np.ndarray, near: np.ndarray) -> np.ndarray:
        return np.square(v - self.at[near]).sum(1)

    def moved(self, v: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New cluster and bounds of vectors that had these before the centroids moved, and how many were scanned."""
        upper = (upper + self.drift[near]) * (1 + SLACK)
        away = self.others[near]
        lower = lower - away - SLACK * (np.where(np.isinf(lower), 0.0, lower) + away)
        floor = np.maximum(lower, self.half[near])
        near = near.copy()
        open_ = np.flatnonzero(upper >= floor)
        upper[open_] = np.sqrt(self.own(v[open_], near[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[upper[open_] >= floor[open_]]
        if len(open_):
            near[open_], _, upper[open_], lower[open_] = self.scan(v[open_])
        return near, upper, lower, len(open_)


def _integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and these times scale, rounded down."""
    full = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == dims)
    x = vectors.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    fine = np.isfinite(x).all(1)
    whole = np.floor(x[fine] * scale)
    if np.abs(whole).max(initial=0) > MOST:
        raise ValueError(f"a vector has a component beyond {MOST / scale}: its distances wouldn't be exact")
    return full[fine], whole.astype(np.int64)


def _packed(v: np.ndarray) -> pa.Array:
    """Vectors as binary, two bytes a component where all of the batch fit, else four."""
    small = np.abs(v).max(initial=0) < 1 << 15
    data = v.astype("<i2" if small else "<i4")
    offsets = np.arange(len(v) + 1, dtype=np.int32) * (data.itemsize * v.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(b: pa.Array, dims: int) -> np.ndarray:
    """Batches of a file's reader may hold rows of both widths."""
    size = pc.binary_length(b).to_numpy(zero_copy_only=False)
    out = np.empty((len(b), dims), np.int64)
    for width, kind in ((2, "<i2"), (4, "<i4")):
        at = np.flatnonzero(size == width * dims)
        if len(at):
            out[at] = np.frombuffer(b"".join(b.take(pa.array(at)).to_pylist()), kind).reshape(-1, dims)
    return out


class _Sums:
    """Of each cluster the sum of the vectors that a task has put there, and their number."""

    def __init__(self, k: int, dims: int):
        self.total = np.zeros((k, dims + 1), np.int64)

    def add(self, v: np.ndarray, near: np.ndarray) -> None:
        if len(v):
            order = np.argsort(near, kind="stable")
            begin = np.flatnonzero(np.diff(near[order], prepend=-1))
            here = near[order][begin]
            self.total[here, :-1] += np.add.reduceat(v[order], begin, axis=0)
            self.total[here, -1] += np.diff(np.append(begin, len(v)))


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])


def _state(ids: pa.Array, v: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.list_(pa.int64()))
    return _batch([ids, _packed(v), pa.array(near, pa.int32()), pa.array(upper), pa.array(lower), none], STATE)


def _summary(sums: _Sums) -> pa.RecordBatch:
    there = np.flatnonzero(sums.total[:, -1])
    n, total = len(there), pa.array(sums.total[there].tolist(), pa.list_(pa.int64()))
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.float64(), pa.float64())]
    return _batch([none[0], none[1], pa.array(there, pa.int32()), none[2], none[3], total], STATE)


def _begin(rows: DataFrame, c: Centroids, dims: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(c.at), dims)
        for b in batches:
            kept, v = _integers(b.column(1), dims, scale)
            near, _, upper, lower = c.scan(v)
            sums.add(v, near)
            yield _state(b.column(0).take(pa.array(kept)), v, near, upper, lower)
        yield _summary(sums)

    return rows.mapInArrow(run, STATE)


def _vectors(state: DataFrame) -> DataFrame:
    return state.filter("v is not null").select("id", "v", "cluster", "upper", "lower")


def _round(state: DataFrame, c: Centroids, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(c.at), dims)
        for b in batches:
            v = _unpacked(b.column(1), dims)
            near, upper, lower, _ = c.moved(v, *(x.to_numpy(zero_copy_only=False) for x in b.columns[2:5]))
            sums.add(v, near)
            yield _state(b.column(0), v, near, upper, lower)
        yield _summary(sums)

    return _vectors(state).mapInArrow(run, STATE)


def _end(state: DataFrame, c: Centroids, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _unpacked(b.column(1), dims)
            near, _, _, _ = c.moved(v, *(x.to_numpy(zero_copy_only=False) for x in b.columns[2:5]))
            yield _batch([b.column(0), pa.array(near, pa.int32()), pa.array(c.own(v, near), pa.int64())], RESULT)

    return _vectors(state).mapInArrow(run, RESULT)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The exact means of the clusters, rounded down; those of empty clusters stay. A row a cluster and component reaches the driver."""
    each = state.filter("total is not null").select("cluster", F.posexplode("total").alias("i", "x"))
    told = each.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
    sums = {(r["cluster"], r["i"]): int(r["x"]) for r in told}
    now = before.copy()
    dims = before.shape[1]
    for k in range(len(before)):
        n = sums.get((k, dims), 0)
        if n:
            now[k] = [sums[k, i] // n for i in range(dims)]
    return now


def kept_vector(vec: Column, dims: int) -> Column:
    """Whether a vector has all its components and these are finite."""
    return (F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def k_means(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """Cluster and exact squared distance of each kept vector after ``rounds`` of moving the centroids (RESULT), and the centroids.

    A vector is kept if it has exactly dims components, none null or not finite; each component x counts as floor(scale * x), and one of more than MOST
    raises ValueError. The first centroids are the k vectors with the smallest SHA-256 of salt and id; of equal ids the smaller vector. A vector
    without an id is clustered, but begins no cluster. With fewer vectors than k each begins one; without any there are no centroids and no rows.
    Repeated rows count each; equal centroids are possible, of which only the first has vectors; other columns aren't read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    own = rows.filter(F.col("id").isNotNull() & kept_vector(F.col("v"), dims))
    first = own.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), "v").limit(k).collect()
    begin = _integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dims, scale)[1]
    if not len(begin):
        return spark.createDataFrame([], RESULT), begin
    with Scratch(spark) as tmp:
        at, before, state = begin, None, None
        for _ in range(rounds):
            c = Centroids(at, before)
            state = tmp.written(_begin(rows, c, dims, scale) if state is None else _round(state, c, dims), "bounds")
            tmp.drop_older()
            at, before = _means(state, at), at
        if state is None:
            state = tmp.written(_begin(rows, Centroids(at), dims, scale), "bounds")
        return tmp.result(_end(state, Centroids(at, before), dims), "clusters"), at


def inertias(told: DataFrame, centroids: np.ndarray) -> DataFrame:
    """RESULT with its cluster's and the whole inertia, the sums of squared distances, and the digest of its centroid; a row a cluster is broadcast."""
    sums = {r["cluster"]: r["s"] for r in told.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, s, whole, digest[c]) for c, s in sums.items()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    few = told.sparkSession.createDataFrame(table, schema)
    return told.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", *few.columns[1:])


def sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same for DuckDB, every distance computed in every round."""
    parts = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) - 1 AS c, v AS m FROM e WHERE vec_id IS NOT NULL"
        f" QUALIFY row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) <= {k})",
        f"i AS (SELECT unnest(range(1, {dims} + 1)) AS i)",
    ]
    for r in range(rounds + 1):
        far = f"list_sum(list_transform(range(1, {dims} + 1), lambda i: (e.v[i] - c.m[i]) * (e.v[i] - c.m[i])))::BIGINT"
        parts.append(f"d{r} AS (SELECT e.r, vec_id, e.v, c.c, {far} AS d FROM e, c{r} c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, vec_id, v, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{r} GROUP BY r, vec_id, v)")
        if r < rounds:
            mean = f"list(s // n - (s < 0 AND s % n <> 0)::INT ORDER BY i)"
            parts.append(f"s{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, i GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, {mean} AS m FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (c))")
    digest = "sha256(array_to_string(m, ','))"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, a{rounds}.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,"
        f" (sum(d) OVER ())::BIGINT AS inertia, {digest} AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    )
