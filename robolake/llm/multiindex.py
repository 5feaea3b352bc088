"""Near-duplicate vectors by an inverted multi-index, every link verified by cosine in double precision.

Two codebooks, one for each half of a vector, learned on a bounded sample, form a grid of cells; each vector lies in the cell of its
nearest centroids. A vector visits the cells in the order of the summed distances to both centroids, as multi-sequence traversal does,
as many as find TARGET of the vectors at the threshold itself: this number is measured by moving sampled vectors by just that
angle in random directions. Nearer vectors are found more often. Whatever is met on a visit is verified.

Equal vectors are one first. Vectors of each length are a space of their own. A cell's vectors and its visitors are dealt into blocks by
hash, and each pair of blocks is one group, so a cell may hold any share of all vectors; of the pairs found in a group only
counts and a spanning forest leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, lookup
from .components import components, roots

#: The sample that the codebooks of a length are learned on; a codebook has no more centroids than that.
SAMPLE = 20_000
#: Vectors in a cell on average. The codebooks grow with the root of the number of vectors, so cells don't; lengths with no more vectors
#: than this have one cell and need no sample. With SAMPLE centroids on each side this holds up to 1.6e11 vectors.
IN_CELL = 400
TARGET = 0.999
#: Vectors of a cell and visitors in a block.
BLOCK, VISITORS = 2048, 8192
#: The table of cells is broadcast up to this number of rows, 40 MB; a larger one is joined by a shuffle.
FEW = 1_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _step(c: np.ndarray) -> int:
    """Vectors whose distances to all centroids are held at once: 32 MB."""
    return max(1, (1 << 22) // len(c))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    n = _step(c)
    return np.concatenate([np.zeros(0, np.int64), *(distances(x[a : a + n], c).argmin(1) for a in range(0, len(x), n))])


def _first(y: np.ndarray, n: int) -> np.ndarray:
    """The places of the n smallest values of each row, in their order."""
    at = np.argpartition(y, n - 1, 1)[:, :n] if n < y.shape[1] else np.broadcast_to(np.arange(n), y.shape)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(y, at, 1), 1, kind="stable"), 1)


class MultiIndex:
    """Two codebooks and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, total: int, threshold: float, target: float = TARGET):
        x = sample / np.linalg.norm(sample, axis=1)[:, None]
        self.half = x.shape[1] // 2
        self.k = int(np.clip(np.ceil(np.sqrt(total / IN_CELL)), 1, len(x)))
        self.books = [kmeans(x[:, : self.half], self.k), kmeans(x[:, self.half :], self.k, seed=2)]
        rng = np.random.default_rng(3)
        probe = x[:: max(1, len(x) // 4000)]
        off = rng.standard_normal(probe.shape)
        off -= (off * probe).sum(1)[:, None] * probe
        size = np.linalg.norm(off, axis=1)[:, None]
        moved = threshold * probe + np.sqrt(1 - threshold**2) * np.divide(off, size, out=np.zeros_like(off), where=size > 0)
        self.visits, cells = 1, self.k**2
        there = self.cells(moved)
        while self.visits < cells and (self.order(probe) == there[:, None]).any(1).mean() < target:
            self.visits = min(cells, max(self.visits + 1, self.visits * 5 // 4))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * self.k + nearest(x[:, self.half :], self.books[1])

    def order(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector visits.

        Of the sorted distances of both halves, the i-th and j-th together can be among the first n only if i * j <= n.
        """
        n, most = self.visits, min(self.visits, self.k)
        pairs = [(i, j) for i in range(most) for j in range(min(n // (i + 1), self.k))]
        i, j = (np.array(c) for c in zip(*pairs, strict=True))
        out = [np.zeros((0, n), np.int64)]
        step = max(1, min(_step(self.books[0]), (1 << 22) // len(pairs)))
        for a in range(0, len(x), step):
            d = [distances(h[a : a + step], b) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]
            at = [_first(y, most) for y in d]
            s = [np.take_along_axis(y, o, 1) for y, o in zip(d, at, strict=True)]
            first = _first(s[0][:, i] + s[1][:, j], n)
            out.append(np.take_along_axis(at[0][:, i] * self.k + at[1][:, j], first, 1))
        return np.concatenate(out)


FOUND = "u long, v long, n long"


def _meet(threshold: float, dtype: str):
    """In a pair of blocks: for each visitor and vector that are linked, counts (v null) and a spanning forest (n null)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids, copies, home = (t.column(c).to_numpy() for c in ("asks", "rep", "copies", "home"))
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), dtype).reshape(len(ids), -1).astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        q, i = np.flatnonzero(asks), np.flatnonzero(~asks)
        met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(q), 1024):
            some = q[at : at + 1024]
            cos = (x[some] @ x[i].T) / (norm[some][:, None] * norm[i])
            a, b = np.nonzero((cos >= threshold) & (ids[some][:, None] != ids[i]))
            met.append((some[a], i[b]))
        a, b = (np.concatenate(z) for z in zip(*met, strict=True))
        # the vector of b counts a itself when it visits a's cell; else the pair is counted for both here
        visits = {k: set(v) for k, v in zip(i.tolist(), t.column("visits").filter(~asks).to_pylist(), strict=True)} if len(a) else {}
        back = np.fromiter((h in visits[k] for k, h in zip(b.tolist(), home[a].tolist(), strict=True)), bool, len(a))
        n = np.zeros(len(x), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b[~back], copies[a[~back]])
        low = roots(len(x), a, b)
        hung, counted = np.flatnonzero(low != np.arange(len(x))), np.flatnonzero(n)
        none = [None]
        return pa.table(
            {
                "u": pa.array(np.concatenate([ids[counted], ids[hung]]), pa.int64()),
                "v": pa.array(none * len(counted) + ids[low[hung]].tolist(), pa.int64()),
                "n": pa.array(n[counted].tolist() + none * len(hung), pa.int64()),
            }
        )

    return run


def _indexes(reps: DataFrame, widths: dict[int, int], threshold: float, target: float) -> dict[int, MultiIndex]:
    """An index for each length that has more vectors than a cell, by a sample of its vectors."""
    out = {}
    for width, n in widths.items():
        if n > IN_CELL:
            sample = reps.filter(F.size("v") == width).select("v").orderBy(F.xxhash64("key")).limit(SAMPLE).toArrow().column("v").combine_chunks()
            out[width] = MultiIndex(np.asarray(sample.flatten(), np.float64).reshape(-1, width), n, threshold, target)
    return out


CODED = "rep long, copies long, width int, v binary, home long, visits array<long>"


def _coded(reps: DataFrame, indexes: dict[int, MultiIndex], dtype: str) -> DataFrame:
    """Each vector as bytes, with its own cell and those that it visits."""
    shared = reps.sparkSession.sparkContext.broadcast(indexes)  # the codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size, ends, flat = np.diff(lists.offsets), np.asarray(lists.offsets), np.asarray(lists.values).astype(dtype)
            home, visits = np.zeros(len(size), np.int64), [[0]] * len(size)
            for width in np.unique(size).tolist():
                if index := shared.value.get(width):
                    at = np.flatnonzero(size == width)
                    x = flat[ends[at, None] + np.arange(width)].astype(np.float64)
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                    home[at] = index.cells(x)
                    for k, v in zip(at.tolist(), index.order(x), strict=True):
                        visits[k] = v
            raw = [flat[a:e].tobytes() for a, e in zip(ends[:-1], ends[1:], strict=True)]
            columns = [*b.columns[:2], pa.array(size, pa.int32()), pa.array(raw, pa.binary()), pa.array(home), pa.array(visits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CODED.split(", ")])

    return reps.select("rep", "copies", "v").mapInArrow(run, CODED)


def _links(coded: DataFrame, threshold: float, dtype: str, tmp: Scratch) -> DataFrame:
    """FOUND, of all pairs of blocks."""
    cell = ["width", "cell"]
    homes = coded.withColumn("cell", F.col("home")).withColumn("asks", F.lit(False))
    asking = coded.withColumn("cell", F.explode("visits")).withColumn("asks", F.lit(True)).withColumn("visits", F.lit(None).cast("array<long>"))
    held = homes.groupBy(*cell).agg(F.count(F.lit(1)).alias("held"))
    asked = asking.groupBy(*cell).agg(F.count(F.lit(1)).alias("asked"))
    blocks = [F.ceil(F.col("held") / BLOCK).alias("blocks"), F.ceil(F.col("asked") / VISITORS).alias("askers")]
    deal = tmp.written(held.join(asked, cell).select(*cell, *blocks), "cells")
    deal = F.broadcast(deal) if deal.count() <= FEW else deal.hint("merge")
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = homes.join(deal, cell).withColumn("i", spread("blocks")).withColumn("q", every("askers"))
    visits = asking.join(deal, cell).withColumn("q", spread("askers")).withColumn("i", every("blocks"))
    met = index.unionByName(visits).select(*cell, "i", "q", "asks", "rep", "copies", "v", "home", "visits")
    return tmp.written(met.groupBy(*cell, "i", "q").applyInArrow(_meet(threshold, dtype), FOUND), "found")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET
) -> DataFrame:
    """For each row vec_id, n_links, component_id, kept, by links of cosine >= threshold among the vectors met.

    Null and zero vectors and those that hold null or non-finite components are linked with nothing; vectors of different lengths aren't
    either. Rows that share an id are one node of the graph; a null id is linked with nothing, component_id null and not kept. Other
    columns aren't read; no rows give no rows. Every found pair is verified, so none below the threshold is linked; TARGET of those just at
    it are expected to be found. The result is a written table.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    doubles = dict(vectors.dtypes)[vector_col] == "array<double>"
    v = F.col(vector_col).cast("array<double>" if doubles else "array<float>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    key = F.concat_ws(":", F.size("v"), F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    read = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    with Scratch(spark) as tmp:
        fit = read.filter(fine).withColumn("key", key)
        reps = fit.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"))
        reps = tmp.written(reps, "vectors")
        widths = {r["width"]: r["n"] for r in reps.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()}
        dtype = "<f8" if doubles else "<f4"
        coded = tmp.written(_coded(reps, _indexes(reps, widths, threshold, target), dtype), "coded")
        found = _links(coded, threshold, dtype, tmp)
        counts = found.filter("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
        labels = components(found.filter("v is not null").select("u", "v"), tmp).select(F.col("node").alias("rep"), "component")
        told = reps.select("key", "rep", "copies").join(counts.hint("merge"), "rep", "left").join(labels.hint("merge"), "rep", "left")
        links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        told = tmp.written(told.select("key", "copies", links, F.coalesce("component", "rep").alias("component_id")), "told")
        linked = lookup(tmp.written(fit.select("id", "key"), "rows"), told, "key", "copies").select("id", "n_links", "component_id")
        alone = read.filter(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
        return tmp.result(linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", kept), "op9")
