"""Near-duplicates by min-max hashing over word shingles, every link confirmed on the full shingle sets.

Signature: under each of PERMUTATIONS hash functions both the smallest and the largest value of a set are kept. Each equals
that of another set with probability J, their Jaccard similarity; so one evaluation gives two values. The values form
BANDS bands of ROWS. Two sets of similarity 0.75 share no band with probability (1 - 0.75**5)**40, about 2 in 100,000;
of 0.8, 1 in 10 million.

Only sets that share a band with another are compared, and never all pairs of a bucket. Documents of equal sets are one
set first. Then each bucket's sets are compared with its pivot. Where a bucket still lies in several components, the
sets outside the largest one meet all others that its sets share buckets with, in bounded pairs of blocks that only links leave; in
a block a prefix filter finds the pairs that are counted: those that share one of their rarest shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, lookup, shared_keys
from .components import components, roots
from .wordcache import grouped, numbered

SHINGLE = 5
PERMUTATIONS, BANDS, ROWS = 100, 40, 5
#: Similarity of linked sets as a whole percentage.
PERCENT = 75
#: Ids of sets to be compared are broadcast up to this number, 8 MB; more of them are joined by a shuffle.
FEW = 1_000_000
#: Shingles in a block of a family, about: a sixteenth of the family's, but within these limits.
BLOCK = (20_000, 200_000)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for a text of fewer than k words, none for one without words."""
    import xxhash

    chunks, number, ends = numbered(pc.ascii_lower(pc.fill_null(texts, "")))
    raw = chunks.cast(pa.binary()).to_pylist()
    word = np.array([xxhash.xxh3_64_intdigest(c) for c in raw], np.uint64)
    there = np.array([bool(c) for c in raw], bool)[number] if raw else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(there)])[ends]
    h = mixed(word[number][there]) if raw else np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k):
        rolled = rolled * step + h[j : len(h) - k + 1 + j]
    rolled = mixed(rolled)
    at = 0
    for e in ends.tolist():
        if e - at >= k:
            yield np.unique(rolled[at : e - k + 1])
        elif e > at:
            one = np.array([e - at], np.uint64)
            for w in h[at:e]:
                one = one * step + w
            yield mixed(one)
        else:
            yield np.zeros(0, np.uint64)
        at = e


class MinMax:
    """Band keys of sets. The functions are multiplications of mixed hashes by odd numbers drawn from a fixed seed."""

    def __init__(self, permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        if 2 * permutations != bands * rows:
            raise ValueError("two values a permutation have to fill the bands")
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shape = (bands, rows)

    def signature(self, s: np.ndarray) -> np.ndarray:
        low = high = None
        for at in range(0, len(s), 2048):
            v = s[at : at + 2048, None] * self.factor
            a, b = v.min(0), v.max(0)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.concatenate([low, high])

    def keys(self, s: np.ndarray) -> np.ndarray:
        v = self.signature(s).reshape(self.shape)
        key = np.arange(1, len(v) + 1).astype(np.uint64)
        for j in range(self.shape[1]):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
        return key.view(np.int64)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax()
        for b in grouped(batches, 1):
            size, digest, keys = [], [], []
            for s in shingle_sets(b.column(1), k):
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(minmax.keys(s) if len(s) else None)
            columns = [b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "set", "bands"])

    return docs.mapInArrow(run, "id long, n long, set binary, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, 1):
            sets = pa.array([s.view(np.int64) for s in shingle_sets(b.column(1), k)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _near_sizes(a: str, b: str, percent: int):
    """A link needs sets of like sizes."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) of ids, a < b -> with j, the similarity, and linked; counted on the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - F.col("common")
    linked = F.col("common") * 100 >= union * percent
    return both.withColumn("common", common).select("a", "b", (F.col("common") / union).alias("j"), linked.alias("linked"))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """Links between the components of sets that share buckets: a table (u, v) of a spanning forest for each pair of blocks.

    Sets that share a bucket which lies in several components, directly or by others, form a family. In each, all sets outside its
    largest component meet all of its sets, in pairs of blocks by hash, of a size within BLOCK, one group each.
    """
    named = labels.select(F.col("node").alias("id"), "component")
    rows = tmp.written(members.join(named, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "labelled")
    by_key = rows.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("m"))
    open_ = tmp.written(by_key.filter("c1 <> c2").select("key", "m"), "open")
    mixed_ = tmp.written(lookup(rows, open_, "key", "m").select("id", "n", "c", "pivot"), "mixed")
    families = components(mixed_.select(F.col("id").alias("u"), F.col("pivot").alias("v")).filter("u <> v"), tmp)
    every = mixed_.select("id", "n", "c").distinct().join(families.select(F.col("node").alias("id"), F.col("component").alias("family")), "id")
    every = tmp.written(every.join(sets, "id"), "families")
    by_c = every.groupBy("family", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    largest = F.struct("m", "c")
    main = by_c.groupBy("family").agg(F.max(largest).alias("x"), F.max_by("n", largest).alias("main_n"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    size = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.col("n") / 16))
    blocks = lambda n: F.greatest(F.ceil(n / size), F.lit(1))
    counts = [blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("main_n")).alias("out_blocks")]
    deal = tmp.written(main.select("family", F.col("x.c").alias("main"), "m", *counts), "deal")
    placed = lookup(every, deal, "family", "m")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = placed.filter("c <> main").withColumn("i", spread("out_blocks")).withColumn("j", each("all_blocks")).withColumn("asks", F.lit(True))
    inside = placed.withColumn("j", spread("all_blocks")).withColumn("i", each("out_blocks")).withColumn("asks", F.lit(False))
    met = outside.unionByName(inside).select("family", "i", "j", "asks", "id", "c", "shingles")
    return tmp.written(met.groupBy("family", "i", "j").applyInArrow(_meet(percent), "u long, v long"), "across")


def _meet(percent: int):
    """Links between the sets that ask and the others, in different components, as a spanning forest.

    Prefix filter: with all shingles of the group in one order, rarest first, two sets of that similarity share one of the first
    n - ceil(n * percent / 100) + 1 of both. Only others that share such a shingle with the asking set, have a like size
    and lie in another component are counted, on their whole sets.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids, c = np.asarray(t.column("asks")), np.asarray(t.column("id")), np.asarray(t.column("c"))
        lists = t.column("shingles").combine_chunks()
        ends = np.asarray(lists.offsets)
        size = np.diff(ends)
        distinct, flat, often = np.unique(np.asarray(lists.values)[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
        ends = ends - ends[0]
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(distinct))
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.lexsort((rank[flat], owner))
        flat = rank[flat][order]  # each set's shingles, rarest first
        prefix = size - -(-size * percent // 100) + 1
        leads = (np.arange(len(flat)) - np.repeat(ends[:-1], size) < np.repeat(prefix, size)) & ~asks[owner]
        posts = np.flatnonzero(leads)
        posts = posts[np.argsort(flat[posts], kind="stable")]
        holders = owner[posts]
        begin = np.searchsorted(flat[posts], np.arange(len(distinct) + 1))
        mark = np.zeros(len(distinct), np.int64)
        a, b = [], []
        for x in np.flatnonzero(asks) if len(posts) else ():
            own = flat[ends[x] : ends[x + 1]]
            lead = own[: prefix[x]]
            near = np.unique(holders[_spans(begin[lead], begin[lead + 1])])
            like = np.minimum(size[near], size[x]) * 100 >= np.maximum(size[near], size[x]) * percent
            near = near[like & (c[near] != c[x])]
            if not len(near):
                continue
            mark[own] = 1
            common = np.add.reduceat(mark[flat[_spans(ends[near], ends[near + 1])]], np.cumsum(size[near]) - size[near])
            mark[own] = 0
            hit = near[common * 100 >= (size[near] + size[x] - common) * percent]
            a.append(np.full(len(hit), x))
            b.append(hit)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        low = roots(len(ids), a, b)
        hung = np.flatnonzero(low != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[hung], pa.int64()), "v": pa.array(ids[low[hung]], pa.int64())})

    return run


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end, one span after the other."""
    n = end - begin
    upto = np.cumsum(n)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - upto + n, n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """For each row doc_id, n_shingles, component_id, kept: sets with 100 * intersection >= percent * union are linked.

    A-Z are lower-cased, words are runs of other characters than ASCII white space. A text of fewer than k words has its whole
    sequence as one shingle; null texts and those without words have none and are linked with nothing. A component's smallest id is kept.
    Rows that share an id are one node of the graph; a null id is linked with nothing, component_id null and not kept. Other
    columns aren't read; no rows give no rows. Shingles are compared by 64-bit hashes. The result is a written table.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as tmp:
        rows = tmp.written(_signatures(texts, k), "signatures")
        full = rows.filter("n > 0 and id is not null")
        one = full.groupBy("set").agg(F.min(F.struct("id", "n", "bands")).alias("r"), F.count(F.lit(1)).alias("copies"))
        groups = tmp.written(one.select("set", F.col("r.id").alias("rep"), "r.n", "r.bands", "copies"), "sets")
        banded = groups.select(F.col("rep").alias("id"), "n", F.explode(F.array_distinct("bands")).alias("key"))
        members = tmp.written(shared_keys(banded, tmp), "members")
        ids = tmp.written(members.select("id").distinct(), "ids")
        asked = F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge")
        sets = tmp.written(_sets(texts.join(asked, "id", "left_semi"), k), "shingles")

        first = members.filter(F.col("id") != F.col("pivot")).filter(_near_sizes("n", "pivot_n", percent)).select(*_pair("id", "pivot")).distinct()
        known = tmp.written(_compare(first, sets, percent), "known")
        links = known.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        more = _across(members, components(links, tmp), sets, percent, tmp)
        labels = components(links.unionByName(more), tmp)

        named = labels.select(F.col("node").alias("rep"), "component")
        settled = groups.join(named, "rep", "left").select("set", F.coalesce("component", "rep").alias("component_id"), "copies")
        settled = tmp.written(settled, "settled")
        linked = lookup(full.select("id", "n", "set"), settled, "set", "copies").select("id", "n", "component_id")
        alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
        told = linked.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept)
        return tmp.result(told, "op4")
