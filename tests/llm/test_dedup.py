"""Exact and near duplicates, components, and near vectors against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from robolake.llm import components, exact, minhash, multiindex
from robolake.llm.common import Scratch, lookup, shared_keys


def spaced(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture
def index(spark, tmp_path):
    return exact.DigestIndex(spark, f"t{abs(hash(str(tmp_path)))}", str(tmp_path / "index"), 3)


EDGE = [(5, "a  b"), (2, "a\tb"), (9, "a\n\x0bb"), (3, None), (4, ""), (1, " "), (8, "A b"), (6, "x" * 100_000), (7, "x" * 100_000), (10, "a\xa0b")]


def test_exact_edges(spark, index):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", "1 as keep_id", "2 as digest")
    got = {r.doc_id: r for r in index.ingest(docs).collect()}
    groups: dict = {}
    for i, t in EDGE:
        groups.setdefault(spaced(t), []).append(i)
    for i, t in EDGE:
        g = groups[spaced(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(spaced(t).encode()).hexdigest())


def test_exact_later_batches(spark, index):
    first = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c"), (4, "b ")], "doc_id long, text string")
    assert index.ingest(first).filter("kept").count() == 2
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(second).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False), 4: (4, True)}
    assert {r.doc_id for r in index.ingest(second).filter("kept").collect()} == set()
    assert index.table().count() == 4
    assert index.ingest(second.limit(0)).count() == 0


def test_exact_batch_again(spark, index):
    """A batch that is taken again under its name, as after a loss, gets the same answer, whatever part of it the index has already."""
    earlier = spark.createDataFrame([(50, "a"), (51, "b")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    rows = lambda df: sorted((str(tuple(r)) for r in df.collect()))
    index.ingest(earlier, "first")
    index.ingest(docs.filter("doc_id = 4 or doc_id = 1"), "second")  # the part that was appended before the loss
    told = rows(index.ingest(docs, "second"))
    assert told == rows(index.ingest(docs, "second"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.ingest(docs, "second").collect()} == {(1, 50, False), (2, 2, True), (3, 2, False), (4, 4, True), (None, None, True)}
    assert index.table().count() == 5 and not any(r.kept for r in index.ingest(docs, "third").collect())
    index.drop()
    assert index.name not in {t.name for t in spark.catalog.listTables()}


def test_exact_index_keeps_its_buckets(spark, index):
    """Opened again under another name and shuffle setting, as a later application does, it keeps nothing twice."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert index.ingest(docs, "one").filter("kept").count() == 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact.DigestIndex(spark, index.name + "_again", index.path)
        assert again.buckets == 3 and again.ingest(docs, "two").filter("kept").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in (dict(name=index.name + "_x", path=index.path, buckets=5), dict(name=index.name, path=index.path + "_new", buckets=5)):
        with pytest.raises(ValueError, match="buckets"):
            exact.DigestIndex(spark, **other)
    docs.write.parquet(index.path + "_other")
    with pytest.raises(ValueError, match="no index"):
        exact.DigestIndex(spark, index.name + "_y", index.path + "_other")


def test_exact_anti_join_meets_a_filled_index(spark, index):
    """Bucketed side: sorted and not shuffled."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    index.ingest(docs, "one")
    groups = exact.digests(docs.filter("doc_id > 50")).groupBy("digest").agg({"doc_id": "min"})
    new = index.new_digests(groups, "two")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert new.count() == 0 and "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1


def test_exact_counts_over_batches(spark, index):
    first = exact.digests(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    second = exact.digests(spark.createDataFrame([(4, "a"), (5, "c"), (None, "c"), (None, "d")], "doc_id long, text string"))
    for _ in range(2):  # taken again, nothing is counted twice
        index.add(first, "first")
        index.add(second, "second")
    with Scratch(spark) as tmp:
        got = index.judge(tmp.written(first.unionByName(second), "t")).collect()
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str)
    assert rows == sorted([(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (4, 1, 3, False), (5, 5, 2, True), (None, 5, 2, False), (None, None, 1, True)], key=str)


@pytest.mark.parametrize("rows", [EDGE, [], [(None, "a"), (None, "a"), (None, None)], [(7, "a")], [(1, "a"), (1, "a"), (1, "b"), (9, "b "), (None, "b\t")]])
def test_exact_in_two_batches(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, keep_id int, digest string")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(spaced(t), []).append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(i, least[spaced(t)], len(groups[spaced(t)]), i == least[spaced(t)]) for i, t in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.dedup(docs).collect()), key=str) == sorted(want, key=str)


def test_exact_repeated_and_null_ids(spark, index):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.ingest(docs).collect()), key=str)
    assert got == [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)]


def test_lookup_hot_and_cold(spark):
    with Scratch(spark) as tmp:
        left = tmp.written(spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id div 2 as string)) as k"), "t")
        right = tmp.written(left.groupBy("k").count(), "t")
        got = lookup(left, right, "k", "count")
        assert got.count() == 3000 and got.filter("k = 'hot'").select("count").distinct().first()[0] == 1000


@pytest.mark.parametrize("few", [0, components.FEW])
def test_near_vectors_with_stars(spark, few, monkeypatch):
    """Links, cells and components by shuffles, as for large inputs, and by broadcast."""
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components.components, "__defaults__", (few,))
    monkeypatch.setattr(multiindex, "FEW", few)
    rng = np.random.default_rng(4)
    v = [(c + 0.05 * rng.standard_normal(8)).tolist() for c in rng.standard_normal((5, 8)) for _ in range(8)]
    got = multiindex.near_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()
    want = near_vectors_brute(v)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def near_vectors_brute(v):
    """Number of links and component of each vector; vectors of different lengths aren't linked."""
    linked = []
    for width in {len(x) for x in v if x}:
        at = [i for i, x in enumerate(v) if x and len(x) == width and all(y is not None and np.isfinite(y) for y in x) and any(x)]
        x = np.array([v[i] for i in at], float).reshape(len(at), width)
        n = np.linalg.norm(x, axis=1)
        a, b = np.nonzero(np.tril((x @ x.T) / (n[:, None] * n) >= 0.95, -1))
        linked += [(at[i], at[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    count = dict.fromkeys(range(len(v)), 0)
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    component = brute_components(range(len(v)), linked)
    return {i: (count[i], component[i]) for i in count}


def test_near_vectors_of_other_lengths(spark):
    """Each length is a space of its own; doubles are taken as they are."""
    rng = np.random.default_rng(5)
    v = [[3.0, 4.0], [6.0, 8.0], [1.0, 0.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1e-300, 2e-300, 3e-300], [5.0], [2.0], [-2.0], [], None]
    v += [(c + 0.02 * rng.standard_normal(12)).tolist() for c in rng.standard_normal((4, 12)) for _ in range(5)]
    v += [[float("inf")] * 2, [None, 1.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.near_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()}
    want = near_vectors_brute([x if x is None or max(map(abs, (y for y in x if y is not None)), default=1) > 1e-200 else [y * 1e300 for y in x] for x in v])
    assert {i: want[i] for i in want if i != 5} == {i: got[i] for i in got if i != 5}


def test_near_vectors_recall(spark, monkeypatch):
    """Pairs planted just at the threshold among many other vectors, with codebooks of many cells."""
    monkeypatch.setattr(multiindex, "IN_CELL", 20)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(1)[:, None] * x
    off /= np.linalg.norm(off, axis=1)[:, None]
    cos = rng.uniform(0.951, 0.955, (len(x), 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * off])
    v = np.concatenate([v, rng.standard_normal((2000, 32))])
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in multiindex.near_vectors(rows).collect()}
    n = np.linalg.norm(v, axis=1)
    wanted = ((v @ v.T) / (n[:, None] * n) >= 0.95).sum(1) - 1
    assert all(got[i] <= wanted[i] for i in got) and wanted.sum() >= 3000
    assert sum(got.values()) >= 0.99 * wanted.sum()


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components(spark, few):
    rnd = random.Random(few)
    links = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(180)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = brute_components({x for l in links for x in l}, links)
    with Scratch(spark) as tmp:
        got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long"), tmp, few).collect()}
    assert got == {n: c for n, c in want.items() if any(n in l and l[0] != l[1] for l in links)}


def shingles(t, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_brute(docs, percent=75):
    s = {i: shingles(t) for i, t in docs}
    ids = sorted(s)
    linked = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return s, brute_components(ids, linked)


def test_near_duplicates_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: "w%d" % rnd.randrange(5000)
    base = [[word() for _ in range(rnd.randrange(20, 90))] for _ in range(8)]
    docs = []
    for _ in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            w[rnd.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [None, "", " \n", "one two", "One  TWO", "a b c d e", "passage " + " ".join(base[0][:12]), "É é " * 3, "é é " * 3, "many words " * 4000]
    docs = list(enumerate(docs))
    sets, want = near_brute(docs)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as bands")).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())


def test_near_family_of_blocks(spark, monkeypatch):
    """A family that straddles the threshold, over many small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", (300, 300))
    rnd = random.Random(3)
    base = ["b%d" % i for i in range(60)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(60)] = "r%d" % rnd.randrange(10**6)
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_brute(docs)[1]


def test_shared_keys_of_a_key_over_many_tasks(spark):
    """A key with two thirds of the rows, keys of two rows and single ones, in more and in fewer tasks than keys."""
    rows = [(7, i, 1) for i in range(2000)] + [(i // 2 * 2, 5000 + i, 2) for i in range(10, 800)] + [(10_000 + i, i, 3) for i in range(300)]
    random.Random(1).shuffle(rows)
    by: dict = {}
    for k, i, _ in rows:
        by.setdefault(k, set()).add(i)
    df = spark.createDataFrame(rows, "key long, id long, n long")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            with Scratch(spark) as tmp:
                got = shared_keys(df, tmp).collect()
            members: dict = {}
            for r in got:
                members.setdefault(r.key, set()).add(r.id)
                assert r.pivot in by[r.key] and r.pivot <= r.id
            assert members == {k: ids for k, ids in by.items() if len(ids) > 1}
            whole = brute_components([(r.key, r.id) for r in got], [((r.key, r.id), (r.key, r.pivot)) for r in got])
            assert all(low[1] == min(by[k]) for (k, _), low in whole.items())
            assert len(got) <= sum(map(len, members.values())) + 2 * int(parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_near_family_compares_few_pairs(spark):
    """2,000 sets around the threshold: groups of blocks are bounded, and the prefix filter leaves out sets that share no rare shingle."""
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(9)
    sets, base = [], rng.integers(1, 2**62, 120)
    for i in range(400):
        s = np.concatenate([base[: rng.integers(100, 120)], rng.integers(1, 2**62, rng.integers(1, 30))]) if i % 2 else rng.integers(1, 2**62, 100)
        sets.append(np.unique(s))
    n = len(sets)
    asks = np.arange(n) % 4 == 1
    ids = np.concatenate([np.flatnonzero(asks), np.arange(n)])
    t = pa.table({"asks": [True] * int(asks.sum()) + [False] * n, "id": ids, "c": ids, "shingles": [sets[i] for i in ids]})
    got = minhash._meet(75)(t)
    linked = [(i, j) for i in np.flatnonzero(asks).tolist() for j in range(n) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert len(linked) > 50
    want, have = brute_components(range(n), linked), brute_components(range(n), list(zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True)))
    assert want == have


@pytest.mark.parametrize("few", [0, minhash.FEW])
def test_near_duplicates_without_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(components.components, "__defaults__", (few,))
    docs = [(i, " ".join(f"w{(i // 3) * 100 + k}" for k in range(40 + i % 3))) for i in range(24)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_brute(docs)[1] == {i: i // 3 * 3 for i in range(24)}


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minmax_is_unbiased():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 300, np.uint64)
    a, b = np.sort(pool[:200]), np.sort(pool[100:])
    m = [minhash.MinMax(seed=s) for s in range(30)]
    assert np.mean([(x.signature(a) == x.signature(b)).mean() for x in m]) == pytest.approx(1 / 3, abs=0.03)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    v = [c + 0.08 * rng.standard_normal(16) for c in centres for _ in range(25)] + list(rng.standard_normal((150, 16)))
    v = [x.astype(np.float32).astype(float).tolist() for x in v]
    v += [v[0], v[0], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], []]
    rows = list(enumerate(v))
    got = {r.vec_id: r for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "3 as label", "1 as cell")).collect()}
    fine = [i for i, x in rows if x and len(x) == 16 and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    x = np.array([v[i] for i in fine])
    n = np.linalg.norm(x, axis=1)
    hit = (x @ x.T) / (n[:, None] * n) >= 0.95
    linked = [(fine[a], fine[b]) for a in range(len(fine)) for b in range(a) if hit[a, b]]
    want = brute_components(range(len(v)), linked)
    count = dict.fromkeys(range(len(v)), 0)
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(count.values())
    assert all(got[i].n_links <= count[i] for i in count)
    assert sum(got[i].component_id == want[i] for i in want) >= 0.98 * len(want)
    assert all(got[i].n_links == 0 and got[i].kept for i in set(range(len(v))) - set(fine))


def test_near_vectors_edges(spark):
    t = "vec_id long, embedding array<float>"
    assert multiindex.near_vectors(spark.createDataFrame([], t)).count() == 0
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in multiindex.near_vectors(spark.createDataFrame([(4, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], t)).collect()), key=str)
    assert got == [(2, 1, 2, True), (4, 1, 2, False), (None, 0, None, False)]
