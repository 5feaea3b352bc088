"""Near-duplicate classes against all pairs, and families of which no pairs are made."""

from __future__ import annotations

import random

import pytest

from robolake.functions.scratch import Rounds
from robolake.operators import similar


def brute(docs, percent):
    """doc -> class, cluster, links; and class -> similar classes, smallest of them and itself."""
    sets = {i: frozenset(t.split()) for i, t in docs if t and t.split()}
    first: dict = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    of = {i: first[s] for i, s in sets.items()}
    reps = {i: s for s, i in first.items()}
    near = {i: [j for j in reps if j != i and 100 * len(reps[i] & reps[j]) >= percent * len(reps[i] | reps[j])] for i in reps}
    copies = {i: sum(c == i for c in of.values()) for i in reps}
    cluster = {i: i for i in reps}
    changed = True
    while changed:
        changed = False
        for i in reps:
            low = min([cluster[i], *[cluster[j] for j in near[i]]])
            if low < cluster[i]:
                cluster[i], changed = low, True
    classes = {(i, of[i], cluster[of[i]], copies[of[i]] - 1 + sum(copies[j] for j in near[of[i]])) for i in sets}
    return classes, {(i, len(n), min([i, *n])) for i, n in near.items() if n}


def check(spark, docs, percent):
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    classes, near = brute(docs, percent)
    assert {tuple(r) for r in similar.similar_classes(df, "id", "text", percent).select("id", "class", "cluster", "n_links").collect()} == classes
    assert {tuple(r) for r in similar.similar_representatives(df, "id", "text", percent).collect()} == near


@pytest.mark.parametrize("percent", [60, 80])
def test_small_sets(spark, percent):
    rnd = random.Random(percent)
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(9)))) for i in range(90)] + [(99, None), (98, "  \n"), (97, "")]
    check(spark, docs, percent)


def test_families_of_every_width(spark):
    """Copies with few and with many changed words, so that the triangle inequality says yes, no and nothing."""
    rnd = random.Random(7)
    base = [[f"w{rnd.randrange(400)}" for _ in range(50)] for _ in range(5)]
    docs = []
    for i in range(220):
        words = list(base[i % 5])
        for _ in range(rnd.choice((0, 1, 2, 3, 5, 8, 12))):
            words[rnd.randrange(50)] = f"x{rnd.randrange(60)}"
        docs.append((i, " ".join(words)))
    check(spark, docs, 80)


def test_a_large_family_makes_no_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    docs = [(1000 + i, " ".join([*words[:k], f"new{i}", *words[k + 1 :]])) for i in range(400) for k in [rnd.randrange(120)]]
    docs += [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame(docs, "id long, text string")
    with Rounds(spark) as rounds:
        sets = similar.token_sets(df, "id", "text").withColumnRenamed("set", "s").selectExpr("id", "tokens", "size(tokens) as n", "1 as copies")
        sets = rounds.written(sets)
        postings = similar._postings(sets, rounds, 0.6)
        member = similar._families(sets, postings, rounds, 80)
        roots = member.groupBy("root").agg({"d": "max"}).toDF("id", "rho")
        assert roots.filter("id >= 1000").count() == 1
        assert similar._root_pairs(sets, postings, roots, 80).filter("x >= 1000 or y >= 1000").count() < 100
    got = {r["id"]: (r["n_similar"], r["smallest"]) for r in similar.similar_representatives(df, "id", "text").collect()}
    assert all(got[1000 + i] == (399, 1000) for i in range(400))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a a"), (3, None), (None, "a b"), (None, "q")], "id long, text string")
    got = sorted(((r["id"], r["class"], r["cluster"], r["n_links"]) for r in similar.similar_classes(df, "id", "text").filter("class = 1").collect()), key=str)
    assert got == sorted([(1, 1, 1, 2), (2, 1, 1, 2), (None, 1, 1, 2)], key=str)
    assert similar.similar_classes(df.limit(0), "id", "text").count() == 0 and similar.similar_representatives(df.limit(0), "id", "text").count() == 0


def check_pairs(spark, docs, percent):
    """Every pair of different sets with its similarity, and every text under its set."""
    sets = {i: frozenset(t.split()) for i, t in docs if t and t.split()}
    first: dict = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {("member", first[s], i, 1.0) for i, s in sets.items()}
    for s, x in first.items():
        want |= {("pair", x, y, len(s & t) / len(s | t)) for t, y in first.items() if x < y and 100 * len(s & t) >= percent * len(s | t)}
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    got = [tuple(r) for r in similar.similar_pairs(df, "id", "text", percent).select("kind", "x", "y", "jaccard").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    return sum(k == "pair" for k, *_ in got)


@pytest.mark.parametrize("block", [3, 256])
@pytest.mark.parametrize("percent", [60, 80])
def test_pairs_of_families_and_their_members(spark, monkeypatch, percent, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rnd = random.Random(11)
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(9)))) for i in range(120)]
    base = [[f"w{rnd.randrange(400)}" for _ in range(50)] for _ in range(3)]
    for i in range(150):
        words = list(base[i % 3])
        for _ in range(rnd.choice((0, 0, 1, 2, 3, 5, 8, 12))):
            words[rnd.randrange(50)] = f"x{rnd.randrange(60)}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(2000, None), (2001, " \n"), (2002, "")]
    assert check_pairs(spark, docs, percent) > 500


def test_near_lists_each_link_and_each_text(spark, sf):
    """c05_near gives the pairs themselves, not only how many a set has."""
    from robolake.plans import data

    got = data.c05_near(spark, sf)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    classes, near = brute(docs, 80)
    assert {(r["y"], r["x"]) for r in got.filter("kind = 'member'").collect()} == {(i, c) for i, c, *_ in classes}
    ends = [i for r in got.filter("kind = 'pair'").collect() for i in (r["x"], r["y"])]
    assert {i: ends.count(i) for i in ends} == {i: n for i, n, _ in near}


def test_pairs_without_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "b a"), (None, "q"), (3, "a b c d e"), (4, "a b c d e f")], "id long, text string")
    got = {tuple(r) for r in similar.similar_pairs(df, "id", "text").collect()}
    assert {r for r in got if r[0] == "pair"} == {("pair", 3, 4, 5 / 6)} and ("member", 1, None, 1.0) in got and len(got) == 6
    assert similar.similar_pairs(df.limit(0), "id", "text").count() == 0


def test_bitmaps_of_large_sets(spark, monkeypatch):
    """Large sets that share rare tokens but are far from each other don't get to a comparison of tokens; those that are close do."""
    monkeypatch.setattr(similar, "BITS", 64)
    rnd = random.Random(5)
    common = [f"c{i}" for i in range(2500)]
    docs = []
    for i in range(60):
        words = rnd.sample(common, rnd.choice((20, 150, 300, 900))) + [f"r{i % 6}-{j}" for j in range(3)]
        docs.append((i, " ".join(words)))
        for j in (1, 2, 3):
            cut = len(words) * rnd.choice((0, 2, 10, 21)) // 100
            docs.append((100 * j + i, " ".join(words[cut:] if j < 3 else [*words, *(f"n{i}-{m}" for m in range(cut))])))
    check(spark, docs, 80)
    assert check_pairs(spark, docs, 80) > 50
    df = spark.createDataFrame(docs, "id long, text string")
    with Rounds(spark) as rounds:
        _, _, sets = similar._distinct(df, "id", "text", rounds)
        postings = similar._postings(sets, rounds, 0.6)
        size = {r["id"]: len(r["bits"]) * 64 for r in postings.collect()}
        assert all(size[r["id"]] >= max(64, 2 * r["n"]) for r in postings.collect()) and len(set(size.values())) > 4
        every = postings.select(similar.F.col("id").alias("x")).crossJoin(postings.select(similar.F.col("id").alias("y"))).filter("x < y")
        near = {(r["x"], r["y"]) for r in similar._close(every, postings, "x", "y", similar.F.lit(0.8)).collect()}
    held = {i: set(t.split()) for i, t in docs}
    alike = lambda x, y: len(held[x] & held[y]) / len(held[x] | held[y])
    far = [(x, y) for x in size for y in size if x < y and alike(x, y) < 0.5 and min(len(held[x]), len(held[y])) > 500]
    assert far and not near & set(far)
    assert {(x, y) for x in size for y in size if x < y and alike(x, y) >= 0.8} <= near
