"""Runs against a plain search of every period, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from robolake.llm import registry
from robolake.llm.periods import Runs, digests, find_runs, planted

SCHEMA = "doc_id long, text string, runs int, collapsed string, n_words string, words string"


def plain(w, least=24, times=3):
    n, found = len(w), {}
    for d in range(1, n // times + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and w[j] == w[j + d]:
                j += 1
            if j > i and j + d - i >= max(least, times * d):
                found.setdefault((i, j + d), d)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found(w):
    return Runs(np.array(w, np.int32)).search()


@st.composite
def texts(draw):
    """Words from few letters with stretches that are made periodic one after the other, and some single words changed again."""
    n, kinds = draw(st.integers(0, 300)), draw(st.sampled_from([1, 2, 3, 50]))
    rng = random.Random(draw(st.integers(0, 1 << 30)))
    w = [rng.randrange(kinds) for _ in range(n)]
    for p in draw(st.lists(st.integers(1, 100), max_size=6)):
        if n > p:
            s = rng.randrange(n - p)
            for i in range(s + p, rng.randint(s + p, n)):
                w[i] = w[i - p]
            if rng.random() < 0.5:
                w[rng.randrange(n)] = rng.randrange(kinds + 1)
    return w


@settings(max_examples=400, deadline=None)
@given(texts())
def test_equals_plain(w):
    assert found(w) == plain(w)


@pytest.mark.parametrize("q", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100])
def test_shortest_runs_and_just_below(q):
    least = max(24, 3 * q)
    word = [i + 1 for i in range(q)]
    for off in range(0, 20, 3):
        w = [-1 - i for i in range(off)] + (word * least)[:least]
        assert found([*w, 0]) == [(off, least, q)] and found([*w[:-1], 0]) == []


def test_hard_texts_take_no_square_time():
    rng = random.Random(1)
    fibonacci = ["a", "b"]
    while len(fibonacci[1]) < 60_000:
        fibonacci = [fibonacci[1], fibonacci[1] + fibonacci[0]]
    stretches = [x for k in range(60) for x in [0] * rng.randint(900, 1100) + [1 + k % 2]]
    half = [rng.randrange(9000) for _ in range(20_000)]
    began = time.time()
    assert found([5] * 60_000) == [(0, 60_000, 1)]
    assert all(n >= 3 * q for _, n, q in found([ord(c) for c in fibonacci[1]]))
    assert len(found(stretches)) >= 60 and found(half * 3) == [(0, 60_000, 20_000)]
    assert time.time() - began < 60


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    out = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
    left = sha(" ".join(w for i, w in enumerate(words) if i not in out))
    return (doc_id, len(runs), s, length, q, None if s is None else 1000 * length // q, lines, left)


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 120)))) for i in range(400)]
    rows += [(400, "x y z " * 9), (401, "q\t" * 30 + "r s t u " * 8), (402, "ä b c " * 12), (403, "tic tac " * 12 + "toc " * 24), (404, "one two " * 15 + "x " * 30)]
    rows += [(20, None), (None, "a b " * 20), (None, None), (5, " \n "), (6, ""), (7, "k " * 4000), (7, "k " * 4000), (-8, "m n o " * 20)]
    spark.createDataFrame([(i, t, 1, "c", "n", "w") for i, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = told(registry.QUERIES["op13_periods"](spark, str(tmp_path)))
    assert got == sorted((contract(*r) for r in rows), key=str)


def test_operator_gives_runs_and_texts(spark):
    df = spark.createDataFrame([(1, "p " + "a b " * 14, 1, "c", "n", "w")], SCHEMA)
    r = find_runs(df).first()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (29, [(1, 28, 2)], "p a b")
    assert find_runs(df.limit(0)).count() == 0 and digests(find_runs(planted(df.limit(0)))).count() == 0
    with pytest.raises(ValueError, match="24 words"):
        find_runs(df, least=10)
