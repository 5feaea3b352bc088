"""Tokenisation, shards, packing and counts against the libraries and plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from robolake.llm import packing, pfor, viterbi, wordcache

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ſtraße ẞx É", "<|endoftext|> a<|ENDOFTEXT|>b", "it's don't I'LL!!", "\x1c a\x85b\xa0c", "漢字 한국어", "12,345.67 a1b2", "ΣΑΣ", "", "  ", ".,!", "éx ́"]
EDGE = [(3, "x y"), (None, "null id"), (1, None), (2, ""), (2, "same id"), (7, "long word " * 3000), (5, "x y"), (5, "x y")]


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(WORDS)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_tokens_equal_library(encode):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("abÉéßÀ÷'sS .,!?;:́İ<|>eE\n\t0ª") for _ in range(rnd.randrange(30))) for _ in range(500)]
    ids, ends = wordcache.WordTokens(WORDS, most=50).encode(pa.array([*texts, None]))
    for t, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == encode(t), t
    assert ends[-1] == ends[-2]


def test_other_tokenizers_see_whole_texts(spark):
    """A file that isn't a word tokenizer is told when it is opened: its texts go to the library whole."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(other)
    assert wordcache.by_chunks(WORDS) and not wordcache.by_chunks(other)
    with pytest.raises(ValueError):
        wordcache.WordTokens(other)
    texts = [*ODD, "two  spaces\n\nlines\tand Capitals"]
    rows = [*enumerate(texts), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: crc([*t.encode(x or "", add_special_tokens=False).ids, 7]) for i, x in rows}
    assert {r.doc_id: r.ids_crc32 for r in pfor.read_shards(pfor.write_shards(docs, other, 7)).collect()} == want
    assert {r.doc_id: r.ids_crc32 for r in packing.pack_windows(docs, other, 7, 4096).collect() if r.length == r.doc_tokens} == want


def test_shards_of_one_id_are_spread(spark):
    """Rows that share an id, or have none, are dealt over several parts and still stand in order."""
    docs = spark.range(400).selectExpr("if(id < 300, 5L, null) as doc_id", "concat('text ', lpad(cast(id * 7 % 400 as string), 4, '0')) as text").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = pfor.write_shards(docs, WORDS, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert shards.select("part").distinct().count() > 1
    rows = sorted(pfor.read_shards(shards).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(WORDS)
    texts = [r.text for r in docs.orderBy("doc_id", "text").collect()]
    assert [r.ids_crc32 for r in rows] == [crc([*t.encode(x, add_special_tokens=False).ids, 2]) for x in texts]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()


def test_long_text_in_pieces(encode, monkeypatch):
    monkeypatch.setattr(wordcache, "PIECE", 100)
    text = "some words, and others. " * 50
    ids, ends = wordcache.WordTokens(WORDS).encode(pa.array([text]))
    assert ids.tolist() == encode(text) and ends.tolist() == [len(ids)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    x = np.array(values, np.uint32)
    data = pfor.pack(x)
    assert (pfor.unpack(data) == x).all()
    for k in range(-(-len(x) // pfor.BLOCK)):
        part = x[k * pfor.BLOCK : (k + 1) * pfor.BLOCK]
        assert (pfor.block(data, k)[: len(part)] == part).all()


def test_shards(spark, encode, monkeypatch):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("doc_id", "text", "1 as payload", "2 as part")
    got = sorted((tuple(r) for r in pfor.read_shards(pfor.write_shards(docs, WORDS, 2)).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*encode(t), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert pfor.read_shards(pfor.write_shards(docs.limit(0), WORDS, 2)).count() == 0


def test_packing_whole_and_tight(spark, encode):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").filter("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id", "text", "0 as start")
    rows = packing.pack_windows(docs, WORDS, 2, 64).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc, text in texts.items():
        ids, at = [*encode(text), 2], 0
        for p in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s[:-1]]]).tolist() and sum(r.length for r in s) <= 64


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(None, None)], "doc_id long, text string")
    assert packing.pack_windows(docs, WORDS, 2, 64).count() == 4
    assert packing.pack_windows(docs.limit(0), WORDS, 2, 64).count() == 0


def test_level_is_least_sum_of_squares():
    rnd = random.Random(1)
    for _ in range(200):
        p = packing.SumOfSquares(12)
        for h in range(1, 12):
            p.count[h] = rnd.randrange(4)
        s = rnd.randrange(1, 12)

        def cost(h):
            n = p.count.copy()
            if h:
                n[h] -= 1
            if h + s < 12:
                n[h + s] += 1
            return int((n * n).sum())

        can = [h for h in range(13 - s) if h == 0 or p.count[h]]
        best = min(cost(h) for h in can)
        assert p.level(s) == max(h for h in can if cost(h) == best)


def test_close_leaves_one_open_window():
    p, out = packing.SumOfSquares(50), []
    rnd = random.Random(4)
    for i in range(300):
        out += p.add(i, np.arange(rnd.randrange(1, 120), dtype=np.uint32))
    out += p.close()
    assert sum(sum(len(x.ids) for x in w) < 50 for w in out) <= 1


@pytest.mark.parametrize("sizes", [(2500, 2501), (2049, 4095), (1, 4095), (1, 200), (3000, 9000)])
def test_open_windows_are_bounded(sizes):
    """Remainders above half a window never fit one another; still few windows stay open, no id is lost, and padding stays at one window."""
    p, rnd, seen, short, most = packing.SumOfSquares(4096), random.Random(6), {}, 0, 0
    want = {i: rnd.randint(*sizes) for i in range(6_000)}

    def take(windows):
        nonlocal short, most
        for w in windows:
            n = sum(len(x.ids) for x in w)
            assert 0 < n <= 4096
            short += n < 4096
            for x in w:
                seen.setdefault(x.doc, []).append((x.start, len(x.ids)))
        most = max(most, p.n_open)
        assert p.n_open == sum(map(len, p.open.values())) == p.count.sum() <= packing.OPEN

    for i, n in want.items():
        take(p.add(i, np.arange(n, dtype=np.uint32)))
    take(p.close())
    assert short <= 1 and most > 1
    for i, pieces in seen.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == want[i]


def test_counts_of_empty_tables_and_repeated_rows(spark):
    pieces = viterbi.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, "a word"), (1, "a word"), (None, None), (2, "")], "doc_id long, text string").selectExpr("*", "'c' as n_chars")
    got = sorted(((r.doc_id, r.n_chars, r.n_tokens) for r in viterbi.count_tokens(docs, pieces).collect()), key=str)
    assert got[0] == got[1] and got[0][:2] == (1, 6) and got[2:] == [(2, 0, 0), (None, 0, 0)]
    assert viterbi.count_tokens(docs.limit(0), pieces).count() == 0


def test_counts_equal_library(spark):
    pieces = viterbi.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)])
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcETAth漢字한  \n▁é𓀀𓀁.,1") for _ in range(rnd.randrange(40))) for _ in range(1500)] + ["word " * 5000]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (None, "a")], "doc_id long, text string").selectExpr("*", "5 as n_tokens")
    got = {r.doc_id: r.n_tokens for r in viterbi.count_tokens(docs, pieces).collect()}
    assert got[-1] == 0 and got[None] == 1
    for i, x in enumerate(texts):
        assert got[i] == len(t.encode(x).ids), x
