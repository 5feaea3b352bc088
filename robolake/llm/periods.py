"""Periodic runs of words: blocks that come again at the distance of a period, extended both ways.

A run is a stretch of words with smallest period q, at least max(24, 3 q) long, that no neighbouring word extends. At scale b, a power of two from 8 on,
periods from b up to 2 b are looked for (at scale 8 those from 1 up to 16). A run that long holds an aligned block of b words
together with the same block one period later; so the aligned blocks are the keys of an Aho-Corasick automaton, which is run over the
document, and a match whose distance from its block suits the scale is a seed. It is extended word by word to both sides while words one distance
apart are the same. Scales go up, so of equal stretches the smallest period is found first.

A key is a sequence of eight integers at every scale: the names of a block's eighths. At scale 8 these are word numbers; above, stretches of twice
the length get names by pairs of the names before, equal ones if and only if their words are equal. The document is then read at each
of the b / 8 offsets of that spacing. Short keys keep the automaton small, and a step over it short on periodic text.

What keeps this near n log n: only blocks all of whose 8-word parts come twice in the document are keys (told by hashes, which may only let too much
pass); a seed inside a known run whose period divides its distance is that run again; and a block inside a run of at most a third of its length
that comes again in another run of that period can only lie in a longer run if both begin, or both end, at that distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches

#: Shortest run, and how often its period must fit.
LEAST, TIMES = 24, 3
#: Smallest block: a run of LEAST words or more has an aligned one with its copy for each period below 16.
BLOCK = 8
#: Words of the blocks of one automaton; at large scales eight blocks.
SEGMENT = 1 << 16
RUNS = "array<struct<start: long, length: long, period: long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as a number, the same for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def repeated_blocks(w: np.ndarray) -> np.ndarray:
    """For each aligned block of BLOCK words whether its words may stand elsewhere too: never false where they do."""
    n = len(w) - BLOCK + 1
    h = np.zeros(n, np.uint64)
    for k in range(BLOCK):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    own = h[::BLOCK]
    if not len(twice):
        return np.zeros(len(own), bool)
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    return twice[at] == own


class Runs:
    """All runs of one document. found: (start, end) -> smallest period."""

    def __init__(self, w: np.ndarray, least: int = LEAST, times: int = TIMES):
        self.w, self.least, self.times = w, least, times
        self.found: dict[tuple[int, int], int] = {}
        self.last: dict[int, tuple[int, int]] = {}  # distance -> the stretch extended last at it
        self.names, self.width = w, 1  # names of the stretches of width words, by their first
        self.own: np.ndarray | None = None  # at each place the run that a block beginning there lies in
        self.owners: list[tuple[int, int, int]] = []

    def search(self) -> list[tuple[int, int, int]]:
        """Start, length and smallest period of all runs, by start and period."""
        n, b = len(self.w), BLOCK
        if n >= self.least:
            may = repeated_blocks(self.w)
            while self.times * b <= max(n, self.times * BLOCK) and may.any():
                self.scale(b, may)
                b *= 2
                self.rename()
                may = may[: len(may) // 2 * 2].reshape(-1, 2).all(1)  # a block is a key if both its halves are
        return sorted((s, e - s, q) for (s, e), q in self.found.items())

    def scale(self, b: int, may: np.ndarray) -> None:
        """Periods from b (1 at the smallest scale) up to 2 b, by the aligned blocks of b words in may."""
        self.last.clear()
        self.paint(b)
        blocks = np.flatnonzero(may)
        most = max(BLOCK, SEGMENT // b)
        cuts = np.flatnonzero((np.diff(blocks) > 3)) + 1  # blocks with longer gaps between them are searched apart
        for part in np.split(blocks, cuts):
            for at in range(0, len(part), most):
                self.segment(b, part[at : at + most].tolist())

    def rename(self) -> None:
        """Names of stretches of twice the width."""
        a, b = self.names[: -self.width].astype(np.int64), self.names[self.width :]
        self.names = np.unique(a * (int(self.names.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int32)
        self.width *= 2

    def paint(self, b: int) -> None:
        self.owners = [(s, e, q) for (s, e), q in self.found.items() if e - s >= b and 3 * q <= b]
        self.own = None
        if self.owners:
            self.own = np.full(len(self.w), -1, np.int32)
            for k, (s, e, _) in enumerate(self.owners):
                self.own[s : e - b + 1] = k  # a block lies in one such run at most, so nothing is painted twice

    def segment(self, b: int, blocks: list[int]) -> None:
        import ahocorasick

        lo, hi, step = 1 if b == BLOCK else b, 2 * b, self.width
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        key: dict[int, int] = {}
        for k in blocks:
            word = tuple(self.names[k * b : k * b + b : step].tolist())
            key[k] = automaton.get(word, k + 1)  # equal blocks are one key
            automaton.add_word(word, key[k])
        automaton.make_automaton()
        begin, end = blocks[0] * b, min(len(self.names), blocks[-1] * b + 3 * b)
        for first in range(begin, min(begin + step, end)):
            for last, value in automaton.iter(tuple(self.names[first:end:step].tolist())):
                i = first + (last - BLOCK + 1) * step
                k = (i - lo) // b
                while k >= 0 and i - k * b < hi:
                    if key.get(k) == value:
                        self.seed(k * b, i - k * b, b)
                    k -= 1

    def seed(self, p: int, d: int, b: int) -> None:
        """The words from p to p + b come again at p + d."""
        if self.own is not None and (k := self.own[p]) >= 0:
            s, e, q = self.owners[k]
            j = self.own[p + d]
            if j == k:
                return  # inside one run of a period that divides d
            if j >= 0:
                t, f, _ = self.owners[j]
                if d not in (t - s, f - e):
                    return
        for q in (x for x in range(1, d + 1) if d % x == 0) if b == BLOCK else (d,):
            s, e = self.last.get(q, (0, 0))
            if s <= p and p + d + b <= e:
                return
        s, e = self.back(p, d), self.on(p + b, d)
        self.last[d] = (s, e)
        if e - s >= max(self.least, self.times * d):
            self.found[s, e] = min(d, self.found.get((s, e), d))

    def on(self, x: int, d: int) -> int:
        """The end of the stretch of period d that holds x and x + d where both are the same."""
        n, step = len(self.w), 16
        while x + d < n:
            m = min(step, n - d - x)
            off = np.flatnonzero(self.w[x : x + m] != self.w[x + d : x + d + m])
            if len(off):
                return x + int(off[0]) + d
            x, step = x + m, min(step * 2, 1 << 16)
        return n

    def back(self, x: int, d: int) -> int:
        """The first place of that stretch, to the left of x."""
        step = 16
        while x > 0:
            m = min(step, x)
            off = np.flatnonzero(self.w[x - m : x] != self.w[x - m + d : x + d])
            if len(off):
                return x - m + int(off[-1]) + 1
            x, step = x - m, min(step * 2, 1 << 16)
        return 0


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when of each run only its first period is kept."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For each row its id, n_words, the runs by start and period (RUNS), and collapsed, its words without the runs' repeats, joined by spaces.

    Words are what stands between ASCII white space; least is 24 or more and times 3 or more. A null or empty text, and one of white space alone,
    has no words, no runs and an empty collapsed text. Repeated rows are told each, a null id stays null, other columns aren't read, no rows give
    no rows. One pass without a shuffle; a text is worked on alone, in memory in proportion to its words.
    """
    if least < LEAST or times < TIMES:
        raise ValueError("runs are found from 24 words and 3 periods on")
    bounded_batches(docs.sparkSession)
    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
        for b in batches:
            rows = []
            for text in b.column(1):
                words = (text.as_py() or b"").split()  # bytes split at ASCII white space alone
                runs = Runs(numbered(words), least, times).search()
                left = [words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()] if runs else words
                told = [{"start": s, "length": n, "period": q} for s, n, q in runs]
                rows.append((len(words), told, b" ".join(left).decode()))
            n, found, kept = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts gets a run: with h the CRC of the id and g = floor(h / 10), h % 10 = 0, each of the n words from a = g % n on
    becomes the original word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id has no CRC, and its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = rows.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long"))
    some = some.withColumn("g", F.floor(h / 10)).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    some = some.withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    text = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return some.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def digests(told: DataFrame) -> DataFrame:
    """Of find_runs(): the number of runs, the run of the greatest exponent (ties: smallest start, then period), and digests of all runs and of what is left."""
    best = F.expr(
        "array_sort(runs, (x, y) -> int(case when x.length * y.period <> y.length * x.period then sign(y.length * x.period - x.length * y.period)"
        " when x.start <> y.start then sign(x.start - y.start) else sign(x.period - y.period) end))[0]"
    )
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    some = told.withColumn("best", best)
    return some.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
