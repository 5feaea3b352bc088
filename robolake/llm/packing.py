"""Packing documents into windows of a fixed number of tokens: sum-of-squares online packing.

Each task packs the documents that it reads, in their order; nothing is shuffled. A document with more
tokens than a window fills whole windows first. What remains, of s tokens, goes where the sum over all levels h of
N(h) ** 2 becomes smallest, N(h) being the number of windows filled to level h, 0 < h < window, which one array of
counts tracks: into a window at level h with h + s <= window, or into a new one. Ties take the fullest window.
Where more than OPEN windows are open, and when a task has read its rows, windows are closed by cutting: the emptiest
are poured into the fullest. So a task keeps a bounded number of windows in memory, whatever the lengths of its documents, and leaves one
with padding at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .wordcache import grouped, opened

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a task begin at its number times this.
TASK_IDS = 1 << 33
#: Most windows that a task holds open.
OPEN = 256


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class SumOfSquares:
    """Online packer. add() and close() give full windows, the last one perhaps not, as lists of pieces."""

    def __init__(self, window: int, most: int = OPEN):
        self.window, self.most, self.n_open = window, most, 0
        self.count = np.zeros(window + 1, np.int64)  # the level array; [0] and [window] stay 0
        self.open: dict[int, list[list[Piece]]] = {}

    def level(self, s: int) -> int:
        """The level to put s tokens on. Moving a window from h to h + s adds 2 * (N(h + s) - N(h)) + 2, less where an end isn't counted."""
        n, top = self.count, self.window - s
        change = 2 * (n[s:] - n[: top + 1]) + 2
        change[0] = 2 * n[s] + 1
        change[top] -= 2 * n[self.window] + 1
        there = n[: top + 1] > 0
        there[0] = True
        change[~there] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        rest = Piece(doc, 0, ids, len(ids))
        while len(rest.ids) >= self.window:
            full, rest = rest.cut(self.window)
            yield [full]
        s = len(rest.ids)
        if not s:
            return
        h = self.level(s)
        into = []
        if h:
            into = self.take(h)
        rest.ids = rest.ids.copy()  # lets go of the batch
        into.append(rest)
        if h + s == self.window:
            yield into
        else:
            self.put(h + s, into)
        while self.n_open > self.most:
            yield self.poured()

    def take(self, h: int) -> list[Piece]:
        self.count[h] -= 1
        self.n_open -= 1
        return self.open[h].pop()

    def put(self, h: int, pieces: list[Piece]) -> None:
        self.count[h] += 1
        self.n_open += 1
        self.open.setdefault(h, []).append(pieces)

    def poured(self) -> list[Piece]:
        """The fullest open window, filled up from the emptiest ones as far as they reach."""
        levels = np.flatnonzero(self.count)
        h = int(levels[-1])
        out = self.take(h)
        while h < self.window and self.n_open:
            g = int(np.argmax(self.count > 0))
            src = self.take(g)
            p = src.pop()
            if len(p.ids) > self.window - h:
                p, rest = p.cut(self.window - h)
                src.append(rest)
            out.append(p)
            h += len(p.ids)
            if src:
                self.put(g - len(p.ids), src)
        return out

    def close(self) -> Iterator[list[Piece]]:
        """All open windows, poured together by cutting; one at most isn't full."""
        while self.n_open:
            yield self.poured()


def pack_windows(
    docs: DataFrame, tokenizer_file: str, end_id: int, window: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise the texts, end_id after each document, and pack them; one row a piece (PIECES).

    Null and empty texts are packed as their end_id alone; repeated rows are packed each; a null id stays null;
    other columns aren't read; no rows give no pieces. sequence_id is the task's number times TASK_IDS plus a count,
    so a task that is run again gives the same rows. A task keeps one level array and at most OPEN open windows in memory, beside the
    batch that it reads.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, sequence = opened(tokenizer_file), SumOfSquares(window), TaskContext.get().partitionId() * TASK_IDS
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []

        def told(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for w in windows:
                offset = 0
                for p in w:
                    rows.append((p.doc, p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids)), p.total, sequence, offset))
                    offset += len(p.ids)
                sequence += 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            out = pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])
            rows.clear()
            return out

        for b in grouped(batches, 1):
            ids, ends = tokens.encode(b.column(1))
            at = 0
            for doc, upto in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                told(packer.add(doc, np.concatenate([ids[at:upto], end])))
                at = upto
            if rows:
                yield batch()
        told(packer.close())
        if rows:
            yield batch()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
