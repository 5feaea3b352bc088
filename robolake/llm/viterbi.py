"""Token counts under a unigram tokenizer without tokens: count-only Viterbi.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at each place of a chunk; dynamic programming carries the best
score so far and the number of pieces behind it. Ties follow the tokenizers library: at each place a later way
replaces an earlier one only if it scores strictly higher, ways being tried by their start. A place that no one-character
piece covers gets the unknown piece, ten below the worst score, and neighbouring unknown pieces count as one.

A text's chunks, runs of other bytes than ASCII white space with the mark of a space before unless they begin with it, are counted one by
one; each worker keeps the counts of chunks it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .wordcache import Memory, grouped, numbered

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(sentencepiece_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, without control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_file)
    plain = (i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
    return [(m.id_to_piece(i), m.get_score(i)) for i in plain]


class CountOnly:
    def __init__(self, pieces: list[tuple[str, float]], most: int = 300_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.memory = Memory(lambda chunks: [self.count(c if c.startswith(MARK) else MARK + c) for c in chunks], most)

    def count(self, chunk: str) -> int:
        """Pieces of the best segmentation; 0 for an empty one."""
        n = len(chunk)
        best, pieces, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = -1  # the last place that has a way
        single = True
        for at, (size, s) in self.automaton.iter(chunk):  # by end; of equal ends the longest, that is the earliest, first
            if at > done:
                if not single:
                    self._unknown(done, best, pieces, odd, True)
                for k in range(done + 1, at):
                    self._unknown(k, best, pieces, odd, False)
                done, single = at, size == 1
                best[at + 1], pieces[at + 1] = best[at + 1 - size] + s, pieces[at + 1 - size] + 1
            else:
                way = best[at + 1 - size] + s
                if way > best[at + 1]:
                    best[at + 1], pieces[at + 1] = way, pieces[at + 1 - size] + 1
                single = size == 1
        if not single:
            self._unknown(done, best, pieces, odd, True)
        for k in range(done + 1, n):
            self._unknown(k, best, pieces, odd, False)
        return pieces[n]

    def _unknown(self, at: int, best: list, pieces: list, odd: list, other: bool) -> None:
        """The way by the unknown piece, last as it starts last; other: whether there is one already."""
        way = best[at] + self.unknown
        if not other or way > best[at + 1]:
            best[at + 1], pieces[at + 1], odd[at + 1] = way, pieces[at] + (not odd[at]), True

    def counts(self, texts: pa.Array) -> np.ndarray:
        chunks, number, ends = numbered(texts)
        raw = chunks.to_pylist()
        each = np.array([0 if not c else n for c, n in zip(raw, self.memory.values(raw), strict=True)], np.int64)
        upto = np.concatenate([[0], np.cumsum(each[number])])[ends]
        return np.diff(upto, prepend=0)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens for each row; null and empty texts have none.

    One pass without a shuffle; repeated rows are counted each; a null id stays null; other columns aren't read; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a tokenizer's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = CountOnly(shared.value)
        for b in grouped(batches, 1):
            size = pc.utf8_length(pc.fill_null(b.column(1), "")).cast(pa.int64())
            counts = pa.array(counter.counts(b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, counts], ["doc_id", "n_chars", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
