"""The main text of web pages: a conditional random field over the leaf blocks of a page tells article from what surrounds it.

fit() learns from labelled pages, pages with the text that is wanted of them: blocks that are lines of that text, in its order, are labelled 1. extract() reads each
page, labels its blocks by Viterbi and joins those of the article.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .blocks import Block, edges, features, leaf_blocks
from .common import bounded_batches
from .samples import labelled_page

#: Bounds of the pages learned from: how many, and how many characters together.
SAMPLE, CHARACTERS = 800, 32_000_000


def labels(blocks: list[Block], text: str) -> list[int]:
    """Which blocks are lines of the wanted text: long common stretches first, so a menu entry that equals a heading isn't taken for it."""
    lines = [t for t in (" ".join(line.split()) for line in text.split("\n")) if t]
    out = [0] * len(blocks)
    for m in SequenceMatcher(None, [b.text for b in blocks], lines, autojunk=False).get_matching_blocks():
        out[m.a : m.a + m.size] = [1] * m.size
    return out


def labelled_pages(spark: SparkSession, n: int = SAMPLE, seed: int = 1) -> DataFrame:
    """n labelled pages by robolake.llm.samples: html and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [labelled_page(seed * 1_000_003 + i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["html", "text"])

    return spark.range(n).mapInArrow(run, "html string, text string")


def fit(labelled: DataFrame, html_col: str = "html", text_col: str = "text", sample: int = SAMPLE, characters: int = CHARACTERS) -> crf.Crf:
    """A model from at most ``sample`` of the labelled pages, those with the smallest hashes, no longer than characters / sample each; rows with a null on either side don't count.

    Without any row the model takes no block for a part of an article. The sample and the training are the driver's.
    """
    rows = labelled.select(F.col(html_col).alias("html"), F.col(text_col).alias("text")).filter("html is not null and text is not null")
    rows = rows.filter(F.length("html") + F.length("text") <= characters // max(1, sample))
    chosen = rows.orderBy(F.xxhash64("html", "text"), "html", "text").limit(sample).collect()
    sequences = []
    for r in chosen:
        blocks = leaf_blocks(r["html"])
        sequences.append((features(blocks), edges(blocks), labels(blocks, r["text"])))
    return crf.train(sequences)


def main_text(page: str | None, model: crf.Crf, known: frozenset[str]) -> str:
    blocks = leaf_blocks(page, known)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks), edges(blocks)), strict=True) if y)


def names(model: crf.Crf) -> frozenset[str]:
    """The class and id names that the model has weights for."""
    return frozenset(f[5:] for f in model.weights if f.startswith("name "))


def extract(pages: DataFrame, model: crf.Crf, html_col: str = "html") -> DataFrame:
    """pages with text, the main text, and n_chars, its code points, in place of html and any columns of these names.

    Blocks of the article in page order, one a line; white space in a block is one space, character references are decoded. A null, empty or blank page gives
    an empty text and 0; repeated rows give each a row; no rows give none. One pass without a shuffle; the model, a few hundred kilobytes, is broadcast; a page is worked
    on alone, in memory in proportion to it.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model, names(model)))
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("html"))
    schema = rows.drop("html").selectExpr("*", "'' as text", "0L as n_chars").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, known = shared.value
        for b in batches:
            texts = [main_text(h.as_py(), learned, known) for h in b.column(len(keep))]
            more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
