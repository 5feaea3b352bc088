"""Language identification by compression: the language whose raw-content dictionary makes the text smallest.

fit() gathers a bounded sample of labelled texts and joins, for each language, normalised pieces from all over them into one zstandard
raw-content dictionary. identify() normalises each whole text, cuts it into blocks, compresses every block with every
dictionary and sums the sizes; the smallest sum wins, ties by the smaller name. The score is
1 - smallest / second smallest, from 0 to 1; a score below the least margin rejects the document.
Blocks are short because a dictionary helps little once a text can refer to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

#: The bounds of the sample: so many texts of each language at most, so many characters of each, and of all of a language together,
#: as the compressor finds less in longer dictionaries.
SAMPLE, CHARS, DICTIONARY = 200, 2000, 200_000
#: Characters of all dictionaries together: with very many labels each gets a share of these, and none is left out.
TOTAL = 64_000_000
#: Pieces that a longer text is cut down to, spread evenly from its beginning to its end.
PIECES = 8
#: Most labels; more aren't languages.
LABELS = 100_000
BLOCK = 512
LEVEL = 3
#: Below this score the two best languages are taken for equally good.
MARGIN = 0.002


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case; each run of other characters than letters becomes one space."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")


def training(id_col: Column) -> Column:
    """Whether a document may be learned from: three quarters by the CRC of its id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


def spread(text: Column, n: Column | int, pieces: int = PIECES) -> Column:
    """At most n characters of a text: all, or as many equal pieces of it from the first to the last character, with spaces between."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.greatest(F.lit(1), (n - (pieces - 1)) / pieces).cast("int")
    place = lambda k: (1 + k * (F.length(text) - size) / (pieces - 1)).cast("int")
    cut = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substring(text, place(k), size)))
    return F.when(F.length(text) <= n, text).when(n < 2 * pieces, F.substring(text, F.lit(1), n)).when(text.isNotNull(), cut)


def fit(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, chars: int = CHARS,
    dictionary: int = DICTIONARY, total: int = TOTAL,
) -> dict[str, bytes]:
    """A dictionary for each label, from rows with a text that has a letter and a label; rows without either don't count.

    Every label is learned; more than LABELS raise ValueError. With n labels each gets at most min(dictionary, total / n) characters, from at most ``sample`` texts of it and
    at most ``chars`` characters of a text, in PIECES pieces spread over it; so what reaches the driver is bounded by ``total`` and a few characters a label. Which texts
    is settled by a hash of the text, so a rerun learns the same; copies of a text count once. A first pass counts each
    label's distinct hashes, a second keeps about four times the sample of these by the hash before texts are shuffled; so a label
    gets the sample, or all its texts if it has fewer, however many copies there are.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    texts = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h")).distinct()
    counted = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    counts = {r["lang"]: r["texts"] for r in counted.limit(LABELS + 1).collect()}  # a row a label
    if len(counts) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    if not counts:
        return {}
    room = max(1, min(dictionary, total // len(counts)))
    texts_of = max(1, min(sample, room))
    share = labelled.sparkSession.createDataFrame([(lang, 4.0 * texts_of / n) for lang, n in counts.items()], "of string, rate double")
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), spread(F.col("text"), min(chars, room)).alias("text"))
    drawn = F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    near = hashed.join(F.broadcast(share), F.col("lang") == F.col("of")).filter(drawn)
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = once.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= texts_of)
    each = F.greatest(F.lit(1), F.expr(f"int({room} div count(*) over (partition by lang))"))
    sized = first.withColumn("each", each).withColumn("text", spread(F.col("text"), F.col("each")))
    gathered: dict[str, list[str]] = {}
    for r in sized.orderBy("lang", "h").collect():
        gathered.setdefault(r["lang"], []).append(r["text"])
    return {lang: " ".join(normalised(pa.array(t)).to_pylist()).encode() for lang, t in gathered.items()}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.names = sorted(dictionaries)
        self.by = []
        for lang in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False).compress)

    def sizes(self, text: bytes) -> np.ndarray:
        blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
        return np.array([sum(len(c(b)) for b in blocks) for c in self.by])

    def best(self, text: bytes) -> tuple[str, float]:
        if not self.names or not text.strip():
            return "und", 0.0
        s = self.sizes(text)
        k = int(s.argmin())
        if len(s) == 1:
            return self.names[0], 1.0
        return self.names[k], float(1 - s[k] / np.partition(s, 1)[1])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected added; clashing columns of docs are replaced.

    A text that is null or has no letter gives ``und``, 0 and is rejected; so does every text if nothing was learned.
    One pass without a shuffle; memory is bounded by an Arrow batch.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by what fit() may gather
    place, names = docs.columns.index(text_col), [*docs.columns, "lang_pred", "score", "rejected"]
    schema = docs.selectExpr("*", "'' as lang_pred", "0d as score", "false as rejected").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(shared.value)
        for b in batches:
            got = [compressors.best(t.as_py()) for t in normalised(b.column(place)).cast(pa.binary())]
            langs, scores = [g[0] for g in got], [g[1] for g in got]
            rejected = [n == "und" or s < margin for n, s in got]
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    return docs.mapInArrow(run, schema)
