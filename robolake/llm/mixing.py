"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Each source gets a target, its share by weight of the words wanted; each of its documents then expects target / source size
copies. Laid end to end, the expected copies of a source's documents form a line; one random offset shifts it, and a
document is emitted once for each whole number that its piece of the line crosses.

No task holds a source. A document lies in a cell: source, size class, and the first hex digits of a hash of its id and text, one digit and one more each
time that a source has sixteen times more rows, so that a cell has about CELL_ROWS rows at most. The line runs through the cells in
order and inside a cell by size, id and hash. Where a cell begins follows from the cells' sums alone, a row for each cell.
Neighbours on the line have like sizes, so the words taken come near the target too.
Expected copies are whole multiples of 1 / UNIT, so that sums don't depend on their order. Where a cell begins is kept modulo UNIT: what is
crossed between two places stays the same when both move by whole numbers, so a source may have any number of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, lookup

UNIT = 1 << 28
CELL_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes up to 15 have a class each, larger ones eight for each doubling."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 + F.call_function("shiftright", size, bits - 4))


def _hex(text: Column, digits: Column) -> Column:
    return F.conv(F.md5(text).substr(F.lit(1), digits), 16, 10).cast("long")


def _digits(rows: Column) -> Column:
    """Hex digits that give a source of so many rows a part for each CELL_ROWS of them."""
    more = [(rows > CELL_ROWS * 16**k).cast("int") for k in range(1, 7)]
    return reduce(Column.__add__, more, F.lit(1))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> with target. sizes has a row a source.

    Weights go round by the sources' order by code point, null last. Together the targets are share of all sizes, each at most
    ``most`` times its source's size; the excess is shared anew by weight until none is above. That is filling water into columns
    as wide as the weights: with sources in the order of size / weight, the first k are full where the level that the
    others would have with these full reaches the next one's top. One task orders the sources, a row each: millions of them, but not
    one for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    weighed = weighed.withColumn("cap", most * F.col("source_size"))
    every, up = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    filled = weighed.withColumns({"level": (share * F.sum("source_size").over(every) - full) / open_, "top": F.col("cap") / F.col("weight")})
    level = F.max(F.when(F.col("level") <= F.col("top"), F.col("level"))).over(every)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))
    return filled.withColumn("final", level).select("source", "source_size", "n_rows", target.alias("target"))


def draw(
    docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """For each row how often it is taken: doc_id, source, size, source_size, target, copies.

    Size is the number of words; a null text has none. A null source is a source of its own, after all others. Sources
    without words have target 0 and none of their rows is taken; a row of size 0 in another source may be. Rows of equal id and text in a source
    take their places in any order; nulls and repeated ids are dealt by their texts. Other columns aren't read. The same rows and seed give the same result, however they are dealt
    out. The result is a written table.
    """
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    with Scratch(docs.sparkSession) as tmp:
        keys = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source")]
        mark = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))), 1, 16)
        read = docs.select(*keys, F.col(text_col).cast("string").alias("text")).withColumn("size", words(F.col("text")))
        read = read.withColumn("mark", mark).drop("text")
        rows = tmp.written(read.withColumn("key", name), "rows")
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
        aims = tmp.written(targets(sizes, weights, share, most).withColumn("key", name).drop("source"), "targets")
        return tmp.result(_taken(rows, aims, seed), "op5")


def _taken(rows: DataFrame, aims: DataFrame, seed: int) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    offset = _hex(F.concat(F.lit(f"{seed}:"), "key"), F.lit(7))
    aims = aims.withColumns({"expected": rate.cast("long"), "offset": offset, "digits": _digits(F.col("n_rows"))})
    cell = ["key", "class", "part"]
    part = F.conv(F.col("mark").substr(F.lit(1), F.col("digits")), 16, 10).cast("long")
    placed = lookup(rows, aims, "key", "n_rows").withColumns({"class": size_class(F.col("size")), "part": part})
    cells = placed.groupBy(*cell).agg((F.sum("expected") % UNIT).alias("width"))
    begins = cells.select(*cell, ((F.sum("width").over(Window.partitionBy("key").orderBy("class", "part")) - F.col("width")) % UNIT).alias("begin"))
    inside = F.sum("expected").over(Window.partitionBy(*cell).orderBy("size", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0))
    copies = F.expr(f"end div {UNIT} - (end - expected) div {UNIT}")
    told = placed.join(begins, cell).withColumn("end", F.col("offset") + F.col("begin") + inside)
    return told.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(
    docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of docs, each as often as draw() takes it; one shuffle of the texts, by id. Columns may have any names.

    Rows that share an id are each taken as often as the most taken of them; null is an id like others.
    """
    drawn = draw(docs, weights, share, most, seed, id_col, text_col, source_col)
    taken = drawn.groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    pairs = rows.join(taken.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")))
    return pairs.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS mark,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, key, sum(size)::BIGINT AS source_size, 1 + {digits} AS digits,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source, key
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS top FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY top, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY top, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT *, max(CASE WHEN level <= top THEN level END) OVER () AS final FROM l
), t AS (
  SELECT key, source_size, digits, CASE WHEN final IS NULL THEN cap ELSE least(cap, weight * final) END AS target FROM f
), r AS (
  SELECT d.doc_id, d.key, d.size, d.mark, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 268435456)::BIGINT ELSE 0 END AS expected,
         ('0x' || substr(md5('0:' || d.key), 1, 7))::BIGINT AS offset_,
         CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) END AS class,
         ('0x' || substr(d.mark, 1, t.digits))::BIGINT AS part
  FROM d JOIN t USING (key)
), e AS (
  SELECT *, offset_ + sum(expected) OVER (PARTITION BY key ORDER BY class, part, size, doc_id NULLS FIRST, mark ROWS UNBOUNDED PRECEDING) AS end_ FROM r
)
SELECT doc_id, size, source_size, target, (((end_ // 268435456) - ((end_ - expected) // 268435456)) * size)::BIGINT AS taken FROM e
"""
SQL = _SQL.replace("{digits}", " + ".join(f"(count(*) > {CELL_ROWS * 16**k})::INT" for k in range(1, 7)))
