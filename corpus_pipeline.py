"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept and all but the last return the columns of documents. What a stage writes for itself is gone
when it returns, but for small tables of ids that its rows are still read with. A document is a doc_id, which may be null, with a
text: of rows that repeat both (texts up to white space) one stays, and rows that share only the id stay or go each by its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robolake.llm import common, exact, langid, minhash, mixing, packing, registry
from robolake.llm.common import Scratch


def _few(df: DataFrame) -> DataFrame:
    """A table to be joined: few rows are broadcast, so the texts on the other side aren't shuffled; more of them are merged."""
    return F.broadcast(df) if df.count() <= minhash.FEW else df.hint("merge")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1 and so on, so that a stage's own columns clash with none of them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def _keyed(docs: DataFrame) -> DataFrame:
    """_numbered() with the key of a document: id, and the digest of its text."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return _numbered(docs).withColumns({"id": F.col(at["doc_id"]).cast("long"), "digest": exact.digest(F.col(at["text"]))})


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, out of its numbered ones."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _without(rows: DataFrame, gone: DataFrame, tmp: Scratch, *keys: str) -> DataFrame:
    """rows but for those with the keys in gone, where null equals null."""
    gone = tmp.result(gone.select(*[F.col(k).alias(f"gone_{k}") for k in keys]).distinct(), "gone")
    return rows.join(_few(gone), [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in keys], "left_anti")


def _shared(ids: DataFrame, tmp: Scratch) -> DataFrame:
    """The ids that don't name one row, null among them."""
    counts = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return tmp.written(counts.filter("n > 1 or id is null").select("id"), "shared")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin."""
    learned = langid.fit(docs.filter(langid.training(F.col("doc_id"))))
    told = langid.identify(_numbered(docs), learned, f"c{docs.columns.index('text')}")
    return _named(told.filter("not rejected"), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id, by a digest index that takes the documents in two batches."""
    told = exact.dedup(docs).withColumnRenamed("doc_id", "id")
    with Scratch(spark) as tmp:
        if _shared(told, tmp).isEmpty():
            rows = _numbered(docs).withColumn("id", F.col(f"c{docs.columns.index('doc_id')}").cast("long"))
            return _named(_without(rows, told.filter("not kept"), tmp, "id"), docs)
        keys = told.groupBy("id", F.unhex("text_sha256").alias("digest")).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        keys = tmp.written(keys, "keys")
        rest = _without(_keyed(docs), keys.filter("not kept or n > 1"), tmp, "id", "digest")
        again = _without(_keyed(docs), keys.filter("not kept or n = 1"), tmp, "id", "digest")
        one = again.groupBy("id", "digest").agg(F.min(F.struct(*_numbered(docs).columns)).alias("row")).select("row.*")
        return _named(rest, docs).unionByName(_named(one, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest id."""
    with Scratch(spark) as tmp:
        keys = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
        shared = _shared(keys, tmp)
        if shared.isEmpty():
            rows = _numbered(docs).withColumn("doc_id", F.col(f"c{docs.columns.index('doc_id')}").cast("long"))
            return _named(_without(rows, minhash.near_duplicates(keys, "id").filter("not kept"), tmp, "doc_id"), docs)
        nodes, own = _nodes(docs, shared, tmp)
        text = F.col(f"c{docs.columns.index('text')}").alias("text")
        told = minhash.near_duplicates(nodes.select("node", text), "node").select(F.col("doc_id").alias("own"), "component_id")
        back = own.select("own", F.col("id").alias("given"), F.lit(True).alias("odd"))
        given = F.when(F.col("odd"), F.col("given")).otherwise(F.col("own"))
        told = tmp.written(told.join(_few(back), "own", "left").withColumn("given", given), "given")
        first = F.min(F.struct(F.col("given").isNull(), "given", "own")).alias("x")
        best = told.groupBy("component_id").agg(first, F.count(F.lit(1)).alias("m")).select("component_id", F.col("x.own").alias("best"), "m")
        gone = common.lookup(told, tmp.written(best, "best"), "component_id", "m").filter("own <> best").select(F.col("own").alias("node"))
        return _named(_without(nodes, gone, tmp, "node"), docs)


def _nodes(docs: DataFrame, shared: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """_keyed() with node, an id of each (id, text), and the table of those that had no id of their own: they get one above all others.

    Which of a group stays is then settled by the given ids.
    """
    given = _keyed(docs).select("id", "digest").distinct()
    some = given.join(_few(shared.filter("id is not null")), "id", "left_semi").unionByName(given.filter("id is null"))
    top = max(docs.agg(F.max("doc_id")).first()[0] or 0, 0)
    own = tmp.result(some.select("id", "digest", (F.monotonically_increasing_id() + top + 1).alias("own")), "own")
    keys = own.select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "own")
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    return _keyed(docs).join(_few(keys), same, "left").withColumn("node", F.coalesce("own", "id")), own


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs, *registry.MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_windows(docs, registry.WORD_TOKENS, registry.END_ID, 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: SQL has no compression, tokenizer or packing; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = common.scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.drop_path(spark, before)
        before = path
    return docs
