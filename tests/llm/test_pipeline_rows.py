"""Stages of the pipeline leave the columns of a document as they are, whatever these are called, and take empty tables and null texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

CLASHES = ["score", "lang_pred", "rejected", "digest", "node", "own", "gone_doc_id", "id", "c0", "c1", "row", "kept", "keep_id", "text_sha256", "copies", "own_id"]


def corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


@pytest.mark.parametrize("repeat", [False, True])
@pytest.mark.parametrize("few", [0, 1_000_000])
def test_clashing_columns_keep_their_values(spark, sf, repeat, few, monkeypatch):
    """With ids of their own and with repeated ones, and with tables joined by broadcast and by merge."""
    import corpus_pipeline as p
    from robolake.llm import minhash

    monkeypatch.setattr(minhash, "FEW", few)
    docs = corpus(spark, sf)
    if repeat:
        docs = docs.unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    rows = {tuple(r) for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.schema == docs.schema, name
        kept = [tuple(r) for r in got.collect()]
        assert kept and set(kept) <= rows, name
        if name in ("exact_dedup", "near_dedup"):
            assert len(set(kept)) < len(rows) and (name == "near_dedup" or len(kept) == len(set(kept)))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def test_empty_tables_and_null_texts(spark):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    none = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(1, None, "en", "a", 0, -5.0), (2, None, None, None, None, None), (3, "", "en", "a", 0, 1.0), (None, None, "en", "b", 0, 2.0)], SCHEMA)
    for name, stage in stages.items():
        assert stage(spark, none, "").count() == 0, name
    rows = lambda name: sorted(r["doc_id"] or 0 for r in stages[name](spark, odd, "").collect())
    assert rows("language") == []  # no letter, no language
    assert rows("exact_dedup") == [1]  # null and empty are one text, and a null id stands for none
    assert rows("near_dedup") == [0, 1, 2, 3]  # texts without words are linked with nothing
    assert rows("mix") == []  # sources without words have no target
    assert rows("pack") == [0, 1, 2, 3]  # each is packed as its end id
    text = spark.createDataFrame([(1, None, None, "a", 0, -5.0), (2, "some words of a text", None, "a", 0, 1.0)], SCHEMA)
    assert sorted(r["doc_id"] for r in stages["mix"](spark, text, "").collect() if r["text"]) and stages["language"](spark, text, "").count() == 0
