"""The thin queries over the standard tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import article, centroids, chat, exact, langid, minhash, mixing, multiindex, packing, periods, pfor, secrets, viterbi
from .common import table

WORD_TOKENS = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
UNIGRAM_PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_shards(pfor.write_shards(table(spark, sf_dir, "documents"), WORD_TOKENS, END_ID))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Weights by the order of the sources, the words wanted as a share of all, and the most times a source is taken.
MIX = ((3.0, 1.0, 2.0), 1.5, 2.0)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents"), *MIX)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), viterbi.vocabulary(UNIGRAM_PIECES))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.fit(docs.filter(langid.training(F.col("doc_id"))))
    told = langid.identify(docs.select("doc_id", "text"), learned)
    return told.select("doc_id", (~langid.training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(table(spark, sf_dir, "documents"), WORD_TOKENS, END_ID, 4096)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


#: What both sides of the added conversation -7 say.
SAID = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_chats(chat.format_chats(turns))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.inertias(*centroids.k_means(table(spark, sf_dir, "embeddings")))


@cache
def _article_model():
    """Learned once a process: the labelled pages come from a seed, so every process learns the same."""
    return article.fit(article.labelled_pages(SparkSession.active()))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), _article_model())


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.find_runs(periods.planted(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secrets": op3_secrets,
    "op4_near_dedup": op4_near_dedup,
    "op5_mix": op5_mix,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_pack": op8_pack,
    "op9_near_vectors": op9_near_vectors,
    "op10_chat": op10_chat,
    "op11_clusters": op11_clusters,
    "op12_main_text": op12_main_text,
    "op13_periods": op13_periods,
}

SQL: dict[str, str] = {"op2_exact_dedup": exact.SQL, "op3_secrets": secrets.SQL, "op5_mix": mixing.SQL, "op10_chat": chat.sql(SAID, -7), "op11_clusters": centroids.sql()}
