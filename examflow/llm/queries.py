"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    hard_negatives, iblt, maxscore, minhash, packing, piece_bpe, sharding, spelling, substring_dedup, toxicity,
    url_filter, warc, wavelet)
from .frames import read_table

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
EMBEDDING_SCALE = 64.0


def public_tokenizer(name: str) -> str:
    """Path of a public vocabulary file (they are not part of this repository)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(read_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules).drop("url")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), num=100, den=85)


def op4_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  public_tokenizer("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_words(read_table(spark, sf_dir, "documents"), width=20)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op8_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0,
                          k=20, scale=EMBEDDING_SCALE)


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(read_table(spark, sf_dir, "documents"),
                                      public_tokenizer("piece_bpe_32k.model"))


def op11_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op13_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_iblt_fingerprint, op2_url_filter, op3_minhash, op4_bin_slack_packing,
              op5_toxicity, op6_substring_dedup, op7_warc, op8_lpt_sharding, op9_maxscore,
              op10_piece_bpe, op11_trie_frontier, op12_wavelet, op13_hilbert_negatives)
}
