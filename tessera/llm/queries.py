"""Registered queries of the training-data operators, thin digests of what the operators return."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, fim, langid, licenses, lm, minhash, pii, quality, quotes, sharding, vectors, yinyang
from tessera.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license_id", F.array_join("notice_ids", ",").alias("notice_ids"), F.col("license_id").isNotNull().alias("is_license"))


def op2_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_iterative_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_sha256().alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ["doc_id"], ids=False)


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.conversations(table(spark, sf_dir, "conversations"))
    return linked.withColumn("clean_sha256", F.sha2(F.col("clean_text").cast("binary"), 256)).drop("clean_text")


def op8_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


def op12_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(quality.fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_lookaround(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_canonical_digest, op2_hypergeometric, op3_iterative_quantisation, op4_disclosure, op5_positional_index, op6_merge_replay,
        op7_quotation_linking, op8_hyperdimensional, op9_stupid_backoff, op10_minhash_join, op11_yinyang, op12_random_indexing, op13_lookaround,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {
    "op1_canonical_digest": licenses.oracle_sql(), "op9_stupid_backoff": lm.ORACLE, "op11_yinyang": yinyang.oracle_sql(), "op13_lookaround": fim.ORACLE,
}
