"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, minhash, pii
from tessera.llm.common import shared_dir, table

#: A text whose best cosine is lower has no language; real text of a few words has more.
LEAST_SCORE = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those like no language; the others get the language that was predicted.

    Null, empty and blank texts are rejected, repeated rows are each judged by their text, and an empty table stays empty.
    """
    # by names that are not the operator's own, which documents may have, too
    names = [c if c in ("doc_id", "text", "lang") else f"column_{k}" for k, c in enumerate(docs.columns)]
    found = langid.identify(docs.toDF(*names), names).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id, of repeated rows one.

    Null and empty texts are groups of their own; an empty table stays empty, and other columns are kept as they are.
    """
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages: one word in 20 or more lies in a window of an item.

    Null and empty texts stay, as do all documents if the benchmark is empty; repeated rows share their text's fate.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data and the terms that disclose it taken out of the texts; no row goes.

    Null texts stay null and empty ones empty; repeated rows are changed alike, and n_chars is that of the new text.
    """
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to; null counts as empty."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE", tokens),
]

#: SQL can't express the first, second and last stage; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
