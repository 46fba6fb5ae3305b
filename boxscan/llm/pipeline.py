"""The five stages of the training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves;
``run`` writes each result to the shared folder and reads it for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxscan.llm import bpe, mixing, near_dup, pii, quality_rules
from boxscan.session import stage

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    return quality_rules.keep(docs.select(*DOCUMENT))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are at least 80 % alike."""
    return near_dup.keep_first(docs.select(*DOCUMENT), near_dup.Likeness(words=5, percent=80))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data; ``n_chars`` follows the new text."""
    return pii.pseudonymize(docs.select(*DOCUMENT)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source in an equal share, documents repeated or left out accordingly."""
    return mixing.replicate(docs.select(*DOCUMENT)).select(*DOCUMENT)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return bpe.encode(texts, ranks, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("decodes"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_first),
    ("pii", hide_persons),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: SQL has no word for HyperMinHash components, surrogates or byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
