"""Registered queries of this subpackage: thin wrappers that derive the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxscan.llm import (
    align, bpe, chat, html, importance, mixing, near_dup, pii, pipeline, quality_rules, rans, spellings, suffixes, top_k,
)
from boxscan.llm.oracle import LLM_ORACLE
from boxscan.session import new_folder

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """How does each conversation read back from its formatted text?"""
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(turns)
    line = F.lit("\n")
    spoken = F.transform("turns", lambda t: F.concat(t.role, line, t.text, line))
    return out.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("trained"), F.length("formatted").alias("size"), "valid",
    ).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.col("size").cast("long").alias("formatted_chars"), "valid",
    )


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents stay within the fences of their language and source?"""
    return quality_rules.judge(table(spark, folder, "documents"))


@query
def op6_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """An equal share of every source, as many rows as there are documents."""
    return mixing.replicate(table(spark, folder, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each document and the text they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = bpe.half_partitions(table(spark, folder, "documents").select("doc_id", "text"))
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_rans_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Places and checksums of the ids of each document, read back from token files."""
    path = new_folder(spark, "tokens")
    rans.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return rans.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32")
    )


@query
def op1_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents does resampling towards the good labels keep?"""
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors by integer inner product of every 20th vector."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k.search(vectors, vectors.where("id % 20 = 0"), 20, 64)


@query
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingles are at least 85 % alike."""
    return near_dup.near_duplicates(table(spark, folder, "documents"), near_dup.Likeness(words=3, percent=85))


@query
def op8_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return pii.pseudonymize(table(spark, folder, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without strings of 400 bytes that start twice."""
    out = suffixes.remove_repeats(table(spark, folder, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.begin)
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # what is left, as text; a character that a removal cuts through is shown as U+FFFD
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query
def op12_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """How do the tokens of two tokenizers lie over one another in each document?"""
    pair = align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    out = align.align(table(spark, folder, "documents"), pair)
    return out.withColumn(
        "groups_sha256", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    ).drop("groups")


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Which words are misspellings, and of what?"""
    return spellings.group(table(spark, folder, "documents"))


@query
def op11_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page, by the path its host agrees on."""
    return html.extract_pages(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


LLM_QUERIES["pipeline"] = pipeline.run
if pipeline.ORACLE_SQL:
    LLM_ORACLE["pipeline"] = pipeline.ORACLE_SQL
