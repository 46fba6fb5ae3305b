"""Contigs, peaks and signals derived from the given parquet tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from boxscan.functions.sequences import in_pieces
from boxscan.session import spread_small

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAN"
_SPELLED = bytes.maketrans((LETTERS + LETTERS.upper()).encode(), (BASES + BASES).encode())
#: Every byte of UTF-8 text that is no letter a-z or A-Z.
_OTHER = bytes(sorted(set(range(256)) - set((LETTERS + LETTERS.upper()).encode())))


def _bases(text: str | None) -> bytes | None:
    return None if text is None else text.encode().translate(_SPELLED, _OTHER)


@F.arrow_udf(StringType())
def spelled(texts: pa.Array) -> pa.Array:
    """The letters of each text as bases; by regular expression and ``translate`` this takes 0.3 microseconds a byte."""
    return in_pieces(lambda some: pa.array([_bases(t) for t in some.to_pylist()], pa.binary()).cast(pa.string()), texts)


@F.arrow_udf(LongType())
def letter_count(texts: pa.Array) -> pa.Array:
    """The number of bases of each text."""
    return in_pieces(
        lambda some: pa.array([None if t is None else len(_bases(t)) for t in some.to_pylist()], pa.int64()), texts)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_small(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def document_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """``contigs(contig, seq, length)``: the letters of each text spelled as bases."""
    # "nondeterministic" keeps filters on the length from reading the text once more
    return documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("contig"),
        spelled.asNondeterministic()("text").alias("seq"),
        letter_count.asNondeterministic()("text").alias("length"),
    )


def document_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks laid over the document contigs, about one per 300 nt.

    Lengths run from 50 to 400; strands are +, - and unknown.  Some peaks
    repeat an id or a location, have start >= end or name an unknown contig,
    so that the checks and the deduplication have work to do.
    """
    doc = F.col("doc_id")
    k = F.col("k")
    n = letter_count.asNondeterministic()("text")
    start = k * 300 + F.pmod(doc * 37 + k * 11, F.lit(260))
    width = 50 + F.pmod(doc * 31 + k * 17, F.lit(351))
    twin = k - F.when(F.pmod(doc + k, F.lit(13)) == 12, F.least(k, F.lit(1))).otherwise(0)
    return (
        documents(spark, folder)
        .select("doc_id", n.alias("length"))
        .select(
            "doc_id", "length",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / 300))).alias("k"),
        )
        .select(
            F.when(F.pmod(doc, F.lit(97)) == 5, F.concat(F.lit("x"), doc.cast("string")))
            .otherwise(doc.cast("string")).alias("contig"),
            start.alias("start"),
            F.when(F.pmod(doc + k, F.lit(89)) == 7, start)
            .otherwise(F.least(start + width, F.greatest(F.col("length"), start + 1)))
            .alias("end"),
            F.concat(F.lit("p"), doc.cast("string"), F.lit("_"), twin.cast("string"))
            .alias("gene_id"),
            F.lit(".").alias("score"),
            F.element_at(
                F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.pmod(doc + k, F.lit(3)) + 1).cast("int")
            ).alias("strand"),
            (doc * 1000000 + k).alias("row_no"),
        )
    )


def event_signals(spark: SparkSession, folder: str) -> DataFrame:
    """``signals(id, ts, seq_no, value)``: one value series per user."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq_no"), "value"
    )
