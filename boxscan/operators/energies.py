"""A table of energies that grows: each distinct sequence is solved once, ever.

A folding solver is the dearest step per gene, and the same sequences come back
with every run.  The table lies in a folder, one partition ``round=k`` per
``extend`` that found something new; a row is found by the hash of its sequence
and stem and then by both texts, so two sequences of one hash stay apart.

Defined results: a gene without a sequence is not asked for; repeated sequences
are solved once; a table that does not exist yet is empty.  A failed ``extend``
may be called again: what it has committed counts as known.  Two calls at the
same time may solve a sequence twice; ``load`` keeps the earlier round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.operators.features import duplex_energy, flanks, hairpin_energy, pairing_string

PLACE = ["key", "sequence", "stem"]
SCHEMA = (
    "key bigint, sequence string, stem string, gene_energy double, stem_energy double, pairing string, round int"
)
Solver = Callable[[DataFrame], DataFrame]


def questions(genes: DataFrame, width: int = K.FLANK) -> DataFrame:
    """The distinct ``(key, sequence, stem, left_flank, right_flank)`` of genes."""
    asked = flanks(genes, width).filter("predicted_sequence IS NOT NULL").select(
        F.col("predicted_sequence").alias("sequence"),
        F.concat_ws("&", "left_flank", "right_flank").alias("stem"), "left_flank", "right_flank",
    )
    return asked.withColumn("key", F.xxhash64("sequence", "stem")).dropDuplicates(PLACE)


def default_solver(asked: DataFrame) -> DataFrame:
    """Pair counting, the stand-in of ``features``; a real solver may be a ``mapInPandas``."""
    left, right = F.col("left_flank"), F.col("right_flank")
    return asked.select(
        *PLACE, hairpin_energy(F.col("sequence")).alias("gene_energy"),
        duplex_energy(left, right).alias("stem_energy"), pairing_string(left, right).alias("pairing"),
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def unseen(genes: DataFrame, path: str, width: int = K.FLANK) -> DataFrame:
    """The questions that the table at ``path`` does not answer yet."""
    known = _stored(genes.sparkSession, path).select(*PLACE)
    return questions(genes, width).join(known, PLACE, "left_anti")


def extend(genes: DataFrame, path: str, solver: Solver = default_solver, width: int = K.FLANK) -> int:
    """Solves what is unseen and appends it; returns the number of the round.

    ``solver`` maps rows of ``questions`` to ``(key, sequence, stem, gene_energy,
    stem_energy, pairing)``.  A question it leaves out is asked again next time.
    """
    spark = genes.sparkSession
    last = _stored(spark, path).agg(F.coalesce(F.max("round"), F.lit(0)).alias("k")).first().k
    solved = solver(unseen(genes, path, width)).select(
        *PLACE, F.col("gene_energy").cast("double"), F.col("stem_energy").cast("double"), "pairing",
    )
    solved.withColumn("round", F.lit(last + 1)).write.mode("append").partitionBy("round").parquet(path)
    return last + 1


def load(spark: SparkSession, path: str) -> DataFrame:
    """``(sequence, stem, gene_energy, stem_energy, pairing, round)``, one row per question.

    What ``features.with_features`` takes as ``energies``.
    """
    cells = F.struct("round", "gene_energy", "stem_energy", "pairing")
    once = _stored(spark, path).groupBy(*PLACE).agg(F.min(cells).alias("_cells"))
    return once.select(
        "sequence", "stem", "_cells.gene_energy", "_cells.stem_energy", "_cells.pairing", "_cells.round"
    )
