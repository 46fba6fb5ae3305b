"""From box positions in a window to genes on the contig."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxscan.functions.sequences import cut
from boxscan.operators.motifs import LEN_C, LEN_D
from boxscan.operators.peaks import first_of

MARGIN = 5       # a gene starts 5 nt before its C box and ends 5 nt after its D box
EXTENSION = 15   # more flank for the terminal stem

BOXES = {"C": ("c", LEN_C), "D": ("d", LEN_D),
         "C_PRIME": ("c_prime", LEN_C), "D_PRIME": ("d_prime", LEN_D)}

GENE_COLUMNS = [
    "gene_id", "contig", "start", "end", "strand", "probability_CD", "box_score",
    "C_MOTIF", "C_START", "C_END", "score_c", "D_MOTIF", "D_START", "D_END", "score_d",
    "C_PRIME_MOTIF", "C_PRIME_START", "C_PRIME_END",
    "D_PRIME_MOTIF", "D_PRIME_START", "D_PRIME_END",
    "predicted_sequence", "predicted_extended_sequence", "window_seq",
]


def gene_limits(boxed: DataFrame) -> DataFrame:
    """Adds the gene interval and its two sequences.

    ``c_limit`` and ``d_limit`` count along the strand, the interval does not:
    on the minus strand the window end is where counting begins.
    """
    seq = F.col("window_seq")
    size = F.length(seq)
    lo = F.greatest(F.col("c_limit") - MARGIN - 1, F.lit(0))
    hi = F.least(F.col("d_limit") + MARGIN, size)
    minus = F.col("strand") == "-"
    return (
        boxed.withColumns({
            "gene_start": F.when(minus, F.col("end") - hi).otherwise(F.col("start") + lo),
            "gene_end": F.when(minus, F.col("end") - lo).otherwise(F.col("start") + hi),
            "_origin": lo,
            "predicted_sequence": cut(seq, lo, hi),
            "predicted_extended_sequence": cut(seq, lo - EXTENSION, F.least(hi + EXTENSION, size)),
        })
    )


def rebase(limited: DataFrame) -> DataFrame:
    """Box columns counted within the gene (1-based); a missing box has positions 0."""
    columns = {}
    for name, (box, size) in BOXES.items():
        at = F.col(f"{box}.start") - F.col("_origin")
        columns[f"{name}_MOTIF"] = F.coalesce(F.col(f"{box}.motif"), F.lit("N" * size))
        columns[f"{name}_START"] = F.coalesce(at, F.lit(0)).cast("int")
        columns[f"{name}_END"] = F.coalesce(at + size - 1, F.lit(0)).cast("int")
    return limited.withColumns(columns)


def gene_table(boxed: DataFrame) -> DataFrame:
    """The 24-column gene table, one row per location."""
    genes = rebase(gene_limits(boxed))
    start, end = F.col("gene_start"), F.col("gene_end")
    picked = genes.withColumn("start", start).withColumn("end", end).withColumnRenamed(
        "probability", "probability_CD"
    ).select(*GENE_COLUMNS)
    return one_per_location(picked)


def one_per_location(genes: DataFrame) -> DataFrame:
    """Lowest box score per (contig, start, end, strand), then smallest id."""
    return first_of(genes, ["contig", "start", "end", "strand"], ["box_score", "gene_id"])


def without_n(genes: DataFrame) -> DataFrame:
    """Genes whose sequence holds an unknown base are dropped."""
    return genes.filter(~F.col("predicted_sequence").contains("N"))
