"""Column sets of the final tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX_COLUMNS = [
    "C_MOTIF", "C_START", "C_END", "D_MOTIF", "D_START", "D_END",
    "C_PRIME_MOTIF", "C_PRIME_START", "C_PRIME_END",
    "D_PRIME_MOTIF", "D_PRIME_START", "D_PRIME_END",
]
PLACE_COLUMNS = ["gene_id", "chr", "start", "end", "strand"]
MINIMAL = [*PLACE_COLUMNS, "probability_CD", "box_score", *BOX_COLUMNS, "predicted_sequence"]
EXTRA = [
    "terminal_stem_score", "normalized_sno_stability", "probability_expressed_pseudogene",
    "predicted_label",
]
FULL = [*MINIMAL[:-1], *EXTRA, "predicted_sequence"]
INTEGERS = ["box_score", *[c for c in BOX_COLUMNS if not c.endswith("MOTIF")]]


def final_table(genes: DataFrame, minimal: bool = False) -> DataFrame:
    """24 columns, or 20 when only the first model was run; positions as integers."""
    types = {**dict.fromkeys(INTEGERS, "int"), "start": "long", "end": "long"}
    named = genes.withColumnRenamed("contig", "chr")
    return named.select(*[
        F.col(name).cast(types[name]).alias(name) if name in types else F.col(name)
        for name in (MINIMAL if minimal else FULL)
    ])


def is_minimal(final: DataFrame) -> bool:
    return "predicted_label" not in final.columns
