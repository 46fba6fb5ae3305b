"""Structure features of genes.

Energies are a column: bring a table of folding energies per sequence, or use
the default below, which counts antiparallel pairs (GC -3, AT -2, GT -1) and
is a stand-in, not a folding solver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.sequences import in_pieces, numbered

# Pair energies; T stands for U.
PAIR_ENERGY = {"GC": -3, "CG": -3, "AT": -2, "TA": -2, "GT": -1, "TG": -1}


_ENERGIES = np.zeros((256, 256), np.int64)
for _pair, _energy in PAIR_ENERGY.items():
    _ENERGIES[ord(_pair[0]), ord(_pair[1])] = _energy


def paired(left: pa.Array, right: pa.Array, inward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pairs per row, energy of each pair) of a batch: ``left`` from its start with ``right`` from its end, or the other way round.

    There are as many pairs as the shorter text has letters, or the one that is
    known; those of a missing text have no energy.
    """
    known = left.is_valid().to_numpy(zero_copy_only=False), right.is_valid().to_numpy(zero_copy_only=False)
    codes, size, begin = [], [], []
    for column in (left, right):
        texts = pc.fill_null(column, "")
        codes.append(np.frombuffer("".join(texts.to_pylist()).encode("ascii", "replace"), dtype=np.uint8))
        size.append(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin.append(np.cumsum(size[-1]) - size[-1])
    both = known[0] & known[1]
    n = np.where(both, np.minimum(*size), np.maximum(*size))
    rank, met = numbered(n), np.repeat(both, n)
    forward, backward = (0, 1) if inward else (1, 0)
    at = [None, None]
    at[forward] = np.repeat(begin[forward], n) + rank
    at[backward] = np.repeat(begin[backward] + size[backward] - 1, n) - rank
    energy = np.zeros(len(rank), np.int64)
    energy[met] = _ENERGIES[codes[0][at[0][met]], codes[1][at[1][met]]]
    return n, energy


def duplex_energy(left: Column, right: Column) -> Column:
    """Summed pair energy of ``left[i]`` with ``right[n-1-i]``."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_pieces(summed, a, b)

    def summed(a: pa.Array, b: pa.Array) -> pa.Array:
        n, energy = paired(a, b, inward=True)
        return pa.array(np.bincount(np.repeat(np.arange(len(n)), n), energy, len(n)))

    return run(left, right)


def hairpin_energy(seq: Column) -> Column:
    """Default energy of a whole gene: its first half against its second."""
    half = F.floor(F.length(seq) / 2).cast("int")
    return duplex_energy(F.substr(seq, F.lit(1), half), F.substr(seq, F.length(seq) - half + 1, half))


def pairing_string(left: Column, right: Column) -> Column:
    """Dots and brackets of the left flank, read away from the C box."""

    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_pieces(marked, a, b)

    def marked(a: pa.Array, b: pa.Array) -> pa.Array:
        n, energy = paired(a, b, inward=False)
        marks = np.where(energy < 0, ord("("), ord(".")).astype(np.uint8)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(marks))

    return run(left, right)


def stem_length_score(pairing: Column, width: int = K.FLANK) -> Column:
    """Brackets opened less brackets closed less gap dots between opened ones; at least 0."""
    left = F.substr(pairing, F.lit(1), F.lit(width))
    gaps = F.array_join(F.regexp_extract_all(left, F.lit(r"\((\.{1,19})(?=\()"), F.lit(1)), "")
    score = (
        F.regexp_count(left, F.lit(r"\(")) - F.regexp_count(left, F.lit(r"\)")) - F.length(gaps)
    )
    return F.greatest(score, F.lit(0))


def flanks(genes: DataFrame, width: int = K.FLANK) -> DataFrame:
    """Outer ``width`` nt of the extended sequence, either side."""
    ext = F.col("predicted_extended_sequence")
    return genes.withColumn("left_flank", F.substr(ext, F.lit(1), F.lit(width))).withColumn(
        "right_flank",
        F.substr(ext, F.greatest(F.length(ext) - width + 1, F.lit(1)), F.lit(width)),
    )


def box_flanks(seq: Column, c_start: Column, d_end: Column, width: int = K.FLANK) -> tuple[Column, Column]:
    """``width`` nt before the C box and after the D box of a window."""
    lo = F.greatest(c_start - width, F.lit(1))
    return (
        F.substr(seq, lo, F.greatest(c_start - lo, F.lit(0))),
        F.substr(seq, d_end + 1, F.lit(width)),
    )


def with_features(genes: DataFrame, energies: DataFrame | None = None) -> DataFrame:
    """Adds ``normalized_sno_stability``, ``terminal_combined`` and ``terminal_stem_score``.

    ``energies(sequence, stem, gene_energy, stem_energy, pairing)`` holds a
    solver's results per (predicted sequence, left&right flank); genes missing
    in it fall back to the default.
    """
    flanked = flanks(genes)
    left, right, seq = F.col("left_flank"), F.col("right_flank"), F.col("predicted_sequence")
    if energies is None:
        known = flanked.withColumns({
            "_ge": hairpin_energy(seq), "_se": duplex_energy(left, right), "_pairing": pairing_string(left, right),
        })
    else:
        table = energies.select(
            F.col("sequence").alias("predicted_sequence"), F.col("stem").alias("_stem"),
            F.col("gene_energy").alias("_g"), F.col("stem_energy").alias("_s"),
            F.col("pairing").alias("_p"),
        )
        known = (
            flanked.withColumn("_stem", F.concat_ws("&", "left_flank", "right_flank"))
            .join(table, ["predicted_sequence", "_stem"], "left")
            .withColumns({
                "_ge": F.coalesce("_g", hairpin_energy(seq)),
                "_se": F.coalesce("_s", duplex_energy(left, right)),
                "_pairing": F.coalesce("_p", pairing_string(left, right)),
            })
            .drop("_g", "_s", "_p", "_stem")
        )
    combined = F.col("_se") * stem_length_score(F.col("_pairing"))
    return (
        known.withColumn("normalized_sno_stability", F.round(F.col("_ge") / F.length(seq), 2))
        .withColumn("terminal_combined", combined)
        .withColumn("terminal_stem_score", F.round(combined, 2))
        .drop("_ge", "_se", "_pairing", "left_flank", "right_flank")
    )
