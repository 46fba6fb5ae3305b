"""Sliding windows on both strands, as rows (the scan itself never makes these strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.intervals import flip
from boxscan.functions.sequences import on_strand

STRANDS = {"both": ["+", "-"], "plus": ["+"], "minus": ["-"]}


def owned_starts(strand: Column, width: int, step: int) -> Column:
    """Plus-strand starts of the windows a tile owns.

    Starts are multiples of ``step`` from the 5' end of the strand, plus the
    window flush with its 3' end, exactly once.  A contig no longer than a
    window gives one window.
    """
    lo, length = F.col("tile_start"), F.col("length")
    last = length - width
    hi = F.least(F.col("tile_end") - 1, last)
    phase = F.when(strand == "-", F.pmod(last, F.lit(step))).otherwise(F.lit(0))
    first = lo + F.pmod(phase - lo, F.lit(step))
    none = F.array().cast("array<bigint>")
    regular = F.when(first <= hi, F.sequence(first, F.greatest(hi, first), F.lit(step).cast("long"))).otherwise(none)
    flush = F.when(strand == "-", F.lit(0).cast("long")).otherwise(last)
    with_flush = F.when(
        (flush >= lo) & (flush <= hi), F.array_union(regular, F.array(flush))
    ).otherwise(regular)
    whole = F.when(lo == 0, F.array(F.lit(0).cast("long"))).otherwise(none)
    return F.when(length <= width, whole).otherwise(with_flush)


def sliding_windows(
    tiles: DataFrame, width: int = K.WINDOW, step: int = K.STEP, strand: str = "both"
) -> DataFrame:
    """``(contig, strand, start, end, window)``; the tile halo must be >= width - 1."""
    strands = F.array(*[F.lit(s) for s in STRANDS[strand]])
    return (
        tiles.withColumn("strand", F.explode(strands))
        .withColumn("start", F.explode(owned_starts(F.col("strand"), width, step)))
        .select(
            "contig", "strand", "start",
            F.least(F.col("start") + width, F.col("length")).alias("end"),
            on_strand(
                F.substr("seq", (F.col("start") - F.col("tile_start") + 1).cast("int"), F.lit(width)),
                F.col("strand"),
            ).alias("window"),
        )
    )


def strand_starts(sizes: DataFrame, width: int = K.WINDOW, step: int = K.STEP) -> DataFrame:
    """Windows of the minus strand counted from its own 5' end, and lifted to plus."""
    n = F.col("length")
    own = F.array_union(
        F.sequence(F.lit(0).cast("long"), n - width, F.lit(step).cast("long")), F.array(n - width)
    )
    start, end = flip(F.col("strand_start"), F.col("strand_start") + width, n)
    return (
        sizes.filter(n > width)
        .select("contig", "length", F.explode(own).alias("strand_start"))
        .select("contig", "strand_start", start.alias("start"), end.alias("end"))
    )


def lift(hits: DataFrame, offset: str = "tile_start") -> DataFrame:
    """Tile coordinates -> contig coordinates; the offset is a column, not a name suffix."""
    return hits.withColumn("start", F.col("start") + F.col(offset)).withColumn(
        "end", F.col("end") + F.col(offset)
    )
