"""Sequences of intervals, looked up in the tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxscan.functions.sequences import on_strand
from boxscan.operators.tiles import HALO, TILE, region_of
from boxscan.session import broadcast_if_small, stage


def sequences_at(
    intervals: DataFrame,
    tiles: DataFrame,
    size: int = TILE,
    halo: int = HALO,
    name: str = "window_seq",
    stranded: bool = True,
) -> DataFrame:
    """Adds the stranded sequence of each interval, at most ``halo + 1`` nt long.

    One tile holds the whole interval, so this is an equi-join on
    (contig, tile): a tile row meets only its own intervals.  Where both sides
    are shuffled, AQE splits a tile on which many of them lie; a bucketed lake is
    not shuffled, so there the intervals of a tile stay in one task.  Intervals
    on unknown contigs drop out (``peaks.rejected_peaks`` names them).

    The tiles are the large side.  The intervals are written and measured
    first: a small set is broadcast, so that no tile moves; a large one is
    joined by key, where a lake saved by ``tiles.save_lake`` is already in
    place and only the intervals are shuffled.
    """
    intervals = stage(intervals, "intervals")
    inside = F.substr(
        "_seq", (F.col("start") - F.col("_tile_start") + 1).cast("int"),
        (F.col("end") - F.col("start")).cast("int"),
    )
    checked = F.when(F.col("end") - F.col("start") <= halo + 1, inside).otherwise(
        F.raise_error(F.lit(f"interval longer than {halo + 1} nt; use long_sequences_at"))
    )
    lake, on = _by_region(tiles.select(
        "contig", F.col("tile").alias("_tile"),
        F.col("tile_start").alias("_tile_start"), F.col("seq").alias("_seq"), *_region(tiles),
    ))
    asked = intervals.withColumn("_tile", F.floor(F.col("start") / size))
    return (
        broadcast_if_small(_with_region(asked, on))
        .join(lake, on)
        .withColumn(name, on_strand(checked, F.col("strand")) if stranded else checked)
        .select(*intervals.columns, name)
    )


def _region(tiles: DataFrame) -> list[str]:
    return ["region"] if "region" in tiles.columns else []


def _by_region(lake: DataFrame) -> tuple[DataFrame, list[str]]:
    """The lake and its join keys; one laid out by regions (``tiles.save_regions``) is joined by region, too."""
    if "region" not in lake.columns:
        return lake, ["contig", "_tile"]
    return lake.withColumnRenamed("region", "_region"), ["contig", "_tile", "_region"]


def _with_region(asked: DataFrame, on: list[str]) -> DataFrame:
    """Intervals with the region of their tile.

    Spark prunes folders at run time only for a side that has a filter; every
    interval passes this one.
    """
    if "_region" not in on:
        return asked
    named = asked.withColumn("_region", region_of(F.col("contig"), F.col("_tile")))
    return named.filter(F.col("_tile") >= F.lit(-(1 << 62)))


def long_sequences_at(
    intervals: DataFrame, tiles: DataFrame, key: list[str], size: int = TILE, name: str = "sequence"
) -> DataFrame:
    """Like ``sequences_at`` for intervals of any length; ``key`` names a row."""
    lake, on = _by_region(
        tiles.select("contig", F.col("tile").alias("_tile"), "tile_start", "tile_end", "seq", *_region(tiles)))
    lo = F.greatest(F.col("start"), F.col("tile_start"))
    hi = F.least(F.col("end"), F.col("tile_end"))
    if "_region" in on:
        intervals = broadcast_if_small(stage(intervals, "intervals"))
    asked = intervals.select(
        *dict.fromkeys([*key, "contig", "start", "end", "strand"]),
        F.explode(
            F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))
        ).alias("_tile"),
    )
    parts = (
        _with_region(asked, on).join(lake, on)
        .filter(lo < hi)
        .select(
            *key, "strand", lo.alias("at"),
            F.substr("seq", (lo - F.col("tile_start") + 1).cast("int"), (hi - lo).cast("int")).alias("bases"),
        )
    )
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("at", "bases")))["bases"], "")
    return parts.groupBy(*key, "strand").agg(joined.alias("_whole")).select(
        *key, on_strand(F.col("_whole"), F.col("strand")).alias(name)
    )


def slop(intervals: DataFrame, sizes: DataFrame, left, right) -> DataFrame:
    """Intervals widened by ``left`` and ``right`` columns, clamped to their contig."""
    return (
        intervals.join(sizes.select("contig", F.col("length").alias("_length")), "contig")
        .withColumn("_start", F.greatest(F.col("start") - left, F.lit(0)))
        .withColumn("_end", F.least(F.col("end") + right, F.col("_length")))
        .select(*[
            F.col("_start").alias("start") if c == "start"
            else F.col("_end").alias("end") if c == "end" else F.col(c)
            for c in intervals.columns
        ])
    )
