"""Islands of neighbouring windows, found without one task per contig.

A plain window over (contig, strand) makes one task of a contig.  Here the
windows are laid out in ranges of (contig, strand, start), whatever contigs they
belong to: one exchange, and the only one that moves a window.  A range is folded
in order and knows the island of each of its rows but for those at its beginning,
which may belong to an island that opened earlier.

What a range knows is summed up in one row: its first and last start, and the
head of its last island, if that opened inside.  Such rows compose: a range
whose first start is near the last one before it takes over the open island, and
one that is a single island hands on what it took over.  A scan over one row
per range settles all beginnings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxscan.session import stage, task_count

KEYS = ["contig", "strand"]
BUCKET = 1 << 18


def _fold(max_gap: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds ``_own``: the first start of each row's island, null where it may lie before the range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, head = None, None  # the last row, and the head of the open island
        for pdf in batches:
            if not len(pdf):
                continue
            start = pdf["start"].to_numpy()
            opens = np.ones(len(pdf), bool)
            opens[1:] = start[1:] - start[:-1] > max_gap
            for key in KEYS:
                values = pdf[key].to_numpy()
                opens[1:] |= values[1:] != values[:-1]
            first = (pdf["contig"].iloc[0], pdf["strand"].iloc[0], start[0])
            opens[0] = before is not None and (first[:2] != before[:2] or first[2] - before[2] > max_gap)
            last = np.maximum.accumulate(np.where(opens, np.arange(len(pdf)), -1))
            own = pd.array(start[np.maximum(last, 0)], "Int64")
            own[last < 0] = pd.NA if head is None else head
            before = (pdf["contig"].iloc[-1], pdf["strand"].iloc[-1], start[-1])
            head = None if pd.isna(own[-1]) else int(own[-1])
            yield pdf.assign(_own=own)

    return run


def islands(windows: DataFrame, max_gap: int = 1, ranges: int | None = None) -> DataFrame:
    """Adds ``head``, the start of the first window of the island of each window.

    An island ends where the next start on the same contig and strand is more
    than ``max_gap`` away.  ``windows`` is read twice, as ranges are found by
    sampling: pass a written table where it is costly to make.
    """
    laid = stage(in_ranges(windows, max_gap, ranges), "islands")
    return laid.join(F.broadcast(carried_heads(laid, max_gap)), "_range").select(
        *windows.columns, F.coalesce("_own", "_carry").alias("head")
    )


def in_ranges(windows: DataFrame, max_gap: int, ranges: int | None = None) -> DataFrame:
    """Windows in ranges of their order, each with ``_range`` and the island that its range knows (``_own``)."""
    ranges = ranges or task_count(windows.sparkSession)
    return (
        windows.repartitionByRange(ranges, *KEYS, "start").sortWithinPartitions(*KEYS, "start", "end")
        .mapInPandas(_fold(max_gap), T.StructType([*windows.schema, T.StructField("_own", T.LongType())]))
        .withColumn("_range", F.spark_partition_id())
    )


def carried_heads(laid: DataFrame, max_gap: int) -> DataFrame:
    """(_range, _carry): the head of the island at the beginning of each range; one row per range."""
    place = F.struct(*KEYS, "start")
    summary = laid.groupBy("_range").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.max_by("_own", place).alias("open")
    )
    in_order = Window.orderBy("_range")
    last = F.lag("last").over(in_order)
    same = F.lit(True)
    for key in KEYS:
        same = same & F.col(f"first.{key}").eqNullSafe(last[key])
    goes_on = F.coalesce(same & (F.col("first.start") - last["start"] <= max_gap), F.lit(False))
    # the island open at the end of a range: its own, or the one it began with
    begun = F.when(~goes_on, F.col("first.start"))
    summary = summary.withColumn("begun", begun).withColumn("left", F.coalesce("open", "begun"))
    handed = F.last("left", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return summary.select("_range", F.coalesce("begun", handed).alias("_carry"))


def block_aggregate(windows: DataFrame) -> DataFrame:
    """One block per island: first start, last end, mean probability, window count."""
    return (
        windows.groupBy(*KEYS, "head")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.round(F.avg("prob"), 9).alias("score"),
            F.count("*").alias("n_windows"),
        )
        .drop("head")
    )


def blocks_of(windows: DataFrame, max_gap: int = 1, ranges: int | None = None) -> DataFrame:
    return block_aggregate(islands(windows, max_gap, ranges))
