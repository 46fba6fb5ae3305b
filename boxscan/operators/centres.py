"""Centre windows of blocks, their confirmation, and prediction ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.intervals import centre_end, centre_start
from boxscan.functions.sequences import on_strand
from boxscan.operators.extract import sequences_at
from boxscan.operators.scoring import Scorer, score_windows
from boxscan.operators.tiles import HALO, TILE
from boxscan.session import broadcast_if_small, stage, task_count

PLACE = ["contig", "start", "end", "strand"]


def block_id() -> F.Column:
    return F.concat_ws(
        ":", "contig", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")),
        "strand",
    )


def centre_windows(blocks: DataFrame, width: int = K.WINDOW) -> DataFrame:
    """``(contig, start, end, strand, score, block_id, block_start, block_end)``."""
    start, end = F.col("start"), F.col("end")
    return blocks.select(
        "contig",
        centre_start(start, end, width).alias("start"),
        centre_end(start, end, width).alias("end"),
        "strand", "score",
        block_id().alias("block_id"),
        start.alias("block_start"), end.alias("block_end"),
    )


def confirmed(centres: DataFrame, windows: DataFrame) -> DataFrame:
    """Centres that are positive windows themselves."""
    return centres.join(windows.select(*PLACE), PLACE, "left_semi")


def unconfirmed(centres: DataFrame, windows: DataFrame) -> DataFrame:
    return centres.join(windows.select(*PLACE), PLACE, "left_anti")


def with_presence(centres: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``present``.  The windows are reduced to the centres before anything is joined."""
    wanted = broadcast_if_small(centres.select(*PLACE))
    hit = windows.select(*PLACE).join(wanted, PLACE, "left_semi").distinct()
    return centres.join(hit.withColumn("present", F.lit(True)), PLACE, "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


def confirm_centres(
    centres: DataFrame,
    windows: DataFrame,
    tiles: DataFrame,
    threshold: float,
    step: int = K.STEP,
    scorer: Scorer | None = None,
    size: int = TILE,
    halo: int = HALO,
) -> DataFrame:
    """Centres that hold up, with their ``window_seq``.

    A centre among the positive windows stays.  With a step above 1 the scan
    may have jumped over a centre; such a centre is scored now and stays when
    positive above the threshold.  It keeps the score of its block.
    """
    marked = with_presence(centres, windows)
    if step == 1:
        return sequences_at(marked.filter("present").drop("present"), tiles, size, halo)
    read = sequences_at(marked, tiles, size, halo)
    asked = read.withColumn("_asked", F.when(~F.col("present"), F.col("window_seq")))
    return (
        score_windows(asked, scorer, "_asked", threshold)
        .filter(F.col("present") | F.col("passes"))
        .select(*centres.columns, "window_seq")
    )


def blocks_kept(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blocks whose centre held up."""
    return (
        blocks.withColumn("block_id", block_id())
        .join(candidates.select("block_id"), "block_id", "left_semi")
        .select("block_id", *blocks.columns)
    )


def number_rows(df: DataFrame, order: list[str], column: str = "row_number") -> DataFrame:
    """1-based row number over the whole table, without a one-task window.

    The table is range-partitioned, sorted and written with the partition and
    the position of each row; one count per partition then gives the offsets.
    Writing first is what makes the positions final.
    """
    spot = F.monotonically_increasing_id()
    # ranges are found by sampling, which would run an unwritten input twice
    df = stage(df, "unnumbered")
    laid = stage(
        # a fixed count, so that the costly steps per row that follow stay spread
        df.repartitionByRange(task_count(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(spot, 33))
        .withColumn("_rank", spot.bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset")
    )
    # one row per partition of the table above, whatever the data
    return (
        laid.join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_offset") + F.col("_rank") + 1)
        .drop("_part", "_rank", "_offset")
    )


def with_prediction_ids(candidates: DataFrame, prefix: str = "CD_") -> DataFrame:
    """Adds ``gene_id`` = CD_1, CD_2, ... in the order of contig, start, strand."""
    numbered = number_rows(candidates, ["contig", "start", "strand", "end", "block_id"], "_n")
    return numbered.withColumn("gene_id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def short_candidates(windows: DataFrame, tiles: DataFrame, width: int = K.WINDOW) -> DataFrame:
    """Contigs no longer than a window: their one window is block and centre at once."""
    whole = tiles.filter(F.col("length") <= width).select(
        "contig", F.col("length").alias("end"), F.col("seq").alias("_seq")
    )
    few = windows.filter((F.col("start") == 0) & (F.col("end") <= width))
    return few.join(whole, ["contig", "end"]).select(
        "contig", "start", "end", "strand", F.col("prob").alias("score"),
        block_id().alias("block_id"),
        F.col("start").alias("block_start"), F.col("end").alias("block_end"),
        on_strand(F.col("_seq"), F.col("strand")).alias("window_seq"),
    )
