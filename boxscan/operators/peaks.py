"""Preparation of user peaks (BED rows) for scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.intervals import centre_end, centre_start, widen_left, widen_right
from boxscan.operators.extract import slop

CENTRED = "_center_window"


def centre_long(peaks: DataFrame, width: int = K.WINDOW) -> DataFrame:
    """Peaks longer than a window shrink to their centre and are renamed."""
    start, end = F.col("start"), F.col("end")
    long = end - start > width
    return (
        peaks.withColumn("_long", long)
        .withColumn("_s", F.when(long, centre_start(start, end, width)).otherwise(start))
        .withColumn("_e", F.when(long, centre_end(start, end, width)).otherwise(end))
        .withColumn("gene_id", F.when(F.col("_long"), F.concat("gene_id", F.lit(CENTRED)))
                    .otherwise(F.col("gene_id")))
        .withColumn("start", F.col("_s")).withColumn("end", F.col("_e"))
        .drop("_s", "_e", "_long")
    )


def long_peaks(peaks: DataFrame, width: int = K.WINDOW) -> DataFrame:
    """The peaks of which only the centre is looked at."""
    return peaks.filter(F.col("end") - F.col("start") > width).select("gene_id", "contig", "start", "end")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key.  An aggregate, not a window: a key with a third of all
    rows is reduced in every task before it is shuffled."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def deduplicate(peaks: DataFrame, order: str = "row_no") -> DataFrame:
    """First row per id, then first row per location, in input order."""
    return first_of(
        first_of(peaks, ["gene_id"], [order]), ["contig", "start", "end", "strand"], [order]
    )


def duplicated_ids(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("gene_id").agg(F.count("*").alias("n")).filter("n > 1")


def expand_strands(peaks: DataFrame) -> DataFrame:
    """Peaks without a strand are looked at on both, under two ids."""
    known = F.col("strand").isin("+", "-")
    sides = F.when(known, F.array("strand")).otherwise(F.array(F.lit("+"), F.lit("-")))
    return (
        peaks.withColumn("_known", F.coalesce(known, F.lit(False)))
        .withColumn("strand", F.explode(sides))
        .withColumn("gene_id", F.when(F.col("_known"), F.col("gene_id"))
                    .otherwise(F.concat_ws("_", "gene_id", "strand")))
        .drop("_known")
    )


def widen_short(peaks: DataFrame, sizes: DataFrame, width: int = K.WINDOW) -> DataFrame:
    """Peaks shorter than a window grow to it; the odd nt goes right; contig ends clamp."""
    start, end = F.col("start"), F.col("end")
    return slop(peaks, sizes, widen_left(start, end, width), widen_right(start, end, width))


def rejected_peaks(peaks: DataFrame, sizes: DataFrame, width: int = K.WINDOW) -> DataFrame:
    """``(row_no, gene_id, reason)`` of every peak that ``prepare_peaks`` leaves out.

    ``row_no`` tells the rows apart.  Each peak has the first reason that holds,
    in the order in which the preparation meets them.
    """
    reversed_, negative = F.col("start") >= F.col("end"), F.col("start") < 0
    bad = peaks.filter(reversed_ | negative).select(
        "row_no", "gene_id", F.when(reversed_, "start_not_before_end").otherwise("negative_start").alias("reason"))
    valid = peaks.filter(~(reversed_ | negative))
    centred = centre_long(valid, width)
    by_id = first_of(centred, ["gene_id"], ["row_no"])
    by_place = first_of(by_id, ["contig", "start", "end", "strand"], ["row_no"])
    inside = widen_short(by_place, sizes, width).filter(F.col("start") < F.col("end"))
    known = peaks.join(sizes.select("contig"), "contig", "left_semi")

    def mark(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("row_no", F.lit(True).alias(name))

    reason = (
        F.when(F.col("_id").isNull(), "repeated_id").when(F.col("_place").isNull(), "repeated_place")
        .when(F.col("_known").isNull(), "unknown_contig").when(F.col("_inside").isNull(), "outside_contig")
    )
    judged = valid.select("row_no", "gene_id")
    for rows, name in ((by_id, "_id"), (by_place, "_place"), (known, "_known"), (inside, "_inside")):
        judged = judged.join(mark(rows, name), "row_no", "left")
    return bad.unionByName(
        judged.select("row_no", "gene_id", reason.alias("reason")).filter("reason IS NOT NULL"))


def strandless(peaks: DataFrame) -> DataFrame:
    """Peaks that are looked at on both strands."""
    return peaks.filter(~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)))


def prepare_peaks(peaks: DataFrame, sizes: DataFrame, width: int = K.WINDOW) -> DataFrame:
    """Centre, deduplicate, expand strands, widen; bad or unknown places drop out."""
    valid = peaks.filter((F.col("start") < F.col("end")) & (F.col("start") >= 0))
    ready = expand_strands(deduplicate(centre_long(valid, width)))
    return widen_short(ready, sizes, width).filter(F.col("start") < F.col("end")).select(
        "contig", "start", "end", "gene_id", "strand"
    )
