"""Input checks.  Each returns one row ``(check, severity, n, sample)``.

Counts and samples are plain aggregates; the full list of offending rows is
what the ``*_rows`` functions return.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.operators.peaks import duplicated_ids
from boxscan.sources.bed import bad_numbers

ERROR, WARNING, INFO = "error", "warning", "info"


def report(rows: DataFrame, check: str, severity: str, sample: str) -> DataFrame:
    """Count of offending rows and the smallest of them."""
    return rows.agg(
        F.count("*").alias("n"), F.min(F.col(sample).cast("string")).alias("sample")
    ).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n", "sample")


def combine(reports: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


# --- FASTA ---------------------------------------------------------------

def empty_entries(headers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries without any base."""
    filled = sizes.filter("length > 0").select("contig")
    return headers.join(filled, "contig", "left_anti")


def spaced_headers(headers: DataFrame) -> DataFrame:
    """Whitespace between ``>`` and the name."""
    return headers.filter(F.col("header").rlike(r"^>(\s|$)"))


def duplicate_names(headers: DataFrame) -> DataFrame:
    return headers.groupBy("contig").agg(F.count("*").alias("n")).filter("n > 1")


def check_fasta(headers: DataFrame, sizes: DataFrame, many: int = 25) -> DataFrame:
    totals = headers.agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("sample"))

    def counted(check, severity, keep):
        return totals.select(
            F.lit(check).alias("check"), F.lit(severity).alias("severity"),
            F.when(keep, F.greatest("n", F.lit(1))).otherwise(0).cast("long").alias("n"), "sample",
        )

    return combine([
        report(empty_entries(headers, sizes), "empty_entry", ERROR, "contig"),
        report(spaced_headers(headers), "spaced_header", ERROR, "header"),
        report(duplicate_names(headers), "duplicate_name", ERROR, "contig"),
        counted("no_entries", ERROR, F.col("n") == 0),
        counted("many_entries", WARNING, F.col("n") > many),
    ])


# --- BED -----------------------------------------------------------------

def column_counts(lines: DataFrame) -> DataFrame:
    """Lines per number of tab-separated cells."""
    return lines.groupBy(F.size(F.split("value", "\t", -1)).alias("cells")).agg(F.count("*").alias("n"))


def missing_contigs(peaks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every contig named by a peak but absent from the sequences, with its peaks."""
    return (
        peaks.groupBy("contig").agg(F.count("*").alias("n_peaks"))
        .join(sizes.select("contig"), "contig", "left_anti")
    )


def reversed_peaks(peaks: DataFrame) -> DataFrame:
    return peaks.filter(F.col("start") >= F.col("end"))


def check_bed_lines(lines: DataFrame) -> DataFrame:
    """Tabs present, the same number of cells everywhere, at least six."""
    counts = column_counts(lines)
    cells = F.col("cells").cast("string").alias("cells")
    kinds = counts.agg(
        F.count("*").alias("kinds"), F.min("cells").alias("least"), F.max("cells").alias("most")
    )

    def row(check, n):
        return kinds.select(
            F.lit(check).alias("check"), F.lit(ERROR).alias("severity"), n.cast("long").alias("n"),
            F.concat_ws("-", F.col("least").cast("string"), F.col("most").cast("string")).alias("sample"),
        )

    untabbed = counts.filter("cells < 2").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min(cells).alias("sample")
    ).select(F.lit("not_tabbed").alias("check"), F.lit(ERROR).alias("severity"), "n", "sample")
    kind = F.col("kinds")
    return combine([
        untabbed,
        row("empty_bed", F.when(kind == 0, 1).otherwise(0)),
        row("uneven_columns", F.when(kind > 1, kind).otherwise(0)),
        row("too_few_columns", F.when((kind == 1) & (F.col("most") < 6), 1).otherwise(0)),
    ])


def check_bed_numbers(lines: DataFrame) -> DataFrame:
    """Places that are no integers; the first line of a file may be a header."""
    return report(bad_numbers(lines), "no_number", ERROR, "value")


def check_peaks(peaks: DataFrame, sizes: DataFrame, width: int = K.WINDOW) -> DataFrame:
    long = peaks.filter(F.col("end") - F.col("start") > width)
    return combine([
        report(missing_contigs(peaks, sizes), "unknown_contig", ERROR, "contig"),
        report(reversed_peaks(peaks), "start_not_before_end", ERROR, "gene_id"),
        report(long, "longer_than_window", WARNING, "gene_id"),
        report(duplicated_ids(peaks), "duplicated_id", WARNING, "gene_id"),
        scoring_units(peaks),
    ])


def scoring_units(peaks: DataFrame) -> DataFrame:
    """Windows to score: peaks, counted twice where the strand is unknown."""
    known = F.coalesce(F.col("strand").isin("+", "-"), F.lit(False))
    return peaks.agg(
        (F.count("*") + F.count_if(~known)).alias("n")
    ).select(F.lit("scoring_units").alias("check"), F.lit(INFO).alias("severity"), "n",
             F.lit(None).cast("string").alias("sample"))


def raise_on_error(checks: DataFrame) -> None:
    """Collects the report, a dozen rows, and raises on the first error."""
    bad = checks.filter((F.col("severity") == ERROR) & (F.col("n") > 0)).orderBy("check").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['n']} (e.g. {r['sample']})" for r in bad))
