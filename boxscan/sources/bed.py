"""BED peaks as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["contig", "start", "end", "gene_id", "score", "strand"]


def bed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with a column that orders them as in the files."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("row_no"),
    )


def _typed(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t", -1)
    typed = lines.select(
        *[F.get(cells, F.lit(i)).alias(name) for i, name in enumerate(COLUMNS)], "row_no", "value"
    )
    return typed.withColumn("start", F.col("start").try_cast("long")).withColumn("end", F.col("end").try_cast("long"))


def parse_bed(lines: DataFrame) -> DataFrame:
    """First six columns, typed, of the rows with integer places; ``bad_numbers`` has the others."""
    return _typed(lines).drop("value").filter(F.col("start").isNotNull() & F.col("end").isNotNull())


def bad_numbers(lines: DataFrame) -> DataFrame:
    """Lines whose start or end is no integer, but for a header in the first line of a file."""
    bad = _typed(lines).filter(F.col("start").isNull() | F.col("end").isNull())
    first = lines.groupBy(F.col("row_no.file").alias("_file")).agg(F.min("row_no").alias("_first"))
    met = (F.col("row_no.file") == F.col("_file")) & (F.col("row_no") == F.col("_first"))
    return bad.join(first, met, "left_anti").select("value", "row_no")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``peaks(contig, start, end, gene_id, score, strand, row_no)``; extra columns ignored."""
    return parse_bed(bed_lines(spark, path))
