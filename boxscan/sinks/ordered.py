"""Exports whose order can be checked: parts in order, with the key range of each.

``export`` writes a final table as ``formats.write`` does, reads the written lines
back and stores one row per part under ``_manifest``: its number of lines and
genes, its least and greatest (chr, start), and how many lines stand before a
smaller one.  Reading is by split, so a part of any size is many tasks; only the
summaries, one row per split, meet in one.

Defined results: an empty table has one part without genes, or none; lines
without a place (sequences, table heads) are counted but not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxscan.sinks.formats import SOURCE, write


def written_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(part, split, at, value)`` of every line; ``at`` rises inside a split of a part."""
    return spark.read.text(path).select(
        F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def place_of(value: Column, output_type: str) -> Column:
    """struct(chr, start) of a written line; null where it has none."""
    cells = F.split(value, "\t")
    if output_type == "fa":
        head = r"^>\S+ (.*):(\d+)-\d+ \([+-]\)"
        chr_, start = F.regexp_extract(value, head, 1), F.regexp_extract(value, head, 2)
    else:
        column = {"bed": (0, 1), "gtf": (0, 3), "tsv": (1, 2)}[output_type]
        chr_, start = F.get(cells, F.lit(column[0])), F.get(cells, F.lit(column[1]))
    number = F.when(start.rlike(r"^\d+$"), start).cast("long")
    return F.when(number.isNotNull(), F.struct(chr_.alias("chr"), number.alias("start")))


def _splits(lines: DataFrame, output_type: str) -> DataFrame:
    """One row per split of a part."""
    before = F.last("_place", ignorenulls=True).over(
        Window.partitionBy("part", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("_place", place_of(F.col("value"), output_type))
    return placed.withColumn("_back", (F.col("_place") < before).cast("long")).groupBy("part", "split").agg(
        F.count("*").alias("lines"), F.count("_place").alias("placed"),
        F.min("_place").alias("first"), F.max("_place").alias("last"),
        F.coalesce(F.sum("_back"), F.lit(0)).alias("back"),
    )


def manifest(spark: SparkSession, path: str, output_type: str) -> DataFrame:
    """One row per part that holds lines: ``part, lines, placed, first, last, back``.

    ``back`` counts the lines before a smaller one, the joints of splits included,
    and adds one where a part begins below the end of the parts before it.
    """
    # one row per split of the export
    earlier = Window.orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)
    joints = F.coalesce((F.col("first") < F.max("last").over(earlier)).cast("long"), F.lit(0))
    return (
        _splits(written_lines(spark, path), output_type).withColumn("_joint", joints)
        .groupBy("part").agg(
            F.sum("lines").alias("lines"), F.sum("placed").alias("placed"), F.min("first").alias("first"),
            F.max("last").alias("last"), F.sum(F.col("back") + F.col("_joint")).alias("back"),
        )
    )


def export(final: DataFrame, path: str, output_type: str = "tsv", source: str = SOURCE) -> DataFrame:
    """Writes ``final``, stores the manifest under ``path/_manifest`` and returns it.

    Raises where the written lines are out of order.
    """
    spark = final.sparkSession
    write(final, path, output_type, source)
    manifest(spark, path, output_type).coalesce(1).write.parquet(f"{path}/_manifest")
    stored = spark.read.parquet(f"{path}/_manifest")
    check_order(stored)
    return stored


def check_order(parts: DataFrame) -> None:
    wrong = parts.filter("back > 0").agg(F.count("*").alias("n"), F.min("part").alias("part")).first()
    if wrong.n:
        raise ValueError(f"{wrong.n} parts are out of order, the first is {wrong.part}")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)``: every written line with its 1-based number in the whole export."""
    lines = written_lines(spark, path)
    # one row per split of the export
    counts = lines.groupBy("part", "split").agg(F.count("*").alias("_n")).select(
        "part", "split", F.coalesce(F.sum("_n").over(
            Window.orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("part", "split").orderBy("at"))
    return lines.withColumn("_rank", rank).join(counts, ["part", "split"]).select(
        (F.col("_offset") + F.col("_rank")).cast("long").alias("line_no"), "value")
