"""FASTA text as a distributed table.

A FASTA line does not say which entry it belongs to, nor where in the entry
it lies; both depend on the lines before it.  The reader works per input
split, so a chromosome is never one row and no line is ever shuffled just to
learn its position:

1. a first pass over the text keeps one summary row per split (last header,
   bases before the first header, bases after the last one);
2. a window over those summary rows, one row per split of a file, carries
   the open entry and its offset into each split;
3. a second pass cuts every split into pieces of consecutive bases, and the
   carried values are joined in on (file, split).

Compressed files are one split each: correct, but read by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxscan.session import broadcast_if_small, stage

PIECE = 1 << 16
FASTA_FILES = "*.{fa,fasta}"

_SUMMARY = "file string, block long, has_header boolean, last_name string, head_len long, tail_len long"
_PIECES = "file string, block long, name string, offset long, bases string"


def fasta_lines(spark: SparkSession, path: str, glob: str | None = FASTA_FILES) -> DataFrame:
    """Raw lines with the file and split they come from, in split order per task."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (
        reader.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )


def _runs(batches: Iterator[pd.DataFrame]):
    """Yield ((file, block), name or None, opens, bases) per run of lines.

    A run starts at a header, at a new split or with a batch; ``name`` is
    None while no header of the split has been seen.
    """
    where, name = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        header = pdf["value"].str.startswith(">").to_numpy(dtype=bool)
        moved = (
            (pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())
        ).to_numpy(dtype=bool)
        text = [line.strip() for line in pdf["value"]]
        cuts = np.flatnonzero(header | moved)
        files, blocks = pdf["file"].to_numpy()[cuts], pdf["block"].to_numpy()[cuts]
        stops = np.append(cuts[1:], len(text))
        for start, stop, file, block in zip(cuts, stops, files, blocks):
            if (file, block) != where:
                where, name = (file, int(block)), None
            opens = bool(header[start])
            if opens:
                words = text[start][1:].split()
                name = words[0] if words else ""
            yield where, name, opens, "".join(text[start + opens:stop]).upper()


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: dict[tuple, list] = {}
    for (file, block), name, opens, bases in _runs(batches):
        row = out.setdefault((file, block), [file, block, False, None, 0, 0])
        if opens:
            row[2], row[3], row[5] = True, name, 0
        if row[2]:
            row[5] += len(bases)
        else:
            row[4] += len(bases)
    yield pd.DataFrame(
        list(out.values()),
        columns=["file", "block", "has_header", "last_name", "head_len", "tail_len"],
    )


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file", "block", "name", "offset", "bases"]
    key, offset, rows, held = None, 0, [], 0
    for (file, block), name, opens, bases in _runs(batches):
        if opens or key != (file, block):
            key, offset = (file, block), 0
        for i in range(0, len(bases), PIECE):
            rows.append((file, block, name, offset + i, bases[i:i + PIECE]))
        held += len(bases)
        offset += len(bases)
        if held > 1 << 24:
            yield pd.DataFrame(rows, columns=cols)
            rows, held = [], 0
    yield pd.DataFrame(rows, columns=cols)


def carried_entries(summary: DataFrame) -> DataFrame:
    """(file, block, carry_name, carry_len): the entry open at the start of each split, and its bases so far.

    ``summary`` has a row per split: has_header, last_name, head_len (bases
    before the first header) and tail_len (bases after the last one).
    """
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    # number of headers met before the split decides which lengths add up
    carried = (
        summary.withColumn("entry", F.sum(F.col("has_header").cast("int")).over(
            by_file.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("carry_name", F.last("last_name", ignorenulls=True).over(before))
        .withColumn("entry_in", F.col("entry") - F.col("has_header").cast("int"))
    )
    within = (
        Window.partitionBy("file", "entry_in").orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    opened = carried.filter("has_header").select(
        "file", F.col("entry").alias("entry_in"), F.col("tail_len").alias("opened_len")
    )
    return (
        carried.withColumn("bases_in", F.coalesce(F.sum("head_len").over(within), F.lit(0)))
        .join(opened, ["file", "entry_in"], "left")
        .select(
            "file", "block", "carry_name",
            (F.col("bases_in") + F.coalesce("opened_len", F.lit(0))).alias("carry_len"),
        )
    )


def joined_pieces(pieces: DataFrame, carried: DataFrame, changed: str, behind: Column | int = 0) -> DataFrame:
    """Pieces with ``contig`` and ``pos``; ``behind`` is added to offsets within their split."""
    resplit = F.raise_error(F.lit(changed))
    before = F.when(F.col("known"), F.col("carry_len")).otherwise(resplit.cast("long"))
    stray = F.raise_error(F.concat(F.lit("bases before the first header of "), "file")).cast("string")
    return (
        pieces.join(carried, ["file", "block"], "left")
        .withColumn("contig", F.coalesce("name", "carry_name", F.when(F.length("bases") > 0, stray)))
        .withColumn("pos", F.col("offset") + behind + F.when(F.col("name").isNull(), before).otherwise(0))
        .filter(F.col("contig").isNotNull())
    )


def read_fasta(spark: SparkSession, path: str, glob: str | None = FASTA_FILES) -> DataFrame:
    """``lines(contig, pos, bases)``: pieces of every entry with their 0-based offset."""
    lines = fasta_lines(spark, path, glob)
    # one row per split, written once: the text is not summed up again for
    # every use of the lines
    carried = stage(carried_entries(lines.mapInPandas(_summaries, _SUMMARY)), "splits")
    carried = broadcast_if_small(carried.withColumn("known", F.lit(True)))
    joined = joined_pieces(
        lines.mapInPandas(_pieces, _PIECES), carried, "the split size changed since the FASTA files were summed up")
    return joined.select("contig", "pos", "bases")


def fasta_headers(spark: SparkSession, path: str, glob: str | None = FASTA_FILES) -> DataFrame:
    """``headers(file, header, contig)``; ``contig`` is empty for a bare or spaced ``>``."""
    return (
        fasta_lines(spark, path, glob)
        .filter(F.col("value").startswith(">"))
        .select(
            "file",
            F.col("value").alias("header"),
            F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("contig"),
        )
    )


def contig_sizes(lines: DataFrame) -> DataFrame:
    """``(contig, length)``; partial sums meet before the shuffle, so a huge entry is cheap."""
    return lines.groupBy("contig").agg(F.sum(F.length("bases")).cast("long").alias("length"))
