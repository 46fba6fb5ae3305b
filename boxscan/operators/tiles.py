"""Tiles with a halo: the unit in which sequences are stored, shuffled and scanned.

Tile ``t`` owns the starts ``[t*size, (t+1)*size)`` and carries ``halo`` more
bases, so a window that starts in it is complete inside it.  Results do not
depend on the tile size, and one long contig spreads over many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K

TILE = 1 << 16
HALO = K.WINDOW - 1

COLUMNS = ["contig", "length", "tile", "tile_start", "tile_end", "seq"]


def tile_sequences(contigs: DataFrame, size: int = TILE, halo: int = HALO) -> DataFrame:
    """Tiles of ``contigs(contig, seq, length)``; a narrow explode, no shuffle."""
    tile = F.col("tile")
    return (
        contigs.filter("length > 0")
        .select(
            "contig", "length", F.col("seq").alias("_whole"),
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))
            ).alias("tile"),
        )
        .select(
            "contig", "length", "tile",
            (tile * size).alias("tile_start"),
            F.least((tile + 1) * size, F.col("length")).alias("tile_end"),
            F.substr("_whole", (tile * size + 1).cast("int"), F.lit(size + halo)).alias("seq"),
        )
    )


def tile_lines(
    lines: DataFrame, sizes: DataFrame, size: int = TILE, halo: int = HALO
) -> DataFrame:
    """Tiles of ``lines(contig, pos, bases)``, whose pieces may be of any length.

    Each piece goes, cut to size, to the tiles it touches; pieces meet by
    (contig, tile), so a contig that holds a third of all bases is spread
    evenly.  The contig length comes as one more row per tile of ``sizes``,
    through the same shuffle: a join by contig would move every base again.
    """
    last = F.floor((F.col("pos") + F.length("bases") - 1) / size)
    first = F.greatest(F.floor((F.col("pos") - halo) / size), F.lit(0))
    lo = F.greatest(F.col("pos"), F.col("tile") * size)
    hi = F.least(
        F.col("pos") + F.length("bases"), (F.col("tile") + 1) * size + halo
    )
    cut = (
        lines.filter(F.length("bases") > 0)
        .withColumn("tile", F.explode(F.sequence(first, last)))
        .select(
            "contig", "tile", F.lit(None).cast("long").alias("length"),
            F.struct(
                lo.alias("pos"),
                F.substr("bases", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("bases"),
            ).alias("part"),
        )
    )
    known = sizes.filter("length > 0").select(
        "contig",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("tile"),
        "length",
        F.lit(None).cast("struct<pos:bigint,bases:string>").alias("part"),
    )
    return (
        cut.unionByName(known).groupBy("contig", "tile")
        .agg(F.max("length").alias("length"), F.array_sort(F.collect_list("part")).alias("parts"))
        # what lies beyond the last tile was only copied as a halo
        .filter(F.col("length").isNotNull())
        .select(
            "contig", "length", "tile",
            (F.col("tile") * size).alias("tile_start"),
            F.least((F.col("tile") + 1) * size, F.col("length")).alias("tile_end"),
            F.array_join(F.col("parts.bases"), "").alias("seq"),
        )
        # entries of one name, or lines that are missing, would give another length
        .withColumn("seq", F.when(
            F.length("seq") == F.least(F.col("tile_end") + halo, F.col("length")) - F.col("tile_start"), F.col("seq")
        ).otherwise(F.raise_error(F.concat(
            F.lit("tile "), F.col("tile").cast("string"), F.lit(" of "), F.col("contig"),
            F.lit(" does not hold each base once: repeated names or missing lines")))))
    )


def split_lines(contigs: DataFrame, width: int = 60) -> DataFrame:
    """``lines(contig, pos, bases)`` of whole sequences, as a FASTA file would hold them."""
    n = F.floor((F.col("length") - 1) / width)
    return (
        contigs.filter("length > 0")
        .select("contig", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i"))
        .select(
            "contig",
            (F.col("i") * width).alias("pos"),
            F.substr("seq", (F.col("i") * width + 1).cast("int"), F.lit(width)).alias("bases"),
        )
    )


def redistribute(tiles: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread tiles by (contig, tile): entries are split without one file per entry."""
    keys = ["contig", "tile"]
    return tiles.repartition(partitions, *keys) if partitions else tiles.repartition(*keys)


def save_lake(tiles: DataFrame, name: str, buckets: int) -> DataFrame:
    """Tiles as a table bucketed by (contig, tile).

    Looking up intervals then shuffles the intervals only, run after run.
    """
    (
        tiles.repartition(buckets, "contig", "tile").write.bucketBy(buckets, "contig", "tile")
        .sortBy("contig", "tile").mode("overwrite").saveAsTable(name)
    )
    return tiles.sparkSession.table(name)


#: Tiles in a row that share a region, and the number of regions of a lake.
SPAN, REGIONS = 64, 256


def region_of(contig: Column, tile: Column) -> Column:
    """The folder of a tile in a lake laid out by regions: neighbours together, contigs spread."""
    return F.pmod(F.xxhash64(contig, F.floor(tile / SPAN).cast("long")), F.lit(REGIONS)).cast("int")


def save_regions(tiles: DataFrame, path: str) -> DataFrame:
    """Tiles as parquet in a folder per ``region``.

    A lookup of few intervals reads the folders that these lie in: the regions
    of a broadcast side prune the scan while it runs.  A region holds runs of
    neighbouring tiles of many contigs, so none is hot.
    """
    named = tiles.withColumn("region", region_of(F.col("contig"), F.col("tile")))
    named.repartition("region").sortWithinPartitions("region", "contig", "tile").write.partitionBy("region").parquet(path)
    return tiles.sparkSession.read.schema(named.schema).parquet(path)
