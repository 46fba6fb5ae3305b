"""TSV, BED, GTF and FASTA writers.

Each format is a DataFrame of cells or lines, sorted and written by Spark as
part files in order; nothing passes the driver.  BED keeps the half-open
coordinates, GTF gets 1-based inclusive ones.  An empty result is an empty
folder with the same header.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.session import stage
from boxscan.sinks.tables import BOX_COLUMNS, is_minimal

SOURCE = "boxscan"

_ATTRIBUTES = ["probability_CD", "box_score", *BOX_COLUMNS]
_STRUCTURE = ["terminal_stem_score", "normalized_sno_stability", "probability_expressed_pseudogene"]


def text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("NA"))


def _fill(template: str) -> Column:
    """``'{a}:{b} text'`` with columns in place of the braces."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), text(name)]
    return F.concat(*parts, F.lit(rest))


def bed_rows(final: DataFrame) -> DataFrame:
    """Seven columns, the last one ``key=value; ...``."""
    names = list(_ATTRIBUTES)
    if not is_minimal(final):
        names += [*_STRUCTURE, "predicted_label"]
    names.append("predicted_sequence")
    attributes = F.concat_ws("; ", *[F.concat(F.lit(f"{n}="), text(n)) for n in names])
    return final.select(
        "chr", "start", "end", "gene_id", F.lit(".").alias("empty_score"), "strand",
        attributes.alias("attributes"),
    )


def gtf_rows(final: DataFrame, source: str = SOURCE) -> DataFrame:
    """Gene, transcript and exon rows; boxes and features sit on the gene row."""
    minimal = is_minimal(final)
    gene_id = F.col("gene_id")
    biotype = (
        F.lit(K.POSITIVE_LABEL) if minimal
        else F.when(F.col("predicted_label") == K.EXPRESSED, K.POSITIVE_LABEL)
        .otherwise(F.col("predicted_label"))
    )
    gene = {
        "gene_id": gene_id, "gene_version": F.lit("1"), "gene_name": gene_id,
        "gene_source": F.lit(source), "gene_biotype": biotype,
    }
    transcript = {
        "transcript_id": F.concat(gene_id, F.lit(".t1")), "transcript_version": F.lit("1"),
        "transcript_name": F.concat(gene_id, F.lit("-1")), "transcript_source": F.lit(source),
        "transcript_biotype": biotype, "tag": F.lit("basic"),
        "transcript_support_level": F.lit("NA"),
    }
    exon = {
        "exon_id": F.concat(gene_id, F.lit(".e1")), "exon_number": F.lit("1"),
        "exon_version": F.lit("1"),
    }
    boxes = {n: text(n) for n in [*_ATTRIBUTES, *([] if minimal else _STRUCTURE)]}

    def attributes(*groups: dict[str, Column]) -> Column:
        cells = [
            F.concat(F.lit(f'{name} "'), value, F.lit('"'))
            for group in groups for name, value in group.items()
        ]
        return F.concat(F.concat_ws("; ", *cells), F.lit(";"))

    features = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(name).alias("feature"), value.alias("attributes"))
        for i, (name, value) in enumerate([
            ("gene", attributes(gene, boxes)),
            ("transcript", attributes(gene, transcript)),
            ("exon", attributes(gene, transcript, exon)),
        ])
    ])
    return final.select("*", F.inline(features)).select(
        "chr", F.lit(source).alias("source"), "feature",
        (F.col("start") + 1).alias("start"), "end", F.lit(".").alias("score"), "strand",
        F.lit(".").alias("frame"), "attributes", "gene_id", "rank",
    )


def fasta_records(final: DataFrame) -> DataFrame:
    """``record``: header line and sequence line of each gene."""
    header = (
        ">{gene_id} {chr}:{start}-{end} ({strand}) probability_CD={probability_CD} "
        "C={C_MOTIF}/{C_START}/{C_END} D_PRIME={D_PRIME_MOTIF}/{D_PRIME_START}/{D_PRIME_END} "
        "C_PRIME={C_PRIME_MOTIF}/{C_PRIME_START}/{C_PRIME_END} D={D_MOTIF}/{D_START}/{D_END} "
        "box_score={box_score}"
    )
    if not is_minimal(final):
        header += (
            " terminal_stem_score={terminal_stem_score} "
            "normalized_sno_stability={normalized_sno_stability} predicted_label={predicted_label}"
        )
    return final.select(
        "chr", "start", "strand", "end", "gene_id", _fill(header + "\n{predicted_sequence}").alias("record")
    )


def write(final: DataFrame, path: str, output_type: str = "tsv", source: str = SOURCE) -> None:
    """Writes the final table to the folder ``path``, sorted by (chr, start, strand, end, gene_id).

    The table is written as parquet first: sorting samples its input, which
    would run the whole plan twice.
    """
    final = stage(final, "final")
    if final.limit(1).count() == 0:
        warnings.warn("no gene was predicted in the input")
    place = ["chr", "start", "strand", "end", "gene_id"]
    if output_type == "tsv":
        final.orderBy(*place).write.option("sep", "\t").option("header", True).csv(path)
    elif output_type == "bed":
        bed_rows(final).orderBy(*place).write.option("sep", "\t").option("quote", "").csv(path)
    elif output_type == "gtf":
        rows = gtf_rows(final, source).orderBy("chr", "start", "gene_id", "rank")
        rows.select(F.concat_ws("\t", *[
            F.col(c).cast("string") for c in rows.columns if c not in ("gene_id", "rank")
        ]).alias("value")).write.text(path)
    elif output_type == "fa":
        fasta_records(final).orderBy(*place).select("record").write.text(path)
    else:
        raise ValueError(f"output_type must be tsv, fa, bed or gtf, not {output_type!r}")


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> None:
    """Contigs as FASTA text in ``path``, lines of ``width``; one part per task."""
    body = F.regexp_replace(F.col("seq"), f"(.{{{width}}})(?=.)", "$1\n")
    contigs.select(F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), body)).write.text(path)
