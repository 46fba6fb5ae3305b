"""The whole runs: a scan over sequences, or scoring of given peaks."""

from __future__ import annotations

from contextlib import nullcontext
from copy import copy
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.operators import checks
from boxscan.operators.attribution import attribute, positives_only
from boxscan.operators.centres import (
    centre_windows, confirm_centres, short_candidates, with_prediction_ids,
)
from boxscan.operators.extract import sequences_at
from boxscan.operators.features import with_features
from boxscan.operators.islands import blocks_of
from boxscan.operators.limits import gene_table, without_n
from boxscan.operators.merge import keep_long, merge_reciprocal
from boxscan.operators.motifs import find_boxes
from boxscan.operators.peaks import prepare_peaks
from boxscan.operators.rules import apply_rules
from boxscan.operators.scoring import (
    MotifScorer, Scorer, StemScorer, bed_threshold, refine, scan, scan_threshold, score_windows,
)
from boxscan.operators.tiles import TILE, tile_lines
from boxscan.session import files_key, resumable, stage, task_count
from boxscan.sinks.formats import write
from boxscan.sinks.tables import final_table
from boxscan.sources.bed import bed_lines, parse_bed
from boxscan.sources.fasta import contig_sizes, fasta_headers, read_fasta
from boxscan.sources.fasta_ranges import range_headers, read_fasta_ranges


@dataclass
class Params:
    """Everything a user may set."""

    width: int | None = None                  # of a window, nt; None: what the first model reads
    step_size: int = K.STEP
    strand: str = "both"
    tile_size: int = TILE
    prob_first_model: float | None = None     # None: 0.999, relaxed where inputs are short
    consecutive_windows: int = K.CONSECUTIVE_WINDOWS
    min_windows: int | None = None            # also ask for a number of windows
    prob_second_model: float = K.PROB_SECOND
    box_score: int = K.BOX_SCORE
    score_c: int = K.SCORE_C
    score_d: int = K.SCORE_D
    terminal_stem_score: float = K.TERMINAL_STEM_SCORE
    normalized_sno_stability: float = K.SNO_STABILITY
    first_model_only: bool = False
    min_box_dist: int = K.MIN_BOX_DIST
    flanking_nt: int = K.FLANK
    batch_size: int | None = None             # None: what the model itself asks for
    range_bytes: int | None = None            # read FASTA by byte ranges of this size; None: by lines
    on_bad_peaks: str = "raise"               # or "drop": leave them out, see rejected_peaks
    first_model: Scorer = field(default_factory=MotifScorer)
    second_model: Scorer = field(default_factory=StemScorer)

    def __post_init__(self):
        for name in ("width", "step_size", "tile_size", "consecutive_windows", "batch_size", "range_bytes"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be > 0")
        for name in ("box_score", "score_c", "score_d"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be >= 0")
        for name in ("prob_first_model", "prob_second_model"):
            value = getattr(self, name)
            if value is not None and not 0.5 <= value < 1:
                raise ValueError(f"{name} must be >= 0.5 and < 1")
        for name in ("terminal_stem_score", "normalized_sno_stability"):
            if getattr(self, name) > 0:
                raise ValueError(f"{name} must be <= 0")
        if self.strand not in ("both", "plus", "minus"):
            raise ValueError("strand must be both, plus or minus")
        if self.on_bad_peaks not in ("raise", "drop"):
            raise ValueError("on_bad_peaks must be raise or drop")
        if self.width is None:
            self.width = self.first_model.width
        self.first_model, self.second_model = (
            type(m)(self.width) if type(m) in (MotifScorer, StemScorer) and m.width != self.width else m
            for m in (self.first_model, self.second_model))
        if {self.first_model.width, self.second_model.width} != {self.width}:
            raise ValueError(f"both models must read windows of {self.width} nt")
        if self.batch_size is not None:  # on copies: the models belong to the caller
            self.first_model, self.second_model = copy(self.first_model), copy(self.second_model)
            self.first_model.batch_size = self.second_model.batch_size = self.batch_size

    @property
    def halo(self) -> int:
        """What a tile must hold beyond its end."""
        return self.width - 1

    def key(self) -> dict:
        """What decides the results, for a resumable run; models by class, version and plain settings."""
        out = {}
        for item in fields(self):
            value = getattr(self, item.name)
            out[item.name] = model_key(value) if isinstance(value, Scorer) else value
        return out


def model_key(model: Scorer) -> list:
    """A model changed under the same name needs another ``Scorer.version``."""
    names = sorted({"width", "batch_size", *vars(model)} - {"version"})
    plain = [(n, getattr(model, n)) for n in names if isinstance(getattr(model, n), (int, float, str, bool, type(None)))]
    calls = [(n, f"{v.__module__}.{v.__qualname__}") for n, v in sorted(vars(model).items()) if hasattr(v, "__qualname__")]
    kind = type(model)
    return [f"{kind.__module__}.{kind.__qualname__}", model.version, plain, calls]


def positive_windows(tiles: DataFrame, params: Params, threshold: float) -> DataFrame:
    """Positive windows above the threshold, written once: scoring is what costs."""
    hits = scan(tiles, params.first_model, params.step_size, params.strand, threshold=threshold)
    return stage(hits, "windows")


def merged_blocks(windows: DataFrame, params: Params) -> DataFrame:
    merged = merge_reciprocal(blocks_of(windows))
    return keep_long(merged, params.consecutive_windows, params.width, min_count=params.min_windows)


def find_candidates(tiles: DataFrame, params: Params, threshold: float) -> DataFrame:
    """Where are the candidate genes?  One row per confirmed centre window."""
    windows = positive_windows(tiles, params, threshold)
    centres = centre_windows(merged_blocks(windows, params), params.width)
    found = confirm_centres(
        centres, windows, tiles, threshold, params.step_size, params.first_model, params.tile_size,
        params.halo,
    )
    short = short_candidates(windows, tiles, params.width)
    if params.consecutive_windows == 1:
        # a contig of one window would be a block as well
        found = found.join(short.select("contig").distinct(), "contig", "left_anti").select(*found.columns)
    return with_prediction_ids(found.unionByName(short))


def candidates_of_peaks(
    peaks: DataFrame, sizes: DataFrame, tiles: DataFrame, params: Params
) -> DataFrame:
    """Prepared peaks whose window is positive; ids are the user's."""
    threshold = bed_threshold(params.prob_first_model)
    read = sequences_at(prepare_peaks(peaks, sizes, params.width), tiles, params.tile_size, params.halo)
    scored = score_windows(read, params.first_model, above=threshold)
    # attribution scores each candidate some 190 times: spread the few rows first
    return scored.repartition(task_count(peaks.sparkSession), "gene_id").filter("passes").select(
        "contig", "start", "end", "strand", F.col("p_top").alias("score"),
        F.col("gene_id").alias("block_id"), F.col("start").alias("block_start"),
        F.col("end").alias("block_end"), "window_seq", "gene_id",
    )


def genes_of(candidates: DataFrame, params: Params) -> DataFrame:
    """Attribution, boxes and gene limits; one shuffle, for the locations."""
    positive = positives_only(attribute(candidates, params.first_model))
    return gene_table(
        find_boxes(positive, params.width, params.min_box_dist, params.flanking_nt)
    )


def label_genes(
    genes: DataFrame, refinements: DataFrame, params: Params, energies: DataFrame | None = None
) -> DataFrame:
    """Features, second model and rules."""
    seen = refinements.select(
        "gene_id", "probability_expressed_pseudogene", "second_model_prediction"
    )
    joined = with_features(genes, energies).join(seen, "gene_id", "left")
    labelled = apply_rules(
        joined, params.prob_second_model, params.terminal_stem_score,
        params.normalized_sno_stability, params.box_score, params.score_c, params.score_d,
    )
    return without_n(labelled)


def _finish(candidates: DataFrame, params: Params, energies: DataFrame | None) -> DataFrame:
    if params.first_model_only:
        return final_table(without_n(genes_of(candidates, params)), minimal=True)
    candidates = stage(candidates, "candidates")
    return final_table(label_genes(
        genes_of(candidates, params), refine(candidates, params.second_model), params, energies
    ))


def run_scan(
    tiles: DataFrame, params: Params | None = None, energies: DataFrame | None = None
) -> DataFrame:
    """Final gene table of a whole set of tiled contigs."""
    params = params or Params()
    threshold = scan_threshold(tiles, params.prob_first_model, params.width)
    return _finish(find_candidates(tiles, params, threshold), params, energies)


def run_peaks(
    peaks: DataFrame,
    sizes: DataFrame,
    tiles: DataFrame,
    params: Params | None = None,
    energies: DataFrame | None = None,
) -> DataFrame:
    """Final gene table of given peaks; step, strand and block settings do not apply."""
    params = params or Params()
    if params.on_bad_peaks == "raise":
        checks.raise_on_error(checks.check_peaks(peaks, sizes, params.width))
    return _finish(candidates_of_peaks(peaks, sizes, tiles, params), params, energies)


def run_files(
    spark: SparkSession,
    fasta: str,
    bed: str | None = None,
    params: Params | None = None,
    energies: DataFrame | None = None,
    resume: str | None = None,
) -> DataFrame:
    """Final gene table straight from FASTA, and BED if peaks are given.

    All input checks run first and raise.  The tiles are written once, as the
    run reads them several times.  With ``resume``, a shared folder, the written
    tables stay there: a run of the same files, parameters and models takes up
    those that an earlier one finished (``session.Steps``).  Given energies join
    after the last of them.
    """
    params = params or Params()
    if resume is None:
        kept = nullcontext()
    else:
        inputs = {"fasta": [fasta, *files_key(spark, fasta)], "bed": bed and [bed, *files_key(spark, bed)]}
        kept = resumable(spark, resume, {**inputs, "params": params.key()})
    with kept:
        return _run_files(spark, fasta, bed, params, energies)


def _run_files(
    spark: SparkSession, fasta: str, bed: str | None, params: Params, energies: DataFrame | None
) -> DataFrame:
    if params.range_bytes is None:
        lines, headers = read_fasta(spark, fasta), fasta_headers(spark, fasta)
    else:
        lines = read_fasta_ranges(spark, fasta, params.range_bytes)
        headers = range_headers(spark, fasta, params.range_bytes)
    sizes = stage(contig_sizes(lines), "sizes")
    checks.raise_on_error(checks.check_fasta(headers, sizes))
    if bed is not None:
        raw = bed_lines(spark, bed)
        checks.raise_on_error(checks.combine([checks.check_bed_lines(raw), checks.check_bed_numbers(raw)]))
        peaks = parse_bed(raw)
        checks.raise_on_error(checks.check_peaks(peaks, sizes, params.width))
    tiles = stage(tile_lines(lines, sizes, params.tile_size, params.halo), "lake")
    return run_scan(tiles, params, energies) if bed is None else run_peaks(peaks, sizes, tiles, params, energies)


def save(final: DataFrame, path: str, output_type: str = "tsv") -> None:
    write(final, path, output_type)
