"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions import sequences as S
from boxscan.functions.signals import framed, peaks, savgol
from boxscan.operators import attribution, centres, checks, energies, features, islands, limits, merge
from boxscan.operators import motifs, rules, scoring, signals, tiles, windows
from boxscan.operators import peaks as bed
from boxscan.operators.extract import long_sequences_at, sequences_at, slop
from boxscan.plans import genome
from boxscan.session import new_folder, stage, task_count
from boxscan.sinks import formats, ordered
from boxscan.sources import tables
from boxscan.sources.bed import read_bed
from boxscan.sources.fasta import contig_sizes, read_fasta
from boxscan.sources.fasta_ranges import read_fasta_ranges

SCAN = 0.9     # threshold of the interval queries
GENES = 0.99   # threshold of the per-candidate queries
SMALL_TILE = 500
RANGE = 1 << 16    # bytes; many entries lie across two ranges
NARROW = 150       # window width of the queries with other windows
KMER_TILE = 1 << 8   # short strings: reading a k-mer costs its offset


def lake(spark: SparkSession, folder: str) -> DataFrame:
    return tiles.tile_sequences(tables.document_contigs(spark, folder))


def staged_lake(spark, folder):
    """The lake as a written table, as ``run_files`` has it: a run reads it several times."""
    return stage(lake(spark, folder), "lake")


def sizes(spark, folder):
    return tables.document_contigs(spark, folder).select("contig", "length")


def hits(spark, folder, threshold, step=K.STEP):
    return scoring.scan(lake(spark, folder), step=step, threshold=threshold)


def staged_hits(spark, folder, threshold=SCAN, step=K.STEP):
    """Positive windows as a written table: what follows reads them more than once."""
    return stage(hits(spark, folder, threshold, step), "windows")


def params(**more) -> genome.Params:
    return genome.Params(prob_first_model=GENES, **more)


def candidates(spark, folder, threshold=GENES):
    return genome.find_candidates(staged_lake(spark, folder), params(), threshold)


def attributed(spark, folder):
    return attribution.attribute(candidates(spark, folder))


def boxed(spark, folder):
    return motifs.find_boxes(attribution.positives_only(attributed(spark, folder)))


# --- sources and checks --------------------------------------------------

def q_contig_sizes(spark, folder):
    lines = tiles.split_lines(tables.document_contigs(spark, folder))
    return contig_sizes(lines)


def q_duplicate_names(spark, folder):
    named = tables.document_contigs(spark, folder).select(F.md5("seq").alias("contig"))
    return checks.duplicate_names(named)


def q_fasta_scan(spark, folder):
    """Documents written as FASTA text, read back split by split, tiled and digested."""
    path = new_folder(spark, "fasta")
    formats.write_fasta(tables.document_contigs(spark, folder).filter("length > 0"), path)
    lines = read_fasta(spark, path, glob=None)
    cut = tiles.tile_lines(lines, contig_sizes(lines), SMALL_TILE)
    return cut.select("contig", "tile", "length", F.md5("seq").alias("digest"))


def q_fasta_ranges(spark, folder):
    """Documents as FASTA without line breaks, read by ranges far smaller than a line."""
    path = new_folder(spark, "unwrapped")
    contigs = tables.document_contigs(spark, folder).filter("length > 0")
    contigs.select(F.concat(F.lit(">"), "contig", F.lit(" one line\n"), "seq")).write.text(path)
    lines = read_fasta_ranges(spark, path, RANGE, globs="")
    cut = tiles.tile_lines(lines, contig_sizes(lines), SMALL_TILE)
    return cut.select("contig", "tile", "length", F.md5("seq").alias("digest"))


def q_fasta_checks(spark, folder):
    """Headers and sizes of the documents, some made bad."""
    doc = F.col("doc_id")
    named = tables.table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.pmod(doc, F.lit(89)) == 4, doc - 1).otherwise(doc).cast("string").alias("contig"),
        F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("n"),
    )
    headers = named.select(
        "contig",
        F.concat(F.when(F.pmod(doc, F.lit(97)) == 3, "> ").otherwise(">"), "contig").alias("header"),
    )
    filled = named.filter(F.pmod(doc, F.lit(83)) != 6).groupBy("contig").agg(F.sum("n").alias("length"))
    return checks.check_fasta(headers, filled)


def bed_text(spark, folder) -> DataFrame:
    peaks_ = tables.document_peaks(spark, folder)
    return peaks_.select(F.concat_ws("\t", *[
        F.col(c).cast("string") for c in ["contig", "start", "end", "gene_id", "score", "strand"]
    ], F.lit("extra")).alias("value"))


def q_bed_scan(spark, folder):
    """Peaks written as BED text with a header line in every part, read back."""
    path = new_folder(spark, "bed")
    titled = bed_text(spark, folder).select(F.concat(
        F.when(F.col("value").startswith("1\t0\t") | F.col("value").contains("_0\t"),
               "chrom\tstart\tend\tname\tscore\tstrand\tmore\n").otherwise(""), "value").alias("value"))
    titled.write.text(path)
    return read_bed(spark, path).drop("row_no")


def q_bed_checks(spark, folder):
    peaks_ = tables.document_peaks(spark, folder)
    return checks.combine([
        checks.check_bed_lines(bed_text(spark, folder)),
        checks.check_peaks(peaks_, sizes(spark, folder)),
    ])


def q_bed_line_checks(spark, folder):
    """Lines with blanks for tabs, missing cells and places that are no numbers; a file per contig."""
    peaks_ = tables.document_peaks(spark, folder)
    place = F.when(F.pmod("row_no", F.lit(67)) == 3, "1e3").otherwise(F.col("start").cast("string"))
    cells = [F.col("contig"), place, F.col("end").cast("string"), F.col("gene_id")]
    line = (
        F.when(F.pmod("row_no", F.lit(83)) == 1, F.concat_ws(" ", *cells))
        .when(F.pmod("row_no", F.lit(71)) == 2, F.concat_ws("\t", *cells))
        .otherwise(F.concat_ws("\t", *cells, F.col("score"), F.col("strand")))
    )
    lines = peaks_.select(
        line.alias("value"), F.struct(F.col("contig").alias("file"), F.col("row_no").alias("line")).alias("row_no"))
    return checks.combine([checks.check_bed_lines(lines), checks.check_bed_numbers(lines)])


def q_missing_contigs(spark, folder):
    return checks.missing_contigs(tables.document_peaks(spark, folder), sizes(spark, folder))


# --- sequences, tiles, windows -------------------------------------------

def q_reverse_complement(spark, folder):
    return tables.document_contigs(spark, folder).select("contig", S.revcomp(F.col("seq")).alias("rc"))


def kmer_tiles(spark, folder, k=K.KMER):
    """Small tiles whose halo completes the last k-mer, so no contig is one row."""
    return tiles.tile_sequences(tables.document_contigs(spark, folder), KMER_TILE, k - 1)


def q_kmer_tokens(spark, folder):
    seq = F.col("seq")
    return kmer_tiles(spark, folder).select(
        "contig", "tile", F.size(S.kmers(seq)).alias("n_tokens"), F.md5(S.kmer_tokens(seq)).alias("digest")
    )


def q_kmer_counts(spark, folder):
    return (
        kmer_tiles(spark, folder).select(F.explode(S.kmers(F.col("seq"))).alias("kmer"))
        .groupBy("kmer").agg(F.count("*").alias("n"))
    )


def q_tile_sequences(spark, folder):
    return tiles.tile_sequences(tables.document_contigs(spark, folder), SMALL_TILE)


def q_tile_lines(spark, folder):
    contigs = tables.document_contigs(spark, folder)
    lines = tiles.split_lines(contigs)
    return tiles.redistribute(tiles.tile_lines(lines, contig_sizes(lines), SMALL_TILE))


def q_sliding_windows(spark, folder):
    cut = tiles.tile_sequences(tables.document_contigs(spark, folder), SMALL_TILE)
    return windows.sliding_windows(cut).groupBy("contig", "strand").agg(
        F.count("*").alias("n_windows"), F.min("start").alias("first_start"),
        F.max("start").alias("last_start"), F.sum("start").alias("sum_start"),
        F.max("end").alias("last_end"),
        F.min("window").alias("min_window"), F.max("window").alias("max_window"),
    )


def q_lift_minus(spark, folder):
    return windows.strand_starts(sizes(spark, folder))


def q_lift_tiles(spark, folder):
    """Per-tile window starts lifted to the contig."""
    cut = tiles.tile_sequences(tables.document_contigs(spark, folder), SMALL_TILE)
    inside = cut.select(
        "contig", "tile", "tile_start", F.lit(0).cast("long").alias("start"),
        (F.col("tile_end") - F.col("tile_start")).alias("end"),
    )
    return windows.lift(inside)


def q_motif_hamming(spark, folder):
    """Distances of every 7-mer to both boxes; k-mers are counted before they are measured."""
    counted = (
        kmer_tiles(spark, folder, 7).select(F.explode(S.kmers(F.col("seq"), 7)).alias("k7"))
        .groupBy("k7").agg(F.count("*").alias("n"))
    )
    k7 = F.col("k7")
    return counted.groupBy(
        S.hamming(k7, K.C_BOX).alias("c_dist"), S.hamming(k7, K.D_BOX).alias("d_dist")
    ).agg(F.sum("n").alias("n"))


# --- scoring and intervals -----------------------------------------------

def q_score_histogram(spark, folder):
    scored = scoring.scan(lake(spark, folder), keep_all=True)
    return scored.groupBy("strand", "prob", "label").agg(F.count("*").alias("n"))


def q_positive_windows(spark, folder):
    return hits(spark, folder, SCAN)


def q_narrow_windows(spark, folder):
    """Windows of another width."""
    narrow = params(width=NARROW)
    cut = tiles.tile_sequences(tables.document_contigs(spark, folder), SMALL_TILE, narrow.halo)
    return scoring.scan(cut, narrow.first_model, threshold=SCAN)


def q_narrow_centres(spark, folder):
    narrow = params(width=NARROW)
    cut = stage(tiles.tile_sequences(tables.document_contigs(spark, folder), halo=narrow.halo), "lake")
    found = genome.positive_windows(cut, narrow, SCAN)
    middle = centres.centre_windows(genome.merged_blocks(found, narrow), NARROW)
    return centres.confirm_centres(
        middle, found, cut, SCAN, scorer=narrow.first_model, halo=narrow.halo)


def q_islands(spark, folder):
    return islands.islands(staged_hits(spark, folder, GENES, step=1))


def q_block_aggregate(spark, folder):
    return islands.blocks_of(staged_hits(spark, folder, GENES, step=1))


def q_merge_reciprocal(spark, folder):
    return merge.merge_reciprocal(islands.blocks_of(staged_hits(spark, folder)))


def q_long_blocks(spark, folder):
    merged = merge.merge_reciprocal(islands.blocks_of(staged_hits(spark, folder)))
    return merge.keep_long(merged, min_count=3)


def _centres(spark, folder):
    found = staged_hits(spark, folder)
    return centres.centre_windows(genome.merged_blocks(found, genome.Params())), found


def q_centre_windows(spark, folder):
    return _centres(spark, folder)[0]


def q_centre_membership(spark, folder):
    return centres.with_presence(*_centres(spark, folder)).select(
        "contig", "start", "end", "strand", "block_id", "present")


def q_centres_confirmed(spark, folder):
    return centres.confirmed(*_centres(spark, folder))


def q_centres_unconfirmed(spark, folder):
    return centres.unconfirmed(*_centres(spark, folder))


def q_rescore_centres(spark, folder):
    found, positive = _centres(spark, folder)
    return centres.confirm_centres(found, positive, lake(spark, folder), SCAN)


def q_prediction_ids(spark, folder):
    return candidates(spark, folder, SCAN).select(
        "gene_id", "contig", "start", "end", "strand", "score", "block_id", "window_seq")


def q_blocks_kept(spark, folder):
    positive = staged_hits(spark, folder)
    blocks = genome.merged_blocks(positive, genome.Params())
    kept = centres.confirm_centres(
        centres.centre_windows(blocks), positive, lake(spark, folder), SCAN)
    return centres.blocks_kept(blocks, kept)


def q_short_contigs(spark, folder):
    """Documents cut into entries of 190 nt: every window is its own candidate."""
    pieces = tiles.split_lines(tables.document_contigs(spark, folder), 190)
    short = tiles.tile_sequences(pieces.select(
        F.concat_ws("_", "contig", F.col("pos").cast("string")).alias("contig"),
        F.col("bases").alias("seq"), F.length("bases").cast("long").alias("length"),
    ))
    return centres.short_candidates(scoring.scan(short, threshold=SCAN), short)


def q_short_contigs_small_tile(spark, folder):
    """The same entries, cut into tiles that are shorter than they are."""
    pieces = tiles.split_lines(tables.document_contigs(spark, folder), 190)
    short = pieces.select(
        F.concat_ws("_", "contig", F.col("pos").cast("string")).alias("contig"),
        F.col("bases").alias("seq"), F.length("bases").cast("long").alias("length"),
    )
    cut = tiles.tile_sequences(short, 100)
    return centres.short_candidates(scoring.scan(cut, threshold=SCAN), tiles.tile_sequences(short))


class OwnModel(scoring.Scorer):
    """A model of a user's: only ``logits``, no shortcut for tiles."""

    def logits(self, windows):
        return scoring.MotifScorer().logits(windows)


def q_scan_user_scorer(spark, folder):
    """Positive windows by a user's model over tiles of 500 nt."""
    cut = tiles.tile_sequences(tables.document_contigs(spark, folder), 500)
    return scoring.scan(cut, OwnModel(), threshold=SCAN)


# --- peaks ---------------------------------------------------------------

def q_bed_centre(spark, folder):
    return bed.centre_long(tables.document_peaks(spark, folder)).drop("row_no")


def q_bed_deduplicate(spark, folder):
    return bed.deduplicate(tables.document_peaks(spark, folder)).drop("row_no")


def q_bed_prepare(spark, folder):
    return bed.prepare_peaks(tables.document_peaks(spark, folder), sizes(spark, folder))


def q_rejected_peaks(spark, folder):
    """Every peak that the preparation leaves out, and why."""
    return bed.rejected_peaks(tables.document_peaks(spark, folder), sizes(spark, folder))


def q_bed_slop(spark, folder):
    wide = slop(tables.document_peaks(spark, folder), sizes(spark, folder), F.lit(30), F.lit(50))
    return wide.select("row_no", "contig", "start", "end")


def q_interval_sequence(spark, folder):
    """Stranded sequence of every peak, whatever its length, from small tiles in folders by region."""
    peaks_ = tables.document_peaks(spark, folder).filter("start < end")
    cut = tiles.tile_sequences(tables.document_contigs(spark, folder), SMALL_TILE)
    laid = tiles.save_regions(cut, new_folder(spark, "regions"))
    return long_sequences_at(peaks_, laid, ["row_no"], SMALL_TILE)


def _prepared_windows(spark, folder):
    return sequences_at(q_bed_prepare(spark, folder), lake(spark, folder))


def q_bed_scored(spark, folder):
    return scoring.score_windows(_prepared_windows(spark, folder)).drop("window_seq")


def q_bed_candidates(spark, folder):
    return genome.candidates_of_peaks(
        tables.document_peaks(spark, folder), sizes(spark, folder), lake(spark, folder),
        genome.Params(),
    ).drop("block_id", "block_start", "block_end")


# --- signals -------------------------------------------------------------

def q_kmer_to_nt(spark, folder):
    """A value per 6-mer of each prepared peak window, spread over its nucleotides."""
    values = F.transform(
        S.kmers(F.col("window_seq")),
        lambda k: F.when(F.substr(k, F.lit(1), F.lit(1)) == "A", 4.0)
        .when(F.substr(k, F.lit(6), F.lit(1)) == "C", 1.0).otherwise(2.0),
    )
    return _prepared_windows(spark, folder).select(
        "gene_id", "strand",
        F.posexplode(S.kmer_to_nt(values, F.length("window_seq"))).alias("pos", "v"),
    ).groupBy("gene_id", "strand").agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"),
        F.round(F.sum(F.col("v") * F.pmod("pos", F.lit(7))), 4).alias("checksum"),
    )


def numbered_events(spark, folder):
    return signals.number_ranged(tables.event_signals(spark, folder), "id", ["ts", "seq_no"])


def q_savgol_events(spark, folder):
    return signals.smooth_rows(numbered_events(spark, folder), chunk=32).select(
        "id", "seq_no", "pos", "n", F.round("smoothed", 6).alias("smoothed"))


def q_peaks_events(spark, folder):
    smooth = signals.smooth_rows(numbered_events(spark, folder), chunk=32)
    return signals.peak_rows(smooth, chunk=32).select(
        "id", "seq_no", "pos", F.round("smoothed", 6).alias("smoothed"))


def q_occlusion_attribution(spark, folder):
    return attributed(spark, folder).select(
        "gene_id", "predicted_label", "probability", F.posexplode("signal").alias("pos", "v")
    ).select("gene_id", "predicted_label", "probability", "pos", F.round("v", 8).alias("value"))


def q_candidate_peaks(spark, folder):
    found = peaks(savgol(framed(F.col("signal"))))
    return attributed(spark, folder).select("gene_id", F.inline(found)).select(
        "gene_id", "pos", F.round("height", 7).alias("height"))


# --- boxes, limits, features, rules --------------------------------------

def q_fuzzy_boxes(spark, folder):
    """Leftmost best C, rightmost best D and exact D in their ranges of each window."""
    (c_lo, c_hi), (d_lo, d_hi) = motifs.box_ranges()
    ready = motifs.with_distances(candidates(spark, folder))
    lit = F.lit
    return ready.select(
        "gene_id",
        motifs.leftmost_c(F.col("_cd"), lit(c_lo - 1), lit(c_hi + 7)).alias("c"),
        motifs.rightmost_d(F.col("_dd"), lit(d_lo - 1), lit(d_hi + 4)).alias("d"),
        motifs.exact_d(F.col("_dd"), lit(d_lo - 1), lit(d_hi + 4)).alias("x"),
    ).select(
        "gene_id", F.col("c.start").alias("c_start"), F.col("c.dist").alias("c_dist"),
        F.col("d.start").alias("d_start"), F.col("d.dist").alias("d_dist"),
        F.col("x.start").alias("exact_d_start"),
    )


def q_boxes(spark, folder):
    out = boxed(spark, folder)
    cols = [
        F.col(f"{box}.{part}").alias(f"{box}_{part}")
        for box in ("c", "d", "c_prime", "d_prime") for part in ("motif", "start", "dist")
    ]
    return out.select("gene_id", *cols, "c_limit", "d_limit", "box_score")


def q_prime_pairs(spark, folder):
    """C'/D' of every prepared peak window, between fixed box limits."""
    spread = _prepared_windows(spark, folder).repartition(task_count(spark), "gene_id")
    ready = (
        motifs.with_distances(spread)
        .withColumns({"c_limit": F.lit(25), "d_limit": F.lit(170)})
    )
    return motifs.pair_primes(ready).select(
        "gene_id", "strand",
        F.col("c_prime.start").alias("c_prime_start"), F.col("c_prime.dist").alias("c_prime_dist"),
        F.col("d_prime.start").alias("d_prime_start"), F.col("d_prime.dist").alias("d_prime_dist"),
    )


def q_gene_limits(spark, folder):
    return limits.gene_limits(boxed(spark, folder)).select(
        "gene_id", "contig", F.col("gene_start").alias("start"), F.col("gene_end").alias("end"),
        "strand", "predicted_sequence", "predicted_extended_sequence")


def genes(spark, folder):
    return limits.gene_table(boxed(spark, folder))


def q_gene_table(spark, folder):
    return genes(spark, folder)


def q_genes_without_n(spark, folder):
    return limits.without_n(genes(spark, folder)).select("gene_id", "contig", "start", "end", "strand")


def q_refinements(spark, folder):
    return scoring.refine(candidates(spark, folder))


def q_structure_features(spark, folder):
    return features.with_features(genes(spark, folder)).select(
        "gene_id", "normalized_sno_stability", "terminal_combined", "terminal_stem_score")


def q_energies_table(spark, folder):
    """The table of energies after the genes of one strand, then all genes."""
    made = stage(genes(spark, folder), "genes")
    path = new_folder(spark, "energies")
    energies.extend(made.filter("strand = '+'"), path)
    energies.extend(made, path)
    return energies.load(spark, path)


def q_stem_flanks(spark, folder):
    """Flanks before C and after D, taken from the window, of every gene."""
    left, right = features.box_flanks(F.col("window_seq"), F.col("c_limit"), F.col("d_limit"))
    return boxed(spark, folder).select(
        "gene_id", left.alias("left_flank"), right.alias("right_flank"),
        features.stem_length_score(features.pairing_string(left, right)).alias("stem_length_score"),
    )


def q_rule_cascade(spark, folder):
    found = stage(candidates(spark, folder), "candidates")
    made = limits.gene_table(motifs.find_boxes(attribution.positives_only(attribution.attribute(found))))
    seen = scoring.refine(found).select(
        "gene_id", "probability_expressed_pseudogene", "second_model_prediction")
    joined = features.with_features(made).join(seen, "gene_id", "left")
    return rules.apply_rules(joined).select(
        "gene_id", "probability_expressed_pseudogene", "second_model_prediction", "predicted_label")


def q_final_genes(spark, folder):
    return genome.run_scan(staged_lake(spark, folder), params())


def q_final_first_model(spark, folder):
    return genome.run_scan(staged_lake(spark, folder), params(first_model_only=True))


def q_final_peaks(spark, folder):
    return genome.run_peaks(
        tables.document_peaks(spark, folder), sizes(spark, folder), lake(spark, folder),
        params(on_bad_peaks="drop"))


# --- sinks ---------------------------------------------------------------

def q_bed_rows(spark, folder):
    return formats.bed_rows(q_final_genes(spark, folder))


def q_gtf_rows(spark, folder):
    return formats.gtf_rows(q_final_genes(spark, folder)).drop("rank")


def q_fasta_records(spark, folder):
    return formats.fasta_records(q_final_genes(spark, folder)).select("gene_id", "record")


def q_tsv_roundtrip(spark, folder):
    final = q_final_first_model(spark, folder)
    path = new_folder(spark, "tsv")
    formats.write(final, path, "tsv")
    return spark.read.schema(final.schema).option("sep", "\t").option("header", True).csv(path)


def _exported(spark, folder, output_type):
    """Every line of a written export, by its number in the whole."""
    path = new_folder(spark, output_type)
    ordered.export(q_final_genes(spark, folder), path, output_type)
    return ordered.read_ordered(spark, path)


def q_bed_file(spark, folder):
    return _exported(spark, folder, "bed")


def q_gtf_file(spark, folder):
    return _exported(spark, folder, "gtf")


def q_fasta_file(spark, folder):
    return _exported(spark, folder, "fa")


def q_empty_result(spark, folder):
    """Contigs with every base masked: no gene, and a written table that has its columns."""
    masked = tables.document_contigs(spark, folder).withColumn("seq", F.regexp_replace("seq", "[ACGT]", "N"))
    final = genome.run_scan(stage(tiles.tile_sequences(masked), "lake"), params())
    path = new_folder(spark, "empty")
    formats.write(final, path, "tsv")
    return spark.read.schema(final.schema).option("sep", "\t").option("header", True).csv(path)


# --- relational ----------------------------------------------------------

def q_label_joins(spark, folder):
    """Left, semi and anti join of contigs with a side table."""
    contigs = sizes(spark, folder)
    known = tables.table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("contig"), "quality")
    left = contigs.join(known, "contig", "left").select(
        F.lit("left").alias("kind"), "contig", "length", "quality")
    semi = contigs.join(known, "contig", "left_semi").select(
        F.lit("semi").alias("kind"), "contig", "length", F.lit(None).cast("int").alias("quality"))
    anti = contigs.join(known, "contig", "left_anti").select(
        F.lit("anti").alias("kind"), "contig", "length", F.lit(None).cast("int").alias("quality"))
    return left.unionByName(semi).unionByName(anti)


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
