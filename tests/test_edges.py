"""Bad input is refused or reported, and the edges of tiles, models and thresholds hold."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxscan import session
from boxscan.operators import attribution, checks, merge, peaks, scoring, tiles, windows
from boxscan.plans.genome import Params, run_files, run_peaks
from boxscan.sources.bed import bad_numbers, bed_lines, parse_bed

PEAK = "contig string, start long, `end` long, gene_id string, score string, strand string, row_no long"


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def gene(n):
    rng = np.random.default_rng(n)
    bases = list("".join(rng.choice(list("ACGT"), n)))
    bases[60:67], bases[160:164] = "ATGATGA", "CTGA"
    return "".join(bases)


def test_repeated_names_and_gaps_are_refused(spark):
    lines = spark.createDataFrame(
        [("a", 0, "A" * 60), ("a", 0, "C" * 60), ("a", 60, "G" * 60)], "contig string, pos long, bases string")
    sizes = spark.createDataFrame([("a", 120)], "contig string, length long")
    with pytest.raises(Exception, match="does not hold each base once"):
        tiles.tile_lines(lines, sizes).collect()
    gap = spark.createDataFrame([("a", 0, "A" * 60)], lines.schema)
    with pytest.raises(Exception, match="does not hold each base once"):
        tiles.tile_lines(gap, sizes).collect()


def test_bases_without_a_header_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="before the first header"):
        run_files(spark, write(tmp_path / "stray", "a.fa", f"ACGT\n>one\n{gene(300)}\n"))


def test_only_a_first_line_may_be_a_header(spark, tmp_path):
    folder = write(tmp_path / "bed", "a.bed", "chrom\tstart\tend\tname\tscore\tstrand\na\t1\t9\tx\t.\t+\na\t1e3\t1,000\ty\t.\t+\n")
    lines = bed_lines(spark, folder)
    assert [r.gene_id for r in parse_bed(lines).collect()] == ["x"]
    assert [r.value.split("\t")[1] for r in bad_numbers(lines).collect()] == ["1e3"]
    with pytest.raises(ValueError, match="no_number"):
        checks.raise_on_error(checks.check_bed_numbers(lines))


def test_kept_and_rejected_peaks_are_all_peaks(spark):
    rows = [
        ("a", 10, 100, "p", ".", "+", 1), ("a", 10, 100, "p", ".", "+", 2), ("a", 10, 100, "q", ".", "+", 3),
        ("a", 50, 50, "r", ".", "+", 4), ("a", -5, 50, "s", ".", "+", 5), ("z", 1, 50, "t", ".", "+", 6),
        ("a", 900, 950, "u", ".", "+", 7), ("a", 100, 500, "v", ".", ".", 8),
    ]
    given = spark.createDataFrame(rows, PEAK)
    sizes = spark.createDataFrame([("a", 600)], "contig string, length long")
    reasons = {r.row_no: r.reason for r in peaks.rejected_peaks(given, sizes).collect()}
    assert reasons == {2: "repeated_id", 3: "repeated_place", 4: "start_not_before_end", 5: "negative_start",
                       6: "unknown_contig", 7: "outside_contig"}
    kept = {r.gene_id for r in peaks.prepare_peaks(given, sizes).collect()}
    assert kept == {"p", "v_center_window_+", "v_center_window_-"}
    assert [r.gene_id for r in peaks.strandless(given).collect()] == ["v"]
    lake = tiles.tile_sequences(spark.createDataFrame([("a", gene(600), 600)], "contig string, seq string, length long"))
    with pytest.raises(ValueError, match="start_not_before_end"):
        run_peaks(given, sizes, lake, Params())
    run_peaks(given, sizes, lake, Params(on_bad_peaks="drop")).count()


def test_run_from_files(spark, tmp_path):
    fasta = write(tmp_path / "fa", "a.fa", f">one\n{gene(600)}\n>two\n{gene(700)}\n")
    assert run_files(spark, fasta, params=Params(prob_first_model=0.9, first_model_only=True)).count() > 0
    bed = write(tmp_path / "bed", "a.bed", "one\t0\t194\tp\t.\t+\n")
    run_files(spark, fasta, bed, Params()).count()
    twice = write(tmp_path / "twice", "a.fa", f">one\n{gene(300)}\n>one\n{gene(300)}\n")
    with pytest.raises(ValueError, match="duplicate_name"):
        run_files(spark, twice)


@pytest.mark.parametrize("size", [50, 100, 193, 194, 400])
def test_short_contigs_are_one_window_in_any_tiling(spark, size):
    contigs = spark.createDataFrame([("a", gene(194)[:150], 150), ("b", gene(194), 194), ("c", gene(420), 420)],
                                    "contig string, seq string, length long")
    cut = tiles.tile_sequences(contigs, size)
    got = sorted(tuple(r) for r in scoring.scan(cut, keep_all=True).select("contig", "strand", "start", "end", "prob").collect())
    want = sorted(tuple(r) for r in scoring.scan(tiles.tile_sequences(contigs), keep_all=True)
                  .select("contig", "strand", "start", "end", "prob").collect())
    assert got == want
    assert windows.sliding_windows(cut).filter("contig = 'a'").count() == 2


def test_a_last_tile_shorter_than_the_model(spark):
    contigs = spark.createDataFrame([("a", gene(510), 510)], "contig string, seq string, length long")
    model = scoring.CallableScorer(lambda seqs: np.array([[0.0, 1.0]] * len(seqs)))
    got = scoring.scan(tiles.tile_sequences(contigs, 100), model).count()
    assert got == scoring.scan(tiles.tile_sequences(contigs), model).count()


def test_one_window_contig_is_one_candidate(spark, tmp_path):
    fasta = write(tmp_path / "fa", "a.fa", f">one\n{gene(194)}\n>long\n{gene(400)}\n")
    out = run_files(spark, fasta, params=Params(
        prob_first_model=0.9, consecutive_windows=1, first_model_only=True, strand="plus"))
    assert out.filter("chr = 'one'").count() <= 1


def test_models_keep_their_batch_size():
    model = scoring.CallableScorer(lambda seqs: np.zeros((len(seqs), 2)), batch_size=512)
    assert Params(first_model=model).first_model.batch_size == 512
    own = Params(first_model=model, batch_size=7)
    assert own.first_model.batch_size == 7 and model.batch_size == 512


def test_threshold_sees_the_unrounded_probability(spark):
    contigs = spark.createDataFrame([("a", gene(194), 194)], "contig string, seq string, length long")
    sure = scoring.CallableScorer(lambda seqs: np.array([[0.0, 15.0]] * len(seqs)))
    lake = tiles.tile_sequences(contigs)
    assert scoring.scan(lake, sure, threshold=0.9999998).count() == 0
    assert scoring.scan(lake, sure, threshold=0.999999).count() == 2
    one = spark.createDataFrame([(gene(194),)], "window_seq string")
    assert not scoring.score_windows(one, sure, above=0.9999998).first().passes


def test_longer_sequences_are_refused():
    with pytest.raises(ValueError, match="does not fit"):
        scoring.encode(["A" * 195], 194)


def test_staging_folder(spark):
    with session.own_folders(spark):
        staged = session.stage(spark.range(5), "five")
        assert staged.count() == 5
        path = staged.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert not os.path.exists(path)
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.own_folder(spark).startswith(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"))


def test_a_local_folder_is_refused_on_a_cluster(spark):
    class Elsewhere:
        conf, _jvm, _jsc = spark.conf, spark._jvm, spark._jsc

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.own_folder(Elsewhere)


def test_attribution_fills_its_batches(spark):
    """The model is called once per full batch of an Arrow batch, whatever the candidates."""
    calls = spark.sparkContext.accumulator(0)
    plain = scoring.MotifScorer()

    def logits(seqs):
        calls.add(1)
        return plain.logits(scoring.encode(seqs, 194))

    model = scoring.CallableScorer(logits, batch_size=100)
    rows = spark.createDataFrame([(gene(194 - 7 * i),) for i in range(5)], "window_seq string").coalesce(1)
    got = rows.select("window_seq", attribution.occlusion(model, F.col("window_seq")).alias("d")).collect()
    windows_ = sum(194 - 7 * i - 5 + 1 for i in range(5))
    assert calls.value == -(-windows_ // 100)
    for r in got:
        n = len(r.window_seq)
        masked = [r.window_seq] + [r.window_seq[:i] + "N" * 6 + r.window_seq[i + 6:] for i in range(n - 5)]
        out = plain.logits(scoring.encode(masked, 194))
        p = 1 / (1 + np.exp(out[:, 0] - out[:, 1]))
        assert np.allclose(r.d, p[0] - p[1:])


@pytest.mark.parametrize("k", [1, 3, 6, 30])
def test_masked_scores_are_those_of_masked_copies(k):
    model, rng = scoring.MotifScorer(), np.random.default_rng(k)
    windows_ = rng.choice(np.frombuffer(b"ACGTN", np.uint8), (40, 194), p=[.3, .2, .2, .29, .01])
    found = model.masked_logits(windows_, k)
    for at in range(194 - k + 1):
        copies = windows_.copy()
        copies[:, at:at + k] = ord("N")
        assert (model.logits(copies) == found[:, at]).all()


def test_a_halo_that_is_too_small_is_refused(spark):
    blocks = spark.createDataFrame([("a", "+", 0, 700, 0.9, 1), ("a", "+", 100, 800, 0.9, 1)],
                                   "contig string, strand string, start long, `end` long, score double, n_windows long")
    with pytest.raises(Exception, match="is too small"):
        merge.merge_reciprocal(blocks, halo=300).collect()
