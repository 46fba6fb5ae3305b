"""Reading FASTA and BED text, the checks, and the four output formats."""

import random

import pytest
from pyspark.sql import functions as F

from boxscan.operators import checks, peaks, tiles
from boxscan.plans import genome
from boxscan.sinks import formats
from boxscan.sinks.tables import FULL, MINIMAL
from boxscan.sources.bed import bed_lines, read_bed
from boxscan.sources.fasta import contig_sizes, fasta_headers, read_fasta


def planted(rng, size, at, box="ATGATGA", d="CTGA", gap=80):
    """Random bases with a C box at ``at`` and a D box ``gap`` nt after its start."""
    seq = [rng.choice("ACGT") for _ in range(size)]
    seq[at:at + 7] = box
    seq[at + gap:at + gap + 4] = d
    return "".join(seq)


def rc(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("fa")
    contigs = {}
    for name in ("one.fa", "two.fasta"):
        lines = []
        for i in range(5):
            seq = "".join(rng.choice("ACGTacgt") for _ in range(rng.choice([30, 61, 3000, 9000])))
            contigs[f"{name}_{i}"] = seq.upper()
            lines.append(f">{name}_{i} some words")
            lines += [seq[k:k + 60] for k in range(0, len(seq), 60)]
        (folder / name).write_text("\n".join(lines) + "\n")
    (folder / "notes.txt").write_text(">ignored\nACGT\n")
    return str(folder), contigs


@pytest.mark.parametrize("split", [700, 5000, 1 << 27])
def test_fasta_over_splits(spark, fasta, split):
    folder, contigs = fasta
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        lines = read_fasta(spark, folder)
        sizes = contig_sizes(lines)
        assert {r.contig: r.length for r in sizes.collect()} == {k: len(v) for k, v in contigs.items()}
        whole = {}
        for r in lines.collect():
            whole.setdefault(r.contig, []).append((r.pos, r.bases))
        joined = {}
        for name, parts in whole.items():
            text = ""
            for pos, bases in sorted(parts):
                assert pos == len(text) or not bases
                text += bases
            joined[name] = text
        assert joined == contigs
        cut = tiles.tile_lines(lines, sizes, 500)
        assert all(contigs[r.contig][r.tile_start:r.tile_start + 693] == r.seq for r in cut.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta_checks(spark, tmp_path):
    (tmp_path / "bad.fa").write_text(">a\nACGT\n>b\n> c\nAC\n>a\nGG\n>d\n\n")
    path = str(tmp_path)
    report = checks.check_fasta(fasta_headers(spark, path), contig_sizes(read_fasta(spark, path)))
    got = {r.check: (r.n, r["sample"]) for r in report.collect()}
    assert got == {"empty_entry": (2, "b"), "spaced_header": (1, "> c"), "duplicate_name": (1, "a"),
                   "no_entries": (0, None), "many_entries": (0, None)}
    with pytest.raises(ValueError, match="duplicate_name"):
        checks.raise_on_error(report)


def test_bed(spark, tmp_path):
    (tmp_path / "p.bed").write_text(
        "chrom\tstart\tend\tname\tscore\tstrand\n"
        "c\t100\t150\tp1\t.\t+\nc\t100\t150\tp2\t.\t+\nc\t10\t400\tp3\t.\t.\nc\t7\t9\tp1\t.\t-\nz\t5\t2\tp4\t.\tx\n")
    path = str(tmp_path)
    rows = read_bed(spark, path)
    assert rows.count() == 5
    sizes = spark.createDataFrame([("c", 500)], "contig string, length long")
    ready = {(r.gene_id, r.start, r.end, r.strand) for r in peaks.prepare_peaks(rows, sizes).collect()}
    assert ready == {("p1", 28, 222, "+"), ("p3_center_window_+", 108, 302, "+"),
                     ("p3_center_window_-", 108, 302, "-")}
    report = {r.check: r.n for r in checks.check_peaks(rows, sizes).collect()}
    assert report == {"unknown_contig": 1, "start_not_before_end": 1, "longer_than_window": 1,
                      "duplicated_id": 1, "scoring_units": 7}
    lines = {r.check: r.n for r in checks.check_bed_lines(bed_lines(spark, path)).collect()}
    assert not any(lines.values())
    (tmp_path / "p2.bed").write_text("c 1 2\nc\t1\t2\n")
    uneven = {r.check: r.n for r in checks.check_bed_lines(bed_lines(spark, path)).collect()}
    assert uneven["not_tabbed"] == 1 and uneven["uneven_columns"] == 3


@pytest.fixture(scope="module")
def lake(spark):
    rng = random.Random(8)
    rows = []
    for i, at in enumerate([300, 1017, 0 + 57, 2000 - 137]):
        seq = planted(rng, 2000, at)
        rows += [(f"g{i}p", seq, 2000), (f"g{i}m", rc(seq), 2000)]
    return spark.createDataFrame(rows, "contig string, seq string, length long")


@pytest.fixture(scope="module")
def final(spark, lake):
    from boxscan.session import stage
    return stage(genome.run_scan(tiles.tile_sequences(lake), genome.Params(prob_first_model=0.999)), "t")


def test_planted_genes_are_found_on_both_strands(final):
    rows = final.collect()
    assert final.columns == FULL
    for i, at in enumerate([300, 1017]):
        # gene: 5 nt before the C box to 5 nt after the D box
        lo, hi = at - 5, at + 84 + 5
        assert any(r.chr == f"g{i}p" and r.strand == "+" and (r.start, r.end) == (lo, hi) for r in rows), i
        assert any(r.chr == f"g{i}m" and r.strand == "-" and (r.start, r.end) == (2000 - hi, 2000 - lo)
                   for r in rows), i
    for i, at in ((2, 57), (3, 2000 - 137)):
        # at a contig end the block is cut off and its centre is no longer
        # the middle of the boxes: the gene is found, its limits may differ
        for name, strand, lo in ((f"g{i}p", "+", at), (f"g{i}m", "-", 2000 - at - 84)):
            assert any(r.chr == name and r.strand == strand and r.start < lo + 84 and r.end > lo for r in rows)
    for r in rows:
        if r.C_MOTIF != "NNNNNNN":
            assert r.C_START == 6 and r.predicted_sequence[5:12] == r.C_MOTIF
        if r.D_MOTIF != "NNNN":
            assert r.predicted_sequence[r.D_START - 1:r.D_END] == r.D_MOTIF


def test_result_does_not_depend_on_tiles_or_row_order(spark, lake, final):
    params = genome.Params(prob_first_model=0.999, tile_size=400)
    again = genome.run_scan(tiles.tile_sequences(lake.orderBy(F.desc("contig")), 400), params)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, final.collect()))


def test_first_model_only_and_step_one(spark, lake):
    params = genome.Params(prob_first_model=0.999, first_model_only=True, step_size=1, strand="plus")
    out = genome.run_scan(tiles.tile_sequences(lake), params)
    rows = out.collect()
    assert out.columns == MINIMAL and rows and {r.strand for r in rows} == {"+"}


def test_energies_table_replaces_the_default(spark, lake, final):
    from boxscan.operators import features
    genes = spark.createDataFrame(
        [("g", "ACGTACGTAC", "A" * 20 + "C" * 5 + "G" * 20)],
        "gene_id string, predicted_sequence string, predicted_extended_sequence string")
    table = spark.createDataFrame(
        [("ACGTACGTAC", "A" * 20 + "&" + "G" * 20, -5.0, -2.0, "((((................")],
        "sequence string, stem string, gene_energy double, stem_energy double, pairing string")
    row = features.with_features(genes, table).first()
    assert (row.normalized_sno_stability, row.terminal_combined) == (-0.5, -8.0)
    row = features.with_features(genes).first()
    assert row.terminal_combined == 0


def read_lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_formats_round_trip(spark, final, tmp_path):
    want = {r.gene_id: r for r in final.collect()}
    for kind in ("tsv", "bed", "gtf", "fa"):
        formats.write(final, str(tmp_path / kind), kind)
    back = spark.read.schema(final.schema).option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    assert {r.gene_id: r for r in back.collect()} == want

    bed = [line.split("\t") for line in read_lines(spark, str(tmp_path / "bed"))]
    assert {c[3]: (c[0], int(c[1]), int(c[2]), c[5]) for c in bed} == {
        k: (r.chr, r.start, r.end, r.strand) for k, r in want.items()}
    assert all(dict(kv.split("=") for kv in c[6].split("; "))["predicted_sequence"] == want[c[3]].predicted_sequence
               for c in bed)

    gtf = [line.split("\t") for line in read_lines(spark, str(tmp_path / "gtf"))]
    assert len(gtf) == 3 * len(want) and all(c[8].endswith('";') and '""' not in c[8] for c in gtf)
    for c in (c for c in gtf if c[2] == "gene"):
        gene = c[8].split('gene_id "')[1].split('"')[0]
        assert (int(c[3]), int(c[4])) == (want[gene].start + 1, want[gene].end)
    assert [c[2] for c in gtf[:3]] == ["gene", "transcript", "exon"]

    fa = read_lines(spark, str(tmp_path / "fa"))
    assert {h[1:].split(" ")[0]: s for h, s in zip(fa[::2], fa[1::2])} == {
        k: r.predicted_sequence for k, r in want.items()}


def test_empty_result_keeps_the_schema(spark, lake, tmp_path):
    # nothing passes: a window cannot be positive in a run of one base
    flat = spark.createDataFrame([("x", "A" * 500, 500)], "contig string, seq string, length long")
    out = genome.run_scan(tiles.tile_sequences(flat))
    assert out.columns == FULL and out.count() == 0
    with pytest.warns(UserWarning, match="no gene"):
        formats.write(out, str(tmp_path / "none"), "gtf")


def test_short_contigs_are_their_own_candidates(spark):
    rng = random.Random(6)
    rows = [(f"s{i}", planted(rng, 194, 55), 194) for i in range(4)]
    short = spark.createDataFrame(rows, "contig string, seq string, length long")
    got = genome.run_scan(tiles.tile_sequences(short), genome.Params(first_model_only=True)).collect()
    assert {r.chr for r in got if r.strand == "+"} == {f"s{i}" for i in range(4)}
    assert all((r.start, r.end) == (50, 144) for r in got if r.strand == "+")


def test_parameters_are_checked():
    for bad in ({"step_size": 0}, {"prob_first_model": 0.2}, {"terminal_stem_score": 1.0},
                {"strand": "x"}, {"score_c": -1}):
        with pytest.raises(ValueError):
            genome.Params(**bad)
    genome.Params(score_c=0, score_d=0, box_score=0, terminal_stem_score=0.0)
