"""Resumable runs, the table of energies, ordered exports, window width, ranges inside a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from boxscan import session
from boxscan.operators import energies, features, scoring, signals, tiles
from boxscan.plans import genome
from boxscan.sinks import formats, ordered
from boxscan.sinks.tables import FULL
from tests.test_sources_sinks import planted


@pytest.fixture(scope="module")
def genome_files(tmp_path_factory):
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("genome")
    # a gene in the middle of each contig, and one short contig
    lines = []
    for i in range(6):
        lines += [f">c{i}", planted(rng, 1500, 700 + 5 * i)]
    (folder / "all.fa").write_text("\n".join([*lines, ">short", "ACGT" * 20]) + "\n")
    return str(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_resumed_run(spark, genome_files, tmp_path, monkeypatch):
    params = genome.Params(prob_first_model=0.9)
    whole = rows(genome.run_files(spark, genome_files, params=params))
    made = []
    kept = session.Steps.table

    def breaks(self, df, name, options):
        if name == "numbered":
            raise RuntimeError("lost")
        return kept(self, df, name, options)

    monkeypatch.setattr(session.Steps, "table", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        genome.run_files(spark, genome_files, params=params, resume=str(tmp_path))

    def seen(self, df, name, options):
        out = kept(self, df, name, options)
        made.append((name, name in self.reused))
        return out

    monkeypatch.setattr(session.Steps, "table", seen)
    again = genome.run_files(spark, genome_files, params=params, resume=str(tmp_path))
    assert rows(again) == whole and whole
    lost = made.index(("numbered", False))
    assert all(reused for _, reused in made[:lost]) and not any(reused for _, reused in made[lost:])
    assert {"sizes", "lake", "windows"} <= {name for name, _ in made[:lost]}
    made.clear()
    assert rows(genome.run_files(spark, genome_files, params=params, resume=str(tmp_path))) == whole
    assert all(reused for _, reused in made)
    # another parameter is another run
    made.clear()
    genome.run_files(spark, genome_files, params=genome.Params(prob_first_model=0.95), resume=str(tmp_path))
    assert not any(reused for _, reused in made)
    # staging outside the block is as before
    assert session._steps.get() is None


def test_half_written_step_is_made_again(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    with session.resumable(spark, str(tmp_path), {"a": 1}) as first:
        session.stage(df, "t")
    first._put(f"{first.root}/00-t.done", "{}")
    with session.resumable(spark, str(tmp_path), {"a": 1}) as second:
        assert session.stage(df, "t").count() == 10
    assert second.made == ["t"] and second.reused == []
    with session.resumable(spark, str(tmp_path), {"a": 1}) as third:
        # the same step with another schema does not fit either
        assert session.stage(df.drop("x"), "t").columns == ["id"]
    assert third.made == ["t"]


def test_changed_input_is_another_run(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGT\n")
    first = session.files_key(spark, str(tmp_path))
    assert first == session.files_key(spark, str(tmp_path)) and first[0] == "1"
    (tmp_path / "a.fa").write_text(">a\nACGTA\n")
    assert session.files_key(spark, str(tmp_path)) != first


def test_model_key():
    class Own(scoring.Scorer):
        def logits(self, windows):
            raise NotImplementedError

    a, b = Own(), Own()
    b.version = "2"
    assert genome.model_key(a) != genome.model_key(b)
    assert genome.model_key(scoring.MotifScorer()) != genome.model_key(scoring.MotifScorer(150))


GENES = "gene_id string, predicted_sequence string, predicted_extended_sequence string"


def test_energies_grow(spark, tmp_path):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(20)]
    ext = [s[:20] + s + s[-20:] for s in seqs]
    genes = spark.createDataFrame(
        [(f"g{i}", seqs[i % 20], ext[i % 20]) for i in range(60)] + [("none", None, None)], GENES)
    path, asked = str(tmp_path / "energies"), []

    def solver(df):
        asked.append(df.count())
        return energies.default_solver(df)

    first = genes.filter(F.col("predicted_sequence").isin(seqs[:7]))
    assert energies.extend(first, path, solver) == 1
    assert energies.extend(genes, path, solver) == 2
    energies.extend(genes, path, solver)
    assert asked == [7, 13, 0]
    table = energies.load(spark, path)
    assert table.count() == 20 and rows(table.groupBy("round").count()) == [(1, 7), (2, 13)]
    known = features.with_features(genes.filter("predicted_sequence IS NOT NULL"), table)
    plain = features.with_features(genes.filter("predicted_sequence IS NOT NULL"))
    names = ["gene_id", "normalized_sno_stability", "terminal_combined", "terminal_stem_score"]
    assert rows(known.select(names)) == rows(plain.select(names))


def test_energies_of_one_hash(spark, tmp_path, monkeypatch):
    """Sequences of one hash are told apart by their texts; an empty table answers nothing."""
    genes = spark.createDataFrame([("a", "ACGT" * 10, "ACGT" * 20), ("b", "GGCC" * 10, "GGCC" * 20)], GENES)
    monkeypatch.setattr(energies.F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    path = str(tmp_path / "energies")
    assert energies.load(spark, path).count() == 0
    energies.extend(genes.limit(0), path)
    energies.extend(genes.filter("gene_id = 'a'"), path)
    assert [r.sequence for r in energies.unseen(genes, path).collect()] == ["GGCC" * 10]
    energies.extend(genes, path)
    assert energies.load(spark, path).count() == 2


def final_rows(spark, n):
    rng = random.Random(n)
    cells = []
    for i in range(n):
        start = rng.randrange(5000)
        own = {c: "NA" for c in FULL}
        own |= {c: 1 for c in FULL if c.endswith(("_START", "_END")) or c == "box_score"}
        own |= {"gene_id": f"g{i}", "chr": f"chr {rng.randrange(9)}", "start": start, "end": start + 90,
                "strand": rng.choice("+-"), "probability_CD": 0.9, "predicted_sequence": "ACGT" * 20}
        cells.append(tuple(own[c] for c in FULL))
    types = {"start": "long", "end": "long", "probability_CD": "double"}
    types |= {c: "int" for c in FULL if c.endswith(("_START", "_END")) or c == "box_score"}
    return spark.createDataFrame(cells, ", ".join(f"`{c}` {types.get(c, 'string')}" for c in FULL))


@pytest.mark.parametrize("kind, lines", [("bed", 1), ("gtf", 3), ("fa", 2), ("tsv", 1)])
def test_export_is_in_order(spark, tmp_path, kind, lines):
    final = final_rows(spark, 500)
    path = str(tmp_path / "out")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")   # several splits a part
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordered.export(final, path, kind)
        summary = parts.orderBy("part").collect()
        assert len(summary) > 1 and sum(r.back for r in summary) == 0
        assert sum(r.placed for r in summary) == 500 * (3 if kind == "gtf" else 1)
        assert all(a["last"] <= b["first"] for a, b in zip(summary, summary[1:]))
        read = [r.value for r in ordered.read_ordered(spark, path).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    heads = len(summary) if kind == "tsv" else 0
    assert len(read) == 500 * lines + heads
    files = sorted((tmp_path / "out").glob("part-*"))
    assert read == [x for f in files for x in f.read_text().splitlines()]


def test_disorder_is_seen(spark, tmp_path):
    def put(name, starts):
        (tmp_path / name).write_text("".join(f"c\t{s}\t{s + 9}\tg\t.\t+\tx\n" for s in starts))

    put("part-00000.txt", [1, 5, 9])
    put("part-00001.txt", [9, 12])
    ordered.check_order(ordered.manifest(spark, str(tmp_path), "bed"))
    put("part-00002.txt", [20, 19, 30])                             # inside a part
    with pytest.raises(ValueError, match="1 parts .* part-00002"):
        ordered.check_order(ordered.manifest(spark, str(tmp_path), "bed"))
    put("part-00002.txt", [11, 30])                                 # between two parts
    with pytest.raises(ValueError, match="part-00002"):
        ordered.check_order(ordered.manifest(spark, str(tmp_path), "bed"))


def test_empty_export(spark, tmp_path):
    with pytest.warns(UserWarning, match="no gene"):
        parts = ordered.export(final_rows(spark, 3).limit(0), str(tmp_path / "out"), "bed")
    assert parts.agg(F.sum("placed")).first()[0] in (None, 0)
    assert ordered.read_ordered(spark, str(tmp_path / "out")).count() == 0


def test_window_width(spark, genome_files):
    params = genome.Params(prob_first_model=0.9, width=160)
    final = genome.run_files(spark, genome_files, params=params).collect()
    assert {r.chr for r in final} >= {f"c{i}" for i in range(6)}
    assert (params.first_model.width, params.second_model.width, params.halo) == (160, 160, 159)
    with pytest.raises(ValueError, match="both models"):
        genome.Params(width=160, first_model=scoring.CallableScorer(len, 170))
    with pytest.raises(ValueError, match="no room"):
        genome.Params(width=40)


def test_halo_too_small_for_the_width(spark):
    contigs = spark.createDataFrame([("a", "ACGT" * 300, 1200)], "contig string, seq string, length long")
    cut = tiles.tile_sequences(contigs, 500, 100)
    with pytest.raises(Exception, match="halo of 193"):
        scoring.scan(cut).collect()


def test_hot_key_is_numbered_in_ranges(spark):
    """One key holds half of all rows; a third of those share one time."""
    rng = random.Random(5)
    data = [("hot" if i % 2 else f"k{i % 50}", 7 if i % 3 == 0 and i % 2 else rng.randrange(10**6), i) for i in range(6000)]
    df = spark.createDataFrame([*data, (None, 1, -1), ("hot", None, -2)], "id string, t long, seq_no long").cache()
    cut, levels = signals.range_buckets(df.filter("id IS NOT NULL"), "id", ["t", "seq_no"], 100)
    sizes = cut.groupBy("id", *levels).count()
    assert sizes.agg(F.max("count")).first()[0] <= 200
    got = signals.number_ranged(df, "id", ["t", "seq_no"], 100)
    assert "_range0" not in got.columns
    place, order = {}, sorted([*data, ("hot", None, -2)], key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    for key, t, no in order:
        place[no] = place.get(key, 0)
        place[key] = place.get(key, 0) + 1
    out = got.collect()
    assert len(out) == 6001
    assert all(r.pos == place[r.seq_no] and r.n == place[r.id] for r in out)


def test_one_value_cannot_be_cut(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)], "id string, t long")
    cut, levels = signals.range_buckets(df, "id", ["t"], 10)
    assert levels == [] and cut.count() == 51
    assert sorted(r.pos for r in signals.number_ranged(df, "id", ["t"], 10).filter("id = 'a'").collect()) == list(range(50))
