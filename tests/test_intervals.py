"""Tiles, scan, islands and merge: invariance and brute force."""

import random
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.operators import centres, extract, islands, merge, scoring, tiles, windows

# the workers cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(seq):
    return seq.translate(COMPLEMENT)[::-1]


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(1)
    sizes = [1, 50, 193, 194, 195, 204, 207, 400, 1000, 6592]
    return {f"s{n}": "".join(rng.choice("ACGT") for _ in range(n)) for n in sizes}


@pytest.fixture(scope="module")
def contigs(spark, sequences):
    rows = [(k, v, len(v)) for k, v in sequences.items()]
    return spark.createDataFrame(rows, "contig string, seq string, length long")


def starts(length, step, strand):
    if length <= K.WINDOW:
        return [0]
    own = sorted({*range(0, length - K.WINDOW + 1, step), length - K.WINDOW})
    return own if strand == "+" else sorted(length - K.WINDOW - j for j in own)


def test_tail_window_is_listed_once():
    assert starts(207, 5, "+") == [0, 5, 10, 13]
    assert starts(204, 5, "+") == [0, 5, 10]
    assert 6398 in starts(6592, 5, "+")


@pytest.mark.parametrize("size", [200, 333, 1 << 16])
def test_windows_do_not_depend_on_the_tile(contigs, sequences, size):
    got = windows.sliding_windows(tiles.tile_sequences(contigs, size)).collect()
    want = set()
    for name, seq in sequences.items():
        for strand in "+-":
            for s in starts(len(seq), K.STEP, strand):
                part = seq[s:s + K.WINDOW]
                want.add((name, strand, s, s + len(part), rc(part) if strand == "-" else part))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_tiles_from_pieces_equal_tiles_from_sequences(contigs):
    sizes = contigs.select("contig", "length")
    whole = tiles.tile_sequences(contigs, 300)
    for width in (7, 60, 5000):
        cut = tiles.tile_lines(tiles.split_lines(contigs, width), sizes, 300)
        assert sorted(map(tuple, cut.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def by_hand(seq):
    """Logit of the built-in scorer, letter by letter."""
    seq = seq.ljust(K.WINDOW, "N")

    def best(box, lo, hi):
        return min(
            sum(not (b in "AG" if c == "R" else b == c) for b, c in zip(seq[o:o + len(box)], box))
            for o in range(lo, hi))

    return 3 * (7 - best(K.C_BOX, 20, 76)) + 2 * (4 - best(K.D_BOX, 112, 171)) - 21


@pytest.mark.parametrize("size,step", [(250, 5), (1 << 16, 5), (1 << 16, 3)])
def test_scan_equals_scoring_each_window(contigs, sequences, size, step):
    got = scoring.scan(tiles.tile_sequences(contigs, size), step=step, keep_all=True).collect()
    want = {}
    for name, seq in sequences.items():
        for strand in "+-":
            for s in starts(len(seq), step, strand):
                part = seq[s:s + K.WINDOW]
                lg = by_hand(rc(part) if strand == "-" else part)
                want[name, strand, s] = (round(1 / (1 + np.exp(-lg)), 6), int(lg > 0))
    assert {(r.contig, r.strand, r.start): (r.prob, r.label) for r in got} == want
    assert len(got) == len(want)


def test_own_scorer_gives_the_same_scan(contigs):
    def network(seqs):
        return [(0.0, by_hand(s)) for s in seqs]

    cut = tiles.tile_sequences(contigs.filter("length < 1500"), 300)
    own = scoring.scan(cut, scoring.CallableScorer(network), keep_all=True)
    assert sorted(own.collect()) == sorted(scoring.scan(cut, keep_all=True).collect())


def fold(rows):
    out, cur = [], None
    for c, s, a, b, p, n in sorted(rows):
        if cur and cur[:2] == (c, s) and max(min(cur[3], b) - max(cur[2], a), 0) >= 0.5 * max(cur[3] - cur[2], b - a):
            cur = (c, s, cur[2], b, (cur[4] + p) / 2, cur[5] + n)
        else:
            if cur:
                out.append(cur)
            cur = (c, s, a, b, p, n)
    return out + [cur]


def merge_rows():
    rng = random.Random(3)
    rows = []
    for c in range(8):
        pos = 0
        for _ in range(300):
            pos += rng.choice([5] * 6 + [10, 20, 60] + ([97, 98, 150, 300, 3000] if c % 3 == 0 else []))
            rows.append((f"c{c}", "+-"[c % 2], pos, pos + 194 + (rng.choice([0, 3, 40]) if c % 4 == 1 else 0),
                         round(rng.random(), 6), 1))
    # one endless chain, and a block longer than several buckets
    rows += [("d", "+", i * 5, i * 5 + 194, round(rng.random(), 6), 1) for i in range(2000)]
    rows += [("e", "-", 0, 9000, 0.5, 1)] + [("e", "-", s, s + 200, 0.25, 1) for s in range(8600, 9500, 7)]
    return rows


@pytest.mark.parametrize("bucket,halo", [(1000, 400), (777, 500), (1 << 18, 4096)])
def test_merge_equals_the_sequential_fold(spark, bucket, halo):
    rows = merge_rows()
    pdf = pd.DataFrame(rows, columns=["contig", "strand", "start", "end", "score", "n_windows"])
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    got = merge.merge_reciprocal(df, bucket=bucket, halo=halo).select(*pdf.columns).collect()
    assert sorted(map(tuple, got)) == sorted(fold(rows))


def test_merge_golden(spark):
    def run(*spans):
        df = spark.createDataFrame(
            [("c", "+", a, b, p, 1) for a, b, p in spans],
            "contig string, strand string, start long, end long, score double, n_windows long")
        return sorted((r.start, r.end, r.score) for r in merge.merge_reciprocal(df).collect())

    assert run((100, 294, 0.9), (105, 299, 0.8)) == [(100, 299, pytest.approx(0.85))]
    assert len(run((100, 294, 0.9), (200, 394, 0.8))) == 2
    run60 = run(*[(5 * i, 5 * i + 194, 0.9) for i in range(60)])
    assert run60[0][:2] == (0, 379)


@pytest.mark.parametrize("ranges, hops", [(1, [1, 2]), (3, [1, 1, 1, 2, 7, 120]), (40, [1, 1, 1, 2, 7, 120]), (60, [1] * 400 + [2])])
def test_islands_do_not_depend_on_the_ranges(spark, ranges, hops):
    rng = random.Random(9)
    rows, want = [], {}
    for strand in "+-":
        pos, head = 0, None
        for i in range(500):
            hop = rng.choice(hops)
            pos += hop
            if i == 0 or hop > 1:
                head = pos
            rows.append(("c", strand, pos, pos + 194, 0.5))
            want[strand, pos] = head
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "contig string, strand string, start long, end long, prob double")
    got = {(r.strand, r.start): r["head"] for r in islands.islands(df, ranges=ranges).collect()}
    assert got == want


def test_islands_move_the_windows_once(spark):
    df = spark.createDataFrame([("c", "+", 1, 195, 0.5)], "contig string, strand string, start long, end long, prob double")
    plan = islands.in_ranges(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange rangepartitioning") == 1
    found = islands.islands(df)._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange hashpartitioning(_range") <= 1 and "SortMergeJoin" not in found


def test_sequences_of_intervals(spark, contigs, sequences):
    rng = random.Random(2)
    spans = []
    for i in range(200):
        name = rng.choice(["s1000", "s6592", "s400"])
        n = len(sequences[name])
        a = rng.randrange(n - 1)
        spans.append((i, name, a, rng.randint(a + 1, n), rng.choice("+-")))
    df = spark.createDataFrame(spans, "i int, contig string, start long, end long, strand string")
    want = {i: (rc(sequences[c][a:b]) if s == "-" else sequences[c][a:b]) for i, c, a, b, s in spans}
    cut = tiles.tile_sequences(contigs, 128)
    got = {r.i: r["sequence"] for r in extract.long_sequences_at(df, cut, ["i"], 128).collect()}
    assert got == want
    short = df.filter("end - start <= 194")
    got = {r.i: r.window_seq for r in extract.sequences_at(short, cut, 128).collect()}
    assert got == {i: s for i, s in want.items() if len(s) <= 194}
    with pytest.raises(Exception, match="long_sequences_at"):
        extract.sequences_at(df, cut, 128).collect()


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = centres.number_rows(df, ["v"], "n").collect()
    assert all(r.n == r.v + 1 for r in got) and len(got) == 1000


def test_saved_lake_is_not_shuffled(spark, contigs, monkeypatch):
    from boxscan import session
    lake = tiles.save_lake(tiles.tile_sequences(contigs, 128), "lake_test", 4)
    spans = spark.createDataFrame(
        [("s1000", 5, 100, "+"), ("s6592", 6000, 6100, "-")], "contig string, start long, end long, strand string")
    small = extract.sequences_at(spans, lake, 128)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = extract.sequences_at(spans, lake, 128)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == 1      # the intervals
        assert sorted(large.collect()) == sorted(small.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE lake_test")


@pytest.mark.parametrize("long", [False, True])
def test_lookups_read_the_regions_they_need(spark, contigs, tmp_path, long):
    cut = tiles.tile_sequences(contigs, 128)
    lake = tiles.save_regions(cut, str(tmp_path / "lake"))
    spans = spark.createDataFrame(
        [(1, "s1000", 5, 100, "+"), (2, "s6592", 6000, 6100, "-")], "i int, contig string, start long, end long, strand string")

    def look(source):
        return extract.long_sequences_at(spans, source, ["i"], 128) if long else extract.sequences_at(spans, source, 128)

    found = look(lake)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, look(cut).collect())) and len(rows) == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    regions = {r.region for r in lake.select("region").distinct().collect()}
    assert len(regions) > 2
