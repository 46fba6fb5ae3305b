"""Steps that run on whole Arrow batches: the same values as loops over each row, in bounded memory."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions import sequences as S
from boxscan.functions.signals import DIGITS, HALF, rounded, savgol, savgol_weights, smoothed_batch
from boxscan.operators import features, scoring
from boxscan.sources import tables


def strings(rng, n=200):
    return [None, ""] + ["".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 3, 4, 6, 7, 12, 40]))) for _ in range(n)]


def lists(rng, seqs, less=0):
    return [[rng.choice([None, 0.5, rng.random(), -1e6]) for _ in range(max(len(s or "") - less, 0))] for s in seqs]


def mean_or_none(values, n):
    total = 0.0
    for v in values:
        total = None if v is None or total is None else total + v
    return None if total is None else total / n


def test_spread_is_the_mean_of_the_kmers_over_each_nucleotide():
    rng = random.Random(1)
    seqs = strings(rng)
    values = [None, *lists(rng, seqs, 5)[1:]]
    size = [8, *[len(s) for s in seqs[1:]]]
    want = []
    for v, n in zip(values, size, strict=True):
        m = n - 5
        spans = [(max(i - 5, 0), min(i, m - 1)) for i in range(n if m > 0 else 0)]
        want.append([None if v is None else mean_or_none(v[a:b + 1], b - a + 1) for a, b in spans])
    got = S.spread(pa.array(values, pa.list_(pa.float64())), pa.array(size, pa.int32()), 6)
    assert got.to_pylist() == want
    # a part of a batch
    assert S.spread(pa.array(values).slice(7, 20), pa.array(size, pa.int32()).slice(7, 20), 6).to_pylist() == want[7:27]
    assert S.spread(pa.array([], pa.list_(pa.float64())), pa.array([], pa.int32()), 6).to_pylist() == []


@pytest.mark.parametrize(("box", "sign"), [(K.C_BOX, 1), (K.D_BOX, -1)])
def test_box_distances_at_every_position(box, sign):
    seqs = [*strings(random.Random(2)), "ACé" + box]
    fits = {"R": "AG"}
    want = [[{"dist": sum(s[i + k] not in fits.get(c, c) for k, c in enumerate(box)), "start": (i + 1) * sign}
             for i in range(len(s or "") - len(box) + 1)] for s in seqs]
    assert S.box_distances(pa.array(seqs), box, sign).to_pylist() == want


def test_smoothed_batch_in_the_order_of_the_points():
    rng = random.Random(3)
    rows = [None, *lists(rng, strings(rng))]
    want = []
    for v in rows:
        n = len(v or ())
        if n < K.SAVGOL_WIDTH:
            want.append(None)
            continue
        out = []
        for i in range(n):
            first = min(max(i - HALF, 0), n - K.SAVGOL_WIDTH)
            part, total = v[first:first + K.SAVGOL_WIDTH], None
            if None not in part:
                terms = [t * w for t, w in zip(part, savgol_weights(i - first - HALF), strict=True)]
                total = terms[0]
                for t in terms[1:]:
                    total += t
            out.append(total)
        want.append(out)
    assert smoothed_batch(pa.array(rows, pa.list_(pa.float64()))).to_pylist() == want


def test_energies_and_marks_of_odd_rows(spark):
    rng = random.Random(4)
    pairs = [(None, None), (None, "GC"), ("AC", None), ("", ""), *zip(strings(rng), reversed(strings(rng)), strict=True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", features.duplex_energy(a, b).alias("e"), features.pairing_string(a, b).alias("m")).collect()
    assert len(got) == len(pairs)
    for i, e, m in got:
        left, right = pairs[i]
        n = min(len(x) for x in pairs[i] if x is not None) if (left is not None or right is not None) else 0
        met = n if left is not None and right is not None else 0
        energy = features.PAIR_ENERGY
        assert e == sum(energy.get(left[k] + right[len(right) - 1 - k], 0) for k in range(met))
        assert m == ("".join("(" if energy.get(left[-1 - k] + right[k], 0) < 0 else "." for k in range(met)) or "." * n)


def tiles_of(seqs, width=K.WINDOW):
    return pa.RecordBatch.from_pydict({
        "contig": [f"c{i}" for i in range(len(seqs))], "length": [len(s) for s in seqs], "tile_start": [0] * len(seqs),
        "tile_end": [len(s) for s in seqs], "seq": seqs})


def test_a_scan_holds_the_scores_of_a_slice_only(monkeypatch):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([50, 194, 300, 900]))) for _ in range(60)]
    seen = []

    class Seen(scoring.MotifScorer):
        def scan(self, codes, starts, strand):
            seen.append(len(codes))
            return super().scan(codes, starts, strand)

    def found():
        run = scoring._scan_batches(Seen(), 1, ["+", "-"], False, None)
        return sorted(r for b in run(iter([tiles_of(seqs)])) for r in map(tuple, zip(*b.to_pydict().values(), strict=True)))

    whole = found()
    assert whole and max(seen) > 10_000
    seen.clear()
    monkeypatch.setattr(scoring, "SLICE_BASES", 2000)
    assert found() == whole
    assert max(seen) < 2000 + 900


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.9, 0.9999999, 1.0])
def test_the_task_drops_only_what_is_below_the_threshold(threshold):
    rng = random.Random(6)
    batch = tiles_of(["".join(rng.choice("ACGT") for _ in range(3000))])

    def rows(limit):
        run = scoring._scan_batches(scoring.MotifScorer(), 1, ["+"], False, limit)
        return [r for b in run(iter([batch])) for r in map(tuple, zip(*b.to_pydict().values(), strict=True))]

    p = {r: 1 / (1 + np.exp(r[4] - r[5])) for r in rows(None)}
    assert {r for r in p if p[r] > threshold} <= set(rows(threshold)) <= {r for r in p if p[r] > threshold - 1e-5}


def test_documents_are_spelled_as_by_regular_expression(spark, tmp_path):
    texts = [None, "", "a-Z zed", "Ünïcode Straße 東京 \x00 end", "123", "The quick brown fox"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    letters = F.regexp_replace("text", "[^A-Za-z]+", "")
    both = tables.LETTERS + tables.LETTERS.upper()
    want = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        F.col("doc_id").cast("string"), F.translate(letters, both, tables.BASES * 2), F.length(letters).cast("long"))
    got = tables.document_contigs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pieces_of_a_batch_give_the_whole(monkeypatch):
    seen = []

    def run(a, b):
        seen.append(len(a))
        return S.spread(a, b, 6)

    values = pa.array([[1.0] * (i % 9) for i in range(25)])
    size = pa.array([i % 9 + 5 for i in range(25)])
    whole = S.in_pieces(run, values, size).to_pylist()
    monkeypatch.setattr(S, "ROWS", 4)
    assert S.in_pieces(run, values, size).to_pylist() == whole and max(seen[1:]) == 4
    assert S.in_pieces(run, values.slice(0, 0), size.slice(0, 0)).to_pylist() == []


def test_rounded_as_spark_rounds(spark):
    """Halves by their decimal digits, signs of zero, large numbers and none at all."""
    rng = np.random.default_rng(4)
    values = [0.0, -0.0, 5e-10, -5e-10, 4.9e-10, 1.5e-9, 2.5e-9, -2.5e-9, 0.1 + 0.2, 1.0000000005, 1.0000000015,
              123456.7890123455, 1e12 + 0.0001220703125, 2.0 ** 53 + 2, 1e300, -1e-300, math.nan, math.inf, -math.inf]
    values += ((rng.integers(-10 ** 9, 10 ** 9, 200) * 10 + 5) / 1e10).tolist() + rng.normal(0, 1, 200).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    want = [r.v for r in df.select("i", F.round("v", DIGITS).alias("v")).orderBy("i").collect()]
    assert [repr(v) for v in rounded(np.array(values)).tolist()] == [repr(v) for v in want]


def test_savgol_rounds_in_its_batches(spark):
    """The rounding is part of the Arrow batch: no lambda visits the points of a signal in the JVM."""
    df = spark.createDataFrame([([0.1 * k for k in range(12)],), ([1.0, None] + [2.0] * 12,), ([1.0],), (None,)], "v array<double>")
    out = df.select(savgol(F.col("v")).alias("s"))
    assert "transform" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [r.s for r in out.collect()]
    raw = smoothed_batch(pa.array([r.v for r in df.collect()], pa.list_(pa.float64()))).to_pylist()
    want = [None if s is None else [None if x is None else rounded(np.array([x]))[0] for x in s] for s in raw]
    assert got == want and got[2] is None and None in got[1]
