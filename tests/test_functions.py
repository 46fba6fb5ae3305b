"""Golden cases worked out by hand, and properties."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions import sequences as S
from boxscan.functions.intervals import centre_end, centre_start, widen_left, widen_right
from boxscan.functions.signals import peaks, savgol, savgol_weights
from boxscan.operators import features, motifs, rules


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_kmers_and_reverse_complement(spark):
    row = one(
        spark, S.kmer_tokens(F.lit("ACGTACGT")), S.revcomp(F.lit("AACGTN")), S.revcomp(F.lit("acRYK")),
        F.size(S.kmers(F.lit("ACGT"))), S.revcomp(S.revcomp(F.lit("ACGTRYKMBDHVSWN"))),
    )
    assert row == ("ACGTAC CGTACG GTACGT", "NACGTT", "MRYGT", 0, "ACGTRYKMBDHVSWN")


def test_hamming(spark):
    row = one(spark, *[S.hamming(F.lit(m), K.C_BOX) for m in ("ATGATGA", "GTGATGA", "CTGATGA", "NNNNNNN")],
              S.hamming(F.lit("NNNN"), K.D_BOX))
    assert tuple(row) == (0, 0, 1, 7, 4)


def test_kmer_to_nt(spark):
    row = one(spark, S.kmer_to_nt(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(8)))
    assert row[0] == [1, 1.5, 2, 2, 2, 2, 2.5, 3]


def test_interval_arithmetic(spark):
    def at(fn, a, b):
        return fn(F.lit(a), F.lit(b))

    row = one(spark, at(centre_start, 100, 299), at(centre_end, 100, 299),
              at(centre_start, 1000, 1214), at(centre_end, 1000, 1214),
              at(widen_left, 1000, 1101), at(widen_right, 1000, 1101))
    assert tuple(row) == (102, 296, 1010, 1204, 46, 47)


def test_savgol_weights_are_the_known_fractions():
    assert savgol_weights() == pytest.approx(
        [x / 429 for x in (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)])
    assert savgol_weights(-5) == pytest.approx(
        [x / 143 for x in (83, 54, 30, 11, -3, -12, -16, -15, -9, 2, 18)])


def test_savgol_keeps_a_parabola_and_finds_peaks(spark):
    values = [0.5 * i * i - 3 * i + 2 for i in range(30)]
    bump = [0.0] * 8 + [0.1] + [0.0] * 8
    row = one(spark, savgol(F.array(*[F.lit(v) for v in values])),
              savgol(F.array(*[F.lit(v) for v in values[:10]])),
              peaks(F.array(*[F.lit(v) for v in bump])))
    assert row[0] == pytest.approx(values)
    assert row[1] is None
    assert [(p.pos, p.height) for p in row[2]] == [(8, 0.1)]


def test_box_search_equals_fuzzy_patterns(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(14)) for _ in range(600)] + ["CTGACCTGAC", "ACG", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, window_seq string")
    n = F.length("window_seq")
    got = {
        r.i: r for r in motifs.with_distances(df).select(
            "i", motifs.leftmost_c(F.col("_cd"), F.lit(0), n).alias("c"),
            motifs.rightmost_d(F.col("_dd"), F.lit(0), n).alias("d"),
            motifs.exact_d(F.col("_dd"), F.lit(0), n).alias("x")).collect()
    }

    def fuzzy(pattern, seq, most, last):
        for subs in range(most + 1):
            hits = [m.start() + 1 for m in regex.finditer("(?:%s){s<=%d}" % (pattern, subs), seq, overlapped=True)]
            if hits:
                return subs, hits[-1 if last else 0]
        return None

    for i, seq in enumerate(seqs):
        pair = lambda b: None if b is None else (b.dist, b.start)
        assert pair(got[i].c) == fuzzy("[AG]TGATGA", seq, 3, False)
        assert pair(got[i].d) == fuzzy("CTGA", seq, 2, True)
        assert pair(got[i].x) == fuzzy("CTGA", seq, 0, True)


def test_prime_pairs_equal_listing_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        size = rng.choice([194, 194, 60, 100])
        seq = "".join(rng.choice("ACGTTGA") for _ in range(size))
        rows.append((i, seq, rng.randint(15, 82), rng.randint(min(110, size), min(179, size + 20))))
    df = spark.createDataFrame(rows, "i int, window_seq string, c_limit int, d_limit int")
    got = {r.i: r for r in motifs.pair_primes(motifs.with_distances(df)).collect()}

    def hits(seq, lo, hi, box, most):
        out = []
        for s in range(max(lo, 0), min(hi, len(seq)) - len(box) + 1):
            dist = sum(not (b in "AG" if c == "R" else b == c) for b, c in zip(seq[s:s + len(box)], box))
            if dist <= most:
                out.append((dist, s + 1))
        return sorted(out)

    for i, seq, c_limit, d_limit in rows:
        mid = len(seq) // 2
        cs, ds = hits(seq, mid, d_limit - 14, K.C_BOX, 3), hits(seq, c_limit + 17, mid, K.D_BOX, 2)
        pairs = sorted((c[0] + d[0], d[0], d[1], c[1], d, c) for d in ds for c in cs if d[1] + 5 <= c[1])
        if pairs:
            d, c = pairs[0][4:]
        elif ds:
            d, c = ds[0], None
        else:
            d, c = None, (cs[0] if cs else None)
        pair = lambda b: None if b is None else (b.dist, b.start)
        assert (pair(got[i].d_prime), pair(got[i].c_prime)) == (d, c), seq


def test_stem_features(spark):
    row = one(
        spark, features.stem_length_score(F.lit("((((..((((((((((((((")),
        features.stem_length_score(F.lit("....................")),
        features.stem_length_score(F.lit("(.(..(...)..........")),
        features.duplex_energy(F.lit("GGAT"), F.lit("GTCC")),
        features.pairing_string(F.lit("GGAT"), F.lit("GTCC")),
    )
    assert tuple(row) == (16, 0, 0, -9.0, "((((")


RULES = [
    # p, label, c, d, terminal, stability, box, c_motif, d_motif, expected
    (0.9, 1, 2, 1, -50.0, -0.5, 3, "A", "A", K.PSEUDOGENE),
    (0.9, 0, 0, 1, -25.0, 0.0, 9, "A", "A", K.EXPRESSED),
    (0.9, 1, 1, 1, 0.0, -0.3, 9, "A", "A", K.PSEUDOGENE),
    (0.9, 1, 1, 0, 0.0, -0.3, 9, "A", "A", K.EXPRESSED),
    (0.9, 0, 1, 0, 0.0, -0.3, 9, "A", "A", K.PSEUDOGENE),
    (0.9999, 0, 1, 1, -30.0, -0.3, 3, "A", "A", K.EXPRESSED),
    (0.9999, 0, 1, 1, -30.0, -0.1, 3, "A", "A", K.PSEUDOGENE),
    (0.9999, 1, 3, 2, 0.0, 0.0, 12, "A", "A", K.EXPRESSED),
    (0.9999, 1, 0, 0, -30.0, -0.3, 0, "NNNNNNN", "A", K.PSEUDOGENE),
    (0.9, 1, 0, 0, -30.0, -0.3, 0, "A", "NNNN", K.PSEUDOGENE),
    (None, 1, 0, 0, -30.0, -0.3, 0, "A", "A", None),
]


def test_rule_cascade(spark):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(RULES)],
        "i int, probability_expressed_pseudogene double, second_model_prediction int, score_c int, "
        "score_d int, terminal_combined double, normalized_sno_stability double, box_score int, "
        "C_MOTIF string, D_MOTIF string, expected string")
    got = {r.i: r.predicted_label for r in rules.apply_rules(df).collect()}
    assert got == {i: r[-1] for i, r in enumerate(RULES) if r[-1]}
    # a threshold of zero is a threshold
    zero = rules.apply_rules(df.filter("i = 3"), c=0, d=0).first()
    assert zero.predicted_label == K.PSEUDOGENE
