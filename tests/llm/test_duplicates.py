"""Near duplicates and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from boxscan.llm import near_dup, suffixes
from boxscan.llm.queries import LLM_QUERIES
from helpers import FOLDER, components, empty, odd, odd_rows, prose, without_repeats


def check_components(spark, rows, how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(docs, how).collect())
    want = sorted(
        (str(i), n, str(c), i == c) for (i, _), (n, c) in zip(rows, components(rows, how.words, how.percent), strict=True))
    assert got == want


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_of_one_original(spark, monkeypatch):
    """A large group of variants of one text, some too far from it, over several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(5)
    base = prose(7, 150).split()
    rows = [(i, edited(base, rng.randrange(9), rng)) for i in range(90)]
    rows += [(100 + i, prose(100 + i, 60)) for i in range(20)]
    check_components(spark, rows, near_dup.Likeness(words=3, percent=85))


def test_near_duplicates_chain(spark):
    """Neighbours are alike, the ends are not: one component all the same."""
    words = [f"w{i}" for i in range(300)]
    rows = [(20 - k, " ".join(words[k * 6:k * 6 + 150])) for k in range(20)]
    check_components(spark, rows, near_dup.Likeness(words=5, percent=80))


def test_near_duplicates_single_node_apart(spark):
    """X is linked to Y, Y to the original O, X not to O, and nothing else around O is apart."""
    rows = []
    for g in range(6):
        own = [f"g{g}w{i}" for i in range(300)]

        def but(words, places, new):
            return [f"g{g}{new}{i}" if i in places else w for i, w in enumerate(words)]

        y = but(own, {0, 1}, "y")
        group = [own, y, but(y, set(range(100, 124)), "x")]
        group += [but(own, {10 + 2 * k, 11 + 2 * k}, f"v{k}n") for k in range(30)]
        rows += [(100 * g + k, " ".join(words)) for k, words in enumerate(group)]
    check_components(spark, rows, near_dup.Likeness(words=1, percent=85))


def passages(n):
    """Short texts that share one passage, every tenth with a near copy."""
    rows = []
    for k in range(n):
        text = f"the common words of them all {' '.join(f't{k}w{i}' for i in range(24))}"
        rows += [(2 * k, text)] + [(2 * k + 1, f"{text} more")] * (k % 10 == 0)
    return rows


def test_near_duplicates_of_a_common_passage(spark, monkeypatch):
    """Texts that share little are not all compared with one another, however many share a bucket."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    sides, plans, links = [], [], near_dup._links

    def seen(left, right, *more):
        found = links(left, right, *more)
        sides.append((left, right))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(near_dup, "_links", seen)
    check_components(spark, passages(200), near_dup.Likeness(words=3, percent=85))
    compared = [left.join(right.withColumnRenamed("node", "other"), ["pivot", "i", "j"]).count() for left, right in sides]
    assert len(compared) == 2 and max(compared) < 4 * 220
    assert "Inner, Build" not in plans[1]  # the copies that a side holds are not broadcast


@pytest.mark.parametrize(("few", "meetings"), [(4, 16), (100, 1)])
def test_near_duplicates_of_a_common_passage_and_copies(spark, monkeypatch, few, meetings):
    """Groups of copies that share the passage: too many for a rare shingle's sake, or in too many groups."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "MEETINGS", meetings)
    rng = random.Random(3)
    rows = passages(60)
    for g in range(4):
        base = f"the common words of them all {' '.join(f'g{g}w{i}' for i in range(40))}".split()
        rows += [(1000 + 100 * g + k, edited(base, rng.randrange(4), rng)) for k in range(25)]
    check_components(spark, rows, near_dup.Likeness(words=3, percent=85))


def test_rare_shingles_meet(spark):
    """Two sets that are alike enough have a rare shingle in common."""
    rng = np.random.default_rng(4)
    for percent in (50, 80, 85, 100):
        bases = [rng.integers(0, 300, 40) for _ in range(6)]
        sets = [set(b[rng.random(40) < 0.95].tolist()) | set(rng.integers(0, 300, 2).tolist()) for b in bases for _ in range(10)]
        rows = [(k, bytearray(np.array(sorted(x), "<u8").tobytes())) for k, x in enumerate(sets)]
        found = near_dup.rare_shingles(spark.createDataFrame(rows, "node long, members binary").repartition(3), percent).collect()
        rare = [{r.shingle for r in found if r.node == k} for k in range(len(sets))]
        for a in range(len(sets)):
            assert rare[a] <= sets[a]
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    assert rare[a] & rare[b]


def test_near_duplicates_odd_rows(spark):
    how = near_dup.Likeness(words=3, percent=85)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dup.near_duplicates(odd(spark), how).collect())
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert got == sorted((str(i), n, str(c)) for (i, _), (n, c) in zip(rows, components(rows, 3, 85), strict=True))
    kept = near_dup.keep_first(odd(spark), how)
    assert kept.columns == odd(spark).columns
    assert {8, 3, 4, 5, 6, 7, 1} <= {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}


def test_near_duplicates_empty_table(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = {i: (n, c, i == c) for (i, _), (n, c) in zip(rows, components(rows, 3, 85), strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in LLM_QUERIES["op9_near_duplicates"](spark, FOLDER).collect()}
    assert got == want


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (" ".join(f"w{i}" for i in rng.integers(0, 1 << 40, n)) for n in (900, 100, 100))
    value, counts = near_dup.shingle_sets(pa.array([f"{common} {a}", f"{common} {b}"]), 1)
    regs = near_dup.registers(value, counts)
    got = near_dup.estimate(regs, regs[0], counts, int(counts[0]))
    assert got[0] > 0.999 and abs(got[1] - 900 / 1100) < 0.15


def check_repeats(spark, rows, length):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (bytes(r.kept), [(s.begin, s.end) for s in r.spans]) for r in suffixes.remove_repeats(docs, length).collect()}
    want = without_repeats(rows, length)
    for i, own in enumerate(want):
        assert got[i] == own, i


@pytest.mark.parametrize("few", [16, 1])
def test_repeats_random(spark, monkeypatch, few):
    """Copies, cuts, overlaps and periodic texts; also with every gram counted by whole strings."""
    monkeypatch.setattr(suffixes, "FEW", few)
    rng = random.Random(few)
    parts = [prose(i, 60) for i in range(8)] + ["ab" * 300, "z" * 700]
    rows = []
    for _ in range(60):
        text = "".join(rng.choice(parts)[rng.randrange(80):][:rng.randrange(100, 600)] for _ in range(rng.randrange(1, 5)))
        rows.append(prose(rng.randrange(10**6), rng.randrange(40)) + text)
    check_repeats(spark, [*rows, None, "", "short", rows[0], rows[0]], 150)


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(rows, without_repeats([r.text for r in rows], 400), strict=True)}
    for r in LLM_QUERIES["op5_suffix_dedup"](spark, FOLDER).collect():
        kept, spans = want[r.doc_id]
        assert (r.n_spans, r.n_removed) == (len(spans), sum(b - a for a, b in spans))
        assert r.n_bytes - r.n_removed == len(kept)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.text == kept.decode("utf-8", "replace")


def test_repeats_of_one_run_send_one_place():
    """Copies in a run leave as ready spans; the ranges get one place of each context."""
    import zstandard

    texts = [prose(77, 200).encode()] * 50 + [prose(78, 200).encode()]
    data = [zstandard.ZstdCompressor().compress(t) for t in texts]
    found = [[{"h": 5, "g": 51, "place": 300, "first": 100, "last": 250}]] * len(texts)
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "data": data, "found": found})
    out = pa.Table.from_batches(suffixes._runs(iter([batch]), 400, [])).to_pandas()
    assert sum(len(p) for p in out.places[out.range >= 0]) == 2 * 6 * 8
    ready = np.frombuffer(b"".join(out.places[out.range < 0]), "<i8").reshape(-1, 3)
    assert ready.tolist() == [[i, 100, 250] for i in range(50)]


def test_repeats_odd_rows_and_empty_table(spark):
    found = suffixes.remove_repeats(odd(spark), 400).collect()
    got = [(r.doc_id, bytes(r.kept), [tuple(x) for x in r.spans]) for r in found]
    want = [(r[0], *w) for r, w in zip(odd_rows(), without_repeats([r[1] for r in odd_rows()], 400), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffixes.remove_repeats(empty(spark), 400).count() == 0


def test_loser_tree_merges_and_counts_prefixes():
    rng = random.Random(9)
    runs, keys = [], []
    for _ in range(7):
        own = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(40)})
        keys += own
        shared, tails = suffixes.front_coded(own)

        class Row:
            pass

        row = Row()
        row.shared, row.sizes = shared.astype("<u2").tobytes(), np.array([len(t) for t in tails], "<u2").tobytes()
        row.tails, row.many = b"".join(tails), np.ones(len(own), "<u4").tobytes()
        row.places = np.zeros((len(own), 6), "<i8").tobytes()
        runs.append(suffixes.Run(row))
    out = [(lcp, key) for lcp, key, _ in suffixes.merged(runs)]
    assert [k for _, k in out] == sorted(keys)
    before = b""
    for lcp, key in out:
        assert lcp == suffixes.common(before, key)
        before = key
