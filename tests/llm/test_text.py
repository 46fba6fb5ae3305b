"""Chat, quality rules, mixing, personal data, resampling, search and the pipeline."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxscan.llm import chat, importance, mixing, pii, quality_rules, top_k
from boxscan.llm.queries import LLM_QUERIES
from boxscan.session import stage
from helpers import FOLDER, components, empty, odd, odd_rows, prose

TURNS = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip_and_order(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>", "\\\\</turn>\n<turn user>\n", "<turn ", "", None, "ends in \\", "\n</turn>\n"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "first", "x"), (3, 0, None, None, "x"), (3, 1, "tool>\n<turn ", "odd role", "x")]
    rows += [(4, 0, "user", "a", "x"), (4, 0, "user", "a", "x"), (None, None, "user", "q", "x"), (None, 1, "assistant", "r", "x")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {
        r.conv_id: r for r in out.withColumn("back", chat.read_turns(F.col("formatted")))
        .withColumn("trained", chat.loss_text(F.col("segments"))).collect()
    }
    assert [t.text for t in got[1].back] == [t or "" for t in nasty]
    assert got[1].trained == "".join(t or "" for t in nasty[1::2])
    assert got[1].valid and got[1].bad_turn is None
    assert not got[2].valid and got[2].bad_turn == 1
    assert [(t.role, t.text) for t in got[3].back] == [("", ""), ("tool>\n<turn ", "odd role")]
    assert got[4].n_turns == 2 and got[4].bad_turn == 2 and got[None].valid
    for r in got.values():
        for s in r.segments:
            assert r.formatted[s.start:s.start + s.length] == s.text
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_query_has_the_extra_conversation(spark):
    r = LLM_QUERIES["op3_chat_format"](spark, FOLDER).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(said)
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


def test_quality_measures(spark):
    rows = [*odd_rows(), (99, "a b c a b c a b c d", "en", "s0", 1, "", 99, 0), (98, "x y z q x y z\nx y z\nx y z", "en", "s0", 1, "", 98, 0)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    got = docs.select("node", quality_rules.measured(F.col("text")).alias("m")).select("node", "m.*").collect()
    want = {r[6]: by_hand(r[1]) for r in rows}
    for r in got:
        assert tuple(r[1:]) == want[r.node], r.node


def test_quality_fences_follow_the_values(spark):
    """Two groups with symbols of other sizes get other fences, and a constant in none of them."""
    def text(k, symbols):
        return prose(500 + k, 80) + " " + "#" * symbols

    rows = [(k, text(k, (k % 7) * size), "en", source, 1, "", k, 0)
            for source, size in (("few", 1), ("many", 9)) for k in range(140)]
    sketch = quality_rules.sketches(quality_rules.measure(
        spark.createDataFrame(rows, odd(spark).schema), quality_rules.Rules()))
    found = {r.t_source: r for r in quality_rules.thresholds(sketch, quality_rules.Rules()).collect()}
    assert found["many"].symbol_share_high > 5 * found["few"].symbol_share_high > 0


def test_quality_outliers_of_a_group_go(spark):
    rows = [(i, prose(i, 200), "en", "s0", 1, "", i, 0) for i in range(150)]
    rows += [(1000 + i, " ".join(x + "###" for x in prose(i, 200).split()), "en", "s0", 1, "", i, 0) for i in range(15)]
    rows += [(2000 + i, prose(5000 + i, 200), "de", None, 1, "", i, 0) for i in range(5)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert kept == {r[0] for r in rows if not 1000 <= r[0] < 2000}
    passed = quality_rules.keep(docs)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == kept
    assert quality_rules.judge(odd(spark)).count() == len(odd_rows())
    assert quality_rules.judge(empty(spark)).count() == 0 and quality_rules.keep(empty(spark)).count() == 0


def test_quality_sketch_bucket_is_close(spark):
    got = spark.range(1, 200_000, 37).select("id", quality_rules._bucket("id").alias("b")).collect()
    assert all(r.b <= r.id < r.b + max(1, r.b / 64) for r in got)


def test_mixing(spark):
    rows = [(i, "t", "en", "a" if i < 600 else "b" if i < 900 else None, 1, "", i, 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    out = mixing.replicate(docs, mixing.Mixture(size=3.0)).collect()
    share = Counter(r.source for r in out)
    assert all(abs(share[s] - 1000) < 160 for s in ("a", "b", None))
    assert all(1 <= r.copy_no <= r.n_copies for r in out)
    assert Counter((r.doc_id, r.copy_no) for r in out).most_common(1)[0][1] == 1
    again = mixing.replicate(docs.repartition(7), mixing.Mixture(size=3.0)).collect()
    assert sorted(r.mix_key for r in out) == sorted(r.mix_key for r in again)
    none = mixing.replicate(docs, mixing.Mixture(weights={"a": 0.0})).collect()
    assert {r.source for r in none} == {"b", None}
    assert mixing.replicate(odd(spark)).columns[:8] == odd(spark).columns and mixing.replicate(empty(spark)).count() == 0


def test_poisson_inversion_matches_the_distribution(spark):
    for rate in (0.3, 5.0, 16.0):
        upto = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("c")).first().c
        p, total = np.exp(-rate), 0.0
        for k in range(40):
            total += p
            assert abs(upto[k] - total) < 1e-12
            p *= rate / (k + 1)
    docs = spark.createDataFrame([(i, "t", "en", "a", 1, "", i, 0) for i in range(40)], odd(spark).schema)
    n = mixing.replicate(docs, mixing.Mixture(size=50.0)).count()
    assert abs(n - 2000) < 6 * 2000**0.5


def test_pii(spark):
    text = (
        "Mr. John Smith met Mrs. Anna Smith, then Mr. Smith; Госпожа Анна Иванова. x@y.org X@Y.org "
        '4111 1111 1111 1111 and 4111111111111111, not 4111111111111112; token = "deadbeef01234567" '
        "+1 (974) 555-3436 1.2.3.4 not 1.2.3.456 123-45-6789"
    )
    rows = [(1, text), (2, None), (3, ""), (4, "plain 12345"), (5, "mail x@y.org"), (5, "mail x@y.org"), (None, "1.2.3.4")]
    docs = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, found string, swap int")
    out = pii.pseudonymize(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {}
    for r in out.collect():
        assert (r.found, r.swap) == ("keep", 1)
        got.setdefault(r.doc_id, r.text)
    new = got[1]
    for gone in ("John", "Smith", "Anna", "Анна", "y.org", "4111 1111", "4111111111111111", "deadbeef", "555-3436", "1.2.3.4 ", "123-45"):
        assert gone not in new, gone
    assert "4111111111111112" in new and "1.2.3.456" in new and (got[2], got[3], got[4]) == (None, "", "plain 12345")
    names = re.match(r"Mr\. (\w+o?n) (\w+) met Mrs\. (\w+a) (\w+), then Mr\. (\w+); Госпожа (\w+а) (\w+)\. (\S+) (\S+) ([\d ]{19}) and (\d{16})", new)
    assert names and names[2] == names[4] == names[5] and re.fullmatch("[а-я]+", names[7].lower())
    assert names[8] == names[9] == got[5].split()[1] and names[10].replace(" ", "") == names[11]
    assert re.search(r'token = "[0-9a-f]{16}" \+1 \(\d{3}\) \d{3}-\d{4} 10\.\d+\.\d+\.\d+ not', new)
    digits = [int(c) for c in names[11]][::-1]
    assert sum(digits[0::2]) % 10 == -sum(2 * d - 9 * (d > 4) for d in digits[1::2]) % 10
    assert pii.pseudonymize(docs.limit(0)).count() == 0 and pii.pseudonymize(odd(spark)).count() == len(odd_rows())


def test_pii_whole_names_and_numbers(spark):
    """Names of several words, initials, bare words of a name, national and grouped phones, numbers by their digits."""
    texts = [
        "Mr John Paul Smith met Ms Mary Smith-Jones. Later Smith's car hit Jones, and Paul ran.",
        "Mrs O'Brien, Mr McDonald, Mr J. Smith, Prof. Dr. Anna Lee and Herr Ludwig van Beethoven. The end.",
        "212-555-0147 or 212.555.0147 or (212) 555-0147, +33 6 12 34 56 78 and +33612345678, 06 12 34 56 78",
        "123-45-6789 is 123 45 6789", "Mr J. and Ms Ella Brown The third, +49 (0231) 555-3436 12", "Smith stays without a title, 1 000 000 too",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.pseudonymize(docs).collect()}
    for i, gone in ((0, "John Paul Smith Mary Jones"), (1, "Brien McDonald J. Smith Anna Lee Ludwig Beethoven"),
                    (2, "555 0147 12 34 6123"), (3, "45 6789"), (4, "J. Ella Brown 0231")):
        for word in gone.split():
            assert word not in new[i], (word, new[i])
    names = re.fullmatch(r"Mr (\w+) (\w+) (\w+) met Ms (\w+) (\w+)-(\w+)\. Later (\w+)'s car hit (\w+), and (\w+) ran\.", new[0])
    assert names and names[3] == names[5] == names[7] and names[6] == names[8] and names[2] == names[9]
    assert re.fullmatch(
        r"Mrs \w+, Mr \w+, Mr [A-Z]\. (\w+), Prof\. Dr\. \w+ \w+ and Herr \w+ van \w+\. The end\.", new[1])[1] == names[3]
    phones = re.fullmatch(
        r"(\d{3}-\d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4}) or (\(\d{3}\) \d{3}-\d{4}), "
        r"(\+33 \d(?: \d\d){4}) and (\+33\d{9}), (\d\d(?: \d\d){4})", new[2])
    digits = [re.sub("[^0-9]", "", p) for p in phones.groups()]
    assert digits[0] == digits[1] == digits[2] and digits[3] == digits[4]
    assert new[3].split(" is ")[0].replace("-", " ") == new[3].split(" is ")[1]
    assert new[5] == texts[5]


def test_pii_surrogates_are_distinct(spark):
    values = spark.range(4000).select(
        F.lit("phone").alias("kind"), F.format_string("+1 (01%d) 000-000%d", F.col("id") % 7, F.col("id") % 9).alias("value")
    ).union(spark.range(60).select(F.lit("surname"), F.format_string("Name%s", F.expr("chr(97 + id % 26)"))))
    given = pii.assign(values, pii.Pseudonyms()).collect()
    assert len(given) == values.distinct().count()
    assert len({(r.kind, r.given) for r in given}) == len(given)
    assert not {r.given for r in given} & {r.value for r in given}


def test_resampling_tells_labels_apart(spark):
    folder = FOLDER.replace("sf0.001", "sf0.1")  # some hundred labels are too few to count n-grams of
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    out = importance.resample(docs, train)
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [(r.kept, held[r.doc_id]) for r in out.collect() if r.doc_id in held]
    assert sum(k == bool(q) for k, q in rows) / len(rows) > 0.95
    odd_out = importance.resample(odd(spark), labels.limit(0)).collect()
    assert len(odd_out) == len(odd_rows()) and not any(r.kept for r in odd_out if r.n_grams == 0)
    assert importance.resample(empty(spark), labels).count() == 0


def test_kth_largest(spark):
    steps = [int(x) for x in np.random.default_rng(1).integers(1 << 61, (1 << 62) + (1 << 61), 500)] + [1 << 62] * 20
    table = spark.createDataFrame([(s,) for s in steps], "step long")
    for k in (1, 7, 260, 520):
        assert importance.kth_largest(table, k) == sorted(steps, reverse=True)[k - 1]


def test_top_k_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "TILE", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(60)]
    rows += [(70, None), (71, [1.0, None]), (72, [float("nan")]), (73, [float("inf")]), (None, [1.0]), (80, []), (81, [2.0]), (100, [1e30, 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k.search(v, v.where("id % 20 = 0"), 6, 1).collect()]
    fit = [(i, x) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for q, a in fit:
        if q % 20 == 0:
            scored = [
                (-max(min(sum(int(c) * int(d) for c, d in zip(a, b, strict=False)), (1 << 63) - 1), -(1 << 63)), i)
                for i, b in fit if i != q]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:6])]
    assert sorted(got) == sorted(want)
    assert top_k.search(v.limit(0), v.limit(0), 6, 1).count() == 0


def test_top_k_repeated_query_with_an_invalid_vector(spark):
    """The least vector of a repeated query is taken among the valid ones."""
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame(
        [(20, [None, 5.0]), (20, [3.0, 1.0]), (20, [float("-inf"), 0.0]), (20, [4.0, 0.0]), (20, None)], v.schema)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k.search(v, asked, 6, 1).collect()]
    assert sorted(got) == [(20, 1, 2, 7), (20, 2, 1, 5)]


def test_top_k_goes_by_key(spark):
    """The copies of query tiles are sized like the tiles, so they must not be broadcast."""
    v = stage(spark.createDataFrame([(i, [i % 7.0, i % 5.0]) for i in range(200)], "id long, vector array<double>"), "few-vectors")
    found = top_k.search(v, v.where("id % 20 = 0"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [column") == 1 and plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [tile") == 1
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    want = [
        (q, k + 1, i) for q in range(0, 200, 20)
        for k, (_, i) in enumerate(sorted((-((q % 7) * (i % 7) + (q % 5) * (i % 5)), i) for i in range(200) if i != q)[:3])]
    assert got == want


def test_top_k_lists_of_many_tiles():
    """Lists kept from tile to tile equal a plain search, also with ties, repeated ids and long numbers."""
    rng = np.random.default_rng(5)
    for top in (1, 2, 90, 5000, 1 << 22, 1 << 30):
        for k in (1, 6):
            asked, a = rng.choice(60, 15, replace=False), rng.integers(-top, top + 1, (15, 4)).astype(float)
            lists, met = top_k.Lists(asked, k), []
            for n in (70, 3, 40, 120):
                names, b = np.sort(rng.integers(0, 60, n)), rng.integers(-top, top + 1, (n, 4)).astype(float)
                ids, cells, dim = next(top_k._tiles(iter([pa.record_batch([pa.array(names), pa.array(b.tolist())], ["id", "v"])]), 1))
                lists.meet(a, *top_k._matrix(ids[0].as_py(), cells[0].as_py(), dim[0].as_py()))
                met += zip(names.tolist(), b.astype(np.int64).tolist(), strict=True)
            want = []
            for q, x in zip(asked.tolist(), a.astype(np.int64).tolist(), strict=True):
                scored = sorted((-sum(c * d for c, d in zip(x, y, strict=True)), i) for i, y in met if i != q)
                want += [(q, i, -s) for s, i in scored[:k]]
            got = zip(asked[lists.line].tolist(), lists.name.tolist(), lists.score.tolist(), strict=True)
            assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, step in corpus_pipeline.STAGES:
        after = step(spark, docs, FOLDER).persist()
        out.append((docs, after))
        docs = after
    return out


def test_pipeline_stages(spark, stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(sorted(after.columns) == sorted(names) for _, after in stages[:-1])
    before, after = stages[0]
    judged = {r.doc_id for r in quality_rules.judge(before).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == judged
    rows = [(r.doc_id, r.text) for r in after.collect()]
    first = {i for (i, _), (_, c) in zip(rows, components(rows, 5, 80), strict=True) if i == c}
    assert {r.doc_id for r in stages[1][1].collect()} == first
    old, new = ({r.doc_id: r.text for r in t.collect()} for t in stages[2])
    assert old.keys() == new.keys()
    for i, text in old.items():
        assert not any(x in new[i] for x in re.findall(r"\S+@mail\d\.example\.com", text))
    mixed = Counter(r.doc_id for r in stages[3][1].collect())
    drawn = {r.doc_id: r.n_copies for r in mixing.replicate(stages[3][0]).collect()}
    assert mixed == drawn
    last = stages[4][1].collect()
    assert Counter(r.doc_id for r in last) == mixed and all(r.decodes for r in last)
