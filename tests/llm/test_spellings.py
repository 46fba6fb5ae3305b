"""Spelling variants, held against a plain search through all one-edit strings."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import FOLDER, LOWER, empty, odd, odd_rows

from boxscan.llm import spellings
from boxscan.llm.queries import LLM_QUERIES
from boxscan.session import stage


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def by_hand(rows, how=spellings.Spelling()):
    """{word: (form, root, n, n_near, form_n)}"""
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if how.typo_every and h % how.typo_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= how.least_letters and n >= how.least_count}
    # near words share a string with one letter blanked out, or are one another's shortened string
    holders = defaultdict(set)
    for w in words:
        holders[w].add(w)
        for i in range(len(w)):
            holders[w[:i] + w[i + 1:]].add(w)
            holders[w[:i] + "?" + w[i + 1:]].add(w)
    out = {}
    for w, n in words.items():
        keys = [w] + [w[:i] + x + w[i + 1:] for i in range(len(w)) for x in ("", "?")]
        near = {v for k in keys for v in holders[k] if one_edit(v, w)}
        form = min(near, key=lambda v: (-words[v], v), default=None)
        if form is not None and words[form] < how.factor * n:
            form = None
        out[w] = (form, n, len(near))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (f, root(w), n, k, words.get(f)) for w, (f, n, k) in out.items()}


def collected(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("symbols", [1, 2, 5, 40])
def test_made_up_vocabulary(spark, symbols):
    """Ties, accents, words of the least length and a very long one."""
    how = spellings.Spelling(symbols=symbols, typo_every=0)
    rng = np.random.default_rng(symbols)
    words = ["abcdef" * 500, "abcdef" * 500 + "g", "éàüöøß", "éàüöøs", "Éàüöøß"] * 5
    words += ["".join(rng.choice(list("abc"), rng.integers(5, 9))) for _ in range(4000)]
    rows = [(i, " ".join(words[i::7])) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(spellings.group(docs, how)) == by_hand(rows, how)


def test_chain_of_forms(spark):
    steps = ["kingdom", "kingdoms", "kingdomsa", "kingdomsab", "kingdomsabc", "kingdomsabcd"]
    how = spellings.Spelling(typo_every=0)
    docs = spark.createDataFrame(
        [(k, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(steps)], "doc_id long, text string")
    got = collected(spellings.group(docs, how))
    assert [got[w][0] for w in steps] == [*steps[1:], None]
    assert {got[w][1] for w in steps} == {steps[-1]}


def test_odd_rows(spark):
    how = spellings.Spelling(least_count=1)
    want = by_hand([(r[0], r[1]) for r in odd_rows()], how)
    assert collected(spellings.group(odd(spark), how)) == want


def test_empty_table(spark):
    assert spellings.group(empty(spark)).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = by_hand(rows)
    assert any(x[0] for x in want.values())
    assert collected(LLM_QUERIES["op13_spelling_variants"](spark, FOLDER)) == want


def test_neighbourhood_is_whole():
    rng = np.random.default_rng(3)
    for length in range(1, 7):
        reduced = rng.integers(1, 4, (5, length)).astype(np.uint64)
        got = spellings.neighbour_codes(reduced, 3)
        for word, codes in zip(reduced, got, strict=True):
            w = list(word)
            near = {tuple(w)} | {(*w[:i], *w[i + 1:]) for i in range(length)}
            near |= {(*w[:i], s, *w[i + 1:]) for i in range(length) for s in (1, 2, 3)}
            near |= {(*w[:i], s, *w[i:]) for i in range(length + 1) for s in (1, 2, 3)}
            want = {int(spellings.own_code(np.array([x], np.uint64).reshape(1, len(x)))[0]) for x in near}
            assert set(codes.tolist()) == want


def test_neighbourhoods_and_pointers_are_never_broadcast(spark):
    words = [("kingdom", 5), ("kingdoms", 25), ("kingdomsa", 125)]
    table = stage(spark.createDataFrame(words, "word string, n long"), "few-words")
    pairs = spellings.near_pairs(table, spellings.Spelling())
    docs = spark.createDataFrame([(k, " ".join([w] * n)) for k, (w, n) in enumerate(words)], "doc_id long, text string")
    for df in (pairs, spellings.group(docs, spellings.Spelling(typo_every=0))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in pairs.collect()} == {
        (a, b, n) for a, _ in words for b, n in words if abs(len(a) - len(b)) == 1}
