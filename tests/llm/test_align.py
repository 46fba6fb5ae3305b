"""Alignment of two tokenizers, held against both libraries and all overlaps by hand."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import FOLDER, empty, odd, odd_rows
from tokenizers import Tokenizer

from boxscan.llm import align
from boxscan.llm.queries import LLM_QUERIES

PAIR = align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = align.Bytewise._letters()


def ends_by_hand(texts):
    """Per text (a ids, a ends, b ids, b ends), or None without tokens, as the two libraries give them."""
    a = Tokenizer.from_file(PAIR.a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PAIR.b)
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        coded = a.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(LETTERS[c] for c in x) for x in coded.tokens]
        b_ids = b.encode(text)
        b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in b_ids
        ]
        if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            out.append((coded.ids, list(np.cumsum([*map(len, a_bytes)])), b_ids, list(np.cumsum([*map(len, b_bytes)]))))
        else:
            out.append(None)
    return out


def by_hand(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) of each text."""
    coded, links, count = ends_by_hand(texts), [], Counter()
    for one in coded:
        own = []
        if one:
            a, a_ends, b, b_ends = one
            i = j = 0
            while i < len(a):
                own.append((a[i], b[j]))  # both cover what lies before the nearer end
                at = min(a_ends[i], b_ends[j])
                i, j = i + (a_ends[i] == at), j + (b_ends[j] == at)
        links.append(own)
        count.update(own)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for one, own in zip(coded, links, strict=True):
        if not one:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, a_ends, b, b_ends = one
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            to_a, to_b = a_ends.index(end, at_a) + 1, b_ends.index(end, at_b) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        out.append((
            len(a), len(b), len(groups), len(own), sum(count[x] == highest[x[1]] for x in own),
            sum(count[x] for x in own), hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return out


def digest(row):
    sha = hashlib.sha256(row.groups.encode()).hexdigest() if row.n_a else ""
    return (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, sha)


STRANGE = ["a▁b", " lead", "trail ", "two  blanks", "a\n\nb", "a\tb\r\nc", "\x00", "<s> </s> <|endoftext|>", "日本語 テスト",
           "ไทย ภาษา", "🙂🙂 🙃", "it's we'll I'M", "x1234567 89", "é İ ı ß", " nb ", "a\x1cb", " ", "﻿ x"]


@pytest.mark.parametrize("chars", [50, align.BLOCK_CHARS])
def test_odd_texts(spark, chars):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + i, t) for i, t in enumerate(STRANGE)]
    docs = odd(spark).select("doc_id", "text", "found", "node").unionByName(
        spark.createDataFrame([(100 + i, t, "x", 1) for i, t in enumerate(STRANGE)], "doc_id long, text string, found string, node long"))
    got = Counter((r.doc_id, digest(r)) for r in align.align(docs, PAIR, chars=chars).collect())
    assert got == Counter(zip([i for i, _ in rows], by_hand([t for _, t in rows]), strict=True))


def test_empty_table(spark):
    assert align.align(empty(spark), PAIR).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], by_hand([r.text for r in rows]), strict=True))
    got = {r.doc_id: tuple(r)[1:] for r in LLM_QUERIES["op12_cross_tokenizer"](spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_join_to_the_whole(size):
    rng = np.random.default_rng(size)
    for n in range(1, 60):
        last = int(rng.integers(1, 3 * n + 2))
        a = np.unique(np.append(rng.integers(1, last + 1, n), last))
        b = np.unique(np.append(rng.integers(1, last + 1, n), last))
        ends = np.union1d(a, b)
        i, j = align.diagonals(a, b, size)
        assert (np.diff(i + j)[:-1] == size).all() and 0 < np.diff(i + j)[-1] <= size
        links_a, links_b, common = align.merge_ends(a, b, size)
        assert (links_a == np.searchsorted(a, ends)).all() and (links_b == np.searchsorted(b, ends)).all()
        assert (ends[common] == np.intersect1d(a, b)).all()


def test_a_piece_reads_one_token_beyond_its_bounds():
    rng = np.random.default_rng(5)
    a, b = (np.unique(np.append(rng.integers(1, 9000, 3000), 9000)) for _ in range(2))
    i, j = align.diagonals(a, b, 100)
    k = len(i) // 2
    want = align.overlaps(a, b, i[k], i[k + 1], j[k], j[k + 1])
    cut_a, cut_b = a.copy(), b.copy()
    cut_a[:i[k] - 1], cut_b[:j[k] - 1] = 0, 0
    cut_a[i[k + 1] + 1:], cut_b[j[k + 1] + 1:] = 1 << 40, 1 << 40
    got = align.overlaps(cut_a, cut_b, i[k], i[k + 1], j[k], j[k + 1])
    assert all((x == y).all() for x, y in zip(want, got, strict=True))
