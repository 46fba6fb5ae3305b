"""Small documents with all the odd cases, and plain versions of the operators."""

import os
import re
from collections import Counter, defaultdict

import numpy as np

FOLDER = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, node long, measured int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    pick = np.random.default_rng(seed).integers(0, 400, n)
    return " ".join(f"{WORDS[i % 20]}{WORDS[i // 20][:2]}" for i in pick)


def odd_rows() -> list[tuple]:
    """Null and empty texts, null ids and keys, repeated rows, a very long text, many scripts."""
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, "  \n\t "), (6, "one"), (7, "one two"),
        (8, prose(2, 30_000)), (9, base.replace("alphaal", "ALPHAal", 1)), (10, "x" * 5000), (11, "\r\n a  b c \x1c d"),
        (12, "Ünï ßtraße 日本語 🙂🙂 é it's we'll"), (None, base), (None, None), (13, "a\n\nb\n\nb\n"),
        (14, prose(3, 200) + " " + prose(1, 80)), (15, "﻿<|endoftext|> </turn> \\"),
    ]
    return [
        (i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"s{k % 3}", None, "clash", k, k)
        for k, (i, t) in enumerate(texts)
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def components(rows, size, percent):
    """row number: (set size, least doc_id of the component), by comparing all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    names = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[root(i)].append(doc)
    return [
        (len(sets[i]), min(names[root(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows)
    ]


def without_repeats(texts, length):
    """(kept bytes, spans) of each text, by counting every string of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        change = np.zeros(len(d) + 1, int)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                change[p] += 1
                change[p + length] -= 1
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        out.append((np.frombuffer(d, np.uint8)[~gone].tobytes(), [tuple(map(int, x)) for x in edge]))
    return out
