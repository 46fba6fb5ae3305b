"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else.  Not every suffix is sorted: among the 64-byte grams of each string of
``length`` bytes the one of least hash is its anchor (the last one on a tie), so
equal strings have equal anchors at equal distances.  About one suffix in 170 is
the anchor of a run of neighbouring strings.  Only anchors whose gram is found
twice go on.

Tasks cut the context of their anchors (all bytes of the strings it stands for),
sort them as suffixes (bytes from the anchor on, a sign that no text holds, then
the bytes before it, backwards), join equal ones (their spans are settled at once,
one place and the count of each go on: a group of copies sends a range at most
one place of a context per run), and exchange the sorted runs front-coded: common prefix with the entry before, and the rest.  Ranges are
bounded by whole contexts of a bounded sample, so that a gram of any frequency
is spread as long as its surroundings differ.  A range merges its runs with a
loser tree that compares two entries only from the prefix on that both are known
to share.  The merged order gives, with the common prefixes of neighbours:

* entries with several places: all their strings repeat;
* a gram with few contexts, all in one range: each pair shares so many bytes to
  the right and to the left, which tells the strings that repeat;
* other grams: neighbours prove most strings; each entry's strings within the
  reach of its longest common prefix are compared by a hash of the whole string,
  counted over all tasks.

Defined results: null is empty; strings never cross documents; repeated rows
are documents of their own, so their strings repeat; texts shorter than
``length`` lose nothing; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxscan.llm.hashing import mix, powers, prefix, slices
from boxscan.session import stage

GRAM = 64
#: Windows whose anchors are found in one go.
PIECE = 1 << 20
#: Contexts of one gram that are compared pair by pair.
FEW = 16
#: Documents whose contexts bound the ranges, and bytes of contexts in a range.
SAMPLE_DOCS = 1000
RANGE_BYTES = 12 << 20
#: Bytes of contexts in a run.
RUN_BYTES = 48 << 20
END = b"\xff"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [(x or "").encode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0), "n_bytes": pa.array(map(len, texts), pa.int64()),
                "data": pa.array(map(press.compress, texts), pa.binary()),
            })


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, hash): anchors and the starts of the strings that each stands for.

    ``data`` holds texts one after another, ``ends`` where each ends.
    """
    width = length - GRAM + 1
    out = []
    n = len(data)
    for base in range(0, max(n - length + 1, 0), PIECE):
        part = data[base:base + PIECE + length - 1]
        sums = prefix(part)
        _, down = powers(len(part) + 1)
        grams = len(part) - GRAM + 1
        hashes = mix((sums[GRAM:] - sums[:-GRAM]) * down[:grams])
        low = np.uint64((1 << 24) - 1)
        keys = (hashes & ~low) | np.arange(grams - 1, -1, -1, dtype=np.uint64)
        rows = -(-grams // width)
        padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:grams] = keys
        padded = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        starts = grams - width + 1
        least = np.minimum(behind[:starts], ahead[width - 1:width - 1 + starts])
        place = grams - 1 - (least & low).astype(np.int64)
        own_end = ends[np.searchsorted(ends, base + np.arange(starts), "right")]
        whole = base + np.arange(starts) + length <= own_end
        start = np.flatnonzero(whole)
        place = place[start]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        if len(new):
            last = np.concatenate([new[1:] - 1, [len(place) - 1]])
            out.append((place[new] + base, start[new] + base, start[last] + base, hashes[place[new]]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        held, size = [], 0
        for k in range(batch.num_rows + 1):
            if k == batch.num_rows or size > PIECE:
                texts = [unpack.decompress(batch.column(2)[i].as_py()) for i in held]
                sizes = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(sizes)
                place, first, last, h = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, length)
                own = np.searchsorted(ends, place, "right")
                begin = (ends - sizes)[own] if len(own) else own
                rows = np.asarray(batch.column(0).take(pa.array(held, pa.int64()))) if held else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(rows[own] if len(own) else [], pa.int64()),
                    "place": pa.array(place - begin, pa.int64()), "first": pa.array(first - begin, pa.int64()),
                    "last": pa.array(last - begin, pa.int64()), "h": pa.array(h.view(np.int64), pa.int64()),
                })
                held, size = [], 0
            if k < batch.num_rows and batch.column(1)[k].as_py() >= length:
                held.append(k)
                size += batch.column(1)[k].as_py()


def context(data: bytes, place: int, first: int, last: int, length: int) -> bytes:
    """The sort key of an anchor: its right context, END, and its left context backwards."""
    left = data[first:place]
    return data[place:last + length] + END + left[::-1]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # equal below low, different before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low] != b[low] else high


def _contexts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, tuple[int, int, int, int, int, int]]]:
    """(key, (h, g, row, place, first, last)) of all anchors of the rows (row, data, found)."""
    unpack = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        data, row = unpack.decompress(batch.column(1)[k].as_py()), batch.column(0)[k].as_py()
        for a in batch.column(2)[k].as_py():
            yield context(data, a["place"], a["first"], a["last"], length), (
                a["h"], a["g"], row, a["place"], a["first"], a["last"])


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(common prefix with the key before, the rest) of sorted keys."""
    shared = np.zeros(len(keys), np.int64)
    tails = []
    before = b""
    for i, key in enumerate(keys):
        shared[i] = common(before, key)
        tails.append(key[shared[i]:])
        before = key
    return shared, tails


def _runs(batches: Iterator[pa.RecordBatch], length: int, bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of a task's contexts, cut at the bounds of the ranges.

    A context that a run holds twice or more is settled here: the spans of its
    places leave as a range of the run's own (below zero), and one place goes on,
    with the count.
    """
    from bisect import bisect_right

    from pyspark import TaskContext

    held: dict[bytes, list[tuple]] = {}
    size = flushed = 0
    own_task = TaskContext.get()
    task = own_task.partitionId() if own_task else 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = sorted(held)
        cuts = [0]
        for bound in bounds:
            cuts.append(bisect_right(keys, bound, cuts[-1]))
        cuts.append(len(keys))
        copies = []
        for key in keys:
            if len(held[key]) > 1:  # all strings of these places repeat: only one place goes to the range
                right = key.index(END)
                far, near = len(key) - right - 1, length - right
                copies += [(row, place - far, place - near) for _, _, row, place, _, _ in held[key]]
        if copies:
            none = pa.array([b""], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "range": pa.array([-1 - (task * 8191 + flushed) % (1 << 30)], pa.int32()), "shared": none, "sizes": none,
                "tails": none, "many": none, "places": pa.array([np.array(copies, "<i8").tobytes()], pa.binary()),
            })
        for r in range(len(cuts) - 1):
            own = keys[cuts[r]:cuts[r + 1]]
            if own:
                shared, tails = front_coded(own)
                places = [held[key][0] for key in own]
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([r], pa.int32()),
                    "shared": pa.array([shared.astype("<u2").tobytes()], pa.binary()),
                    "sizes": pa.array([np.array([len(t) for t in tails], "<u2").tobytes()], pa.binary()),
                    "tails": pa.array([b"".join(tails)], pa.binary()),
                    "many": pa.array([np.array([len(held[key]) for key in own], "<u4").tobytes()], pa.binary()),
                    "places": pa.array([np.array(places, "<i8").tobytes()], pa.binary()),
                })

    for batch in batches:
        for key, what in _contexts(batch, length):
            if key not in held:
                held[key] = []
                size += len(key)
            held[key].append(what)
            size += 64
        if size > RUN_BYTES:
            yield from flush()
            held, size = {}, 0
            flushed += 1
    if held:
        yield from flush()


class Run:
    """Head of a front-coded run: its key, and the prefix it shares with the key before."""

    def __init__(self, row) -> None:
        self.shared = np.frombuffer(row.shared, "<u2").tolist()
        sizes = np.frombuffer(row.sizes, "<u2").astype(np.int64)
        self.ends = np.cumsum(sizes).tolist()
        self.tails = row.tails
        many = np.frombuffer(row.many, "<u4").astype(np.int64)
        self.places = np.column_stack([np.frombuffer(row.places, "<i8").reshape(-1, 6), many])
        self.at, self.key, self.lcp = -1, b"", 0
        self.advance()

    def advance(self) -> None:
        self.at += 1
        if self.at == len(self.ends):
            self.key = None
            return
        i = self.at
        self.lcp = self.shared[i]
        self.key = self.key[:self.lcp] + self.tails[self.ends[i - 1] if i else 0:self.ends[i]]

    def what(self) -> np.ndarray:
        """One of the places of the head's context in this run, and how many there are."""
        return self.places[self.at:self.at + 1]


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(prefix shared with the entry before, key, places) in order, by a loser tree.

    Each run knows how far its head agrees with the last entry that left.  Of two
    heads the one that agrees further is the smaller, without a look at either;
    heads that agree equally far are compared from there on, and the loser then
    knows its agreement with the winner.
    """
    n = len(runs)
    losers: list[Run | None] = [None] * max(n, 1)

    def play(a: Run, b: Run) -> tuple[Run, Run]:
        if b.key is None:
            return a, b
        if a.key is None:
            return b, a
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        m = common(a.key, b.key, a.lcp)
        if a.key[m:m + 1] <= b.key[m:m + 1]:
            b.lcp = m
            return a, b
        a.lcp = m
        return b, a

    def build(node: int) -> Run:
        if node >= n:
            return runs[node - n]
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not n:
        return
    leaf = {id(run): n + i for i, run in enumerate(runs)}
    winner = build(1) if n > 1 else runs[0]
    while winner.key is not None:
        yield winner.lcp, winner.key, winner.what()
        node = leaf[id(winner)] // 2
        winner.advance()
        while node >= 1 and n > 1:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def window_hashes(key: bytes, right: int, length: int, low: int, high: int) -> np.ndarray:
    """Hashes of the strings that start ``low`` to ``high`` bytes before the anchor."""
    text = key[right + 1:][::-1] + key[:right]
    sums = prefix(np.frombuffer(text, np.uint8))
    _, down = powers(len(text) + 1)
    at = len(key) - right - 1 - np.arange(low, high + 1)
    return mix((sums[at + length] - sums[at]) * down[at])


def _settled(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Starts that repeat (h null), and strings that are still to be counted, of one range."""
    out: list[tuple[np.ndarray, ...]] = []

    def spans(places: np.ndarray, low: int, high: int) -> None:
        """The strings that start low to high bytes before these anchors repeat."""
        k = len(places)
        out.append((places[:, 2], places[:, 3] - high, places[:, 3] - low, np.zeros(k, np.int64), np.zeros(k, np.int64),
                    np.zeros(k, np.int64)))

    def settle(gathered: list[tuple[int, bytes, list[np.ndarray]]]) -> None:
        group = [(shared, key, np.concatenate(parts)) for shared, key, parts in gathered]
        copies = [int(p[:, 6].sum()) for _, _, p in group]
        whole = sum(copies) == group[0][2][0, 1]
        keys = [key for _, key, _ in group]
        rights = [key.index(END) for key in keys]
        lows = [length - r for r in rights]  # distance from the anchor to the last string's start
        highs = [len(key) - r - 1 for key, r in zip(keys, rights, strict=True)]
        lefts = [key[r + 1:] for key, r in zip(keys, rights, strict=True)]
        for i, (_, _, places) in enumerate(group):
            if copies[i] > 1:
                spans(places[places[:, 6] == 1], lows[i], highs[i])  # the runs settled the others
        if len(group) == 1 and whole:
            return
        reach = [0] * len(group)

        def pair(i: int, j: int, shared: int) -> None:
            right = min(shared, rights[i], rights[j])
            reach[i], reach[j] = max(reach[i], right), max(reach[j], right)
            left = common(lefts[i], lefts[j])
            for k in (i, j):
                low, high = max(length - right, lows[k]), min(left, highs[k])
                if low <= high and copies[k] == 1:
                    spans(group[k][2], low, high)

        few = whole and len(group) <= FEW
        for i in range(len(group)):
            shared = len(keys[i])
            for j in range(i + 1, len(group) if few else min(i + 2, len(group))):
                shared = min(shared, group[j][0])
                pair(i, j, shared)
        if few:
            return
        for i, (_, key, places) in enumerate(group):
            low = max(lows[i], length - reach[i]) if whole else lows[i]
            if low > highs[i]:
                continue
            hashes = window_hashes(key, rights[i], length, low, highs[i]).view(np.int64)
            k = len(hashes)
            start = places[0, 3] - np.arange(low, highs[i] + 1)
            out.append((np.full(k, places[0, 2]), start, start, np.full(k, places[0, 0]), hashes,
                        np.full(k, min(copies[i], 2))))

    for data in rows.places[rows.range < 0]:
        ready = np.frombuffer(data, "<i8").reshape(-1, 3)
        none = np.zeros(len(ready), np.int64)
        out.append((ready[:, 0], ready[:, 1], ready[:, 2], none, none, none))
    group: list[tuple[int, bytes, list[np.ndarray]]] = []
    for shared, key, places in merged([Run(row) for row in rows[rows.range >= 0].itertuples()]):
        if group and (shared >= GRAM or key[:GRAM] == group[0][1][:GRAM]):
            if shared == len(key) == len(group[-1][1]):  # the same context from another run
                group[-1][2].append(places)
                continue
        elif group:
            settle(group)
            group = []
        group.append((shared, key, [places]))
    if group:
        settle(group)
    columns = ["row", "low", "high", "h", "mark", "n"]
    if not out:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in columns})
    return pd.DataFrame({c: np.concatenate(x).astype(np.int64) for c, x in zip(columns, zip(*out, strict=True), strict=True)})


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, spans and the bytes that are left."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        names, sizes, spans, kept = [], [], [], []
        for k in range(batch.num_rows):
            data = unpack.decompress(batch.column(2)[k].as_py())
            found = batch.column(3)[k].values
            own: list[dict[str, int]] = []
            if found is not None and len(found):
                low, high = (np.asarray(found.field(i)) for i in (0, 1))
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, low, 1)
                np.add.at(change, high + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                own = [{"begin": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                data = np.frombuffer(data, np.uint8)[~gone].tobytes()
            names.append(batch.column(0)[k].as_py())
            sizes.append(batch.column(1)[k].as_py())
            spans.append(own)
            kept.append(data)
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, spans (removed, [begin, end)) and kept (binary) of every document."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    texts = stage(
        docs.select("doc_id", "text").mapInArrow(_packed, "doc_id bigint, n_bytes bigint, data binary")
        .withColumn("row", F.monotonically_increasing_id()), "texts")
    found = stage(
        texts.select("row", "n_bytes", "data").mapInArrow(
            lambda b: _anchored(b, length), "row bigint, place bigint, first bigint, last bigint, h bigint"), "anchors")
    twice = stage(found.groupBy("h").agg(F.count("*").alias("g")).where("g > 1"), "grams")
    open_rows = stage(found.join(twice, "h").groupBy("row").agg(
        F.collect_list(F.struct("h", "g", "place", "first", "last")).alias("found")), "found")
    total = open_rows.agg(F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("n"), F.count("*").alias("docs")).first()

    # bounds of the ranges, from the contexts of a bounded sample of documents
    some = open_rows.orderBy(F.xxhash64("row")).limit(SAMPLE_DOCS)
    sample = sorted(
        bytes(r.key) for r in some.join(texts, "row").select("row", "data", "found").mapInArrow(
            lambda batches: (
                pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in list(_contexts(b, length))[:4096]], pa.binary())})
                for b in batches), "key binary").collect())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total.n * 600 // RANGE_BYTES + 1)
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    runs = open_rows.join(texts, "row").select("row", "data", "found").mapInArrow(
        lambda b: _runs(b, length, bounds),
        "range int, shared binary, sizes binary, tails binary, many binary, places binary")
    settled = stage(
        runs.groupBy("range").applyInPandas(
            lambda rows: _settled(rows, length), "row bigint, low bigint, high bigint, h bigint, mark bigint, n bigint"),
        "settled")
    repeats = stage(
        settled.where("n > 0").groupBy("h", "mark").agg(F.sum("n").alias("all")).where("all > 1").select("h", "mark"), "strings")
    proven = settled.where("n = 0").select("row", "low", "high").union(
        settled.where("n = 1").join(repeats, ["h", "mark"]).select("row", "low", "high"))
    spans = proven.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    return texts.join(spans, "row", "left").select("doc_id", "n_bytes", "data", "found").mapInArrow(
        lambda b: _cut(b, length), "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")
