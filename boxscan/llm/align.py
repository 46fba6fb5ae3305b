"""Alignment of two tokenizers' tokens: merge-path pieces over the byte offsets where tokens end.

Documents are taken in blocks of one partition.  Texts whose only white space is
single blanks and line feeds are cut at them, as no token of either tokenizer
crosses such a cut; each distinct unit of a block is encoded once by both.  Any
other text is one unit, whatever its length.

The ends of all A tokens and of all B tokens of a block's units are two sorted
arrays.  Diagonals of their merge grid at equal distances are searched by
bisection, all at once; between two diagonals lies a piece: the same number of
steps each, independent of every other piece but for one token of halo.  A piece
emits its overlaps (one per distinct end) and the ends that both have.  Groups
that cross a boundary are stitched: a group reaches from the last common end of
an earlier piece to the first one of a later piece.

Counts of id pairs go over the corpus: a block sends each of its distinct pairs
once, with its number; sums, and the highest per B id, are plain aggregates; the
block's pairs get them back by a join and a cogroup by block.  A pair has at most
one row per block, so no pair is hot, and a block's rows are bounded by its text.

Defined results: a null or empty text, and one whose joined A or B bytes differ
from blank + text, has no tokens (zeros, groups ''); repeated rows are aligned
alike and each counts; a null doc_id stays null; other columns are not read, so
names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxscan.llm.bpe import SPACE
from boxscan.session import stage

#: Characters of text in a block.
BLOCK_CHARS = 2 << 20
#: Steps of a piece.
PIECE = 1 << 16
#: Texts in which a token may not begin at each blank or line feed.
_OTHER = SPACE.replace("\\t-\\r ", "\\t\\x0b-\\r")
ODD = re.compile(f"[{SPACE}](?:[{SPACE}]|\\Z)|\\A[{SPACE}]|[{_OTHER}]")
#: Characters on whose classes all versions of Unicode agree.
PLAIN = re.compile("[\\n -~\\u00a1-\\u024f]*")


class Bytewise:
    """Tokenizer A: a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts["pre_tokenizer"] or {}
        #: Words begin at a blank only if the built-in pattern alone cuts the text.
        self.cuts = (
            parts["normalizer"] is None and before.get("type") == "ByteLevel"
            and bool(before.get("use_regex")) and not before.get("add_prefix_space")
        )
        letters = self._letters()
        names = self.tokenizer.get_vocab()
        self.pieces = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            known = all(c in letters for c in name)
            self.pieces[i] = bytes(letters[c] for c in name) if known else name.encode()
        self.widths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.fast = self._as_ranks(parts) if self.cuts else None

    @staticmethod
    def _letters() -> dict[str, int]:
        """The byte that each letter of a byte-level vocabulary stands for."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def _as_ranks(self, parts: dict):
        """The same merges in tiktoken, which is faster, if ids are ranks."""
        import public_tokenizers
        import tiktoken

        special = {x["id"] for x in parts["added_tokens"]}
        ranks = {piece: i for i, piece in enumerate(self.pieces) if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
        vocabulary = parts["model"]["vocab"]
        made = [vocabulary.get(a + b) for a, b in merges]
        if made != sorted(set(made)) or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: a sentencepiece model; it puts a blank before the text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [
            bytes([int(name[1:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self.widths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        crossing = any("\n" in name or "▁" in name.lstrip("▁") for name in names)
        #: No token crosses a blank or a line feed, and white space is kept.
        self.cuts = not crossing and self._text(" a\n b") == b"  a\n b" and len(self.model.encode("a\nb")) == 3

    def _text(self, text: str) -> bytes:
        return b"".join(self.pieces[i] for i in self.model.encode(text))

    def encode(self, text: str) -> list[int]:
        """Ids of blank + x, or of units one after another, which may begin with a line feed."""
        if text[:1] == " ":
            return self.model.encode(text[1:])
        return self.model.encode("a" + text)[1:]


@dataclass(frozen=True)
class Pair:
    """Paths of the two tokenizers; each task loads them once."""

    a: str
    b: str

    def load(self) -> tuple[Bytewise, Pieces]:
        return _loaded(self.a, self.b)


@lru_cache(2)
def _loaded(a: str, b: str) -> tuple[Bytewise, Pieces]:
    return Bytewise(a), Pieces(b)


def diagonals(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) where the merge of two sorted arrays crosses each ``size``-th diagonal, both ends included.

    Of equal values the one of ``a`` comes first.
    """
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, size), total)
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # the middle value of a is among the first ones if it does not exceed its partner in b
        first = np.zeros(len(at), bool)
        first[open_] = a[middle[open_]] <= b[at[open_] - middle[open_] - 1]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, at - low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, common): the overlapping tokens of one piece in order, and which of them end together.

    ``a`` and ``b`` are ends; the piece takes a[i0:i1] and b[j0:j1].  It looks at
    one token behind and one ahead of them, and nowhere else.
    """
    own_a, own_b = a[i0:i1], b[j0:j1]
    # the B token that covers the end of each A token, and the other way round
    over_a = j0 + np.searchsorted(own_b, own_a, "left")
    over_b = i0 + np.searchsorted(own_a, own_b, "left")
    common = b[np.minimum(over_a, len(b) - 1)] == own_a
    ahead = a[np.minimum(over_b, len(a) - 1)] == own_b
    if i0 and len(own_b) and a[i0 - 1] == own_b[0]:
        ahead[0] = True  # its partner ended the piece before
    rest = ~ahead
    links_a = np.concatenate([np.arange(i0, i1), over_b[rest]])
    links_b = np.concatenate([over_a, np.arange(j0, j1)[rest]])
    order = np.argsort(np.concatenate([own_a, own_b[rest]]), kind="stable")
    both = np.concatenate([common, np.zeros(int(rest.sum()), bool)])
    return links_a[order], links_b[order], both[order]


def merge_ends(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links_a, links_b, common) over whole arrays: the pieces between diagonals, joined in order.

    ``common`` marks the last link of a group, so a group that spans pieces is
    stitched by the marks before and behind it.
    """
    if not len(a) or not len(b):
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, bool)
    i, j = diagonals(a, b, size)
    found = [overlaps(a, b, i[k], i[k + 1], j[k], j[k + 1]) for k in range(len(i) - 1)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _decimals(size: int) -> np.ndarray:
    """Row 3 * id + k: the id in decimal digits and then ',', '|' or ';', padded with zeros; ``size`` ids at least."""
    return _rows_of_digits(1 << size.bit_length())


@lru_cache(2)
def _rows_of_digits(size: int) -> np.ndarray:
    rows = [f"{i}{mark}".encode() for i in range(size) for mark in ",|;"]
    width = max(map(len, rows))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)


def group_texts(
    a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray
) -> tuple[bytes, np.ndarray]:
    """All groups as text ``a1,a2|b1;...`` and the place behind each group.

    ``a_ends`` and ``b_ends``: how many A and B tokens lie before the end of each group.
    """
    a_of, b_of = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    ids[np.arange(len(a_ids)) + np.repeat(b_ends - b_of, a_of)] = a_ids * 3
    ids[np.arange(len(b_ids)) + np.repeat(a_ends, b_of)] = b_ids * 3
    ids[a_ends + b_ends - b_of - 1] += 1
    ids[a_ends + b_ends - 1] += 2
    out, upto = [], [np.zeros(1, np.int64)]
    table = _decimals(int(ids.max(initial=0)) // 3 + 1)
    for at in range(0, len(ids), 1 << 20):
        cells = table[ids[at:at + (1 << 20)]]
        used = cells != 0
        out.append(cells[used].tobytes())
        upto.append(upto[-1][-1] + np.cumsum(used.sum(axis=1)))
    places = np.concatenate(upto)
    return b"".join(out), places[a_ends + b_ends]


#: A row is a block, so row groups of a few rows; they bound what a reader holds.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
#: Bits of a B id in the number of a pair.
B_BITS = 24


def encode_units(
    coder: Bytewise | Pieces, units: list[str], alone: set[int], sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all units, how many each has, whether its bytes are its tokens' bytes).

    Units that begin where tokens begin are encoded in one text of many; the
    places of its tokens tell them apart.  If these do not fit, one by one.
    """
    numbers, flat = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = 1 if len(alone) * 4 > len(units) else 1000
    for at in range(0, len(units), step):
        part = units[at:at + step]
        if len(part) > 1 and alone.isdisjoint(range(at, at + len(part))):
            ids = np.array(coder.encode("".join(part)), np.int64)
            ends, wanted = np.cumsum(coder.widths[ids]), np.cumsum(sizes[at:at + len(part)])
            upto = np.searchsorted(ends, wanted) + 1
            if len(ends) and ends[-1] == wanted[-1] and (ends[upto - 1] == wanted).all():
                numbers.append(np.diff(upto, prepend=0))
                flat.append(ids)
                continue
        rows = [coder.encode(unit) for unit in part]
        numbers.append(np.fromiter(map(len, rows), np.int64, len(rows)))
        flat.append(np.fromiter(chain.from_iterable(rows), np.int64, numbers[-1].sum()))
    n, ids = np.concatenate(numbers), np.concatenate(flat)
    return ids, n, _same_bytes(coder, units, ids, n, sizes)


def _same_bytes(coder: Bytewise | Pieces, units: list[str], ids: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(coder.widths[ids])])
    upto = np.cumsum(n)
    begin, end = ends[upto - n], ends[upto]
    joined = b"".join(map(coder.pieces.__getitem__, ids.tolist()))
    if joined == "".join(units).encode():
        return end - begin == sizes
    return np.fromiter((joined[s:e] == u.encode() for s, e, u in zip(begin, end, units, strict=True)), bool, len(units))


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers as compressed planes of bytes; the first byte tells how many planes."""
    top = int(values.max(initial=0))
    width = next(w for w in range(1, 9) if top < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    cells = np.zeros((planes.shape[1], 8), np.uint8)
    cells[:, :width] = planes.T
    return cells.view("<i8").ravel().astype(np.int64)


class _Block:
    """The documents gathered so far and their distinct units."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.rows: list[np.ndarray] = []
        self.number: dict[str, int] = {}
        self.alone: set[int] = set()
        self.chars = 0

    def add(self, doc_id: int | None, parts: list[str], whole: bool = False) -> None:
        number = self.number
        if whole and parts[0] not in number:
            self.alone.add(len(number))
        for part in parts:
            if part not in number:
                number[part] = len(number)
        self.ids.append(doc_id)
        self.rows.append(np.fromiter(map(number.__getitem__, parts), np.uint32, len(parts)))

    def record(self, block: int, pair: Pair) -> pa.RecordBatch:
        a, b = pair.load()
        units = list(self.number)
        sizes = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        (a_ids, n_a, good_a), (b_ids, n_b, good_b) = (encode_units(x, units, self.alone, sizes) for x in (a, b))
        good = good_a & good_b
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        links_a, links_b, common = merge_ends(np.cumsum(a.widths[a_ids]), np.cumsum(b.widths[b_ids]))
        # per unit: its links and groups; units without tokens have none
        link_ends = np.searchsorted(links_a, np.cumsum(n_a), "left")
        n_links = np.diff(link_ends, prepend=0)
        n_groups = np.diff(np.concatenate([[0], np.cumsum(common)])[link_ends], prepend=0)
        pairs, links = np.unique(a_ids[links_a] << B_BITS | b_ids[links_b], return_inverse=True)
        # documents with a unit that does not decode have no tokens
        rows = self.rows if good.all() else [r if good[r].all() else r[:0] for r in self.rows]
        seen = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        per_link = np.repeat(np.bincount(seen, minlength=len(units)), n_links)
        counts = np.bincount(links, per_link, len(pairs)).astype(np.int64)
        last_a = np.append(links_a[1:] != links_a[:-1], True)[:len(links_a)]
        last_b = np.append(links_b[1:] != links_b[:-1], True)[:len(links_b)]
        one = {
            "block": block, "ids": np.array([i or 0 for i in self.ids], "<i8").tobytes(),
            "nulls": bytes(i is None for i in self.ids), "seen": packed(seen),
            "n_units": packed(np.fromiter(map(len, rows), np.int64, len(rows))),
            "n_a": packed(n_a), "n_b": packed(n_b), "n_groups": packed(n_groups), "n_links": packed(n_links),
            "links": packed(links), "lasts": packed(last_a + 2 * last_b), "pairs": pairs, "counts": counts,
        }
        return pa.RecordBatch.from_pylist([one], _BLOCK_TYPE)


_BYTES = ("ids", "nulls", "seen", "n_units", "n_a", "n_b", "n_groups", "n_links", "links", "lasts")
_BLOCK_TYPE = pa.schema([
    ("block", pa.int64()), *((name, pa.binary()) for name in _BYTES),
    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
BLOCK = ", ".join(["block long", *(f"{name} binary" for name in _BYTES), "pairs array<long>, counts array<long>"])


def _blocks(pair: Pair, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = pair.load()
        cuts = a.cuts and b.cuts
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if not text:
                    block.add(ids[k].as_py(), [])
                elif not cuts or ODD.search(text):
                    block.add(ids[k].as_py(), [" " + text], whole=True)
                else:
                    words = text.replace("\n", " \n").split(" ")
                    block.add(ids[k].as_py(), [w if w[:1] == "\n" else " " + w for w in words])
                block.chars += len(text or "") + 1
                if block.chars >= limit:
                    yield block.record(number, pair)
                    number, block = number + 1, _Block()
                    pa.default_memory_pool().release_unused()
        if block.ids:
            yield block.record(number, pair)

    return run


def align_blocks(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of documents: distinct units, their groups and links, and the pairs of the block."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_blocks(pair, chars), BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id << B_BITS | B id) and n, its links over the corpus."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")).where("n > 0")


def with_best(counts: DataFrame) -> DataFrame:
    """``best``: whether a pair's count is the highest of its B id; as many rows as B has ids decide."""
    id_b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1).cast("long"))
    highest = counts.groupBy(id_b.alias("id_b")).agg(F.max("n").alias("most"))
    return (
        counts.withColumn("id_b", id_b).join(F.broadcast(highest), "id_b")
        .select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    )


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), ends])[:-1]


def _scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block, from its record and the counts of its pairs."""
    if left.empty:
        return pd.DataFrame()
    one = left.iloc[0]
    n, best = (np.zeros(len(one["pairs"]), np.int64) for _ in range(2))
    slot = right["slot"].to_numpy()
    n[slot], best[slot] = right["n"].to_numpy(), right["best"].to_numpy()
    sizes = [unpacked(one[name]) for name in ("n_a", "n_b", "n_groups", "n_links")]
    links, n_links = unpacked(one["links"]), sizes[3]
    link_ends = np.cumsum(n_links)

    def per_unit(of_pair: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_pair[links] if len(of_pair) else np.zeros_like(links))])
        return total[link_ends] - total[link_ends - n_links]

    measures = [*sizes, per_unit(best), per_unit(n)]
    seen = unpacked(one["seen"])
    doc_ends = np.cumsum(unpacked(one["n_units"]))
    doc_starts = _starts(doc_ends)
    # the tokens in order: a link is the last one of an A token, a B token, or both, which ends a group
    lasts, pairs = unpacked(one["lasts"]), np.asarray(one["pairs"], np.int64)
    last_a, last_b = (lasts & 1).astype(bool), (lasts & 2).astype(bool)
    texts, group_ends = group_texts(
        pairs[links[last_a]] >> B_BITS, pairs[links[last_b]] & ((1 << B_BITS) - 1),
        np.cumsum(last_a)[last_a & last_b], np.cumsum(last_b)[last_a & last_b],
    )
    text_ends = np.concatenate([[0], group_ends])[np.cumsum(sizes[2])]
    unit_texts = [texts[s:e] for s, e in zip(_starts(text_ends), text_ends, strict=True)]
    ids, nulls = np.frombuffer(one["ids"], "<i8"), np.frombuffer(one["nulls"], np.uint8)
    out = {"doc_id": pd.arrays.IntegerArray(ids.copy(), nulls.astype(bool))}
    for name, of_unit in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), measures, strict=True):
        total = np.concatenate([[0], np.cumsum(of_unit[seen])])
        out[name] = total[doc_ends] - total[doc_starts]
    out["groups"] = [
        b"".join(map(unit_texts.__getitem__, seen[s:e]))[:-1].decode()
        for s, e in zip(doc_starts, doc_ends, strict=True)
    ]
    return pd.DataFrame(out)


def align(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;...``) of each document."""
    blocks = stage(align_blocks(docs, pair, doc_id, text, chars), "align-blocks", SMALL_GROUPS)
    counts = stage(pair_counts(blocks), "align-pairs")
    own = blocks.select(F.col("block").alias("owner"), F.posexplode("pairs").alias("slot", "pair"))
    known = own.join(with_best(counts), "pair").select("owner", "slot", "n", "best")
    return blocks.select("block", *_BYTES, "pairs").groupBy("block").cogroup(
        known.groupBy("owner")
    ).applyInPandas(
        _scored,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string",
    )
