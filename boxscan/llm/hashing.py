"""Hashes of the words of a whole Arrow column at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes that are hashed in one go; a longer text is cut at white space.
CHUNK = 2 << 20


@lru_cache(1)
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        size = max(n, CHUNK + (1 << 16))
        have = _powers[0] = tuple(
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, m, np.uint64))])
            for m in (MULTIPLIER, inverse)
        )
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """S with S[i] the sum of the first i bytes' codes times their powers."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes_table()[data] * up[:len(data)], out=out[1:])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the n + 1 offsets; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count or column.offset:
        column = pa.array(column.fill_null(""), pa.string())
        column = pa.concat_arrays([column])
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts and where each text ends among them."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:-1]
    begins = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:] | edge[1:-1]
    ends = np.flatnonzero(last) + 1
    out = []
    at = 0
    while at < len(begins):
        base = begins[at]
        upto = int(np.searchsorted(ends, base + CHUNK, "right"))
        upto = max(upto, at + 1)
        part = prefix(data[base:ends[upto - 1]])
        b, e = begins[at:upto] - base, ends[at:upto] - base
        _, down = powers(len(part))
        out.append(mix((part[e] - part[b]) * down[b] + (e - b).astype(np.uint64)))
        at = upto
    hashes = np.concatenate(out) if out else np.empty(0, np.uint64)
    return hashes, np.searchsorted(begins, offsets[1:], "left")


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text."""
    column = batch.column(batch.schema.names.index(text))
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right"))
        stop = max(stop, at + 1)
        yield batch.slice(at, stop - at)
        at = stop
