"""Column functions over nucleotide strings.

What visits every nucleotide of a row runs on whole Arrow batches (``spread``,
``box_distances``): a higher-order function costs microseconds an element.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from boxscan import constants as K


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column expression that is used inside a lambda is otherwise evaluated
    again for every element, which makes linear work quadratic.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def revcomp(seq: Column) -> Column:
    """Reverse complement, with ambiguity codes."""
    return F.reverse(F.translate(F.upper(seq), K.COMPLEMENT_FROM, K.COMPLEMENT_TO))


def on_strand(seq: Column, strand: Column) -> Column:
    return F.when(strand == "-", revcomp(seq)).otherwise(seq)


def cut(seq: Column, start: Column, end: Column) -> Column:
    """``seq[start:end)``, 0-based, clamped to the string."""
    lo = F.greatest(start, F.lit(0)).cast("int")
    return F.substr(seq, lo + 1, F.greatest(end.cast("int") - lo, F.lit(0)))


def kmers(seq: Column, k: int = K.KMER) -> Column:
    """Overlapping k-mers as an array; empty when the sequence is shorter than k.

    One pass of a look-ahead: substrings by place would count from the start each time.
    """
    every = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.coalesce(every, F.array().cast("array<string>"))


def kmer_tokens(seq: Column, k: int = K.KMER) -> Column:
    return F.array_join(kmers(seq, k), " ")


def _matches(base: Column, code: str) -> Column:
    return base.isin("A", "G") if code == "R" else base == code


def hamming_at(seq: Column, pos: Column, consensus: str) -> Column:
    """Mismatches between ``consensus`` and ``seq`` read from 1-based ``pos``."""
    terms = [
        F.when(_matches(F.substr(seq, pos + k, F.lit(1)), code), 0).otherwise(1)
        for k, code in enumerate(consensus)
    ]
    return reduce(lambda a, b: a + b, terms)


def hamming(motif: Column, consensus: str) -> Column:
    return hamming_at(motif, F.lit(1), consensus)


#: Rows of an Arrow batch that are worked on at once: index arrays take many times their bytes.
ROWS = 1024


def in_pieces(run: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``run`` over pieces of ``ROWS`` rows of a batch."""
    starts = range(0, max(len(columns[0]), 1), ROWS)
    return pa.concat_arrays([run(*[c.slice(i, ROWS) for c in columns]) for i in starts])


def numbered(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[i] - 1 for every i, in one array."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def flat_list(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, 0 where null; where they are null; number of elements per row) of an array column."""
    inside = values.flatten()
    size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return (
        pc.fill_null(inside, 0.0).to_numpy(zero_copy_only=False),
        inside.is_null().to_numpy(zero_copy_only=False), size,
    )


def list_array(size: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """``size[i]`` of ``values`` in row i; null rows must have none."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=None if null is None else pa.array(null))


def spread(values: pa.Array, length: pa.Array, k: int) -> pa.Array:
    """``kmer_to_nt`` of a batch.

    Rows lie in one buffer, each between k - 1 zeros; k shifted copies are added in
    the order of the k-mers, so the sums are those of a loop over them.
    """
    data, hole, size = flat_list(values)
    n = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.where(n >= k, n, 0)
    found = np.where(n > 0, n - k + 1, 0)
    block = np.where(n > 0, n + k - 1, 0)
    begin = np.cumsum(block) - block
    taken = np.minimum(size, found)
    rank = numbered(taken)
    source = np.repeat(np.cumsum(size) - size, taken) + rank
    target = np.repeat(begin + k - 1, taken) + rank
    places = numbered(n)
    at = np.repeat(begin, n) + places
    count = np.minimum(places, np.repeat(found, n) - 1) - np.maximum(places - k + 1, 0) + 1

    def sums(cells: np.ndarray) -> np.ndarray:
        laid = np.zeros(block.sum(), cells.dtype)
        laid[target] = cells[source]
        total = np.zeros(max(len(laid) - k + 1, 0), cells.dtype)
        for shift in range(k):
            total += laid[shift:shift + len(total)]
        return total[at]

    null = np.repeat(values.is_null().to_numpy(zero_copy_only=False), n)
    if hole.any():
        null |= sums(hole.astype(np.int64)) > 0
    return list_array(n, pa.array(sums(data) / count, mask=null))


def box_distances(seqs: pa.Array, box: str, sign: int) -> pa.Array:
    """Mismatches to ``box`` at every position of each sequence of a batch, with ``sign`` times its 1-based start."""
    texts = pc.fill_null(seqs, "")
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("ascii", "replace"), dtype=np.uint8)
    total = np.zeros(max(len(codes) - len(box) + 1, 0), np.int32)
    for k, code in enumerate(box):
        base = codes[k:k + len(total)]
        total += (base != ord("A")) & (base != ord("G")) if code == "R" else base != ord(code)
    n = np.maximum(size - len(box) + 1, 0)
    rank = numbered(n)
    dist = total[np.repeat(np.cumsum(size) - size, n) + rank]
    return list_array(n, pa.StructArray.from_arrays(
        [pa.array(dist), pa.array(((rank + 1) * sign).astype(np.int32))], ["dist", "start"]))


def kmer_to_nt(scores: Column, length: Column, k: int = K.KMER) -> Column:
    """Mean score of the k-mers that cover each nucleotide.

    ``scores`` holds one value per k-mer (``length - k + 1`` of them), so a
    nucleotide near an end is covered by fewer than k.
    """

    @F.arrow_udf("array<double>")
    def run(values: pa.Array, lengths: pa.Array) -> pa.Array:
        return in_pieces(lambda v, n: spread(v, n, k), values, lengths)

    # "nondeterministic" keeps the optimizer from running it again for every use
    return run.asNondeterministic()(scores.cast("array<double>"), length)
