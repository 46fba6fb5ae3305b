"""Smoothing and peak picking on array columns."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.sequences import bind, flat_list, in_pieces, list_array, numbered

HALF = K.SAVGOL_WIDTH // 2
DIGITS = 9   # rounding after the last operation makes equal heights equal
_WIDE = Context(prec=60)


def savgol_weights(at: int = 0) -> list[float]:
    """Weights of a parabola fitted to points -5..5 and read at point ``at``.

    From the discrete orthogonal polynomials 1, x, x^2 - 10, whose squared
    norms over the eleven points are 11, 110 and 858.
    """
    return [
        1 / 11 + at * x / 110 + (at * at - 10) * (x * x - 10) / 858
        for x in range(-HALF, HALF + 1)
    ]


def weighted(terms: list[Column], weights: list[float]) -> Column:
    return F.round(reduce(lambda a, b: a + b, [t * w for t, w in zip(terms, weights)]), DIGITS)


def framed(values: Column) -> Column:
    """A zero before and after the signal, so that array index i is nt i (1-based)."""
    edge = F.array(F.lit(0.0))
    return F.concat(edge, values, edge)


def smoothed_batch(values: pa.Array) -> pa.Array:
    """Weighted sums of ``savgol`` for a batch, not yet rounded; null where a row is null or has fewer points."""
    data, hole, size = flat_list(values)
    n = np.where(size >= K.SAVGOL_WIDTH, size, 0)
    whole = np.flatnonzero(n)
    begin = (np.cumsum(size) - size)[whole]
    n = n[whole]
    source = np.repeat(begin, n) + numbered(n)  # rows that are long enough, one after another
    data, hole = data[source], hole[source]
    first = np.cumsum(n) - n

    def smooth(cells: np.ndarray, weights, middle: np.ndarray) -> np.ndarray:
        """Sums in the order of the points, the ends by the weights of their own points."""
        out = np.zeros(len(cells))
        out[HALF:len(cells) - HALF] = middle
        span = np.arange(K.SAVGOL_WIDTH)
        for at in range(1, HALF + 1):
            for windows, place, point in (
                (first, first + HALF - at, -at), (first + n - K.SAVGOL_WIDTH, first + n - 1 - HALF + at, at),
            ):
                out[place] = _sums(cells[windows[:, None] + span].T, weights(point))
        return out

    def slid(cells: np.ndarray) -> list[np.ndarray]:
        return [cells[j:len(cells) - K.SAVGOL_WIDTH + 1 + j] for j in range(K.SAVGOL_WIDTH)]

    if not len(whole):
        return pa.nulls(len(values), pa.list_(pa.float64()))
    found = smooth(data, savgol_weights, _sums(slid(data), savgol_weights()))
    null = np.zeros(len(found), bool)
    if hole.any():
        ones, gaps = [1.0] * K.SAVGOL_WIDTH, hole.astype(float)
        null = smooth(gaps, lambda at: ones, _sums(slid(gaps), ones)) > 0
    return list_array(
        np.where(size >= K.SAVGOL_WIDTH, size, 0), pa.array(found, mask=null), size < K.SAVGOL_WIDTH)


def rounded(values: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Spark's ``round``: half up on the decimal digits of each number, which only decide near a half."""
    scale = 10.0 ** digits
    with np.errstate(invalid="ignore", over="ignore"):
        cells = values * scale
        out = np.rint(cells) / scale + 0.0
        plain = (np.abs(cells - np.floor(cells) - 0.5) > 1e-3) & (np.abs(cells) < 2.0 ** 40)
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(~plain):
        value = float(values[i])
        digital = math.isfinite(value) and abs(value) < 2.0 ** 53  # beyond, a number is whole
        out[i] = float(Decimal(repr(value)).quantize(unit, ROUND_HALF_UP, _WIDE)) + 0.0 if digital else value
    return out


def _rounded_batch(values: pa.Array) -> pa.Array:
    found = smoothed_batch(values)
    cells = found.flatten()
    null = cells.is_null().to_numpy(zero_copy_only=False)
    data = rounded(pc.fill_null(cells, 0.0).to_numpy(zero_copy_only=False))
    size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    return list_array(size, pa.array(data, mask=null), found.is_null().to_numpy(zero_copy_only=False))


def _sums(terms, weights: list[float]) -> np.ndarray:
    return reduce(lambda a, b: a + b, [t * w for t, w in zip(terms, weights)])


def savgol(values: Column) -> Column:
    """Smoothed array; the five points at either end come from the outermost fits."""

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        return in_pieces(_rounded_batch, batch)

    # "nondeterministic" keeps the optimizer from running it again for every use
    return run.asNondeterministic()(values.cast("array<double>"))


def peaks(smoothed: Column) -> Column:
    """``array<struct<pos, height>>`` of local maxima; pos is the 0-based array index."""

    def find(v):
        n = F.size(v)

        def is_peak(i):
            here = F.get(v, i)
            drop = F.least(here - F.get(v, i - 1), here - F.get(v, i + 1))
            return (here >= K.PEAK_HEIGHT) & (F.round(drop, DIGITS) >= K.PEAK_DROP)

        at = F.filter(F.sequence(F.lit(1), n - 2), is_peak)
        found = F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(v, i).alias("height")))
        return F.when(n >= 3, found)

    return bind(smoothed, find)
