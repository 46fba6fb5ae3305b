"""Batch scoring with a pluggable model.

A scorer turns windows into two logits (class 0, class 1).  It is pickled to
the executors and may build its network lazily, once per Python worker.  The
scorers shipped here are deterministic motif rules, not trained networks;
their predictions are no substitute for a trained model's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.operators.windows import STRANDS

_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in zip(K.COMPLEMENT_FROM, K.COMPLEMENT_TO):
    _COMPLEMENT[ord(_a)] = ord(_b)


def encode(seqs, width: int) -> np.ndarray:
    """Strings -> (n, width) byte matrix, padded with N on the right; longer ones are refused."""
    seqs = list(seqs)
    longest = max(map(len, seqs), default=0)
    if longest > width:
        raise ValueError(f"a sequence of {longest} nt does not fit a model of {width} nt")
    joined = "".join(s.ljust(width, "N") for s in seqs)
    return np.frombuffer(joined.encode("ascii"), dtype=np.uint8).reshape(-1, width)


def _differs(codes: np.ndarray, code: str) -> np.ndarray:
    """Where a base is none of those that a letter of a consensus stands for."""
    if code == "R":
        return (codes != ord("A")) & (codes != ord("G"))
    if code == "Y":
        return (codes != ord("C")) & (codes != ord("T"))
    return codes != ord(code)


def _mismatches(codes: np.ndarray, consensus: str) -> np.ndarray:
    """Hamming distance to ``consensus`` at every offset of the last axis."""
    n = codes.shape[-1] - len(consensus) + 1
    total = np.zeros(codes.shape[:-1] + (max(n, 0),), dtype=np.uint8)
    for k, code in enumerate(consensus):
        total += _differs(codes[..., k:k + max(n, 0)], code)
    return total


def _differences(rows: np.ndarray, consensus: str) -> np.ndarray:
    """(rows, base of the consensus, offset): 1 where that base of the box at that offset differs."""
    n = rows.shape[1] - len(consensus) + 1
    return np.stack([_differs(rows[:, k:k + n], code) for k, code in enumerate(consensus)], axis=1).astype(np.uint8)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over ``values[i:i+width]`` by doubling; log2(width) passes."""
    out, done = values, 1
    while done < width:
        hop = min(done, width - done)
        out = np.minimum(out[:-hop], out[hop:])
        done += hop
    return out


class Scorer:
    """``logits(windows)`` is enough; ``scan`` may be overridden when tiles allow a shortcut."""

    width = K.WINDOW
    batch_size = 128
    version = ""    # tells two states of one model apart in a resumable run

    def logits(self, windows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def masked_logits(self, windows: np.ndarray, k: int) -> np.ndarray | None:
        """Logits (n, width - k + 1, 2) of each window with each run of ``k`` bases masked.

        None where the model has no shorter way than scoring every masked copy.
        """
        return None

    def scan(self, codes: np.ndarray, starts: np.ndarray, strand: str) -> np.ndarray:
        """Logits of the windows at ``starts`` of a long byte array."""
        if not len(starts):
            return np.empty((0, 2))
        view = np.lib.stride_tricks.sliding_window_view(codes, self.width)
        out = []
        for i in range(0, len(starts), self.batch_size):
            part = view[starts[i:i + self.batch_size]]
            out.append(self.logits(_COMPLEMENT[part[:, ::-1]] if strand == "-" else part))
        return np.concatenate(out) if out else np.empty((0, 2))


class CallableScorer(Scorer):
    """Wraps ``scorer(list of sequences) -> (n, 2) logits``, for a network of one's own."""

    def __init__(self, call: Callable, width: int = K.WINDOW, batch_size: int = 128):
        self.call, self.width, self.batch_size = call, width, batch_size

    def logits(self, windows):
        seqs = [row.tobytes().decode("ascii") for row in windows]
        return np.asarray(self.call(seqs), dtype=float)


class MotifScorer(Scorer):
    """Best C box at offsets 20..75 and best D box at 112..170 of the window.

    Another width makes both ranges longer or shorter by half the difference; they
    keep their distance to the ends of the window.
    """

    def __init__(self, width: int = K.WINDOW):
        more = width - K.WINDOW
        self.width = width
        self.C_AT, self.C_N = 20, 56 + more // 2
        self.D_N = 59 + more // 2
        self.D_AT = 171 + more - self.D_N
        if self.C_N < 1:
            raise ValueError(f"a window of {width} nt has no room for the boxes")

    def distances(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c_span = windows[:, self.C_AT:self.C_AT + self.C_N + len(K.C_BOX) - 1]
        d_span = windows[:, self.D_AT:self.D_AT + self.D_N + len(K.D_BOX) - 1]
        return _mismatches(c_span, K.C_BOX).min(axis=1), _mismatches(d_span, K.D_BOX).min(axis=1)

    def masked_logits(self, windows, k):
        c, d = self._masked(windows, K.C_BOX, self.C_AT, self.C_N, k), self._masked(windows, K.D_BOX, self.D_AT, self.D_N, k)
        return self._stack(c.ravel(), d.ravel()).reshape(*c.shape, 2)

    @staticmethod
    def _masked(windows: np.ndarray, box: str, at: int, n: int, k: int) -> np.ndarray:
        """Least distance to ``box`` at the offsets ``at`` to ``at + n - 1``, for every run of ``k`` masked bases.

        Boxes that end before the mask, or start behind it, keep their distance:
        their least ones are a prefix and a suffix minimum.  Only the boxes that
        touch the mask, fewer than ``k`` plus their length, are counted again, and
        they too from sums of mismatches: a masked base never matches.
        """
        size, places = len(box), windows.shape[1] - k + 1
        span = windows[:, at:at + n + size - 1]
        differs = _differences(span, box)  # (rows, base of the box, offset)
        whole = differs.sum(axis=1, dtype=np.uint8)
        top = np.full((len(windows), 1), size, np.uint8)
        before = np.concatenate([top, np.minimum.accumulate(whole, axis=1)], axis=1)
        behind = np.concatenate([np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1], top], axis=1)
        # boxes at offset o cover o .. o + size - 1; the mask at m covers m .. m + k - 1
        mask = np.arange(places) - at
        out = np.minimum(before[:, np.clip(mask - size + 1, 0, n)], behind[:, np.clip(mask + k, 0, n)])
        matches = 1 - differs
        for shift in range(-size + 1, k):  # the box that begins so far behind the start of the mask
            offset = mask + shift
            hit = np.flatnonzero((offset >= 0) & (offset < n))
            first, last = max(0, -shift), min(size, k - shift)  # its bases under the mask
            hidden = matches[:, first:last].sum(axis=1, dtype=np.uint8)
            touched = whole + hidden
            out[:, hit] = np.minimum(out[:, hit], touched[:, offset[hit]])
        return out

    @staticmethod
    def _stack(hc: np.ndarray, hd: np.ndarray) -> np.ndarray:
        positive = 3.0 * (7 - hc.astype(float)) + 2.0 * (4 - hd.astype(float)) - 21.0
        return np.column_stack([np.zeros_like(positive), positive])

    def logits(self, windows):
        return self._stack(*self.distances(windows))

    def scan(self, codes, starts, strand):
        # A box at offset o of a minus window lies, complemented, at plus
        # offset width - o - len(box): no sequence needs to be reversed.
        if not len(starts):
            return np.empty((0, 2))
        if strand == "-":
            c_at, d_at = self.width - self.C_AT - self.C_N - 6, self.width - self.D_AT - self.D_N - 3
            c_box, d_box = "TCATCAY", "TCAG"
        else:
            c_at, d_at, c_box, d_box = self.C_AT, self.D_AT, K.C_BOX, K.D_BOX
        hc = _sliding_min(_mismatches(codes, c_box), self.C_N)[starts + c_at]
        hd = _sliding_min(_mismatches(codes, d_box), self.D_N)[starts + d_at]
        return self._stack(hc, hd)


class StemScorer(MotifScorer):
    """Second model: box distances and pairing of the two outer flanks."""

    PAIRS = ("AT", "TA", "GC", "CG", "GT", "TG")

    def logits(self, windows):
        hc, hd = self.distances(windows)
        left, right = windows[:, :K.FLANK], windows[:, -K.FLANK:][:, ::-1]
        paired = np.zeros(len(windows))
        for a, b in self.PAIRS:
            paired += ((left == ord(a)) & (right == ord(b))).sum(axis=1)
        positive = 4.0 - 2.0 * (hc.astype(float) + hd.astype(float)) + (paired - 8.0)
        return np.column_stack([np.zeros_like(positive), positive])

    def masked_logits(self, windows, k):
        return None

    def scan(self, codes, starts, strand):
        return Scorer.scan(self, codes, starts, strand)


def p_class1(l0: Column, l1: Column) -> Column:
    """Softmax over two classes, probability of class 1."""
    return 1 / (1 + F.exp(l0 - l1))


def p_top(p_pos: Column) -> Column:
    """Probability of the winning class."""
    return F.greatest(p_pos, 1 - p_pos)


def shown(p: Column) -> Column:
    """A probability as tables show it; thresholds compare the unrounded one."""
    return F.round(p, 6)


def label(l0: Column, l1: Column) -> Column:
    return F.when(l1 > l0, 1).otherwise(0)


def _tile_starts(pdf: pd.DataFrame, width: int, step: int, strand: str):
    """Owned starts of every tile of a batch: (tile index, start) arrays."""
    lo = pdf["tile_start"].to_numpy()
    last = pdf["length"].to_numpy() - width
    stop = np.minimum(pdf["tile_end"].to_numpy(), last + 1)
    phase = last % step if strand == "-" else np.zeros_like(last)
    first = lo + (phase - lo) % step
    n = np.maximum((stop - first + step - 1) // step, 0)
    tile = np.repeat(np.arange(len(pdf)), n)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[tile] + step * rank
    flush = np.zeros_like(last) if strand == "-" else last
    extra = np.flatnonzero((last % step != 0) & (flush >= lo) & (flush < stop))
    return np.concatenate([tile, extra]), np.concatenate([start, flush[extra]])


#: Bases scored at once, if a tile is not longer.
SLICE_BASES = 1 << 18
#: Probabilities this close to a threshold are left to Spark's own comparison.
MARGIN = 1e-6


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pd.DataFrame]]:
    """(contigs, the rest) of runs of tiles of about ``SLICE_BASES``: the scores of all windows of a whole
    Arrow batch take many times its bytes."""
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // SLICE_BASES
        cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
        for first, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            some = batch.slice(first, stop - first)
            yield some.column("contig"), some.drop_columns(["contig"]).to_pandas()


_HITS = "contig string, strand string, start long, `end` long, l0 double, l1 double"


def _scan_batches(scorer: Scorer, step: int, strands: list[str], keep_all: bool, threshold: float | None):
    width = scorer.width
    # Spark decides on the threshold itself; what is clearly below it does not leave the task
    least = -np.inf
    if threshold is not None and threshold > MARGIN:
        p = min(threshold, 1.0) - MARGIN
        least = np.log(p) - np.log1p(-p)

    def rows(contigs, tile, strand, start, end, logits):
        keep = np.ones(len(start), bool) if keep_all else logits[:, 1] > logits[:, 0]
        keep &= ~(logits[:, 1] - logits[:, 0] < least)
        keep = np.flatnonzero(keep)
        return pa.RecordBatch.from_arrays([
            contigs.take(pa.array(tile[keep])), pa.array([strand]).take(pa.array(np.zeros(len(keep), np.int64))),
            pa.array(start[keep].astype(np.int64)), pa.array(end[keep].astype(np.int64)),
            pa.array(logits[keep, 0].astype(float)), pa.array(logits[keep, 1].astype(float)),
        ], names=["contig", "strand", "start", "end", "l0", "l1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contigs, pdf in _slices(batches):
            is_short = ((pdf["length"] <= width) & (pdf["tile_start"] == 0)).to_numpy()
            is_long = (pdf["length"] > width).to_numpy()
            short, tiles = pdf[is_short], pdf[is_long].reset_index(drop=True)
            if len(tiles):
                codes = np.frombuffer("".join(tiles["seq"]).encode("ascii"), dtype=np.uint8)
                size = tiles["seq"].str.len().to_numpy()
                wanted = np.minimum(tiles["tile_end"] + width - 1, tiles["length"]) - tiles["tile_start"]
                if (size < wanted.to_numpy()).any():
                    raise ValueError(f"tiles need a halo of {width - 1} nt for windows of {width} nt")
                at = np.cumsum(size) - size - tiles["tile_start"].to_numpy()
                named = contigs.filter(pa.array(is_long))
                for strand in strands:
                    tile, start = _tile_starts(tiles, width, step, strand)
                    logits = scorer.scan(codes, start + at[tile], strand)
                    yield rows(named, tile, strand, start, start + width, logits)
            for strand in strands if len(short) else []:
                codes = encode(short["seq"], width)
                if strand == "-":
                    # complement from the real 3' end, pad on the right again
                    codes = encode(
                        [_COMPLEMENT[np.frombuffer(s.encode(), np.uint8)[::-1]].tobytes().decode()
                         for s in short["seq"]], width)
                end = short["length"].to_numpy()
                yield rows(
                    contigs.filter(pa.array(is_short)), np.arange(len(short)), strand, np.zeros_like(end), end,
                    scorer.logits(codes))

    return run


def scan(
    tiles: DataFrame,
    scorer: Scorer | None = None,
    step: int = K.STEP,
    strand: str = "both",
    keep_all: bool = False,
    threshold: float | None = None,
) -> DataFrame:
    """``(contig, strand, start, end, prob)`` of the positive windows of tiles.

    Negatives are dropped inside the task, before anything is shuffled;
    ``keep_all`` keeps them, with their label.  A ``threshold`` is compared with
    the unrounded probability.
    """
    scorer = scorer or MotifScorer()
    hits = tiles.select("contig", "length", "tile_start", "tile_end", "seq").mapInArrow(
        _scan_batches(scorer, step, STRANDS[strand], keep_all, threshold), _HITS
    )
    l0, l1 = F.col("l0"), F.col("l1")
    if threshold is not None:
        hits = hits.filter(p_class1(l0, l1) > threshold)
    out = hits.select("contig", "strand", "start", "end", shown(p_class1(l0, l1)).alias("prob"),
                      label(l0, l1).alias("label"))
    return out if keep_all else out.drop("label")


def above(df: DataFrame, threshold: float, column: str = "prob") -> DataFrame:
    """Strict probability filter."""
    return df.filter(F.col(column) > threshold)


def scan_threshold(sizes: DataFrame, threshold: float | None = None, width: int = K.WINDOW) -> float:
    """The default threshold is relaxed when no contig is longer than a window."""
    if threshold is not None and threshold != K.PROB_FIRST:
        return threshold
    longer = sizes.filter(F.col("length") > width).limit(1).count()
    return K.PROB_FIRST if longer else K.PROB_FIRST_RELAXED


def bed_threshold(threshold: float | None = None) -> float:
    """BED input relaxes the default threshold."""
    return K.PROB_FIRST_RELAXED if threshold in (None, K.PROB_FIRST) else threshold


def score_windows(
    df: DataFrame, scorer: Scorer | None = None, seq: str = "window_seq", above: float | None = None
) -> DataFrame:
    """Adds ``p_pos``, ``p_top`` and ``label`` to a table of windows; no shuffle.

    A window without a sequence is not scored and gets label 0.  With ``above``
    also ``passes``: positive, and the unrounded probability over that threshold.
    """
    scorer = scorer or MotifScorer()

    @F.pandas_udf("l0 double, l1 double")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for seqs in batches:
            out = np.full((len(seqs), 2), np.nan)
            asked = np.flatnonzero(seqs.notna().to_numpy())
            codes = encode(seqs.iloc[asked], scorer.width)
            for i in range(0, len(asked), scorer.batch_size):
                out[asked[i:i + scorer.batch_size]] = scorer.logits(codes[i:i + scorer.batch_size])
            yield pd.DataFrame(out, columns=["l0", "l1"])

    # "nondeterministic" keeps the optimizer from running the model once more
    # for a filter on its result
    scored = df.withColumn("_l", logits.asNondeterministic()(F.col(seq)))
    l0, l1 = F.col("_l.l0"), F.col("_l.l1")
    p = p_class1(l0, l1)
    scored = scored.withColumn("p_pos", shown(p)).withColumn("p_top", shown(p_top(p))).withColumn("label", label(l0, l1))
    if above is not None:
        scored = scored.withColumn("passes", (l1 > l0) & (p_top(p) > above))
    return scored.drop("_l")


def refine(candidates: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Second model over candidate windows: expressed gene (1) or pseudogene (0)."""
    return score_windows(candidates, scorer or StemScorer()).select(
        "contig", "start", "end", "gene_id", "block_id",
        F.col("p_top").alias("probability_expressed_pseudogene"),
        F.col("label").alias("second_model_prediction"),
    )
