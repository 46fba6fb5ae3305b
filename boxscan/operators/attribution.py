"""How much each nucleotide of a candidate adds to its score, by occlusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.sequences import kmer_to_nt
from boxscan.operators.scoring import MotifScorer, Scorer, encode, score_windows

MASK = ord("N")
#: Windows whose masked scores are held at once.
ROWS = 512


def occlusion(scorer: Scorer, seq: Column, k: int = K.KMER) -> Column:
    """Drop in P(class 1) when a k-mer is masked, for every k-mer of the window.

    A model that knows the scores of its masked copies (``masked_logits``) gives
    them at once; for any other the whole windows and all their masked copies
    make one stream of rows per Arrow batch, seen in full batches.
    """
    def positive(logits: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(logits[..., 0] - logits[..., 1]))

    def by_copies(codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        copies = np.maximum(lengths - k + 1, 0) + 1  # the first one is not masked
        ends = np.cumsum(copies)
        owner = np.repeat(np.arange(len(codes)), copies)
        place = np.arange(len(owner)) - (ends - copies)[owner] - 1
        p = np.empty(len(owner))
        for at in range(0, len(owner), scorer.batch_size):
            own, where = owner[at:at + scorer.batch_size], place[at:at + scorer.batch_size]
            rows = codes[own]
            masked = np.flatnonzero(where >= 0)
            rows[masked[:, None], where[masked, None] + np.arange(k)] = MASK
            p[at:at + len(own)] = positive(scorer.logits(rows))
        whole = p[ends - copies]
        return [whole[i] - p[ends[i] - copies[i] + 1:ends[i]] for i in range(len(codes))]

    def drops(codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        if scorer.masked_logits(codes[:1], k) is None:
            return by_copies(codes, lengths)
        out = []
        for at in range(0, len(codes), ROWS):
            rows, size = codes[at:at + ROWS], np.maximum(lengths[at:at + ROWS] - k + 1, 0)
            whole, masked = positive(scorer.logits(rows)), positive(scorer.masked_logits(rows, k))
            out += [a - b[:n] for a, b, n in zip(whole, masked, size, strict=True)]
        return out

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for seqs in batches:
            yield pd.Series(drops(encode(seqs, scorer.width), seqs.str.len().to_numpy()), dtype=object)

    return run.asNondeterministic()(seq)


def attribute(candidates: DataFrame, scorer: Scorer | None = None, k: int = K.KMER) -> DataFrame:
    """Adds ``predicted_label``, ``probability`` and ``signal`` (one value per nt).

    The value of a nucleotide is the mean drop of the k-mers that cover it.
    """
    scorer = scorer or MotifScorer()
    length = F.length("window_seq")
    scored = score_windows(candidates, scorer)
    return (
        scored.withColumn("_drops", occlusion(scorer, F.col("window_seq"), k))
        .withColumn("signal", kmer_to_nt(F.col("_drops"), length, k))
        .withColumn("predicted_label",
                    F.when(F.col("label") == 1, K.POSITIVE_LABEL).otherwise(K.NEGATIVE_LABEL))
        .withColumnRenamed("p_top", "probability")
        .select(*candidates.columns, "predicted_label", "probability", "signal")
    )


def positives_only(attributed: DataFrame) -> DataFrame:
    return attributed.filter(F.col("predicted_label") != K.NEGATIVE_LABEL)
