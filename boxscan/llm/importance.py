"""Quality classifier by importance resampling of hashed n-grams.

Words and pairs of words are hashed into ``BUCKETS`` features.  Two generative
models are counted: the raw one over all documents, the target one over
documents labelled good (at most ``TARGET_ROWS`` of them, chosen by a hash of
the id: the only sampled part).  The weight of a document is the log ratio of
its likelihoods; a Gumbel variable hashed from its id is added, and the k
largest sums are kept, which samples k documents without replacement in
proportion to their weights.  The k-th sum is found exactly by four rounds of
counting 16 bits, so nothing but counts reaches the driver.

Defined results: a document without words (or null) has no weight and is not
kept; rows with the same id and text are kept alike, so ties at the k-th place
may exceed k; other columns are ignored; without labelled rows the target model
is the raw one and all weights are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxscan.llm.hashing import mix, slices, word_hashes
from boxscan.session import stage

BUCKETS = 1 << 14
#: Labelled rows that the target model is counted from, at most.
TARGET_ROWS = 20_000


@dataclass(frozen=True)
class Resampling:
    """``keep``: share of the documents to keep, or None for the share of good labels."""

    keep: float | None = None
    target_rows: int = TARGET_ROWS
    smoothing: float = 1.0
    seed: int = 7


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts and the text that each belongs to."""
    words, ends = word_hashes(column, lower=True)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])[doc[:-1] == doc[1:]] if len(words) else words
    owner = doc[:-1][doc[:-1] == doc[1:]] if len(words) else doc
    cut = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([words, pairs]) >> cut).astype(np.int64), np.concatenate([doc, owner])


def _counted(batches: Iterator[pa.RecordBatch], good) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            bucket, owner = features(part.column(1))
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            ids = np.asarray(part.column(0).fill_null(-1))
            target = np.isin(ids, good.value) & np.asarray(part.column(0).is_valid())
            counts[1] += np.bincount(bucket[target[owner]], minlength=BUCKETS)
    kind, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({
        "kind": pa.array(kind, pa.int64()), "bucket": pa.array(bucket, pa.int64()),
        "n": pa.array(counts[kind, bucket], pa.int64()),
    })


def _weighed(batches: Iterator[pa.RecordBatch], ratio, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            bucket, owner = features(part.column(1))
            n = np.bincount(owner, minlength=part.num_rows)
            weight = np.bincount(owner, ratio.value[bucket], part.num_rows)
            ids = np.asarray(part.column(0).fill_null(0)).astype(np.int64).view(np.uint64)
            bits = mix(mix(ids + np.uint64(seed)) + np.uint64(seed)) >> np.uint64(11)
            gumbel = -np.log(-np.log((bits.astype(np.float64) + 0.5) / 2.0**53))
            none = n == 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0), "n_grams": pa.array(n, pa.int64()),
                "log_weight": pa.array(weight, mask=none), "score": pa.array(weight + gumbel, mask=none),
            })


#: Steps per unit that scores are counted in; scores beyond 2 ** 43 are counted as that.
STEPS = 1 << 20


def kth_largest(scores: DataFrame, k: int) -> int | None:
    """The k-th largest ``step`` (a long of 64 bits without sign), by counting 16 bits a round."""
    at, left = 0, k
    for level in range(4):
        shift = 48 - 16 * level
        rest = scores if level == 0 else scores.where(F.shiftright("step", shift + 16) == at)
        rows = (
            rest.groupBy(F.shiftright("step", shift).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("digit"))
            .count().orderBy(F.desc("digit")).collect()  # 65,536 rows at most
        )
        for row in rows:
            if row["count"] >= left:
                at = at << 16 | row.digit
                break
            left -= row["count"]
        else:
            return None
    return at


def resample(docs: DataFrame, labels: DataFrame, how: Resampling | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, score and kept for every document; labels: (doc_id, quality)."""
    how = how or Resampling()
    spark = docs.sparkSession
    good = labels.where("quality = 1 AND doc_id IS NOT NULL")
    share = labels.agg(F.avg("quality").alias("share")).first().share
    ids = [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.target_rows).select("doc_id").collect()]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = spark.sparkContext.broadcast(np.array(ids, np.int64))
    rows = (
        texts.mapInArrow(lambda b: _counted(b, chosen), "kind bigint, bucket bigint, n bigint")
        .groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()  # two rows per bucket at most
    )
    counts = np.zeros((2, BUCKETS))
    for r in rows:
        counts[r.kind, r.bucket] = r.n
    if not counts[1].any():
        counts[1] = counts[0]
    counts += how.smoothing
    logs = np.log(counts / counts.sum(1, keepdims=True))
    ratio = spark.sparkContext.broadcast(logs[1] - logs[0])
    scores = stage(
        texts.mapInArrow(
            lambda b: _weighed(b, ratio, how.seed), "doc_id bigint, n_grams bigint, log_weight double, score double"
        ),
        "scores",
    )
    step = F.round(F.least(F.greatest(F.col("score"), F.lit(-2.0**42)), F.lit(2.0**42)) * STEPS).cast("long") + (1 << 62)
    scores = scores.withColumn("step", step)
    total = scores.count()
    keep = how.keep if how.keep is not None else (share if share is not None else 1.0)
    last = kth_largest(scores.where("score IS NOT NULL"), max(1, round(keep * total)))
    kept = F.col("score").isNotNull() if last is None else F.coalesce(F.col("step") >= last, F.lit(False))
    return scores.select("doc_id", "n_grams", "log_weight", "score", kept.alias("kept"))
