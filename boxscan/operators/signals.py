"""The same smoothing and peaks for signals kept as rows.

A signal may hold a third of all rows, so it is numbered and smoothed in
chunks: one count per chunk gives the row numbers, and each chunk sees the
ten rows before and after it.  ``number_ranged`` finds the ranges in which a
key is numbered from quantile sketches.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.signals import DIGITS, HALF, savgol_weights, weighted
from boxscan.session import broadcast_if_small

CHUNK = 1 << 14
#: Parts that one level of ``range_buckets`` makes of a range.
FAN = 256
_HALO = K.SAVGOL_WIDTH - 1


def _cut_points(df: DataFrame, groups: list[str], by: str, rows: int) -> DataFrame | None:
    """``groups`` of more than ``rows`` rows with ``_cuts``, the values of ``by`` that split them.

    The cuts come from a quantile sketch, which tasks build apart and merge.
    None where no group is too large.
    """
    large = df.groupBy(*groups).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    most = large.agg(F.max("_n").alias("n")).first().n
    if most is None:
        return None
    fan = int(min(FAN, 2 + most // rows))
    shares = [i / fan for i in range(1, fan)]
    same = [F.col(g).eqNullSafe(F.col(f"_large_{i}")) for i, g in enumerate(groups)]
    large = broadcast_if_small(large.select(*[F.col(g).alias(f"_large_{i}") for i, g in enumerate(groups)]))
    return df.join(large, reduce(and_, same), "left_semi").groupBy(*groups).agg(
        F.array_distinct(F.percentile_approx(by, shares, 100 * fan)).alias("_cuts"))


def range_buckets(df: DataFrame, key: str, order: list[str], rows: int = CHUNK) -> tuple[DataFrame, list[str]]:
    """Adds columns that cut every key into ranges of ``order`` of about ``rows`` rows.

    Returns the table and the names of those columns; compared as a row they rise
    with ``order``.  A key of at most ``rows`` rows is one range.  Each level cuts
    what is still too large into at most ``FAN`` parts; where a level cannot cut
    (one value holds the range), the next column of ``order`` is taken.  Rows that
    agree in all of ``order`` stay together: nothing could tell their ranks apart.
    The levels run jobs, so ``df`` should be a written table.
    """
    levels: list[str] = []
    for by in order:
        while True:
            cuts = _cut_points(df, [key, *levels], by, rows)
            if cuts is None:
                return df, levels
            # a level that splits nothing has no cut below the greatest value of any range
            name = f"_range{len(levels)}"
            names = [f"_cut_{i}" for i in range(len(levels) + 1)]
            right = cuts.select(*[F.col(g).alias(n) for g, n in zip([key, *levels], names)], "_cuts")
            same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip([key, *levels], names)]
            cut = (
                df.join(broadcast_if_small(right), reduce(and_, same), "left")
                .withColumn(name, F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(by)))))
                .drop(*names, "_cuts")
            )
            if not cut.filter(F.col(name) > 0).limit(1).count():
                break
            df = cut
            levels.append(name)
    return df, levels


def number_ranged(df: DataFrame, key: str, order: list[str], rows: int = CHUNK) -> DataFrame:
    """``number_within`` over ranges found in the data: no key, however large, is one task.

    Rows without a key are left out; null places come first.
    """
    cut, levels = range_buckets(df.filter(F.col(key).isNotNull()), key, order, rows)
    bucket = F.struct(*levels) if levels else F.lit(0)
    return number_within(cut, key, bucket, order).drop(*levels)


def number_within(df: DataFrame, key: str, bucket: Column, order: list[str]) -> DataFrame:
    """Adds ``pos`` (0-based rank in the key) and ``n`` (rows of the key).

    ``bucket`` must rise with ``order``; ranks are counted per (key, bucket)
    and shifted by the counts of the earlier buckets.
    """
    spread = df.withColumn("_bucket", bucket).repartition(key, "_bucket")
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    across = Window.partitionBy(key)
    counts = (
        spread.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
        .select(
            key, "_bucket",
            F.coalesce(
                F.sum("_n").over(across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_offset"),
            F.sum("_n").over(across).alias("n"),
        )
    )
    return (
        spread.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(counts, [key, "_bucket"])
        .withColumn("pos", (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )


def chunked(df: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Rows copied to the chunks within ``halo`` of them; ``_mine`` marks the owner."""
    own = F.floor(F.col("pos") / chunk)
    first = F.floor(F.greatest(F.col("pos") - halo, F.lit(0)) / chunk)
    last = F.floor(F.least(F.col("pos") + halo, F.col("n") - 1) / chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_mine", F.col("_chunk") == own
    )


def smooth_rows(
    df: DataFrame, key: str = "id", value: str = "value", chunk: int = CHUNK
) -> DataFrame:
    """Adds ``smoothed`` to ``(key, pos, n, value)``; null for fewer than 11 rows."""
    w = Window.partitionBy(key, "_chunk").orderBy("pos")

    def around(shift: int) -> list[Column]:
        return [
            F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)
            for k in range(shift - HALF, shift + HALF + 1)
        ]

    pos, n = F.col("pos"), F.col("n")
    middle = weighted(around(0), savgol_weights())
    smoothed = F.when(n < K.SAVGOL_WIDTH, F.lit(None).cast("double"))
    for at in range(-HALF, 0):
        smoothed = smoothed.when(pos == at + HALF, weighted(around(-at), savgol_weights(at)))
        smoothed = smoothed.when(n - 1 - pos == at + HALF, weighted(around(at), savgol_weights(-at)))
    return (
        chunked(df, chunk, _HALO)
        .withColumn("smoothed", smoothed.otherwise(middle))
        .filter("_mine")
        .drop("_chunk", "_mine")
    )


def peak_rows(
    df: DataFrame, key: str = "id", value: str = "smoothed", chunk: int = CHUNK,
    height: float = K.PEAK_HEIGHT, drop: float = K.PEAK_DROP,
) -> DataFrame:
    """Rows that stand above ``height`` and by ``drop`` above both neighbours."""
    w = Window.partitionBy(key, "_chunk").orderBy("pos")
    here = F.col(value)
    fall = F.least(here - F.lag(value).over(w), here - F.lead(value).over(w))
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)
    return (
        chunked(df, chunk, 1)
        .withColumn("_fall", F.when(inner, F.round(fall, DIGITS)))
        .filter(F.col("_mine") & (here >= height) & (F.col("_fall") >= drop))
        .drop("_chunk", "_mine", "_fall")
    )
