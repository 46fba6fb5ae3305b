"""Fuzzy box search and pairing, inside a candidate row.

A window is 194 nt, so every search below is over short arrays of the row
itself: no explode, no join and no shuffle.  The distances at every position come
from whole Arrow batches.  Box positions are 1-based and
inclusive within the window.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K
from boxscan.functions.sequences import box_distances, hamming, in_pieces
from boxscan.functions.signals import framed, peaks, savgol

LEN_C, LEN_D = len(K.C_BOX), len(K.D_BOX)
BOX = "struct<dist:int,start:int>"


def box_ranges(width=K.WINDOW, min_box_dist=K.MIN_BOX_DIST, flank=K.FLANK):
    """Inclusive 1-based ranges in which a C and a D box may peak."""
    half = (width + 2) // 2
    return (flank + 1, half - min_box_dist - 1), (half + min_box_dist, width - flank)


def c_distances(seq: Column) -> Column:
    """``array<struct<dist, start>>`` at every position: smallest is leftmost at lowest distance."""
    return _distances(seq, K.C_BOX, 1)


def d_distances(seq: Column) -> Column:
    """As above with the start negated: smallest is rightmost at lowest distance."""
    return _distances(seq, K.D_BOX, -1)


def with_distances(df: DataFrame) -> DataFrame:
    """Adds both distance arrays of ``window_seq``, used by every search below."""
    seq = F.col("window_seq")
    return df.withColumns({"_cd": c_distances(seq), "_dd": d_distances(seq)})


def _distances(seq: Column, box: str, sign: int) -> Column:
    @F.arrow_udf(f"array<{BOX}>")
    def run(seqs: pa.Array) -> pa.Array:
        return in_pieces(lambda s: box_distances(s, box, sign), seqs)

    # "nondeterministic" keeps the optimizer from running it again for every use
    return run.asNondeterministic()(seq)


def _best(distances: Column, lo: Column, hi: Column, size: int, most: int, sign: int) -> Column:
    """Best box inside the 0-based region [lo, hi); null when none is close enough."""
    lo = F.greatest(lo, F.lit(0))
    n = F.greatest(hi - lo - (size - 1), F.lit(0))
    found = F.array_min(F.slice(distances, (lo + 1).cast("int"), n.cast("int")))
    box = F.struct(found["dist"].alias("dist"), (found["start"] * sign).alias("start"))
    return F.when(found["dist"] <= most, box)


def leftmost_c(c_dist: Column, lo: Column, hi: Column) -> Column:
    return _best(c_dist, lo, hi, LEN_C, K.C_MAX_SUBS, 1)


def rightmost_d(d_dist: Column, lo: Column, hi: Column) -> Column:
    return _best(d_dist, lo, hi, LEN_D, K.D_MAX_SUBS, -1)


def exact_d(d_dist: Column, lo: Column, hi: Column) -> Column:
    return _best(d_dist, lo, hi, LEN_D, 0, -1)


def mirror(pos: Column, width: int = K.WINDOW) -> Column:
    """Position opposite to ``pos`` with regard to the window middle."""
    return F.lit(width) - pos - 1


def pair_at_peaks(df: DataFrame, c_range=None, d_range=None, width: int = K.WINDOW) -> DataFrame:
    """Adds ``c`` and ``d`` (struct or null) from the array ``peaks`` of each row.

    Each peak offers its box and the best box around the mirrored position.
    Lowest summed distance wins, then the higher peak.  Peaks near the border
    of a range count only where the first pass leaves a box missing.
    """
    (c_lo, c_hi), (d_lo, d_hi) = box_ranges(width)
    c_lo, c_hi = c_range or (c_lo, c_hi)
    d_lo, d_hi = d_range or (d_lo, d_hi)
    cd, dd = F.col("_cd"), F.col("_dd")

    def offer(p):
        pos = p["pos"].cast("int")
        in_c, in_d = pos.between(c_lo, c_hi), pos.between(d_lo, d_hi)
        strict = pos.between(c_lo + LEN_C, c_hi - LEN_C) | pos.between(d_lo + LEN_D, d_hi - LEN_D)
        away = mirror(pos, width)
        c = F.when(in_c, leftmost_c(cd, pos - LEN_C, pos + LEN_C)).otherwise(
            leftmost_c(cd, away - LEN_C, away + LEN_C + 1)
        )
        d = F.when(in_c, rightmost_d(dd, away - LEN_C, away + LEN_C + 1)).otherwise(
            rightmost_d(dd, pos - LEN_D, pos + LEN_D)
        )
        total = F.coalesce(c["dist"], F.lit(LEN_C)) + F.coalesce(d["dist"], F.lit(LEN_D))
        return F.struct(
            total.alias("total"), F.when(strict, 0).otherwise(1).alias("lenient"),
            (-p["height"]).alias("rank"), pos.alias("pos"), c.alias("c"), d.alias("d"),
            (in_c | in_d).alias("ok"),
        )

    offers = F.filter(
        F.transform("peaks", offer), lambda o: o["ok"] & (o["total"] < LEN_C + LEN_D)
    )
    first, any_pass = F.col("_first"), F.col("_any")
    done = first["c"].isNotNull() & first["d"].isNotNull()
    best = F.when(done, first).otherwise(any_pass)
    return (
        with_distances(df)
        .withColumn("_offers", offers)
        .withColumns({
            "_first": F.array_min(F.filter("_offers", lambda o: o["lenient"] == 0)),
            "_any": F.array_min("_offers"),
        })
        .withColumn("_best", best)
        .withColumns({"c": F.col("_best.c"), "d": F.col("_best.d")})
        .drop("_offers", "_first", "_any", "_best")
    )


def rescue_exact_d(df: DataFrame, width: int = K.WINDOW, flank: int = K.FLANK, span: int = 25) -> DataFrame:
    """An inexact D gives way to an exact one up to 25 nt after it."""
    start = F.col("d.start")
    stop = F.least(F.lit(width - flank), start + LEN_D - 1 + span)
    exact = F.when(F.col("d.dist") > 0, exact_d(F.col("_dd"), start, stop))
    return df.withColumn("d", F.coalesce(exact, F.col("d")))


def fill_limits(df: DataFrame, width: int = K.WINDOW, flank: int = K.FLANK) -> DataFrame:
    """Adds ``c_limit`` and ``d_limit``: found, mirrored from the other box, or the default."""
    c_start, d_end = F.col("c.start"), F.col("d.start") + LEN_D - 1
    return df.withColumns({
        "c_limit": F.coalesce(c_start, mirror(d_end, width), F.lit(flank)).cast("int"),
        "d_limit": F.coalesce(d_end, mirror(c_start, width), F.lit(width - flank)).cast("int"),
    })


def pair_primes(df: DataFrame) -> DataFrame:
    """Adds ``c_prime`` and ``d_prime``: the closest pair with D' before C'.

    For a given pair of distances the leftmost D' leaves most room, so the
    best pair is found from one D' and one C' per distance; all pairs are
    never listed.  Without any valid pair the best D' stands alone; without
    any D' the best C' does.
    """
    middle = F.floor(F.length("window_seq") / 2).cast("int")

    def inside(distances, lo, hi, size, most, sign):
        lo = F.greatest(lo, F.lit(0))
        n = F.greatest(hi - lo - (size - 1), F.lit(0))
        hits = F.slice(distances, (lo + 1).cast("int"), n.cast("int"))
        return F.transform(
            F.filter(hits, lambda x: x["dist"] <= most),
            lambda x: F.struct(x["dist"].alias("dist"), (x["start"] * sign).alias("start")),
        )

    spots = df.withColumns({
        "_cs": inside(F.col("_cd"), middle, F.col("d_limit") - LEN_D - 10, LEN_C, K.C_MAX_SUBS, 1),
        "_ds": inside(F.col("_dd"), F.col("c_limit") + LEN_C + 10, middle, LEN_D, K.D_MAX_SUBS, -1),
    })

    def first_d(dist):
        return F.array_min(F.filter("_ds", lambda x: x["dist"] == dist))

    def first_c(dist, d):
        return F.array_min(
            F.filter("_cs", lambda x: (x["dist"] == dist) & (x["start"] >= d["start"] + LEN_D + 1))
        )

    spots = spots.withColumns({f"_d{dist}": first_d(dist) for dist in range(K.D_MAX_SUBS + 1)})
    order = sorted(
        ((x + y, x, y) for x in range(K.D_MAX_SUBS + 1) for y in range(K.C_MAX_SUBS + 1))
    )
    pairs = []
    for _, x, y in order:
        d = F.col(f"_d{x}")
        c = first_c(y, d)
        pairs.append(F.when(d.isNotNull() & c.isNotNull(), F.struct(d.alias("d"), c.alias("c"))))
    nothing = F.lit(None).cast(BOX)
    alone = F.struct(
        F.array_min("_ds").alias("d"),
        F.when(F.size("_ds") == 0, F.array_min("_cs")).otherwise(nothing).alias("c"),
    )
    return (
        spots.withColumn("_pair", F.coalesce(*pairs, alone))
        .withColumns({"c_prime": F.col("_pair.c"), "d_prime": F.col("_pair.d")})
        .drop("_cs", "_ds", "_pair", *[f"_d{x}" for x in range(K.D_MAX_SUBS + 1)])
    )


def box_score(df: DataFrame) -> DataFrame:
    """Adds the distances of the four boxes (their length where missing) and the sum."""
    parts = {"score_c": ("c", LEN_C), "score_d": ("d", LEN_D),
             "score_c_prime": ("c_prime", LEN_C), "score_d_prime": ("d_prime", LEN_D)}
    df = df.withColumns({
        name: F.coalesce(F.col(f"{box}.dist"), F.lit(size)) for name, (box, size) in parts.items()
    })
    return df.withColumn("box_score", reduce(lambda a, b: a + b, [F.col(n) for n in parts]))


def with_motifs(df: DataFrame) -> DataFrame:
    """Box structs as ``struct<motif, start, end, dist>``, null where not found."""
    printed = {}
    for box, size in (("c", LEN_C), ("d", LEN_D), ("c_prime", LEN_C), ("d_prime", LEN_D)):
        at = F.col(f"{box}.start")
        full = F.struct(
            F.substr("window_seq", at, F.lit(size)).alias("motif"), at.alias("start"),
            (at + size - 1).alias("end"), F.col(f"{box}.dist").alias("dist"),
        )
        printed[box] = F.when(at.isNotNull(), full)
    return df.withColumns(printed)


def find_boxes(attributed: DataFrame, width: int = K.WINDOW, min_box_dist: int = K.MIN_BOX_DIST,
               flank: int = K.FLANK) -> DataFrame:
    """All four boxes of each candidate with a ``signal``; one narrow pass."""
    c_range, d_range = box_ranges(width, min_box_dist, flank)
    ready = attributed.withColumn("_smooth", savgol(framed(F.col("signal")))).withColumn(
        "peaks", F.coalesce(peaks(F.col("_smooth")), F.array().cast("array<struct<pos:int,height:double>>"))
    )
    paired = pair_at_peaks(ready, c_range, d_range, width)
    limited = fill_limits(rescue_exact_d(paired, width, flank), width, flank)
    return with_motifs(box_score(pair_primes(limited))).drop("_smooth", "_cd", "_dd", "peaks")


def motif_distance(motif: Column, consensus: str) -> Column:
    """Distance of a printed motif; the missing ones (all N) get their length."""
    return hamming(motif, consensus)
