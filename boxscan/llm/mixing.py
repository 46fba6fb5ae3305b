"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its share of the target rows over its
own rows.  Each document draws its number of copies by inverting the Poisson
distribution at a number hashed from its id and a seed, so a rerun or a lost
executor gives the same mixture; the copies are exploded and dealt out over all
tasks by a second hash, and sorted by it.  Rates are one small row per source;
nothing depends on how many rows a source has.  Only DataFrame functions are
used.

Defined results: a null source is a source of its own; a source without weight
gets ``default_weight``; a weight of 0 drops the source; a null doc_id draws by
its text; rows with the same id draw alike; columns of the input pass through
(``copy_no``, ``n_copies`` and ``mix_key`` are reserved names and replace
columns so called); an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan.session import stage

#: A Poisson variable with a larger mean is drawn as a sum of equal parts up to this mean.
PART = 16.0
#: Terms of the distribution function; what lies beyond is under 2**-60 for a mean of 16.
TERMS = 80


@dataclass(frozen=True)
class Mixture:
    """Weights by source, the rows wanted as a multiple of the rows given, and the seed."""

    weights: dict[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    size: float = 1.0
    seed: str = "mix"


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable with a mean up to PART."""
    first = F.exp(-rate)
    zero = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def term(acc: Column, k: Column) -> Column:
        p = acc.p * rate / k
        return F.struct(p.alias("p"), (acc.c + p).alias("c"), F.concat(acc.all, F.array(acc.c + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, term, lambda acc: acc.all)


def rates(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """One row per source: rate, parts, and the distribution function of a part."""
    rows = stage(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    weight = F.coalesce(
        *[F.when(F.col("source") == s, F.lit(float(w))) for s, w in mixture.weights.items()],
        F.lit(float(mixture.default_weight)),
    )
    rows = rows.withColumn("weight", weight)
    total = rows.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    if not total.n or not total.w:
        rate = F.lit(0.0)
    else:
        rate = F.col("weight") / F.lit(total.w) * F.lit(float(total.n)) * F.lit(mixture.size) / F.col("n")
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    return (
        rows.select(F.col("source").alias("r_source"), rate.alias("rate"))
        .withColumn("parts", parts)
        .withColumn("upto", distribution(F.col("rate") / F.col("parts")))
    )


def replicate(docs: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """The documents' columns plus copy_no (from 1), n_copies and mix_key, in mixed order."""
    mixture = mixture or Mixture()
    names = [c for c in docs.columns if c not in ("copy_no", "n_copies", "mix_key")]
    table = stage(rates(docs, mixture), "rates").select(
        F.col("r_source").alias("__source"), F.col("parts").alias("__parts"), F.col("upto").alias("__upto")
    )
    key = F.coalesce(
        F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.col("text").cast("binary"))), F.lit("-")
    )
    seed = F.lit(mixture.seed)

    def drawn(part: Column) -> Column:
        u = unit(seed, key, part.cast("string"))
        return F.size(F.filter("__upto", lambda c: c <= u))

    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda a, part: a + drawn(part)
    )
    return (
        docs.select(*names).join(table, F.col("source").eqNullSafe(F.col("__source")))
        .select(*names, key.alias("__key"), copies.cast("long").alias("n_copies"))
        .where("n_copies > 0")
        .select(
            *names, "__key", "n_copies",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy_no"),
        )
        .select(
            *names, "copy_no", "n_copies",
            F.md5(F.concat_ws("|", seed, F.lit("deal"), "__key", "copy_no").cast("binary")).alias("mix_key"),
        )
        .repartition("mix_key").sortWithinPartitions("mix_key")
    )
