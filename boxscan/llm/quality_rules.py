"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document is measured once, in its row (no explode, no shuffle of words).
The measures go into log-linear histograms per (lang, source): a value keeps its
seven leading bits, so a bucket's lower bound is within 1/64 of every value in
it.  Such sketches merge by adding counts, which is how the sketch of a language
and that of the whole corpus come from those of the sources; a hot source is one
set of counters per task.  The fence of a group is its third quartile plus three
interquartile ranges, or plus the distance from the median to a high quantile of
its values above zero, if that is more: where most values are zero, the quartiles
say nothing, and those documents that have any tell what is ordinary.  Both
distances come from the sketch; no fence or distance is a constant.  A measure
for which a group has few rows, or few values above zero, uses the sketch of the
language, or else of all rows.  A join by (lang, source) then filters.  Only
DataFrame functions are used.

Defined results: null or empty text has no words and fails the base rules; null
lang or source is a group of its own; repeated rows are measured and kept or
dropped alike; other columns pass through untouched (``measured`` is the one
reserved name); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxscan.llm.columns import let, words
from boxscan.session import stage

SYMBOLS = "#*$%&|<>"
#: Parts of one, for shares.
PPM = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Parameters: base rules, and how fences are drawn from a sketch.

    A group needs ``min_group`` rows, and ``min_positive`` values above zero of a
    measure, to have a fence of its own for it.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    fences: int = 3
    high_percent: int = 95
    min_group: int = 100
    min_positive: int = 20


#: measure: (value in integers, whether low values are outliers as well)
MEASURES = {
    "symbol_share": ("n_symbols * 1000000 div greatest(word_chars, 1)", False),
    "dup_line_share": ("n_dup_lines * 1000000 div greatest(n_lines, 1)", False),
    "repeat_share": ("n_repeat_words * 1000000 div greatest(n_words, 1)", False),
    "word_length": ("word_chars * 1000 div greatest(n_words, 1)", True),
}


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, each counted once.

    Windows are hashed to 64 bits.  A document without a repeated window (the
    usual case) is done after one pass through a hash set; else windows are
    sorted by (hash, place), equal neighbours give the repeated places, and
    places in order give the covered words.
    """
    n = F.size(w)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def places(s: Column) -> Column:
            twins = F.filter(
                s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h)
            )
            return F.array_sort(F.transform(twins, lambda x: x.at))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(let(placed, places), total)

    counted = let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 3, F.lit(0)).otherwise(counted)


def measured(text: Column) -> Column:
    """struct of the base measures of a text (all long)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return let(words(text), of)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure(docs: DataFrame, rules: Rules) -> DataFrame:
    """The documents' columns but the text, plus the base measures and ``base_failed``."""
    failed = F.expr(
        f"n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words"
    )
    return (
        docs.select(*[c for c in ("doc_id", "lang", "source")], measured(F.col("text")).alias("measured"))
        .select("doc_id", "lang", "source", "measured.*")
        .withColumn("base_failed", failed)
    )


def _bucket(value: str) -> Column:
    """The value with all but its seven leading bits cleared."""
    return F.expr(
        f"transform(array(greatest(length(bin({value})) - 7, 0)), "
        f"s -> shiftleft(shiftright({value}, s), s))[0]"
    )


def sketches(table: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): histograms of the rows that pass the base rules."""
    values = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.expr(value).alias("v"))
        for name, (value, _) in MEASURES.items()
    ])).alias("x")
    return (
        table.where("NOT base_failed").select("lang", "source", values)
        .select("lang", "source", "x.measure", _bucket("x.v").alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """One row per group; per measure a low and a high fence, null where the group's sample is too small."""
    group = [*keys, "measure"]
    every = W.partitionBy(*group)
    run = every.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranks = sketch.select(
        *group, "bucket", F.sum("n").over(run).alias("upto"), F.sum("n").over(every).alias("total"),
        F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(every).alias("zeros"),
    )
    positive = F.col("total") - F.col("zeros")

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket")))

    def of_positive(percent: int) -> Column:
        reached = (F.col("upto") - F.col("zeros")) * 100 >= positive * percent
        return F.min(F.when((F.col("bucket") > 0) & reached, F.col("bucket")))

    quantiles = ranks.groupBy(*group).agg(
        quantile(25).alias("q1"), quantile(75).alias("q3"), F.max("total").alias("total"),
        F.max(positive).alias("positive"), (of_positive(rules.high_percent) - of_positive(50)).alias("spread"),
    )
    reach = F.greatest(F.coalesce("spread", F.lit(0)), (F.col("q3") - F.col("q1")) * rules.fences)
    enough = F.lit(not keys) | (F.col("total") >= rules.min_group) & (F.col("positive") >= rules.min_positive)
    bounds = quantiles.select(
        *group, F.when(enough, F.col("q1") - reach).alias("low"), F.when(enough, F.col("q3") + reach).alias("high")
    )
    each = [
        F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}")
        for name in MEASURES for side in ("low", "high")
    ]
    return bounds.groupBy(*keys).agg(*each)


def thresholds(sketch: DataFrame, rules: Rules) -> DataFrame:
    """Fences per (lang, source) and measure, from the finest sketch with a sample that suffices.

    The fences of all rows are one row, read by the driver; it has no least sample.
    """
    edges = [f"{name}_{side}" for name in MEASURES for side in ("low", "high")]
    own = fences(sketch, ["lang", "source"], rules)
    by_lang = fences(merged(sketch, ["lang"]), ["lang"], rules).select(
        F.col("lang").alias("wide_lang"), *[F.col(e).alias(f"wide_{e}") for e in edges],
    )
    whole = fences(merged(sketch, []), [], rules).first()
    return (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("wide_lang")))
        .select(
            F.col("lang").alias("t_lang"), F.col("source").alias("t_source"),
            *[F.coalesce(e, f"wide_{e}", F.lit(whole[e]).cast("long")).alias(e) for e in edges],
        )
    )


def judge(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, lang, source, the base measures, base_failed and kept, for every document.

    The measures are written once to the shared folder, as the sketches and the
    verdict both read them.  Both sides of the join are plain exchanges, so a
    hot (lang, source) is split, or the fences are broadcast once found small.
    """
    rules = rules or Rules()
    table = stage(measure(docs, rules), "measures")
    limits = stage(thresholds(stage(sketches(table), "bins"), rules), "fences")
    broken = F.lit(False)
    for name, (value, low) in MEASURES.items():
        broken = broken | (F.expr(value) > F.col(f"{name}_high"))
        if low:
            broken = broken | (F.expr(value) < F.col(f"{name}_low"))
    met = (F.col("lang").eqNullSafe(F.col("t_lang"))) & (F.col("source").eqNullSafe(F.col("t_source")))
    return (
        table.join(limits, met, "left")
        .select(
            "doc_id", "lang", "source", *BASE, "base_failed",
            (~F.col("base_failed") & ~F.coalesce(broken, F.lit(False))).alias("kept"),
        )
    )


def keep(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The text is measured where it is read, and the fences come from a written
    table of the measures, so the texts themselves are never shuffled unless the
    fences are too many to broadcast.
    """
    rules = rules or Rules()
    table = stage(measure(docs, rules), "measures")
    limits = stage(thresholds(stage(sketches(table), "bins"), rules), "fences")
    names = docs.columns
    rows = docs.withColumn("measured", measured(F.col("text"))).where(
        f"measured.n_words >= {rules.min_words} AND "
        f"100 * measured.n_repeat_words <= {rules.max_repeat_percent} * measured.n_words"
    )
    joined = rows.alias("d").join(
        limits, F.col("d.lang").eqNullSafe(F.col("t_lang")) & F.col("d.source").eqNullSafe(F.col("t_source")), "left")
    broken = F.lit(False)
    for name, (value, low) in MEASURES.items():
        for word in BASE:
            value = value.replace(word, f"measured.{word}")
        broken = broken | (F.expr(value) > F.col(f"{name}_high"))
        if low:
            broken = broken | (F.expr(value) < F.col(f"{name}_low"))
    return joined.where(~F.coalesce(broken, F.lit(False))).select(*[F.col(f"d.{c}") for c in names])
