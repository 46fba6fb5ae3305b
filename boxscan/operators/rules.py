"""Final label of a gene from the second model and its features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxscan import constants as K


def favourable(terminal, stability, box, c, d) -> Column:
    """How many of the five features speak for expression."""
    tests = [
        F.col("terminal_combined") <= terminal,
        F.col("normalized_sno_stability") <= stability,
        F.col("box_score") <= box,
        F.col("score_c") <= c,
        F.col("score_d") < d,
    ]
    return reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in tests])


def apply_rules(
    genes: DataFrame,
    prob: float = K.PROB_SECOND,
    terminal: float = K.TERMINAL_STEM_SCORE,
    stability: float = K.SNO_STABILITY,
    box: int = K.BOX_SCORE,
    c: int = K.SCORE_C,
    d: int = K.SCORE_D,
) -> DataFrame:
    """Adds ``predicted_label``; one expression, no shuffle.

    A sure second model (above ``prob``) is overruled only when four features
    say expressed; an unsure one follows the boxes, the stem, and then the
    feature count.  A missing C or D box always means pseudogene.  Genes the
    second model did not see are dropped.
    """
    p = F.col("probability_expressed_pseudogene")
    model = F.when(F.col("second_model_prediction") == 1, K.EXPRESSED).otherwise(K.PSEUDOGENE)
    count = favourable(terminal, stability, box, c, d)
    unsure = (
        F.when((F.col("score_c") >= c) & (F.col("score_d") >= d), K.PSEUDOGENE)
        .when(F.col("terminal_combined") <= terminal, K.EXPRESSED)
        .when(count <= 2, K.PSEUDOGENE)
        .otherwise(model)
    )
    sure = F.when((model == K.PSEUDOGENE) & (count >= 4), K.EXPRESSED).otherwise(model)
    missing = (F.col("C_MOTIF") == K.C_BOX_MISSING) | (F.col("D_MOTIF") == K.D_BOX_MISSING)
    return genes.filter(p.isNotNull()).withColumn(
        "predicted_label",
        F.when(missing, K.PSEUDOGENE).when(p > prob, sure).otherwise(unsure),
    )
