"""Discrimination of a binary outcome by a score, from per-score class counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import prefix_sums, union


def score_histogram(df: DataFrame, score: str, event: str, by: list[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Events ``p`` and non-events ``q`` at each score value; NULLs dropped."""
    w = F.col(weight) if weight else F.lit(1)
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, score, event]])
    return (df.filter(present).groupBy(*by, score)
            .agg(F.sum(F.col(event) * w).cast("bigint").alias("p"),
                 F.sum((1 - F.col(event)) * w).cast("bigint").alias("q")))


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def discrimination_from(hist: DataFrame, score: str, by: list[str] = (),
                        bounded: bool = False) -> DataFrame:
    """n, events, auroc, auprc per group; NULL where a class is missing."""
    summed = prefix_sums(hist, score, ["p", "q"], by, bounded)
    p, q = _d("p_total"), _d("q_total")
    # share of (event, non-event) pairs the score orders, ties one half
    area = F.sum(_d("p") * (_d("q_below") + _d("q_at") / 2)) / F.nullif(F.max(p * q), F.lit(0.0))
    hits = p - _d("p_below")
    flagged = hits + q - _d("q_below")
    precision = (F.sum(F.when(flagged > 0, _d("p") * hits / flagged))
                 / F.nullif(F.max(p), F.lit(0.0)))
    both = (F.max("p_total") > 0) & (F.max("q_total") > 0)
    return summed.groupBy(*by).agg(
        F.max(F.col("p_total") + F.col("q_total")).alias("n"),
        F.max("p_total").alias("events"),
        F.when(both, area).alias("auroc"), F.when(both, precision).alias("auprc"))


def discrimination(df: DataFrame, score: str, event: str, by: list[str] = (),
                   weight: str | None = None, bounded: bool = False) -> DataFrame:
    return discrimination_from(
        score_histogram(df, score, event, by, weight), score, by, bounded)


def roc_curve(df: DataFrame, score: str, event: str, by: list[str] = (),
              bounded: bool = False, min_rows: int = 0) -> DataFrame:
    """threshold, tp, fp, tpr, fpr for 'score >= threshold', plus the (0, 0) start.

    Every score value is a point (none is dropped as collinear); the start has a NULL
    threshold. Groups lacking a class or with fewer than ``min_rows`` give no curve.
    """
    by = list(by)
    summed = prefix_sums(
        score_histogram(df, score, event, by), score, ["p", "q"], by, bounded)
    usable = summed.filter((F.col("p_total") > 0) & (F.col("q_total") > 0)
                           & (F.col("p_total") + F.col("q_total") >= min_rows))
    points = usable.select(
        *by, F.col(score).cast("double").alias("threshold"),
        (F.col("p_total") - F.col("p_below")).alias("tp"),
        (F.col("q_total") - F.col("q_below")).alias("fp"), "p_total", "q_total")
    start = points.select(*by, "p_total", "q_total").distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
        "p_total", "q_total")
    return union([points, start]).select(
        *by, "threshold", "tp", "fp", (_d("tp") / _d("p_total")).alias("tpr"),
        (_d("fp") / _d("q_total")).alias("fpr"), "p_total", "q_total")


def youden(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """Threshold with the largest tpr - fpr; equal values go to the highest threshold.

    Compared as whole numbers (tp * non-events - fp * events), so ties are exact.
    """
    j = (F.col("tp").cast("decimal(19,0)") * F.col("q_total").cast("decimal(19,0)")
         - F.col("fp").cast("decimal(19,0)") * F.col("p_total").cast("decimal(19,0)"))
    best = F.max(F.struct(j.alias("_j"), "threshold", "tpr", "fpr")).alias("_b")
    return (curve.filter(F.col("threshold").isNotNull()).groupBy(*by).agg(best)
            .filter(F.col("_b").isNotNull()).select(*by, F.col("_b.threshold").alias("threshold"),
                    F.col("_b.tpr").alias("sensitivity"),
                    (1 - F.col("_b.fpr")).alias("specificity"),
                    (F.col("_b.tpr") - F.col("_b.fpr")).alias("youden_j")))


def operating_point(df: DataFrame, score: str, event: str, cut: float,
                    by: list[str] = ()) -> DataFrame:
    """Sensitivity and specificity of 'score >= cut' by conditional counts."""
    e, hit = F.col(event), F.col(score) >= cut
    pos = F.sum(F.when(e == 1, 1).otherwise(0)).cast("double")
    neg = F.sum(F.when(e == 0, 1).otherwise(0)).cast("double")
    true_pos = F.sum(F.when((e == 1) & hit, 1).otherwise(0))
    true_neg = F.sum(F.when((e == 0) & ~hit, 1).otherwise(0))
    return df.dropna(subset=[*by, score, event]).groupBy(*by).agg(
        F.lit(float(cut)).alias("cut"),
        F.when(pos > 0, true_pos / pos).alias("sensitivity"),
        F.when(neg > 0, true_neg / neg).alias("specificity"))
