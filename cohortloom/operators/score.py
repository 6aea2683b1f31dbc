"""Point score: banded values plus flags, summed into a total and a risk level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import band, band_points, or_zero, risk_level


def oral_equivalent(doses: dict[str, Column], factors: dict[str, int]) -> Column:
    """Sum of doses in one drug's units, a missing drug counting 0."""
    terms = [or_zero(doses[d] * F.lit(k)) for d, k in factors.items()]
    return reduce(lambda a, b: a + b, terms).cast("double")


def add_points(df: DataFrame) -> DataFrame:
    """One points column per component."""
    points = {
        name: band_points(F.col(source), cuts, rest)
        for name, (source, cuts, rest) in config.SCORE_BANDS.items()}
    points |= {
        name: F.when(F.col(source) == 1, value).otherwise(0)
        for name, (source, value) in config.FLAG_POINTS.items()}
    return df.withColumns(points)


def add_total(df: DataFrame, low: int = 7, high: int = 12) -> DataFrame:
    """Component sum and its labelled risk level."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in config.SCORE_COMPONENTS])
    labels = [f"{level} risk" for level in config.RISK_LEVELS]
    return (df.withColumn("total_score", total)
            .withColumn("risk_label", risk_level(F.col("total_score"), low, high, labels)))


def dose_label(dose: Column) -> Column:
    cuts, rest = config.HOME_DOSE_LABELS
    return band(dose, cuts, rest)


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Name the score columns as in a table that carries the score's own prefix."""
    names = {"total_score": "total_score", "risk_label": "risk_category",
             "diuretic_points": "diuretic_points"}
    return df.withColumnsRenamed({a: prefix + b for a, b in names.items()})
