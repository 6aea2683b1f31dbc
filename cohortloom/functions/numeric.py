"""Numeric and flag expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

_COMPARE = {
    "<": lambda c, t: c < t,
    "<=": lambda c, t: c <= t,
    ">": lambda c, t: c > t,
    ">=": lambda c, t: c >= t,
}


def band(value: Column, cuts: list[tuple[str, float, object]], rest, missing=None) -> Column:
    """Result of the first true comparison, ``rest`` if none, ``missing`` for NULL."""
    out = F.when(value.isNull(), F.lit(missing))
    for op, limit, result in cuts:
        out = out.when(_COMPARE[op](value, F.lit(limit)), F.lit(result))
    return out.otherwise(F.lit(rest))


def band_points(value: Column, cuts: list[tuple[str, float, int]], rest: int) -> Column:
    return band(value, cuts, rest, missing=0)


def flag(condition: Column) -> Column:
    """0/1 integer; a NULL condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def any_flag(columns: Iterable[Column]) -> Column:
    return F.greatest(F.lit(0), *[or_zero(c) for c in columns])


def risk_level(score: Column, low: int, high: int, labels: list[str] | None = None) -> Column:
    names = labels or config.RISK_LEVELS
    return F.when(score <= low, names[0]).when(score <= high, names[1]).otherwise(names[2])


def level_order(label: Column, levels: list[str]) -> Column:
    """Position of a label in an explicit order, for sorting."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), label)


def phenotype(ef: Column) -> Column:
    return (F.when(ef.isNull(), "Missing").when(ef < 40, "HFrEF")
            .when(ef <= 50, "HFmrEF").otherwise("HFpEF"))


def filtration_rate(creatinine: Column, sex: Column, age: Column) -> Column:
    """Sex-specific power formula; NULL where creatinine is missing or not positive."""

    def formula(knee: float, below: float, factor: float) -> Column:
        ratio = creatinine / F.lit(knee)
        slope = F.when(creatinine <= knee, F.lit(below)).otherwise(
            F.lit(config.EGFR_ABOVE))
        return (F.lit(config.EGFR_BASE) * F.pow(ratio, slope)
                * F.pow(F.lit(config.EGFR_AGE), age) * F.lit(factor))

    by_sex = F.when(sex == "F", formula(*config.EGFR_SEX["F"])).otherwise(
        formula(*config.EGFR_SEX["other"]))
    return F.when(creatinine > 0, by_sex)


def low_output(volume: Column, limit: float, missing: str) -> Column:
    """Volume at or below a limit; ``missing`` says how NULL counts."""
    if missing == "positive":
        volume = F.coalesce(volume, F.lit(0.0))
    elif missing != "negative":
        raise ValueError("missing must be 'positive' or 'negative'")
    return flag(volume <= limit)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """NULL unless the denominator is positive."""
    return F.when(bottom > 0, top / bottom)


def clip_upper(value: Column, limit: float) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(limit)))


def cut_bins(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins with open ends: label i for edges[i-1] < value <= edges[i]."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge, label)
    return out.otherwise(labels[-1])


def recode(value: Column, mapping: dict[str, object], otherwise=None) -> Column:
    """Value map after trimming and upper-casing the text form."""
    key = F.upper(F.trim(value.cast("string")))
    out = F.when(key.isNull(), F.lit(None))
    for source, target in mapping.items():
        out = out.when(key == source.upper(), F.lit(target))
    return out.otherwise(F.lit(otherwise))


def coerce_number(value: Column) -> Column:
    """Text to number, NULL where it is not one."""
    return F.trim(value.cast("string")).try_cast("double")


def coerce_flag(value: Column) -> Column:
    """Positive number to 1, other numbers to 0, anything else NULL."""
    number = coerce_number(value)
    return F.when(number > 0, 1).when(number.isNotNull(), 0)


def strength(kind: str, value: Column) -> Column:
    """Verbal band of a metric."""
    if kind == "correlation":
        size = F.abs(value)
        return (F.when(size > 0.5, "strong").when(size > 0.3, "moderate")
                .when(size.isNotNull(), "weak"))
    return (F.when(value >= 0.7, "good").when(value >= 0.6, "moderate")
            .when(value.isNotNull(), "poor"))


def percent_change(new: Column, old: Column) -> Column:
    """Relative difference of magnitudes, in percent."""
    return F.when(old != 0, (F.abs(new) - F.abs(old)) / F.abs(old) * 100)
