"""Outcome enrichment: the sixteen outcome columns from the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import any_flag, low_output, or_zero, risk_level, safe_ratio
from ..operators.features import distinct_flag, windowed_sums
from ..operators.joins import left_star, semi
from ..sources.tables import Sources
from .admission_features import device_stays, iv_doses, stay_lengths


def outcome_columns(src: Sources, cohort: DataFrame) -> DataFrame:
    """stay_id and the sixteen outcomes, half-open windows, missing output as 0."""
    keys = cohort.select("stay_id").distinct()
    first_day = (semi(src.table("first_day_urine_output"), keys, "stay_id")
                 .withColumnRenamed("urineoutput", "_u24"))
    three_days = windowed_sums(
        src.table("urine_output"), cohort, "stay_id", "charttime", "icu_intime",
        F.col("urineoutput"), {"_u72": 72}, "half_open")
    lines = src.table("invasive_line").filter(
        F.col("line_type").isin(config.SUPPORT_LINE_TYPES))
    base = cohort.select("stay_id", "icu_intime", "icu_outtime", "admittime", "dischtime")
    wide = left_star(base, [
        (first_day, "stay_id"),
        (three_days, "stay_id"),
        (iv_doses(src, cohort, "half_open"), "stay_id"),
        (distinct_flag(src.table("norepinephrine_equivalent_dose"), "stay_id",
                       "vasopressor_use"), "stay_id"),
        (distinct_flag(src.table("dobutamine"), "stay_id", "dobutamine_use"), "stay_id"),
        (distinct_flag(src.table("milrinone"), "stay_id", "milrinone_use"), "stay_id"),
        (distinct_flag(lines, "stay_id", "_line"), "stay_id"),
        (device_stays(src, config.SUPPORT_ECMO_ITEMS, "_ecmo"), "stay_id"),
    ])
    u24, u72 = or_zero(F.col("_u24")), or_zero(F.col("_u72"))
    d24, d72 = F.col("iv_diuretic_dose_24h_mg"), F.col("iv_diuretic_dose_72h_mg")
    wide = stay_lengths(wide, digits=2).withColumns({
        "urine_output_24h_ml": u24,
        "urine_output_72h_ml": u72,
        "diuretic_resistance": low_output(
            F.col("_u24"), config.LOW_OUTPUT_ML, "positive"),
        "vasopressor_use": or_zero(F.col("vasopressor_use")),
        "dobutamine_use": or_zero(F.col("dobutamine_use")),
        "milrinone_use": or_zero(F.col("milrinone_use")),
        "inotrope_use": any_flag([F.col("dobutamine_use"), F.col("milrinone_use")]),
        "mcs_use": any_flag([F.col("_line"), F.col("_ecmo")]),
        "diuretic_efficiency_24h": F.round(safe_ratio(u24, d24), 2),
        "diuretic_efficiency_72h": F.round(safe_ratio(u72, d72), 2),
        "iv_diuretic_dose_24h_mg": or_zero(d24),
        "iv_diuretic_dose_72h_mg": or_zero(d72),
    })
    return wide.select("stay_id", *config.OUTCOME_COLUMNS)


def enrich_outcomes(src: Sources, table: DataFrame) -> DataFrame:
    """``table`` with its outcome columns replaced by name, order kept."""
    from ..sources.sinks import replace_columns

    out = replace_columns(table, outcome_columns(src, table), "stay_id")
    return out.select(*table.columns)


def add_risk_category(df: DataFrame, framework: str = "A") -> DataFrame:
    low, high = config.RISK_FRAMEWORKS[framework]
    return df.withColumn("risk_category", risk_level(F.col("total_score"), low, high))
