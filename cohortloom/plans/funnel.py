"""The six cohort restrictions, the final one-stay-per-admission cohort, the audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import mentions, section
from ..operators.features import first_row
from ..operators.filters import category_allowlist, codeset_filter, require_not_null
from ..operators.joins import extract_for_keys, semi
from ..session import lazy
from ..sources.tables import Sources
from .admission_features import note_facts


def stays_with_admission(src: Sources) -> DataFrame:
    stays = src.table("icustays").withColumnsRenamed(
        {"intime": "icu_intime", "outtime": "icu_outtime"})
    admissions = src.table(
        "admissions", "hadm_id", "admittime", "dischtime", "hospital_expire_flag")
    return stays.join(admissions, "hadm_id")


def coded_admissions(src: Sources, codes) -> DataFrame:
    """Distinct admissions with a code of the set."""
    dx = src.table("diagnoses_icd", "hadm_id", "icd_code", "icd_version")
    return codeset_filter(dx, "icd_code", "icd_version", codes).select("hadm_id").distinct()


STAY_COLUMNS = ["stay_id", "hadm_id", "subject_id", "first_careunit", "icu_intime",
                "icu_outtime", "admittime", "dischtime", "hospital_expire_flag"]
POSITION = "acute_hf_position"


def step1(src: Sources) -> DataFrame:
    """Coded stays. The best position of a matching code rides along for step 5."""
    codes = codeset_filter(src.table("diagnoses_icd"), "icd_code", "icd_version",
                           config.CODE_SETS["acute_hf"])
    best = codes.groupBy("hadm_id").agg(F.min("seq_num").alias(POSITION))
    return (stays_with_admission(src).join(best, "hadm_id")
            .select(*STAY_COLUMNS, POSITION).distinct())


def step2(df: DataFrame) -> DataFrame:
    return category_allowlist(df, "first_careunit", config.CARE_UNITS)


def step3(df: DataFrame, src: Sources) -> DataFrame:
    tested = require_not_null(src.table("cardiac_marker", "hadm_id", "ntprobnp"), "ntprobnp")
    return semi(df, tested.select("hadm_id").distinct(), "hadm_id")


def note_columns(notes: DataFrame) -> DataFrame:
    """All that any later step wants from a note, in one pass over its text.

    Extraction sits at the scan, so at most 1,000 characters per note travel further.
    """
    text = F.col("text")
    speaks = mentions(text, config.SECTION_MENTIONS)
    found = section(text, config.SECTION_PATTERNS, config.SECTION_END)
    return note_facts(notes, speaks.alias("speaks_section"),
                      F.when(speaks, found).alias("med_section"))


def section_notes(src: Sources) -> DataFrame:
    """One row per note that mentions the section: its admission and the section."""
    notes = src.table("discharge", "hadm_id", "text").filter(
        mentions(F.col("text"), config.SECTION_MENTIONS))
    return notes.select("hadm_id", section(
        F.col("text"), config.SECTION_PATTERNS, config.SECTION_END).alias("med_section"))


def step4(df: DataFrame, notes: DataFrame) -> DataFrame:
    return df.join(notes, "hadm_id").select(*df.columns, "med_section")


def step5(df: DataFrame) -> DataFrame:
    leading = F.col(POSITION) <= config.TOP_DIAGNOSIS_POSITION
    return require_not_null(df.filter(leading), "med_section").drop(POSITION).distinct()


def step6(df: DataFrame, src: Sources) -> DataFrame:
    given = (src.table("inputevents", "stay_id", "itemid")
             .filter(F.col("itemid").isin(list(config.IV_DIURETIC_FACTORS)))
             .select("stay_id").distinct())
    return semi(df, given, "stay_id")


def step7(df: DataFrame) -> DataFrame:
    """First stay per admission; stay id and section text settle equal times."""
    return first_row(df, "hadm_id", ["icu_intime", "stay_id", "med_section"])


class Funnel(dict[str, DataFrame]):
    """The steps by name, and the facts of the notes they read (if those were stored)."""

    notes: DataFrame | None = None


#: Steps worth a table of their own; the others are cheap filters of the one before.
STORED_STEPS = ("step1", "step3", "step7")


def cohort_funnel(src: Sources, save=lazy) -> Funnel:
    """All seven steps by name.

    With the default each step is a lazy frame over the previous one; pass
    ``TableStore.save`` to write the steps that others start from. The notes of the
    admissions left by then are read once, for this funnel and for later features.
    """
    steps = Funnel()

    def keep(name: str, df: DataFrame) -> DataFrame:
        steps[name] = save(df, name, "hadm_id") if name in STORED_STEPS else df
        return steps[name]

    df = keep("step1", step1(src))
    df = keep("step2", step2(df))
    df = keep("step3", step3(df, src))
    if save is lazy:
        notes = section_notes(src)
    else:
        keys = df.select("hadm_id").distinct()
        steps.notes = save(extract_for_keys(
            src.table("discharge"), keys, "hadm_id", note_columns), "notes")
        notes = steps.notes.filter("speaks_section").select("hadm_id", "med_section")
    df = keep("step4", step4(df, notes))
    df = keep("step5", step5(df))
    df = keep("step6", step6(df, src))
    keep("step7", step7(df))
    return steps


def funnel_counts(steps: dict[str, DataFrame]) -> DataFrame:
    """Rows left, rows lost and why, per step, in step order."""
    counts = []
    for i, (df, (label, reason)) in enumerate(zip(steps.values(), config.FUNNEL_STEPS), 1):
        counts.append(df.agg(F.count("*").alias("n_remaining")).select(
            F.lit(i).alias("step_no"), F.lit(label).alias("step"), "n_remaining",
            F.lit(reason).cast("string").alias("exclusion_reason")))
    report = reduce(DataFrame.unionByName, counts)
    # seven rows: the previous step is looked up by its number
    previous = report.select((F.col("step_no") + 1).alias("step_no"),
                             F.col("n_remaining").alias("_before"))
    return (report.join(previous, "step_no", "left")
            .select("step_no", "step", "n_remaining",
                    (F.col("_before") - F.col("n_remaining")).alias("n_excluded"),
                    "exclusion_reason")
            .orderBy("step_no"))
