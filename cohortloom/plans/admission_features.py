"""The wide admission table: one row per admission, features, score, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.clock import hours_crossed
from ..functions.numeric import (any_flag, filtration_rate, flag, low_output, or_zero,
                                 phenotype, safe_ratio)
from ..functions.text import any_of, daily_dose, first_pattern, mentions, unnegated_mention
from ..operators.features import (distinct_flag, first_values, item_factor, key_flags,
                                  windowed_sums, within)
from ..operators.filters import code_match, plausible_range
from ..operators.joins import (bridge, extract_for_keys, left_star, lookback_keys,
                               priority_coalesce, semi)
from ..operators.score import add_points, add_total, dose_label, oral_equivalent
from ..sources.tables import Sources


def home_doses(cohort: DataFrame) -> DataFrame:
    """Daily home doses per drug and their common-unit sum, from the section text."""
    text = F.lower("med_section")
    doses = {
        f"{drug}_daily_mg": daily_dose(
            text, names, number, kind, config.WS, config.TWICE_DAILY)
        for drug, (names, number, kind) in config.HOME_DRUGS.items()}
    out = cohort.withColumns(doses).drop("med_section")
    columns = {d: F.col(f"{d}_daily_mg") for d in config.ORAL_FACTORS}
    total = oral_equivalent(columns, config.ORAL_FACTORS)
    plain = oral_equivalent(columns, dict.fromkeys(config.ORAL_FACTORS, 1))
    return (out.withColumn("total_furosemide_equivalent_mg", total)
            .withColumn("home_diuretic_category",
                        dose_label(F.col("total_furosemide_equivalent_mg")))
            .withColumn("on_home_diuretics", flag(plain > 0)))


def first_labs(src: Sources, admissions: DataFrame) -> DataFrame:
    chem = semi(src.table("chemistry"), admissions, "hadm_id")
    chem = first_values(chem, "hadm_id", ["charttime", "specimen_id"],
                        {"creatinine": F.col("creatinine"), "bun": F.col("bun")})
    marker = semi(src.table("cardiac_marker"), admissions, "hadm_id")
    marker = first_values(marker, "hadm_id", ["charttime", "specimen_id"],
                          {"ntprobnp": F.col("ntprobnp")})
    return left_star(admissions, [(chem, "hadm_id"), (marker, "hadm_id")])


def diastolic_sources(src: Sources, cohort: DataFrame) -> list[tuple[DataFrame, str]]:
    """First plausible pressure per stay from each source, best source first."""
    low, high = config.DBP_RANGE
    ed = (src.table("edstays").dropna(subset=["hadm_id"])
          .withColumnRenamed("stay_id", "ed_stay_id")
          .join(cohort.select("stay_id", "hadm_id", "subject_id").distinct(),
                ["subject_id", "hadm_id"]))
    triage = (plausible_range(src.table("triage"), "dbp", low, high)
              .withColumnRenamed("stay_id", "ed_stay_id").join(ed, "ed_stay_id"))
    vitals = (plausible_range(src.table("ed_vitalsign", "stay_id", "charttime", "dbp"),
                              "dbp", low, high)
              .withColumnRenamed("stay_id", "ed_stay_id")
              .join(ed.drop("intime"), "ed_stay_id"))
    icu = semi(plausible_range(src.table("vitalsign"), "dbp", low, high),
               cohort.select("stay_id").distinct(), "stay_id")
    value = {"dbp": F.col("dbp")}
    frames = [
        first_values(triage, "stay_id", ["intime", "ed_stay_id"], value),
        first_values(vitals, "stay_id", ["charttime", "ed_stay_id"], value),
        first_values(icu, "stay_id", ["charttime"], value)]
    return list(zip(frames, config.DBP_SOURCES))


def diagnosis_flags(src: Sources) -> DataFrame:
    """All diagnosis-based flags per admission from one scan of the code table."""
    wanted = {
        "hx_hypertension": "hypertension", "afib_from_icd": "atrial_fibrillation",
        "cs_from_icd": "cardiogenic_shock", "mcs_from_icd": "circulatory_support",
        "esrd": "esrd", "chronic_advanced_ckd": "advanced_ckd"}
    code, version = F.col("icd_code"), F.col("icd_version")
    tests = {n: code_match(code, version, config.CODE_SETS[s]) for n, s in wanted.items()}
    dx = src.table("diagnoses_icd", "hadm_id", "icd_code", "icd_version")
    return key_flags(dx.filter(any_of(list(tests.values()))), "hadm_id", tests)


def rhythm_admissions(src: Sources) -> tuple[DataFrame, DataFrame]:
    """Admissions with the arrhythmia noted in emergency or intensive care."""
    ed = (src.table("ed_vitalsign", "stay_id", "rhythm")
          .filter(F.lower("rhythm").isin(config.ED_RHYTHMS)))
    icu = (src.table("chartevents")
           .filter(F.col("itemid").isin(config.RHYTHM_ITEMS)
                   & mentions(F.col("value"), config.ICU_RHYTHM_FRAGMENTS)))
    return (bridge(ed, src.table("edstays", "stay_id", "hadm_id"), "stay_id", "hadm_id"),
            bridge(icu, src.table("icustays", "stay_id", "hadm_id"), "stay_id", "hadm_id"))


def prior_admissions(src: Sources, cohort: DataFrame, days: int = 365) -> DataFrame:
    """Cohort admissions preceded by a coded admission within the look-back."""
    dx = src.table("diagnoses_icd", "hadm_id", "icd_code", "icd_version")
    coded = dx.filter(code_match(F.col("icd_code"), F.col("icd_version"),
                                 config.CODE_SETS["heart_failure"]))
    history = semi(src.table("admissions", "hadm_id", "subject_id", "admittime", "dischtime"),
                   coded.select("hadm_id").distinct(), "hadm_id")
    index = cohort.select("subject_id", "hadm_id", "admittime").distinct()
    return lookback_keys(index, history, "subject_id", "hadm_id", "admittime",
                         "dischtime", days)


def note_facts(notes: DataFrame, *more: Column) -> DataFrame:
    """Per note: ejection fraction (if the note speaks of it), the shock mention, ``more``."""
    text = F.col("text")
    speaks = mentions(text, config.EF_MENTIONS)
    ef = first_pattern(text, config.EF_PATTERNS).try_cast("bigint")
    shock = unnegated_mention(text, config.SHOCK_MENTION, config.SHOCK_NEGATED)
    return notes.select("hadm_id", "charttime", "note_id", speaks.alias("speaks_ef"),
                        F.when(speaks, ef).alias("ef"), shock.alias("shock"), *more)


def first_note_values(facts: DataFrame) -> DataFrame:
    """First note's shock mention; first EF-speaking note's value, then its range.

    The range test comes after the choice of the note: an implausible first value is
    not replaced by a later note's.
    """
    order = F.struct("charttime", "note_id")
    first_ef = F.min(F.when(F.col("speaks_ef"), F.struct("charttime", "note_id", "ef")))
    picked = facts.groupBy("hadm_id").agg(
        first_ef.getField("ef").alias("ef"), F.min_by("shock", order).alias("cs_from_nlp"))
    low, high = config.EF_RANGE
    return picked.select(
        "hadm_id", F.when(F.col("ef").between(low, high), F.col("ef")).alias("lvef"),
        "cs_from_nlp")


def note_features(src: Sources, admissions: DataFrame,
                  notes: DataFrame | None = None) -> DataFrame:
    """First note values; from ``notes`` if their facts were extracted already."""
    if notes is not None:
        return first_note_values(semi(notes, admissions, "hadm_id"))
    return first_note_values(
        extract_for_keys(src.table("discharge"), admissions, "hadm_id", note_facts))


def urine_up_to(src: Sources, stays: DataFrame) -> DataFrame:
    events = src.table("outputevents").filter(F.col("itemid").isin(config.URINE_ITEMS))
    return windowed_sums(
        events, stays, "stay_id", "charttime", "icu_intime", F.col("value"),
        {"urine_output_24h_ml": 24, "urine_output_72h_ml": 72}, "up_to", empty=0.0)


def iv_doses(src: Sources, stays: DataFrame, mode: str, empty=None) -> DataFrame:
    events = src.table("inputevents").filter(
        F.col("itemid").isin(list(config.IV_DIURETIC_FACTORS)))
    amount = F.col("amount") * item_factor(F.col("itemid"), config.IV_DIURETIC_FACTORS)
    return windowed_sums(
        events, stays, "stay_id", "starttime", "icu_intime", amount,
        {"iv_diuretic_dose_24h_mg": 24, "iv_diuretic_dose_72h_mg": 72}, mode, empty=empty)


def infusion_features(src: Sources, stays: DataFrame) -> DataFrame:
    """Doses and drug-group flags per stay from one scan of the infusion events.

    A dose is NULL for a stay without any event of its drugs, 0 if all of them lie
    outside the horizon.
    """
    item, time, start = F.col("itemid"), F.col("starttime"), F.col("icu_intime")
    diuretic = list(config.IV_DIURETIC_FACTORS)
    groups = {"vasopressor_use": config.VASOPRESSOR_ITEMS,
              "dobutamine_use": config.DOBUTAMINE_ITEMS,
              "milrinone_use": config.MILRINONE_ITEMS}
    every = sorted({i for items in [diuretic, *groups.values()] for i in items})
    events = src.table("inputevents").filter(item.isin(every)).join(
        stays.select("stay_id", "icu_intime").distinct(), "stay_id")
    amount = F.col("amount") * item_factor(item, config.IV_DIURETIC_FACTORS)

    def dose(hours: int) -> Column:
        counted = F.when(within(time, start, hours, "up_to"), amount).otherwise(0.0)
        return F.sum(F.when(item.isin(diuretic), counted))

    return events.groupBy("stay_id").agg(
        *[dose(h).alias(f"iv_diuretic_dose_{h}h_mg") for h in (24, 72)],
        *[F.max(flag(item.isin(items))).alias(name) for name, items in groups.items()])


def device_stays(src: Sources, items: list[int], name: str) -> DataFrame:
    events = src.table("procedureevents").filter(F.col("itemid").isin(items))
    return distinct_flag(events, "stay_id", name)


def ventilated_stays(src: Sources) -> DataFrame:
    events = src.table("ventilation").filter(
        F.col("ventilation_status") == config.INVASIVE_VENTILATION)
    return distinct_flag(events, "stay_id", "invasive_vent")


def comorbidities(src: Sources) -> DataFrame:
    c = src.table("charlson")
    return c.select(
        "hadm_id",
        F.col("myocardial_infarct").alias("hx_myocardial_infarction"),
        F.col("congestive_heart_failure").alias("hx_heart_failure"),
        F.col("cerebrovascular_disease").alias("hx_stroke"),
        any_flag([F.col("diabetes_without_cc"), F.col("diabetes_with_cc")])
        .alias("hx_diabetes"),
        F.col("renal_disease").alias("hx_renal_disease"),
        F.col("chronic_pulmonary_disease").alias("hx_copd"),
        F.col("charlson_comorbidity_index").alias("cci_score"))


def stay_lengths(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Lengths in days from crossed hours, and the two minimum-stay flags."""
    icu = hours_crossed(F.col("icu_intime"), F.col("icu_outtime"))
    hospital = hours_crossed(F.col("admittime"), F.col("dischtime"))
    icu_days, hospital_days = icu / F.lit(24.0), hospital / F.lit(24.0)
    if digits is not None:
        icu_days, hospital_days = F.round(icu_days, digits), F.round(hospital_days, digits)
    return df.withColumns({
        "icu_los_days": icu_days, "hospital_los_days": hospital_days,
        "icu_stay_ge_24h": flag(icu >= 24), "icu_stay_ge_72h": flag(icu >= 72)})


FINAL_COLUMNS = [
    "stay_id", "hadm_id", "subject_id", "gender", "age", "first_careunit", "icu_intime",
    "icu_outtime", "admittime", "dischtime", "hospital_expire_flag",
    "furosemide_daily_mg", "torsemide_daily_mg", "bumetanide_daily_mg",
    "total_furosemide_equivalent_mg", "diuretic_points", "home_diuretic_category",
    "creatinine", "bun", "ntprobnp", "dbp", "dbp_source", "hx_myocardial_infarction",
    "hx_heart_failure", "hx_stroke", "hx_diabetes", "hx_renal_disease", "hx_copd",
    "cci_score", "hx_hypertension", "hx_atrial_fibrillation", "afib_from_icd",
    "afib_from_ed", "afib_from_icu", "prior_hf_hospitalization_12mo", "lvef",
    "hf_phenotype", "cardiogenic_shock", "cs_from_icd", "cs_from_nlp",
    "age_65_or_older", "on_home_diuretics", *config.SCORE_COMPONENTS, "total_score",
    "risk_label", *config.OUTCOME_COLUMNS, "esrd", "invasive_vent", "egfr_admission",
    "chronic_advanced_ckd",
]


def admission_table(src: Sources, cohort: DataFrame, notes: DataFrame | None = None,
                    near: Sources | None = None) -> DataFrame:
    """The 72-column table over a cohort with one stay per admission.

    ``notes`` are the note facts that the funnel extracted; without them the notes of the
    cohort's admissions are read here. ``near`` are the sources of the cohort's admissions, if
    they were cut down to them (:meth:`Sources.of_admissions`); the history of earlier
    admissions comes from ``src``.

    Every source is reduced to one row per key before it meets the cohort, so no join
    multiplies rows. Admission-keyed features come first and stay-keyed ones after
    them: the cohort changes its partitioning once.
    """
    near = near or src
    keys = cohort.select("hadm_id").distinct()
    ed_rhythm, icu_rhythm = rhythm_admissions(near)
    prior = prior_admissions(src, cohort)
    labs = first_labs(near, keys)
    support = device_stays(near, config.SUPPORT_DEVICE_ITEMS, "mcs_from_device")
    people = src.table("patients").withColumnRenamed("anchor_age", "age")

    wide = left_star(home_doses(cohort), [
        (labs, "hadm_id"),
        (comorbidities(near), "hadm_id"),
        (diagnosis_flags(near), "hadm_id"),
        (distinct_flag(ed_rhythm, "hadm_id", "afib_from_ed"), "hadm_id"),
        (distinct_flag(icu_rhythm, "hadm_id", "afib_from_icu"), "hadm_id"),
        (prior.withColumn("prior_hf_hospitalization_12mo", F.lit(1)), "hadm_id"),
        (note_features(src, keys, notes), "hadm_id"),
        (urine_up_to(near, cohort), "stay_id"),
        (infusion_features(near, cohort), "stay_id"),
        (support, "stay_id"),
        (ventilated_stays(near), "stay_id"),
    ])
    wide = priority_coalesce(wide, diastolic_sources(near, cohort), "stay_id", "dbp",
                             "dbp_source")
    wide = wide.join(people, "subject_id")

    zero = ["hx_hypertension", "hx_diabetes", "afib_from_icd", "afib_from_ed",
            "afib_from_icu", "prior_hf_hospitalization_12mo", "cs_from_icd", "cs_from_nlp",
            "esrd", "chronic_advanced_ckd", "vasopressor_use", "dobutamine_use",
            "milrinone_use", "invasive_vent"]
    wide = wide.withColumns({
        **{c: or_zero(F.col(c)) for c in zero},
        "hx_atrial_fibrillation": any_flag(
            [F.col(c) for c in ("afib_from_icd", "afib_from_ed", "afib_from_icu")]),
        "cardiogenic_shock": any_flag([F.col("cs_from_icd"), F.col("cs_from_nlp")]),
        "inotrope_use": any_flag([F.col("dobutamine_use"), F.col("milrinone_use")]),
        "mcs_use": any_flag([F.col("mcs_from_device"), F.col("mcs_from_icd")]),
        "hf_phenotype": phenotype(F.col("lvef")),
        "age_65_or_older": flag(F.col("age") >= 65),
        "egfr_admission": filtration_rate(
            F.col("creatinine"), F.col("gender"), F.col("age")),
        "diuretic_resistance": low_output(
            F.col("urine_output_24h_ml"), config.LOW_OUTPUT_ML, "negative"),
        "diuretic_efficiency_24h": safe_ratio(
            F.col("urine_output_24h_ml"), F.col("iv_diuretic_dose_24h_mg")),
        "diuretic_efficiency_72h": safe_ratio(
            F.col("urine_output_72h_ml"), F.col("iv_diuretic_dose_72h_mg")),
    })
    wide = add_total(add_points(stay_lengths(wide)))
    wide = wide.withColumn("diuretic_points", F.col("points_home_diuretic"))
    return wide.select(*FINAL_COLUMNS)
