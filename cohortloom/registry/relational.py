"""Scans, filters, joins, aggregates, windows and text operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import clock, numeric, text
from ..operators import association as assoc
from ..operators import describe, features, filters, joins, ranks, score
from ..operators.cutoffs import with_candidates
from ..plans import admission_features as wide_plan
from ..plans import cutoffs as cutoff_plan
from ..plans import funnel, outcomes, validation
from ..sources import sinks
from ..sources.tables import SCHEMAS
from . import oracle_views as ov
from .base import Data, query, r6

WIDE_COLUMNS = wide_plan.FINAL_COLUMNS
_DOUBLES = {
    "bumetanide_daily_mg", "total_furosemide_equivalent_mg", "creatinine", "bun",
    "ntprobnp", "dbp", "urine_output_24h_ml", "urine_output_72h_ml",
    "iv_diuretic_dose_24h_mg", "iv_diuretic_dose_72h_mg", "diuretic_efficiency_24h",
    "diuretic_efficiency_72h", "icu_los_days", "hospital_los_days", "egfr_admission"}


def sql_columns(columns: list[str]) -> str:
    return ", ".join(r6(c, c) if c in _DOUBLES else c for c in columns)


# --- scans and sinks ---------------------------------------------------------------

@query("scan_sources", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, count({list(c)[-1]}) AS n_last "
    f"FROM {t}" for t, c in SCHEMAS.items()))
def scan_sources(d: Data) -> DataFrame:
    src = d.dealt
    return ranks.union([
        src.table(t, list(c)[-1]).agg(F.count("*").alias("n_rows"),
                                    F.count(list(c)[-1]).alias("n_last"))
        .select(F.lit(t).alias("table_name"), "n_rows", "n_last")
        for t, c in SCHEMAS.items()])


FINAL_SQL = f"SELECT {sql_columns([*WIDE_COLUMNS, 'risk_category'])} FROM final"


@query("load_cohort", FINAL_SQL)
def load_cohort(d: Data) -> DataFrame:
    return d.final


@query("materialize_step", f"SELECT {ov.STAY_COLUMNS}, med_section FROM step6")
def materialize_step(d: Data) -> DataFrame:
    return sinks.materialize_step(
        funnel.step6(d.steps["step5"], d.src), d.store, "step6_again")


@query("replace_columns", f"SELECT stay_id, {sql_columns(config.OUTCOME_COLUMNS)} FROM final")
def replace_columns(d: Data) -> DataFrame:
    """The stored table is replaced by a query that reads it, and read back."""
    table = sinks.Versions(d.spark, f"enriched_{d.key}")
    table.write(d.wide)
    new = outcomes.outcome_columns(d.near, table.read())
    return table.write(sinks.replace_columns(table.read(), new, "stay_id")).select(
        "stay_id", *config.OUTCOME_COLUMNS)


RATES_SQL = """SELECT risk_category, count(*) AS n,
 CAST(sum(hospital_expire_flag) AS BIGINT) AS events, {rate} FROM final GROUP BY 1""".format(
    rate=r6("avg(hospital_expire_flag) * 100", "rate"))


@query("write_csv", RATES_SQL)
def write_csv(d: Data) -> DataFrame:
    table = describe.rates(d.final, "hospital_expire_flag", ["risk_category"])
    sinks.write_csv(table, d.store.path("rates_csv"))
    return sinks.read_csv(d.spark, d.store.path("rates_csv"), table.schema)


@query("export_analysis_cohort", f"SELECT {sql_columns(config.EXPORT_COLUMNS)} FROM final")
def export_analysis_cohort(d: Data) -> DataFrame:
    return sinks.export_columns(d.final, config.EXPORT_COLUMNS)


@query("plot_feeds", "SELECT hadm_id, total_score, risk_category, "
       + sql_columns(["diuretic_efficiency_24h", "diuretic_efficiency_72h"])
       + ", icu_stay_ge_24h, icu_stay_ge_72h FROM final")
def plot_feeds(d: Data) -> DataFrame:
    return validation.PLOT_FEEDS["efficiency_raw"](d.final)


@query("plot_feed_scatter", "SELECT total_score, "
       + sql_columns(["diuretic_efficiency_24h"]) + ", risk_category FROM eff24")
def plot_feed_scatter(d: Data) -> DataFrame:
    return validation.PLOT_FEEDS["scatter"](d.analysis)


# --- filters and projections -------------------------------------------------------

@query("codeset_filter", "SELECT hadm_id, CAST(seq_num AS INTEGER) AS seq_num, icd_code, "
       f"icd_version FROM diagnoses_icd WHERE {ov.code_test('acute_hf')}")
def codeset_filter(d: Data) -> DataFrame:
    return filters.codeset_filter(d.table("diagnoses_icd"), "icd_code", "icd_version",
                                  config.CODE_SETS["acute_hf"])


@query("category_allowlist", "SELECT stay_id, first_careunit FROM icustays "
       f"WHERE first_careunit IN {ov.in_list(config.CARE_UNITS)}")
def category_allowlist(d: Data) -> DataFrame:
    return filters.category_allowlist(
        d.table("icustays", "stay_id", "first_careunit"), "first_careunit", config.CARE_UNITS)


@query("require_not_null", "SELECT hadm_id, charttime, specimen_id, "
       f"{r6('ntprobnp', 'ntprobnp')} FROM cardiac_marker WHERE ntprobnp IS NOT NULL")
def require_not_null(d: Data) -> DataFrame:
    return filters.require_not_null(d.table("cardiac_marker"), "ntprobnp")


@query("contains_ci", f"SELECT note_id FROM discharge WHERE {ov.SPEAKS_SECTION}")
def contains_ci(d: Data) -> DataFrame:
    return (d.table("discharge", "note_id", "text")
            .filter(text.mentions(F.col("text"), config.SECTION_MENTIONS)).select("note_id"))


@query("prefix_codeset", "SELECT hadm_id, icd_code, icd_version FROM diagnoses_icd WHERE "
       + ov.code_test("hypertension") + " OR " + ov.code_test("atrial_fibrillation"))
def prefix_codeset(d: Data) -> DataFrame:
    codes = config.CODE_SETS["hypertension"] + config.CODE_SETS["atrial_fibrillation"]
    return filters.codeset_filter(d.table("diagnoses_icd", "hadm_id", "icd_code", "icd_version"),
                                  "icd_code", "icd_version", codes)


@query("plausible_range", f"SELECT stay_id, charttime, {r6('dbp', 'dbp')} FROM vitalsign "
       "WHERE dbp BETWEEN 20 AND 200")
def plausible_range(d: Data) -> DataFrame:
    return filters.plausible_range(d.table("vitalsign"), "dbp", *config.DBP_RANGE)


@query("band_points", """SELECT hadm_id, specimen_id, charttime,
 CASE WHEN creatinine IS NULL OR creatinine < 1.2 THEN 0 WHEN creatinine < 1.6 THEN 2 ELSE 4 END AS creatinine_points,
 CASE WHEN bun IS NULL OR bun < 20 THEN 0 WHEN bun < 40 THEN 2 ELSE 3 END AS bun_points FROM chemistry""")
def band_points(d: Data) -> DataFrame:
    def points(name: str):
        source, cuts, rest = config.SCORE_BANDS[name]
        return numeric.band_points(F.col(source), cuts, rest)

    return d.table("chemistry").select(
        "hadm_id", "specimen_id", "charttime",
        points("points_creatinine").alias("creatinine_points"),
        points("points_bun").alias("bun_points"))


@query("flag_points", """SELECT hadm_id, CASE WHEN hx_atrial_fibrillation = 1 THEN 2 ELSE 0 END AS points_afib,
 CASE WHEN hx_hypertension = 1 THEN 3 ELSE 0 END AS points_htn,
 CASE WHEN prior_hf_hospitalization_12mo = 1 THEN 1 ELSE 0 END AS points_prior_hf FROM final""")
def flag_points(d: Data) -> DataFrame:
    raw = d.final.drop(*config.SCORE_COMPONENTS)
    return score.add_points(raw).select("hadm_id", *config.FLAG_POINTS)


@query("total_score", "SELECT hadm_id, "
       + ", ".join(config.SCORE_COMPONENTS) + ", total_score, risk_label FROM wide")
def total_score(d: Data) -> DataFrame:
    raw = d.wide.drop(*config.SCORE_COMPONENTS, "total_score", "risk_label")
    return score.add_total(score.add_points(raw)).select(
        "hadm_id", *config.SCORE_COMPONENTS, "total_score", "risk_label")


@query("risk_category", """SELECT hadm_id, CASE WHEN total_score <= 7 THEN 'Low' WHEN total_score <= 12 THEN 'Moderate' ELSE 'High' END AS a,
 CASE WHEN total_score <= 7 THEN 'Low' WHEN total_score <= 13 THEN 'Moderate' ELSE 'High' END AS b,
 CASE WHEN total_score < 7 THEN 'Low' WHEN total_score <= 12 THEN 'Moderate' ELSE 'High' END AS c FROM final""")
def risk_category(d: Data) -> DataFrame:
    return d.final.select("hadm_id", *[
        numeric.risk_level(F.col("total_score"), low, high).alias(name.lower())
        for name, (low, high) in config.RISK_FRAMEWORKS.items()])


@query("flag_default", """SELECT hadm_id, CASE WHEN hadm_id IN (SELECT hadm_id FROM diagnoses_icd
 WHERE icd_code IN ('N186','5856','Z992','V4511','Z940')) THEN 1 ELSE 0 END AS esrd FROM admissions""")
def flag_default(d: Data) -> DataFrame:
    marks = wide_plan.diagnosis_flags(d.src).select("hadm_id", "esrd")
    return (d.table("admissions", "hadm_id").join(marks, "hadm_id", "left")
            .select("hadm_id", numeric.or_zero(F.col("esrd")).alias("esrd")))


@query("any_of_flags", """SELECT hadm_id, CASE WHEN diabetes_without_cc = 1 OR diabetes_with_cc = 1
 THEN 1 ELSE 0 END AS hx_diabetes FROM charlson""")
def any_of_flags(d: Data) -> DataFrame:
    return wide_plan.comorbidities(d.src).select("hadm_id", "hx_diabetes")


@query("dose_equivalents", f"""SELECT stay_id, itemid, starttime,
 {r6('CASE WHEN itemid IN (221794, 228340) THEN amount WHEN itemid = 229639 THEN amount * 40 ELSE 0 END', 'dose')} FROM inputevents""")
def dose_equivalents(d: Data) -> DataFrame:
    factor = features.item_factor(F.col("itemid"), config.IV_DIURETIC_FACTORS)
    return d.table("inputevents").select(
        "stay_id", "itemid", "starttime", (F.col("amount") * factor).alias("dose"))


@query("oral_equivalents", "SELECT hadm_id, furosemide_daily_mg, torsemide_daily_mg, "
       + sql_columns(["bumetanide_daily_mg", "total_furosemide_equivalent_mg"])
       + ", home_diuretic_category, on_home_diuretics FROM wide")
def oral_equivalents(d: Data) -> DataFrame:
    return wide_plan.home_doses(d.steps["step7"]).select(
        "hadm_id", "furosemide_daily_mg", "torsemide_daily_mg", "bumetanide_daily_mg",
        "total_furosemide_equivalent_mg", "home_diuretic_category", "on_home_diuretics")


@query("derived_flags", "SELECT subject_id, CASE WHEN anchor_age >= 65 THEN 1 ELSE 0 END "
       "AS age_65_or_older FROM patients")
def derived_flags(d: Data) -> DataFrame:
    return d.table("patients").select(
        "subject_id", numeric.flag(F.col("anchor_age") >= 65).alias("age_65_or_older"))


@query("phenotype_band", """SELECT hadm_id, lvef, CASE WHEN lvef < 40 THEN 'HFrEF' WHEN lvef > 50 THEN 'HFpEF'
 WHEN lvef IS NULL THEN 'Missing' ELSE 'HFmrEF' END AS phenotype FROM final""")
def phenotype_band(d: Data) -> DataFrame:
    return d.final.select("hadm_id", "lvef", numeric.phenotype(F.col("lvef")).alias("phenotype"))


@query("egfr_2021", f"""SELECT hadm_id, specimen_id, charttime, {r6(ov.EGFR, 'egfr')} FROM
 (SELECT c.hadm_id, c.specimen_id, c.charttime, c.creatinine, p.gender, p.anchor_age AS age FROM chemistry c
 JOIN admissions a ON a.hadm_id = c.hadm_id JOIN patients p ON p.subject_id = a.subject_id)""")
def egfr_2021(d: Data) -> DataFrame:
    people = d.table("admissions", "hadm_id", "subject_id").join(d.table("patients"), "subject_id")
    rows = d.table("chemistry", "hadm_id", "specimen_id", "charttime", "creatinine").join(
        people, "hadm_id")
    value = numeric.filtration_rate(F.col("creatinine"), F.col("gender"), F.col("anchor_age"))
    return rows.select("hadm_id", "specimen_id", "charttime", value.alias("egfr"))


@query("low_output_flag", """SELECT i.stay_id, CASE WHEN u.urineoutput <= 3000 THEN 1 ELSE 0 END AS missing_negative,
 CASE WHEN u.urineoutput IS NULL OR u.urineoutput <= 3000 THEN 1 ELSE 0 END AS missing_positive
 FROM icustays i LEFT JOIN first_day_urine_output u ON u.stay_id = i.stay_id""")
def low_output_flag(d: Data) -> DataFrame:
    rows = d.table("icustays", "stay_id").join(
        d.table("first_day_urine_output"), "stay_id", "left")
    volume = F.col("urineoutput")
    return rows.select(
        "stay_id",
        numeric.low_output(volume, config.LOW_OUTPUT_ML, "negative").alias("missing_negative"),
        numeric.low_output(volume, config.LOW_OUTPUT_ML, "positive").alias("missing_positive"))


@query("safe_ratio", "SELECT stay_id, "
       + r6("CASE WHEN iv_diuretic_dose_24h_mg > 0 THEN urine_output_24h_ml / iv_diuretic_dose_24h_mg END", "ratio_24h")
       + ", " + r6("CASE WHEN iv_diuretic_dose_72h_mg > 0 THEN urine_output_72h_ml / iv_diuretic_dose_72h_mg END", "ratio_72h")
       + " FROM final")
def safe_ratio(d: Data) -> DataFrame:
    return d.final.select("stay_id", *[
        numeric.safe_ratio(F.col(f"urine_output_{h}h_ml"), F.col(f"iv_diuretic_dose_{h}h_mg"))
        .alias(f"ratio_{h}h") for h in (24, 72)])


@query("length_of_stay", f"""SELECT stay_id, {r6("date_diff('hour', intime, outtime) / 24.0::DOUBLE", 'icu_days')},
 CASE WHEN date_diff('hour', intime, outtime) >= 24 THEN 1 ELSE 0 END AS ge_24h,
 CASE WHEN date_diff('hour', intime, outtime) >= 72 THEN 1 ELSE 0 END AS ge_72h FROM icustays""")
def length_of_stay(d: Data) -> DataFrame:
    crossed = clock.hours_crossed(F.col("intime"), F.col("outtime"))
    return d.table("icustays").select(
        "stay_id", (crossed / F.lit(24.0)).alias("icu_days"),
        numeric.flag(crossed >= 24).alias("ge_24h"), numeric.flag(crossed >= 72).alias("ge_72h"))


_REQUIRED = ["total_score", "hospital_expire_flag", "diuretic_efficiency_24h",
             "diuretic_efficiency_72h", "urine_output_24h_ml", "diuretic_resistance",
             "gender", "lvef", "hf_phenotype", "iv_diuretic_dose_24h_mg"]
_NUMERIC = [c for c in _REQUIRED if c not in ("gender", "hf_phenotype")]


@query("validate_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, 1 AS present, count({c}) AS n_present, "
    + (r6(f"min({c})", "min") + ", " + r6(f"max({c})", "max") if c in _NUMERIC
       else 'CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max"')
    + ", " + r6(f"avg(CASE WHEN {' + '.join(config.SCORE_COMPONENTS)} = total_score THEN 1 ELSE 0 END) * 100",
                "sum_matches_percent") + " FROM final" for c in _REQUIRED)
    + " UNION ALL SELECT 'not_there', 0, 0, NULL, NULL, "
    + f"avg(CASE WHEN {' + '.join(config.SCORE_COMPONENTS)} = total_score THEN 1 ELSE 0 END) * 100 FROM final")
def validate_schema(d: Data) -> DataFrame:
    return describe.validate_schema(
        d.final, [*_REQUIRED, "not_there"], config.SCORE_COMPONENTS, "total_score")


_COHORTS = {
    "all": "TRUE", "icu_ge_24h": "icu_stay_ge_24h = 1",
    "efficiency_24h": "icu_stay_ge_24h = 1 AND diuretic_efficiency_24h > 0",
    "icu_ge_72h": "icu_stay_ge_72h = 1",
    "efficiency_72h": "icu_stay_ge_72h = 1 AND diuretic_efficiency_72h > 0",
    "shock": "cardiogenic_shock = 1", "no_shock": "cardiogenic_shock = 0",
    "known_ef": "lvef IS NOT NULL", "no_advanced_ckd": "chronic_advanced_ckd = 0"}


@query("subcohorts", " UNION ALL ".join(
    f"SELECT '{n}' AS cohort, count(*) AS n, CAST(sum(hospital_expire_flag) AS BIGINT) AS deaths, "
    "count(*) FILTER (WHERE risk_category = 'Low') AS n_low, "
    "count(*) FILTER (WHERE risk_category = 'Moderate') AS n_moderate, "
    f"count(*) FILTER (WHERE risk_category = 'High') AS n_high FROM final WHERE {t}"
    for n, t in _COHORTS.items()))
def subcohorts(d: Data) -> DataFrame:
    return validation.subcohort_summary(d.final)


@query("recode", """SELECT subject_id, CASE WHEN upper(trim(gender)) IN ('M','MALE','MAN') THEN 1 ELSE 0 END AS male_sex,
 CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' END AS sex_label FROM patients""")
def recode(d: Data) -> DataFrame:
    sex = F.col("gender")
    return d.table("patients").select(
        "subject_id", numeric.recode(sex, {"M": 1, "MALE": 1, "MAN": 1}, 0).alias("male_sex"),
        numeric.recode(sex, {"M": "Male", "F": "Female"}).alias("sex_label"))


@query("coerce_numeric", f"""SELECT hadm_id, seq_num, {r6('TRY_CAST(icd_code AS DOUBLE)', 'number')},
 CASE WHEN TRY_CAST(icd_code AS DOUBLE) > 0 THEN 1 WHEN TRY_CAST(icd_code AS DOUBLE) IS NOT NULL THEN 0 END AS flagged
 FROM (SELECT hadm_id, CAST(seq_num AS INTEGER) AS seq_num, icd_code FROM diagnoses_icd)""")
def coerce_numeric(d: Data) -> DataFrame:
    return d.table("diagnoses_icd").select(
        "hadm_id", "seq_num", numeric.coerce_number(F.col("icd_code")).alias("number"),
        numeric.coerce_flag(F.col("icd_code")).alias("flagged"))


@query("clip", f"SELECT stay_id, {r6('least(diuretic_efficiency_24h, 200)', 'capped')} FROM eff24")
def clip(d: Data) -> DataFrame:
    return cutoff_plan.efficiency_cohort(d.final).select(
        "stay_id", numeric.clip_upper(F.col("diuretic_efficiency_24h"), 200.0).alias("capped"))


@query("trim_above_quantile", f"""SELECT stay_id, charttime, {r6('value', 'value')} FROM outputevents
 WHERE value <= (SELECT quantile_cont(value, 0.99) FROM outputevents)""")
def trim_above_quantile(d: Data) -> DataFrame:
    return describe.trim_above(
        d.table("outputevents", "stay_id", "charttime", "value"), "value", 0.99)


# --- joins -------------------------------------------------------------------------

@query("inner_equi_chain", f"SELECT {ov.STAY_COLUMNS} FROM step1")
def inner_equi_chain(d: Data) -> DataFrame:
    return funnel.step1(d.src).select(*funnel.STAY_COLUMNS)


@query("semi_via_distinct", """SELECT i.stay_id, i.hadm_id FROM icustays i
 JOIN (SELECT DISTINCT hadm_id FROM cardiac_marker WHERE ntprobnp IS NOT NULL) m ON m.hadm_id = i.hadm_id""")
def semi_via_distinct(d: Data) -> DataFrame:
    return funnel.step3(d.table("icustays", "stay_id", "hadm_id"), d.src)


@query("exists_semi", f"""SELECT stay_id, hadm_id FROM icustays i WHERE EXISTS
 (SELECT 1 FROM inputevents e WHERE e.stay_id = i.stay_id AND e.itemid IN {ov.IV_ITEMS})""")
def exists_semi(d: Data) -> DataFrame:
    return funnel.step6(d.table("icustays", "stay_id", "hadm_id"), d.src)


@query("one_to_many_notes", f"""SELECT i.stay_id, n.hadm_id, n.med_section FROM icustays i
 JOIN (SELECT hadm_id, {ov.SECTION} AS med_section FROM discharge WHERE {ov.SPEAKS_SECTION}) n ON n.hadm_id = i.hadm_id""")
def one_to_many_notes(d: Data) -> DataFrame:
    return funnel.step4(d.table("icustays", "stay_id", "hadm_id"), funnel.section_notes(d.src))


@query("left_enrich_star", f"""SELECT a.hadm_id, {r6('l.creatinine', 'creatinine')}, {r6('l.bun', 'bun')},
 {r6('m.ntprobnp', 'ntprobnp')}, CAST(c.charlson_comorbidity_index AS INTEGER) AS cci_score,
 x.htn AS hx_hypertension, x.af AS afib_from_icd FROM admissions a
 LEFT JOIN chem_first l ON l.hadm_id = a.hadm_id LEFT JOIN marker_first m ON m.hadm_id = a.hadm_id
 LEFT JOIN charlson c ON c.hadm_id = a.hadm_id
 LEFT JOIN (SELECT * FROM dx_marks WHERE htn + af + cs + mcs + esrd + ckd > 0) x ON x.hadm_id = a.hadm_id""")
def left_enrich_star(d: Data) -> DataFrame:
    keys = d.table("admissions", "hadm_id")
    marks = wide_plan.diagnosis_flags(d.src).select(
        "hadm_id", "hx_hypertension", "afib_from_icd")
    return joins.left_star(wide_plan.first_labs(d.src, keys), [
        (wide_plan.comorbidities(d.src).select("hadm_id", "cci_score"), "hadm_id"),
        (marks, "hadm_id")])


@query("lookback_self_join", f"""SELECT DISTINCT a.hadm_id FROM admissions a JOIN admissions p
 ON p.subject_id = a.subject_id AND p.hadm_id <> a.hadm_id AND p.dischtime < a.admittime
 AND p.dischtime >= a.admittime - INTERVAL '365' DAY
 WHERE p.hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE {ov.code_test('heart_failure')})""")
def lookback_self_join(d: Data) -> DataFrame:
    return wide_plan.prior_admissions(d.src, d.table("admissions"))


_WINDOWS = {"half_open": "charttime >= intime AND charttime < intime + INTERVAL '{h}' HOUR",
            "closed": "charttime >= intime AND charttime <= intime + INTERVAL '{h}' HOUR",
            "up_to": "charttime <= intime + INTERVAL '{h}' HOUR"}


@query("event_window_join", "SELECT i.stay_id, " + ", ".join(
    r6(f"sum(CASE WHEN {w.format(h=24)} THEN value ELSE 0 END)", f"{m}_24h")
    for m, w in _WINDOWS.items())
    + " FROM icustays i JOIN outputevents o ON o.stay_id = i.stay_id GROUP BY i.stay_id")
def event_window_join(d: Data) -> DataFrame:
    stays, events = d.table("icustays", "stay_id", "intime"), d.table("outputevents")
    joined = events.join(stays, "stay_id")
    return joined.groupBy("stay_id").agg(*[
        F.sum(F.when(features.within(F.col("charttime"), F.col("intime"), 24, mode),
                     F.col("value")).otherwise(0.0)).alias(f"{mode}_24h")
        for mode in _WINDOWS])


@query("composite_key_join", """SELECT i.stay_id, e.stay_id AS ed_stay_id, e.intime FROM icustays i
 JOIN edstays e ON e.subject_id = i.subject_id AND e.hadm_id = i.hadm_id""")
def composite_key_join(d: Data) -> DataFrame:
    ed = d.table("edstays").withColumnRenamed("stay_id", "ed_stay_id")
    return (d.table("icustays", "stay_id", "hadm_id", "subject_id")
            .join(ed, ["subject_id", "hadm_id"]).select("stay_id", "ed_stay_id", "intime"))


@query("bridge_join", f"""SELECT 'ed' AS source, e.hadm_id FROM edstays e WHERE e.hadm_id IS NOT NULL AND e.stay_id IN
 (SELECT stay_id FROM ed_vitalsign WHERE lower(rhythm) IN {ov.in_list(config.ED_RHYTHMS)})
 UNION ALL SELECT DISTINCT 'icu', i.hadm_id FROM icustays i WHERE i.stay_id IN (SELECT stay_id FROM chartevents
 WHERE itemid = 220048 AND (lower(value) LIKE '%af (%' OR lower(value) LIKE '%atrial fib%'))""")
def bridge_join(d: Data) -> DataFrame:
    ed, icu = wide_plan.rhythm_admissions(d.src)
    return ed.select(F.lit("ed").alias("source"), "hadm_id").unionByName(
        icu.select(F.lit("icu").alias("source"), "hadm_id"))


_DBP_ALL = """SELECT i.stay_id, 1 AS pri, 'ED Triage' AS src, e.intime AS seen, e.stay_id AS tie, t.dbp FROM icustays i
 JOIN edstays e ON e.subject_id = i.subject_id AND e.hadm_id = i.hadm_id JOIN triage t ON t.stay_id = e.stay_id
 UNION ALL SELECT i.stay_id, 2, 'ED Vitals', v.charttime, e.stay_id, v.dbp FROM icustays i
 JOIN edstays e ON e.subject_id = i.subject_id AND e.hadm_id = i.hadm_id JOIN ed_vitalsign v ON v.stay_id = e.stay_id
 UNION ALL SELECT stay_id, 3, 'ICU Vitals', charttime, 0, dbp FROM vitalsign"""


@query("priority_coalesce", f"""SELECT i.stay_id, {r6('b.dbp', 'dbp')}, b.dbp_source FROM icustays i LEFT JOIN
 (SELECT stay_id, dbp, src AS dbp_source FROM ({_DBP_ALL}) WHERE dbp BETWEEN 20 AND 200
 QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY pri, seen, tie, dbp) = 1) b ON b.stay_id = i.stay_id""")
def priority_coalesce(d: Data) -> DataFrame:
    stays = d.table("icustays", "stay_id", "hadm_id", "subject_id")
    return joins.priority_coalesce(
        stays.select("stay_id"), wide_plan.diastolic_sources(d.src, stays), "stay_id",
        "dbp", "dbp_source")


@query("pairwise_theta", f"""SELECT (SELECT count(*) FROM eff24) AS n, {r6('count(*)', 'permissible')},
 {r6('sum(CASE WHEN a.total_score > b.total_score THEN 1.0 WHEN a.total_score = b.total_score THEN 0.5 ELSE 0 END) / count(*)', 'c_index')}
 FROM eff24 a JOIN eff24 b ON a.y < b.y""")
def pairwise_theta(d: Data) -> DataFrame:
    return assoc.c_index(cutoff_plan.efficiency_cohort(d.final), "total_score",
                         "diuretic_efficiency_24h", config.SCORE_BITS)


_GRID = ("(SELECT l.low, h.high FROM (SELECT unnest(range(4, 18)) AS low) l "
         "JOIN (SELECT unnest(range(6, 20)) AS high) h ON h.high >= l.low + 2)")


@query("candidate_cross_join", f"""SELECT CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high,
 CASE WHEN total_score <= low THEN 0 WHEN total_score <= high THEN 1 ELSE 2 END AS band, count(*) AS n
 FROM final JOIN {_GRID} ON TRUE GROUP BY ALL""")
def candidate_cross_join(d: Data) -> DataFrame:
    hist = ranks.histogram(d.final, ["total_score"])
    return with_candidates(hist, "total_score", cutoff_plan.GRID).groupBy(
        "low", "high", "band").agg(F.sum("n").alias("n"))


# --- aggregates --------------------------------------------------------------------

@query("distinct_rows", "SELECT DISTINCT hadm_id, icd_code, icd_version FROM diagnoses_icd")
def distinct_rows(d: Data) -> DataFrame:
    return d.table("diagnoses_icd", "hadm_id", "icd_code", "icd_version").distinct()


@query("windowed_sums", "SELECT i.stay_id, " + ", ".join(
    r6(f"sum(CASE WHEN starttime >= intime AND starttime < intime + INTERVAL '{h}' HOUR THEN {ov.IV_AMOUNT} END)",
       f"iv_diuretic_dose_{h}h_mg") for h in (24, 72))
    + f" FROM icustays i JOIN inputevents e ON e.stay_id = i.stay_id WHERE itemid IN {ov.IV_ITEMS} GROUP BY i.stay_id")
def windowed_sums(d: Data) -> DataFrame:
    stays = d.table("icustays", "stay_id", "intime").withColumnRenamed("intime", "icu_intime")
    return wide_plan.iv_doses(d.src, stays, "half_open")


@query("key_flags", """SELECT hadm_id, htn AS hx_hypertension, af AS afib_from_icd, cs AS cs_from_icd,
 mcs AS mcs_from_icd, esrd, ckd AS chronic_advanced_ckd FROM dx_marks WHERE htn + af + cs + mcs + esrd + ckd > 0""")
def key_flags(d: Data) -> DataFrame:
    return wide_plan.diagnosis_flags(d.src)


FUNNEL_SQL = """SELECT step_no, step, n_remaining, lag(n_remaining) OVER (ORDER BY step_no) - n_remaining AS n_excluded,
 exclusion_reason FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS step_no, '{label}' AS step, (SELECT count(*) FROM step{i}) AS n_remaining, "
    + (f"'{why}'" if why else "CAST(NULL AS VARCHAR)") + " AS exclusion_reason"
    for i, (label, why) in enumerate(config.FUNNEL_STEPS, 1)) + ")"


@query("funnel_counts", FUNNEL_SQL)
def funnel_counts(d: Data) -> DataFrame:
    return funnel.funnel_counts(d.steps)


@query("ordered_report", f"SELECT *, row_number() OVER (ORDER BY n_remaining DESC, step_no) AS position "
       f"FROM ({FUNNEL_SQL})")
def ordered_report(d: Data) -> DataFrame:
    """The report in its order, which is compared as a column: the place each row comes out at."""
    report = funnel.funnel_counts(funnel.cohort_funnel(d.src))
    # one task reads the seven ordered rows one after the other
    return report.coalesce(1).select(
        "*", (F.monotonically_increasing_id() + 1).cast("bigint").alias("position"))


@query("cohort_overview", f"""SELECT count(*) AS rows, count(DISTINCT subject_id) AS subjects,
 CAST(sum(hospital_expire_flag) AS BIGINT) AS events, {r6('avg(hospital_expire_flag) * 100', 'event_rate')},
 {r6('avg(total_score)', 'mean_value')}, {r6('quantile_cont(total_score, 0.5)', 'median_value')} FROM final""")
def cohort_overview(d: Data) -> DataFrame:
    return describe.cohort_overview(d.final, "subject_id", "hospital_expire_flag", "total_score")


_SKEW = ("CASE WHEN count(*) > 2 AND var_pop({v}) > 0 THEN avg(power({v} - m, 3)) / power(var_pop({v}), 1.5) "
         "* sqrt(count(*) * (count(*) - 1)) / (count(*) - 2) END")


def describe_sql(source: str, value: str, by: str) -> str:
    inner = f"SELECT *, avg({value}) OVER (PARTITION BY {by}) AS m FROM {source} WHERE {value} IS NOT NULL"
    return (f"SELECT {by}, count(*) AS n, {r6(f'avg({value})', 'mean')}, {r6(f'stddev_samp({value})', 'sd')}, "
            f"{r6(_SKEW.format(v=value), 'skew')}, {r6(f'quantile_cont({value}, 0.25)', 'q1')}, "
            f"{r6(f'quantile_cont({value}, 0.5)', 'median')}, {r6(f'quantile_cont({value}, 0.75)', 'q3')}, "
            f"{r6(f'min({value})', 'min')}, {r6(f'max({value})', 'max')} FROM ({inner}) GROUP BY {by}")


@query("describe_column", describe_sql("inputevents", "amount", "itemid"))
def describe_column(d: Data) -> DataFrame:
    return describe.describe(d.table("inputevents", "itemid", "amount"), "amount", ["itemid"])


_POINTS = ", ".join(str(p / 100) for p in config.SCORE_PERCENTILES)


@query("percentiles", f"""SELECT risk_category, CAST(percentile AS DOUBLE) AS percentile, {r6('value', 'value')} FROM
 (SELECT risk_category, unnest({config.SCORE_PERCENTILES}) AS percentile,
 unnest(quantile_cont(egfr_admission, [{_POINTS}])) AS value FROM final WHERE egfr_admission IS NOT NULL GROUP BY 1)""")
def percentiles(d: Data) -> DataFrame:
    return describe.percentiles(d.final, "egfr_admission", config.SCORE_PERCENTILES,
                                ["risk_category"])


@query("skewness_adj", f"""SELECT itemid, {r6(_SKEW.format(v='value'), 'skew')} FROM
 (SELECT *, avg(value) OVER (PARTITION BY itemid) AS m FROM outputevents WHERE value IS NOT NULL) GROUP BY itemid""")
def skewness_adj(d: Data) -> DataFrame:
    return describe.describe(d.table("outputevents", "itemid", "value"), "value",
                             ["itemid"]).select("itemid", "skew")


@query("rates_by_group", RATES_SQL)
def rates_by_group(d: Data) -> DataFrame:
    return describe.rates(d.final, "hospital_expire_flag", ["risk_category"])


@query("crosstab", """SELECT first_careunit, hospital_expire_flag, count(*) AS n FROM icustays i
 JOIN admissions a ON a.hadm_id = i.hadm_id GROUP BY ALL""")
def crosstab(d: Data) -> DataFrame:
    return assoc.contingency(funnel.stays_with_admission(d.src), "first_careunit",
                             "hospital_expire_flag")


_FREQ = f"""SELECT CAST(g.v AS INTEGER) AS total_score, count(f.hadm_id) AS n,
 {r6('count(f.hadm_id) * 100 / CAST((SELECT count(*) FROM final) AS DOUBLE)', 'percent')},
 {r6('sum(count(f.hadm_id)) OVER (ORDER BY g.v) * 100 / CAST((SELECT count(*) FROM final) AS DOUBLE)', 'cumulative_percent')}
 FROM (SELECT unnest(range((SELECT min(total_score) FROM final), (SELECT max(total_score) + 1 FROM final))) AS v) g
 LEFT JOIN final f ON f.total_score = g.v GROUP BY g.v"""


@query("frequency_table", _FREQ)
def frequency_table(d: Data) -> DataFrame:
    return describe.frequency_table(d.final, "total_score")


@query("running_total", f"SELECT total_score, cumulative_percent FROM ({_FREQ})")
def running_total(d: Data) -> DataFrame:
    return describe.frequency_table(d.final, "total_score").select(
        "total_score", "cumulative_percent")


@query("histogram", f"""SELECT risk_category, CAST(floor(total_score) AS DOUBLE) AS bin, count(*) AS n,
 {r6('count(*) / sum(count(*)) OVER (PARTITION BY risk_category)', 'density')} FROM final GROUP BY 1, 2""")
def histogram(d: Data) -> DataFrame:
    return describe.bin_counts(d.final, "total_score", 1.0, ["risk_category"])


@query("quantile_label", f"SELECT stay_id, {r6('y', 'diuretic_efficiency_24h')}, low_q20, low_q25 FROM lab24")
def quantile_label(d: Data) -> DataFrame:
    return cutoff_plan.labelled_efficiency(d.final).select(  # labels derived here
        "stay_id", "diuretic_efficiency_24h", "low_q20", "low_q25")


_MISSING = ["creatinine", "bun", "ntprobnp", "dbp", "lvef", "diuretic_efficiency_24h",
            "furosemide_daily_mg", "cci_score"]


@query("missingness", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n_present, "
    + r6(f"count({c}) * 100 / CAST(count(*) AS DOUBLE)", "percent_present") + " FROM final"
    for c in _MISSING))
def missingness(d: Data) -> DataFrame:
    return describe.missingness(d.final, _MISSING)


# --- windows, set operations -------------------------------------------------------

@query("first_per_key", f"SELECT hadm_id, {r6('creatinine', 'creatinine')}, {r6('bun', 'bun')} FROM chem_first")
def first_per_key(d: Data) -> DataFrame:
    return features.first_values(
        d.table("chemistry"), "hadm_id", ["charttime", "specimen_id"],
        {"creatinine": F.col("creatinine"), "bun": F.col("bun")})


@query("qualify_first", """SELECT hadm_id, stay_id, intime FROM icustays
 QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY intime, stay_id) = 1""")
def qualify_first(d: Data) -> DataFrame:
    return features.first_row(d.table("icustays", "hadm_id", "stay_id", "intime"),
                              "hadm_id", ["intime", "stay_id"])


@query("average_rank", f"""SELECT stay_id, charttime, itemid, {r6('value', 'value')},
 {r6('rank() OVER (PARTITION BY itemid ORDER BY value) + (count(*) OVER (PARTITION BY itemid, value) - 1) / 2.0', 'rank')}
 FROM outputevents""")
def average_rank(d: Data) -> DataFrame:
    return ranks.average_rank(d.table("outputevents"), "value", ["itemid"]).select(
        "stay_id", "charttime", "itemid", "value", "rank")


@query("union_all", " UNION ALL ".join(
    f"SELECT '{s}' AS step, stay_id, hadm_id FROM {s}" for s in ("step1", "step2", "step3")))
def union_all(d: Data) -> DataFrame:
    return ranks.union([d.steps[s].select(F.lit(s).alias("step"), "stay_id", "hadm_id")
                        for s in ("step1", "step2", "step3")])


@query("union_distinct", f"""SELECT stay_id FROM procedureevents WHERE itemid IN {ov.in_list(config.SUPPORT_DEVICE_ITEMS)}
 UNION SELECT i.stay_id FROM icustays i JOIN diagnoses_icd x ON x.hadm_id = i.hadm_id WHERE {ov.code_test('cardiogenic_shock')}""")
def union_distinct(d: Data) -> DataFrame:
    devices = wide_plan.device_stays(d.src, config.SUPPORT_DEVICE_ITEMS, "f").select("stay_id")
    coded = funnel.coded_admissions(d.src, config.CODE_SETS["cardiogenic_shock"])
    stays = joins.semi(d.table("icustays", "stay_id", "hadm_id"), coded, "hadm_id")
    return devices.union(stays.select("stay_id")).distinct()


# --- scalar and text functions -----------------------------------------------------

def _notes(d: Data) -> DataFrame:
    return d.table("discharge", "note_id", "text")


@query("regex_first_group", "SELECT note_id, "
       + ov.first_match("text", r"(?i)lvef[\s:=]+(\d+)") + " AS ef_text FROM discharge")
def regex_first_group(d: Data) -> DataFrame:
    return _notes(d).select("note_id", text.regex_first(
        F.col("text"), config.EF_PATTERNS[0]).alias("ef_text"))


@query("regex_contains", f"""SELECT note_id, CASE WHEN regexp_matches(lower(text), 'cardiogenic shock') THEN 1 ELSE 0 END AS said,
 CASE WHEN regexp_matches(lower(text), '{ov.SHOCK_NO}') THEN 1 ELSE 0 END AS denied FROM discharge""")
def regex_contains(d: Data) -> DataFrame:
    lowered = F.lower("text")
    return _notes(d).select(
        "note_id", numeric.flag(lowered.rlike(config.SHOCK_MENTION)).alias("said"),
        numeric.flag(lowered.rlike(config.SHOCK_NEGATED)).alias("denied"))


@query("section_extract", f"SELECT note_id, {ov.SECTION} AS med_section FROM discharge")
def section_extract(d: Data) -> DataFrame:
    return _notes(d).select("note_id", text.section(
        F.col("text"), config.SECTION_PATTERNS, config.SECTION_END).alias("med_section"))


@query("drug_dose_extract", f"""SELECT note_id, {ov.FUROSEMIDE} AS furosemide, {ov.TORSEMIDE} AS torsemide,
 {r6(ov.BUMETANIDE, 'bumetanide')} FROM (SELECT note_id, {ov.SECTION} AS med_section FROM discharge)""")
def drug_dose_extract(d: Data) -> DataFrame:
    section = F.lower(text.section(F.col("text"), config.SECTION_PATTERNS, config.SECTION_END))
    rows = _notes(d).select("note_id", section.alias("s"))
    return rows.select("note_id", *[
        text.daily_dose(F.col("s"), names, number, kind, config.WS, config.TWICE_DAILY)
        .alias(drug) for drug, (names, number, kind) in config.HOME_DRUGS.items()])


@query("value_extract_fallback", f"""SELECT hadm_id, CASE WHEN ef BETWEEN 10 AND 80 THEN ef END AS lvef FROM
 (SELECT hadm_id, first(ef ORDER BY charttime, note_id) FILTER (WHERE speaks) AS ef
 FROM (SELECT *, {ov.EF} AS ef, {ov.SPEAKS_EF} AS speaks FROM discharge) GROUP BY hadm_id)""")
def value_extract_fallback(d: Data) -> DataFrame:
    facts = wide_plan.note_facts(d.table("discharge"))
    return wide_plan.first_note_values(facts).select("hadm_id", "lvef")


@query("negated_mention", f"SELECT hadm_id, first({ov.SHOCK} ORDER BY charttime, note_id) AS cs_from_nlp "
       "FROM discharge GROUP BY hadm_id")
def negated_mention(d: Data) -> DataFrame:
    facts = wide_plan.note_facts(d.table("discharge"))
    return wide_plan.first_note_values(facts).select("hadm_id", "cs_from_nlp")


@query("lower_upper_trim", """SELECT stay_id, lower(rhythm) AS lowered, upper(trim(rhythm)) AS raised FROM ed_vitalsign""")
def lower_upper_trim(d: Data) -> DataFrame:
    return d.table("ed_vitalsign", "stay_id", "rhythm").select(
        "stay_id", F.lower("rhythm").alias("lowered"), F.upper(F.trim("rhythm")).alias("raised"))


@query("safe_cast", f"""SELECT hadm_id, seq_num, TRY_CAST(icd_code AS BIGINT) AS as_int, {r6('TRY_CAST(icd_code AS DOUBLE)', 'as_double')}
 FROM (SELECT hadm_id, CAST(seq_num AS INTEGER) AS seq_num, icd_code FROM diagnoses_icd)""")
def safe_cast(d: Data) -> DataFrame:
    code = F.col("icd_code")
    return d.table("diagnoses_icd").select(
        "hadm_id", "seq_num", code.try_cast("bigint").alias("as_int"),
        code.try_cast("double").alias("as_double"))


@query("datetime_add_sub", """SELECT hadm_id, admittime - INTERVAL '365' DAY AS year_before,
 dischtime + INTERVAL '24' HOUR AS day_after, dischtime + INTERVAL '72' HOUR AS three_days_after FROM admissions""")
def datetime_add_sub(d: Data) -> DataFrame:
    return d.table("admissions").select(
        "hadm_id", clock.minus_days(F.col("admittime"), 365).alias("year_before"),
        clock.plus_hours(F.col("dischtime"), 24).alias("day_after"),
        clock.plus_hours(F.col("dischtime"), 72).alias("three_days_after"))


@query("hour_boundary_diff", "SELECT hadm_id, date_diff('hour', admittime, dischtime) AS hours FROM admissions")
def hour_boundary_diff(d: Data) -> DataFrame:
    return d.table("admissions").select(
        "hadm_id", clock.hours_crossed(F.col("admittime"), F.col("dischtime")).alias("hours"))


@query("power_round_abs", f"""SELECT hadm_id, specimen_id, charttime, {r6('power(creatinine / 0.9, -1.2)', 'power')},
 {r6(ov.cents('bun / creatinine'), 'ratio')}, {r6('abs(bun - 40)', 'gap')} FROM chemistry""")
def power_round_abs(d: Data) -> DataFrame:
    creatinine, bun = F.col("creatinine"), F.col("bun")
    return d.table("chemistry").select(
        "hadm_id", "specimen_id", "charttime",
        F.pow(creatinine / F.lit(0.9), F.lit(-1.2)).alias("power"),
        F.round(bun / creatinine, 2).alias("ratio"), F.abs(bun - 40).alias("gap"))


@query("cut_bins", """SELECT hadm_id, specimen_id, charttime, CASE WHEN bun <= 20 THEN 'low' WHEN bun <= 40 THEN 'mid'
 WHEN bun IS NOT NULL THEN 'high' END AS bin FROM chemistry""")
def cut_bins(d: Data) -> DataFrame:
    return d.table("chemistry").select(
        "hadm_id", "specimen_id", "charttime",
        numeric.cut_bins(F.col("bun"), [20.0, 40.0], ["low", "mid", "high"]).alias("bin"))


# --- pipelines ---------------------------------------------------------------------

@query("cohort_funnel", f"SELECT {ov.STAY_COLUMNS}, med_section FROM step7")
def cohort_funnel(d: Data) -> DataFrame:
    return funnel.cohort_funnel(d.src)["step7"]


@query("feature_table", f"SELECT {sql_columns(WIDE_COLUMNS)} FROM wide")
def feature_table(d: Data) -> DataFrame:
    return wide_plan.admission_table(d.src, d.steps["step7"], d.steps.notes, d.near)


@query("outcome_enrichment", FINAL_SQL)
def outcome_enrichment(d: Data) -> DataFrame:
    return outcomes.add_risk_category(outcomes.enrich_outcomes(d.near, d.wide))
