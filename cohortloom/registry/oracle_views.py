"""The study tables as plain SQL views over the stand-in tables, for checking.

Written for a single-node SQL engine and independent of the DataFrame code: row-number
and ordered aggregates here, struct minimums and semi joins there.
"""

from __future__ import annotations

from .. import config


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def code_test(name: str, code: str = "icd_code", version: str = "icd_version") -> str:
    tests = []
    for value, ver, how in config.CODE_SETS[name]:
        test = f"{code} = '{value}'" if how == "exact" else f"{code} LIKE '{value}%'"
        tests.append(f"({test} AND {version} = {ver})" if ver else f"({test})")
    return "(" + " OR ".join(tests) + ")"


def first_match(text: str, pattern: str) -> str:
    return (f"CASE WHEN regexp_matches({text}, '{pattern}') "
            f"THEN regexp_extract({text}, '{pattern}', 1) END")


SECTION_A = r"Medications on Admission"
SECTION_B = r"Preadmission Medication[^\n]*"


def section_after(header: str) -> str:
    """Up to 1,000 characters after a header; the header alone decides the match."""
    return (f"CASE WHEN regexp_matches(text, '(?is){header}') THEN "
            rf"left(regexp_extract(text, '(?is){header}[:\s]*(.*)', 1), 1000) END")


SECTION = (f"split_part(COALESCE({section_after(SECTION_A)}, {section_after(SECTION_B)}), "
           "'Discharge Medications', 1)")
EF = ("TRY_CAST(COALESCE("
      + first_match("text", r"(?i)lvef[\s:=]+(\d+)") + ", "
      + first_match("text", r"(?i)(?:ef|ejection fraction)[\s:=]+(\d+)") + ", "
      + first_match("text", r"(?i)(\d+)\s*%?\s*(?:lvef|ef)\b") + ") AS BIGINT)")
SHOCK_NO = (r"(?:no|without|deny|denies|ruled out|unlikely|not in|no evidence of)"
            r"\s{0,10}cardiogenic shock")
SHOCK = ("CASE WHEN regexp_matches(lower(text), 'cardiogenic shock') AND NOT "
         f"regexp_matches(lower(text), '{SHOCK_NO}') THEN 1 ELSE 0 END")
SPEAKS_EF = "(contains(lower(text), 'lvef') OR contains(lower(text), 'ejection fraction'))"
SPEAKS_SECTION = ("(contains(lower(text), 'medications on admission') "
                  "OR contains(lower(text), 'preadmission medication'))")


def dose(names: str, number: str, kind: str, text: str = "lower(med_section)") -> str:
    find = rf"{names}\s*({number})\s*mg"
    twice = rf"{names}\s*{number}\s*mg[^.]{{0,30}}(?:bid|twice|2\s*times)"
    return (f"TRY_CAST({first_match(text, find)} AS {kind}) * "
            f"CASE WHEN regexp_matches({text}, '{twice}') THEN 2 ELSE 1 END")


FUROSEMIDE = dose("(?:furosemide|lasix)", r"\d+", "BIGINT")
TORSEMIDE = dose("torsemide", r"\d+", "BIGINT")
BUMETANIDE = dose("(?:bumetanide|bumex)", r"\d+\.?\d*", "DOUBLE")

IV_ITEMS = in_list(config.IV_DIURETIC_FACTORS)
IV_AMOUNT = "amount * CASE WHEN itemid = 229639 THEN 40 ELSE 1 END"
URINE_ITEMS = in_list(config.URINE_ITEMS)


def hours(a: str, b: str) -> str:
    return f"date_diff('hour', {a}, {b})"


def cents(x: str) -> str:
    """Two digits, half away from zero on the decimal reading of the double."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 12)), 2) AS DOUBLE)"


EGFR = """CASE WHEN creatinine > 0 THEN 142 * power(0.9938, age) * CASE
 WHEN gender = 'F' AND creatinine <= 0.7 THEN 1.012 * power(creatinine / 0.7, -0.241)
 WHEN gender = 'F' THEN 1.012 * power(creatinine / 0.7, -1.2)
 WHEN creatinine <= 0.9 THEN power(creatinine / 0.9, -0.302)
 ELSE power(creatinine / 0.9, -1.2) END END"""

STAY_COLUMNS = ("stay_id, hadm_id, subject_id, first_careunit, icu_intime, icu_outtime, "
                "admittime, dischtime, hospital_expire_flag")

COHORT_VIEWS: dict[str, str] = {
    "step1": f"""SELECT DISTINCT i.stay_id, i.hadm_id, i.subject_id, i.first_careunit,
 i.intime AS icu_intime, i.outtime AS icu_outtime, a.admittime, a.dischtime,
 a.hospital_expire_flag FROM icustays i JOIN admissions a ON a.hadm_id = i.hadm_id
 WHERE i.hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE {code_test('acute_hf')})""",
    "step2": f"SELECT * FROM step1 WHERE first_careunit IN {in_list(config.CARE_UNITS)}",
    "step3": ("SELECT * FROM step2 WHERE hadm_id IN (SELECT hadm_id FROM cardiac_marker "
              "WHERE ntprobnp IS NOT NULL)"),
    "step4": f"""SELECT step3.*, n.med_section FROM step3 JOIN
 (SELECT hadm_id, {SECTION} AS med_section FROM discharge WHERE {SPEAKS_SECTION}) n
 ON n.hadm_id = step3.hadm_id""",
    "step5": f"""SELECT DISTINCT * FROM step4 WHERE med_section IS NOT NULL AND hadm_id IN
 (SELECT hadm_id FROM diagnoses_icd WHERE seq_num <= 5 AND {code_test('acute_hf')})""",
    "step6": ("SELECT * FROM step5 WHERE EXISTS (SELECT 1 FROM inputevents e "
              f"WHERE e.stay_id = step5.stay_id AND e.itemid IN {IV_ITEMS})"),
    "step7": ("SELECT * FROM step6 QUALIFY row_number() OVER (PARTITION BY hadm_id "
              "ORDER BY icu_intime, stay_id, med_section) = 1"),
    "doses": f"""SELECT stay_id, {FUROSEMIDE} AS furosemide_daily_mg,
 {TORSEMIDE} AS torsemide_daily_mg, {BUMETANIDE} AS bumetanide_daily_mg FROM step7""",
    "chem_first": """SELECT hadm_id,
 first(creatinine ORDER BY charttime, specimen_id, creatinine) FILTER (WHERE creatinine IS NOT NULL) AS creatinine,
 first(bun ORDER BY charttime, specimen_id, bun) FILTER (WHERE bun IS NOT NULL) AS bun
 FROM chemistry GROUP BY hadm_id""",
    "marker_first": """SELECT hadm_id,
 first(ntprobnp ORDER BY charttime, specimen_id, ntprobnp) AS ntprobnp
 FROM cardiac_marker WHERE ntprobnp IS NOT NULL GROUP BY hadm_id""",
    "dbp_all": """SELECT c.stay_id, 1 AS pri, 'ED Triage' AS src, e.intime AS seen, e.stay_id AS tie, t.dbp
 FROM step7 c JOIN edstays e ON e.subject_id = c.subject_id AND e.hadm_id = c.hadm_id
 JOIN triage t ON t.stay_id = e.stay_id
 UNION ALL SELECT c.stay_id, 2, 'ED Vitals', v.charttime, e.stay_id, v.dbp
 FROM step7 c JOIN edstays e ON e.subject_id = c.subject_id AND e.hadm_id = c.hadm_id
 JOIN ed_vitalsign v ON v.stay_id = e.stay_id
 UNION ALL SELECT stay_id, 3, 'ICU Vitals', charttime, 0, dbp FROM vitalsign
 WHERE stay_id IN (SELECT stay_id FROM step7)""",
    "dbp_best": """SELECT stay_id, dbp, src AS dbp_source FROM dbp_all WHERE dbp BETWEEN 20 AND 200
 QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY pri, seen, tie, dbp) = 1""",
    "dx_marks": f"""SELECT hadm_id,
 max(CASE WHEN {code_test('hypertension')} THEN 1 ELSE 0 END) AS htn,
 max(CASE WHEN {code_test('atrial_fibrillation')} THEN 1 ELSE 0 END) AS af,
 max(CASE WHEN {code_test('cardiogenic_shock')} THEN 1 ELSE 0 END) AS cs,
 max(CASE WHEN {code_test('circulatory_support')} THEN 1 ELSE 0 END) AS mcs,
 max(CASE WHEN {code_test('esrd')} THEN 1 ELSE 0 END) AS esrd,
 max(CASE WHEN {code_test('advanced_ckd')} THEN 1 ELSE 0 END) AS ckd
 FROM diagnoses_icd GROUP BY hadm_id""",
    "prior_hf": f"""SELECT DISTINCT c.hadm_id FROM step7 c JOIN admissions p
 ON p.subject_id = c.subject_id AND p.hadm_id <> c.hadm_id AND p.dischtime < c.admittime
 AND p.dischtime >= c.admittime - INTERVAL '365' DAY
 WHERE p.hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE {code_test('heart_failure')})""",
    "note_first": f"""SELECT hadm_id,
 first({SHOCK} ORDER BY charttime, note_id) AS shock,
 first(ef ORDER BY charttime, note_id) FILTER (WHERE speaks) AS ef
 FROM (SELECT *, {EF} AS ef, {SPEAKS_EF} AS speaks FROM discharge
 WHERE hadm_id IN (SELECT hadm_id FROM step7)) GROUP BY hadm_id""",
    "urine_any": f"""SELECT c.stay_id,
 sum(CASE WHEN charttime <= icu_intime + INTERVAL '24' HOUR THEN value ELSE 0 END) AS u24,
 sum(CASE WHEN charttime <= icu_intime + INTERVAL '72' HOUR THEN value ELSE 0 END) AS u72
 FROM step7 c JOIN outputevents o ON o.stay_id = c.stay_id WHERE itemid IN {URINE_ITEMS}
 GROUP BY c.stay_id""",
    "dose_any": f"""SELECT c.stay_id,
 sum(CASE WHEN starttime <= icu_intime + INTERVAL '24' HOUR THEN {IV_AMOUNT} ELSE 0 END) AS d24,
 sum(CASE WHEN starttime <= icu_intime + INTERVAL '72' HOUR THEN {IV_AMOUNT} ELSE 0 END) AS d72
 FROM step7 c JOIN inputevents e ON e.stay_id = c.stay_id WHERE itemid IN {IV_ITEMS}
 GROUP BY c.stay_id""",
    "wide_raw": f"""SELECT c.stay_id, c.hadm_id, c.subject_id, p.gender,
 CAST(p.anchor_age AS INTEGER) AS age, c.first_careunit, c.icu_intime, c.icu_outtime,
 c.admittime, c.dischtime, c.hospital_expire_flag, d.furosemide_daily_mg,
 d.torsemide_daily_mg, d.bumetanide_daily_mg,
 CAST(COALESCE(furosemide_daily_mg, 0) + 4 * COALESCE(torsemide_daily_mg, 0)
  + 80 * COALESCE(bumetanide_daily_mg, 0) AS DOUBLE) AS total_furosemide_equivalent_mg,
 l.creatinine, l.bun, m.ntprobnp, b.dbp, b.dbp_source,
 ch.myocardial_infarct AS hx_myocardial_infarction,
 ch.congestive_heart_failure AS hx_heart_failure,
 ch.cerebrovascular_disease AS hx_stroke,
 CASE WHEN ch.diabetes_without_cc = 1 OR ch.diabetes_with_cc = 1 THEN 1 ELSE 0 END AS hx_diabetes,
 ch.renal_disease AS hx_renal_disease, ch.chronic_pulmonary_disease AS hx_copd,
 CAST(ch.charlson_comorbidity_index AS INTEGER) AS cci_score,
 COALESCE(x.htn, 0) AS hx_hypertension, COALESCE(x.af, 0) AS afib_from_icd,
 CASE WHEN c.hadm_id IN (SELECT e.hadm_id FROM ed_vitalsign v JOIN edstays e ON e.stay_id = v.stay_id
  WHERE lower(v.rhythm) IN {in_list(config.ED_RHYTHMS)} AND e.hadm_id IS NOT NULL) THEN 1 ELSE 0 END AS afib_from_ed,
 CASE WHEN c.hadm_id IN (SELECT s.hadm_id FROM chartevents v JOIN icustays s ON s.stay_id = v.stay_id
  WHERE v.itemid = 220048 AND (lower(v.value) LIKE '%af (%' OR lower(v.value) LIKE '%atrial fib%')) THEN 1 ELSE 0 END AS afib_from_icu,
 CASE WHEN c.hadm_id IN (SELECT hadm_id FROM prior_hf) THEN 1 ELSE 0 END AS prior_hf_hospitalization_12mo,
 CASE WHEN n.ef BETWEEN 10 AND 80 THEN n.ef END AS lvef,
 COALESCE(x.cs, 0) AS cs_from_icd, COALESCE(n.shock, 0) AS cs_from_nlp,
 CASE WHEN COALESCE(furosemide_daily_mg, 0) + COALESCE(torsemide_daily_mg, 0)
  + COALESCE(bumetanide_daily_mg, 0) > 0 THEN 1 ELSE 0 END AS on_home_diuretics,
 u.u24 AS urine_output_24h_ml, u.u72 AS urine_output_72h_ml,
 i.d24 AS iv_diuretic_dose_24h_mg, i.d72 AS iv_diuretic_dose_72h_mg,
 CASE WHEN EXISTS (SELECT 1 FROM inputevents e WHERE e.stay_id = c.stay_id AND e.itemid IN {in_list(config.VASOPRESSOR_ITEMS)}) THEN 1 ELSE 0 END AS vasopressor_use,
 CASE WHEN EXISTS (SELECT 1 FROM inputevents e WHERE e.stay_id = c.stay_id AND e.itemid = 221653) THEN 1 ELSE 0 END AS dobutamine_use,
 CASE WHEN EXISTS (SELECT 1 FROM inputevents e WHERE e.stay_id = c.stay_id AND e.itemid = 221986) THEN 1 ELSE 0 END AS milrinone_use,
 CASE WHEN COALESCE(x.mcs, 0) = 1 OR EXISTS (SELECT 1 FROM procedureevents e WHERE e.stay_id = c.stay_id
  AND e.itemid IN {in_list(config.SUPPORT_DEVICE_ITEMS)}) THEN 1 ELSE 0 END AS mcs_use,
 COALESCE(x.esrd, 0) AS esrd,
 CASE WHEN EXISTS (SELECT 1 FROM ventilation v WHERE v.stay_id = c.stay_id AND v.ventilation_status = 'InvasiveVent') THEN 1 ELSE 0 END AS invasive_vent,
 COALESCE(x.ckd, 0) AS chronic_advanced_ckd,
 CAST({hours('c.icu_intime', 'c.icu_outtime')} AS BIGINT) AS icu_hours,
 CAST({hours('c.admittime', 'c.dischtime')} AS BIGINT) AS hospital_hours
 FROM step7 c JOIN patients p ON p.subject_id = c.subject_id
 LEFT JOIN doses d ON d.stay_id = c.stay_id LEFT JOIN chem_first l ON l.hadm_id = c.hadm_id
 LEFT JOIN marker_first m ON m.hadm_id = c.hadm_id LEFT JOIN dbp_best b ON b.stay_id = c.stay_id
 LEFT JOIN charlson ch ON ch.hadm_id = c.hadm_id LEFT JOIN dx_marks x ON x.hadm_id = c.hadm_id
 LEFT JOIN note_first n ON n.hadm_id = c.hadm_id LEFT JOIN urine_any u ON u.stay_id = c.stay_id
 LEFT JOIN dose_any i ON i.stay_id = c.stay_id""",
    "wide_points": f"""SELECT *,
 CASE WHEN creatinine >= 1.6 THEN 4 WHEN creatinine >= 1.2 THEN 2 ELSE 0 END AS points_creatinine,
 CASE WHEN bun >= 40 THEN 3 WHEN bun >= 20 THEN 2 ELSE 0 END AS points_bun,
 CASE WHEN ntprobnp > 12000 THEN 4 WHEN ntprobnp >= 5000 THEN 2 ELSE 0 END AS points_ntprobnp,
 CASE WHEN dbp < 50 THEN 3 WHEN dbp < 60 THEN 1 ELSE 0 END AS points_dbp,
 CASE WHEN total_furosemide_equivalent_mg >= 250 THEN 6 WHEN total_furosemide_equivalent_mg >= 120 THEN 3 ELSE 0 END AS points_home_diuretic,
 greatest(afib_from_icd, afib_from_ed, afib_from_icu) AS hx_atrial_fibrillation,
 2 * greatest(afib_from_icd, afib_from_ed, afib_from_icu) AS points_afib,
 3 * hx_hypertension AS points_htn, prior_hf_hospitalization_12mo AS points_prior_hf,
 CASE WHEN total_furosemide_equivalent_mg >= 250 THEN 'High (≥250 mg/day)'
  WHEN total_furosemide_equivalent_mg >= 120 THEN 'Moderate (120-249 mg/day)'
  ELSE 'Low (<120 mg/day)' END AS home_diuretic_category,
 CASE WHEN lvef IS NULL THEN 'Missing' WHEN lvef < 40 THEN 'HFrEF' WHEN lvef <= 50 THEN 'HFmrEF'
  ELSE 'HFpEF' END AS hf_phenotype,
 greatest(cs_from_icd, cs_from_nlp) AS cardiogenic_shock,
 CASE WHEN age >= 65 THEN 1 ELSE 0 END AS age_65_or_older,
 greatest(dobutamine_use, milrinone_use) AS inotrope_use,
 CASE WHEN urine_output_24h_ml <= 3000 THEN 1 ELSE 0 END AS diuretic_resistance,
 CASE WHEN iv_diuretic_dose_24h_mg > 0 THEN urine_output_24h_ml / iv_diuretic_dose_24h_mg END AS diuretic_efficiency_24h,
 CASE WHEN iv_diuretic_dose_72h_mg > 0 THEN urine_output_72h_ml / iv_diuretic_dose_72h_mg END AS diuretic_efficiency_72h,
 icu_hours / 24.0::DOUBLE AS icu_los_days, hospital_hours / 24.0::DOUBLE AS hospital_los_days,
 CASE WHEN icu_hours >= 24 THEN 1 ELSE 0 END AS icu_stay_ge_24h,
 CASE WHEN icu_hours >= 72 THEN 1 ELSE 0 END AS icu_stay_ge_72h,
 {EGFR} AS egfr_admission FROM wide_raw""",
    "wide": f"""SELECT * EXCLUDE (icu_hours, hospital_hours), points_home_diuretic AS diuretic_points,
 {' + '.join(config.SCORE_COMPONENTS)} AS total_score,
 CASE WHEN {' + '.join(config.SCORE_COMPONENTS)} <= 7 THEN 'Low risk'
 WHEN {' + '.join(config.SCORE_COMPONENTS)} <= 12 THEN 'Moderate risk' ELSE 'High risk' END AS risk_label
 FROM wide_points""",
    "out_raw": f"""SELECT c.stay_id, c.icu_intime, c.icu_outtime, c.admittime, c.dischtime,
 COALESCE((SELECT sum(f.urineoutput) FROM first_day_urine_output f WHERE f.stay_id = c.stay_id), 0) AS u24,
 COALESCE(u.u72, 0) AS u72, d.d24, d.d72,
 CASE WHEN c.stay_id IN (SELECT stay_id FROM norepinephrine_equivalent_dose) THEN 1 ELSE 0 END AS vp,
 CASE WHEN c.stay_id IN (SELECT stay_id FROM dobutamine) THEN 1 ELSE 0 END AS dob,
 CASE WHEN c.stay_id IN (SELECT stay_id FROM milrinone) THEN 1 ELSE 0 END AS mil,
 CASE WHEN c.stay_id IN (SELECT stay_id FROM invasive_line WHERE line_type IN {in_list(config.SUPPORT_LINE_TYPES)})
  OR c.stay_id IN (SELECT stay_id FROM procedureevents WHERE itemid IN {in_list(config.SUPPORT_ECMO_ITEMS)}) THEN 1 ELSE 0 END AS mcs
 FROM step7 c
 LEFT JOIN (SELECT s.stay_id, sum(urineoutput) AS u72 FROM step7 s JOIN urine_output o ON o.stay_id = s.stay_id
  AND o.charttime >= s.icu_intime AND o.charttime < s.icu_intime + INTERVAL '72' HOUR GROUP BY s.stay_id) u ON u.stay_id = c.stay_id
 LEFT JOIN (SELECT s.stay_id,
   sum({IV_AMOUNT}) FILTER (WHERE e.starttime < s.icu_intime + INTERVAL '24' HOUR) AS d24,
   sum({IV_AMOUNT}) AS d72 FROM step7 s JOIN inputevents e ON e.stay_id = s.stay_id
  AND e.starttime >= s.icu_intime AND e.starttime < s.icu_intime + INTERVAL '72' HOUR
  WHERE e.itemid IN {IV_ITEMS} GROUP BY s.stay_id) d ON d.stay_id = c.stay_id""",
    "outcomes": f"""SELECT stay_id, u24 AS urine_output_24h_ml, u72 AS urine_output_72h_ml,
 CASE WHEN u24 <= 3000 THEN 1 ELSE 0 END AS diuretic_resistance, vp AS vasopressor_use,
 dob AS dobutamine_use, mil AS milrinone_use, greatest(dob, mil) AS inotrope_use, mcs AS mcs_use,
 COALESCE(d24, 0) AS iv_diuretic_dose_24h_mg, COALESCE(d72, 0) AS iv_diuretic_dose_72h_mg,
 CASE WHEN d24 > 0 THEN {cents('u24 / d24')} END AS diuretic_efficiency_24h,
 CASE WHEN d72 > 0 THEN {cents('u72 / d72')} END AS diuretic_efficiency_72h,
 {cents(hours('icu_intime', 'icu_outtime') + ' / 24.0::DOUBLE')} AS icu_los_days,
 {cents(hours('admittime', 'dischtime') + ' / 24.0::DOUBLE')} AS hospital_los_days,
 CASE WHEN {hours('icu_intime', 'icu_outtime')} >= 24 THEN 1 ELSE 0 END AS icu_stay_ge_24h,
 CASE WHEN {hours('icu_intime', 'icu_outtime')} >= 72 THEN 1 ELSE 0 END AS icu_stay_ge_72h
 FROM out_raw""",
    "final": f"""SELECT w.* EXCLUDE ({', '.join(config.OUTCOME_COLUMNS)}), o.* EXCLUDE (stay_id),
 CASE WHEN w.total_score <= 7 THEN 'Low' WHEN w.total_score <= 12 THEN 'Moderate' ELSE 'High' END AS risk_category
 FROM wide w JOIN outcomes o ON o.stay_id = w.stay_id""",
    # efficiency cohorts with their labels
    "eff24": """SELECT *, diuretic_efficiency_24h AS y, diuretic_efficiency_24h AS eff FROM final
 WHERE icu_stay_ge_24h = 1 AND diuretic_efficiency_24h > 0""",
    "eff72": """SELECT *, diuretic_efficiency_72h AS y, diuretic_efficiency_72h AS eff FROM final
 WHERE icu_stay_ge_72h = 1 AND diuretic_efficiency_72h > 0""",
    "lab24": """SELECT *, CASE WHEN y <= (SELECT quantile_cont(y, 0.20) FROM eff24) THEN 1 ELSE 0 END AS low_q20,
 CASE WHEN y <= (SELECT quantile_cont(y, 0.25) FROM eff24) THEN 1 ELSE 0 END AS low_q25 FROM eff24""",
    "lab72": """SELECT *, CASE WHEN y <= (SELECT quantile_cont(y, 0.20) FROM eff72) THEN 1 ELSE 0 END AS low_q20,
 CASE WHEN y <= (SELECT quantile_cont(y, 0.25) FROM eff72) THEN 1 ELSE 0 END AS low_q25 FROM eff72""",
}
