"""Study configuration: code sets, item lists, patterns, score bands, labels.

Everything here is data. The operators take these as arguments, so another study
swaps this module for its own.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. They must equal the published study's for results to agree.
# ---------------------------------------------------------------------------

# Diagnosis and procedure code sets: (code, version or None for any, match)
CODE_SETS: dict[str, list[tuple[str, int | None, str]]] = {
    "acute_hf": [
        ("I5021", 10, "exact"), ("I5023", 10, "exact"), ("I5031", 10, "exact"),
        ("I5033", 10, "exact"), ("I5041", 10, "exact"), ("I5043", 10, "exact"),
        ("J810", 10, "exact"),
        ("42821", 9, "exact"), ("42823", 9, "exact"), ("42831", 9, "exact"),
        ("42833", 9, "exact"), ("42841", 9, "exact"), ("42843", 9, "exact"),
    ],
    "hypertension": [
        ("I10", None, "prefix"), ("I11", None, "prefix"), ("I12", None, "prefix"),
        ("I13", None, "prefix"), ("I15", None, "prefix"), ("I16", None, "prefix"),
        ("401", None, "prefix"), ("402", None, "prefix"), ("403", None, "prefix"),
        ("404", None, "prefix"), ("405", None, "prefix"),
    ],
    "atrial_fibrillation": [("I48", 10, "prefix"), ("4273", 9, "prefix")],
    "heart_failure": [("I50", 10, "prefix"), ("428", 9, "prefix")],
    "cardiogenic_shock": [
        ("R570", None, "exact"), ("R571", None, "exact"), ("78551", None, "exact"),
    ],
    "circulatory_support": [
        ("5A02210", None, "exact"), ("5A0221D", None, "exact"),
        ("5A02216", None, "exact"), ("02HA0QZ", None, "exact"),
        ("02HA3QZ", None, "exact"), ("02HA4QZ", None, "exact"),
    ],
    "esrd": [
        ("N186", None, "exact"), ("5856", None, "exact"), ("Z992", None, "exact"),
        ("V4511", None, "exact"), ("Z940", None, "exact"),
    ],
    "advanced_ckd": [
        ("N184", None, "exact"), ("N185", None, "exact"), ("N186", None, "exact"),
        ("5854", None, "exact"), ("5855", None, "exact"), ("5856", None, "exact"),
    ],
}

TOP_DIAGNOSIS_POSITION = 5

CARE_UNITS = [
    "Coronary Care Unit (CCU)",
    "Cardiac Vascular Intensive Care Unit (CVICU)",
    "Medical Intensive Care Unit (MICU)",
    "Medical/Surgical Intensive Care Unit (MICU/SICU)",
]

# Item ids
IV_DIURETIC_FACTORS = {221794: 1.0, 228340: 1.0, 229639: 40.0}
ORAL_FACTORS = {"furosemide": 1, "torsemide": 4, "bumetanide": 80}
VASOPRESSOR_ITEMS = [221906, 221289, 229617, 221662, 221653, 222315]
DOBUTAMINE_ITEMS = [221653]
MILRINONE_ITEMS = [221986]
URINE_ITEMS = [
    226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567,
    226557, 226558, 227488, 227489,
]
RHYTHM_ITEMS = [220048]
SUPPORT_DEVICE_ITEMS = [225153, 225154, 225155, 225156]
SUPPORT_ECMO_ITEMS = [229529, 229530]
SUPPORT_LINE_TYPES = [
    "IABP", "Impella Line", "Tandem Heart Inflow Line", "Tandem Heart Outflow Line",
]
INVASIVE_VENTILATION = "InvasiveVent"

# Rhythm strings
ED_RHYTHMS = ["atrial fibrillation", "afib", "af", "atrial flutter"]
ICU_RHYTHM_FRAGMENTS = ["af (", "atrial fib"]

# Note patterns. White space is spelled out because the class \s differs between
# regex engines on the vertical tab.
SECTION_MENTIONS = ["medications on admission", "preadmission medication"]
SECTION_PATTERNS = [
    r"(?is)Medications on Admission[: \t\n\f\r]*(.{0,1000})",
    r"(?is)Preadmission Medication[^\n]*[: \t\n\f\r]*(.{0,1000})",
]
SECTION_END = "Discharge Medications"
WS = r"[ \t\n\f\r]"
TWICE_DAILY = rf"[^.]{{0,30}}(?:bid|twice|2{WS}*times)"
HOME_DRUGS = {
    "furosemide": (r"(?:furosemide|lasix)", r"\d+", "bigint"),
    "torsemide": (r"torsemide", r"\d+", "bigint"),
    "bumetanide": (r"(?:bumetanide|bumex)", r"\d+\.?\d*", "double"),
}
EF_MENTIONS = ["lvef", "ejection fraction"]
EF_PATTERNS = [
    r"(?i)lvef[ \t\n\f\r:=]+(\d+)",
    r"(?i)(?:ef|ejection fraction)[ \t\n\f\r:=]+(\d+)",
    rf"(?i)(\d+){WS}*%?{WS}*(?:lvef|ef)\b",
]
EF_RANGE = (10, 80)
SHOCK_MENTION = r"cardiogenic shock"
SHOCK_NEGATED = (
    r"(?:no|without|deny|denies|ruled out|unlikely|not in|no evidence of)"
    rf"{WS}{{0,10}}cardiogenic shock"
)

# Plausible range and source order of diastolic pressure
DBP_RANGE = (20, 200)
DBP_SOURCES = ["ED Triage", "ED Vitals", "ICU Vitals"]

# Score bands: first true comparison gives the points, a missing value gives 0
SCORE_BANDS: dict[str, tuple[str, list[tuple[str, float, int]], int]] = {
    "points_creatinine": ("creatinine", [("<", 1.2, 0), ("<", 1.6, 2)], 4),
    "points_bun": ("bun", [("<", 20.0, 0), ("<", 40.0, 2)], 3),
    "points_ntprobnp": ("ntprobnp", [("<", 5000.0, 0), ("<=", 12000.0, 2)], 4),
    "points_dbp": ("dbp", [(">=", 60.0, 0), (">=", 50.0, 1)], 3),
    "points_home_diuretic": (
        "total_furosemide_equivalent_mg", [("<", 120.0, 0), ("<", 250.0, 3)], 6),
}
FLAG_POINTS = {
    "points_afib": ("hx_atrial_fibrillation", 2),
    "points_htn": ("hx_hypertension", 3),
    "points_prior_hf": ("prior_hf_hospitalization_12mo", 1),
}
SCORE_COMPONENTS = [*SCORE_BANDS, *FLAG_POINTS]
SCORE_MAX = 26
SCORE_BITS = 5
HOME_DOSE_LABELS = ([("<", 120.0, "Low (<120 mg/day)"),
                     ("<", 250.0, "Moderate (120-249 mg/day)")],
                    "High (≥250 mg/day)")

RISK_LEVELS = ["Low", "Moderate", "High"]
RISK_FRAMEWORKS = {"A": (7, 12), "B": (7, 13), "C": (6, 12)}
PHENOTYPES = ["HFrEF", "HFmrEF", "HFpEF"]
HIGH_RISK_CUT = 13
LOW_OUTPUT_ML = 3000

# Filtration-rate equation: per sex (knee, exponent below it, factor)
EGFR_BASE, EGFR_AGE, EGFR_ABOVE = 142.0, 0.9938, -1.2
EGFR_SEX = {"F": (0.7, -0.241, 1.012), "other": (0.9, -0.302, 1.0)}

# Attrition report
FUNNEL_STEPS = [
    ("Step 1: ICU stays with acute HF diagnosis", None),
    ("Step 2: Cardiac/Medical ICUs only", "SICU, TSICU, Neuro ICU"),
    ("Step 3: NT-proBNP available", "No NT-proBNP measurement"),
    ("Step 4: Medication reconciliation extractable", "No med reconciliation in notes"),
    ("Step 5: ADHF in top 5 diagnoses", "ADHF incidental diagnosis"),
    ("Step 6: Received IV diuretics", "No IV loop diuretics given"),
    ("Step 7: Final cohort (first ICU stay per admission)", "Duplicate ICU stays removed"),
]

# Validation settings
BOOTSTRAP_RESAMPLES = 1000
BOOTSTRAP_SEED = 42
CUTOFF_RANGE = (4, 20)
TREE_MIN_LEAF = 50
EFFICIENCY_QUANTILES = [0.10, 0.15, 0.20, 0.25, 0.30, 0.33]
OUTPUT_LIMITS_ML = [2000, 2500, 3000, 3500, 4000]
SCORE_PERCENTILES = [10, 20, 25, 33, 50, 67, 75, 80, 90]
SUBGROUPS = {
    "Age ≥65 years": ("age_65_or_older", {"1": "≥65 years", "0": "<65 years"}),
    "Sex": ("gender", {"M": "Male", "F": "Female"}),
    "Diabetes": ("hx_diabetes", {"1": "Diabetes", "0": "No diabetes"}),
    "Chronic kidney disease": (
        "chronic_advanced_ckd", {"1": "Advanced CKD", "0": "No advanced CKD"}),
    "Atrial fibrillation": ("hx_atrial_fibrillation", {"1": "AFib", "0": "No AFib"}),
    "Home diuretics": (
        "on_home_diuretics", {"1": "On home diuretics", "0": "No home diuretics"}),
    "Cardiogenic shock": (
        "cardiogenic_shock", {"1": "Cardiogenic shock", "0": "No cardiogenic shock"}),
}
BASELINE_MEAN = ["age", "dbp", "lvef"]
BASELINE_MEDIAN = [
    "total_score", "creatinine", "bun", "ntprobnp",
    "total_furosemide_equivalent_mg", "cci_score",
]
BASELINE_CATEGORICAL = [
    "male_sex", "risk_category", "hx_atrial_fibrillation", "hx_hypertension",
    "prior_hf_hospitalization_12mo", "hf_phenotype", "hx_diabetes",
    "hx_renal_disease", "hx_myocardial_infarction", "hx_stroke", "hx_copd",
    "cardiogenic_shock", "invasive_vent",
]
BINARY_OUTCOMES = ["vasopressor_use", "inotrope_use", "mcs_use", "invasive_vent"]
STAY_LENGTHS = ["icu_los_days", "hospital_los_days"]
EXPORT_COLUMNS = [
    "hadm_id", "age", "gender", "total_score", "risk_category", "creatinine", "bun",
    "ntprobnp", "dbp", "total_furosemide_equivalent_mg", "hx_atrial_fibrillation",
    "hx_hypertension", "prior_hf_hospitalization_12mo", "lvef", "hf_phenotype",
    "hx_diabetes", "hx_renal_disease", "hx_myocardial_infarction", "hx_stroke",
    "hx_copd", "cci_score", "cardiogenic_shock", "invasive_vent",
    "diuretic_efficiency_24h", "diuretic_efficiency_72h", "urine_output_24h_ml",
    "diuretic_resistance", "hospital_expire_flag", "icu_stay_ge_24h",
    "icu_stay_ge_72h",
]
OUTCOME_COLUMNS = [
    "urine_output_24h_ml", "urine_output_72h_ml", "diuretic_resistance",
    "vasopressor_use", "dobutamine_use", "milrinone_use", "inotrope_use", "mcs_use",
    "iv_diuretic_dose_24h_mg", "iv_diuretic_dose_72h_mg", "diuretic_efficiency_24h",
    "diuretic_efficiency_72h", "icu_los_days", "hospital_los_days",
    "icu_stay_ge_24h", "icu_stay_ge_72h",
]
# Published comparators: (population, n, pearson_r, auroc_q20, auroc_q25, auroc_dr)
COMPARATORS = [
    ("ROSE/CARRESS/ATHENA", 794, None, 0.87, None, None),
    ("DOSE/ESCAPE", 707, None, 0.84, None, None),
    ("CLOROTIC", 220, -0.18, None, 0.70, None),
    ("Floor", 317, -0.40, None, None, 0.631),
]
