"""Hand-written edge rows, one behaviour each."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom import config
from cohortloom.functions import clock, numeric, text
from cohortloom.operators import features, joins
from cohortloom.operators.describe import describe
from cohortloom.plans.admission_features import (first_note_values, home_doses, note_facts,
                                                 windowed_sums)
from cohortloom.operators.ranks import quantiles

T0 = dt(2020, 1, 1, 0, 0, 0)


def values(df, column):
    return [r[column] for r in df.collect()]


def section(spark, body):
    df = spark.createDataFrame([(body,)], "t string")
    return df.select(text.section(F.col("t"), config.SECTION_PATTERNS,
                                  config.SECTION_END).alias("s")).first()["s"]


def test_empty_section_is_kept_apart_from_no_section(spark):
    assert section(spark, "xx Medications on Admission:") == ""
    assert section(spark, "no list at all") is None


def test_second_header_is_a_fallback(spark):
    assert section(spark, "Preadmission Medication list:\nLasix 40 mg") == "Lasix 40 mg"


def test_section_ends_at_next_header_case_sensitively(spark):
    body = "Medications on Admission: a Discharge Medications: b"
    assert section(spark, body) == "a "
    assert section(spark, body.replace("Discharge M", "discharge m")).endswith("b")


def test_section_is_at_most_a_thousand_characters(spark):
    assert len(section(spark, "Medications on Admission: " + "x" * 3000)) == 1000


def test_hour_boundaries(spark):
    rows = [(dt(2020, 1, 1, 9, 59), dt(2020, 1, 1, 10, 1)),
            (dt(2020, 1, 1, 10, 0), dt(2020, 1, 1, 10, 59)),
            (dt(2020, 1, 2, 0, 30), dt(2020, 1, 1, 23, 30))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(clock.hours_crossed(F.col("a"), F.col("b")).alias("h"))
    assert values(out, "h") == [1, 0, -1]


def test_first_row_ties(spark):
    rows = [(1, 12, T0), (1, 11, T0), (2, 20, T0)]
    df = spark.createDataFrame(rows, "hadm_id long, stay_id long, t timestamp_ntz")
    out = features.first_row(df, "hadm_id", ["t", "stay_id"])
    assert sorted((r.hadm_id, r.stay_id) for r in out.collect()) == [(1, 11), (2, 20)]


def test_first_value_skips_missing_and_breaks_ties(spark):
    rows = [(1, T0, 1, None), (1, T0, 3, 30.0), (1, T0, 2, 20.0)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, i long, v double")
    out = features.first_values(df, "k", ["t", "i"], {"v": F.col("v")})
    assert values(out, "v") == [20.0]


def notes(spark, *texts):
    rows = [(1, i, dt(2020, 1, i), t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(
        rows, "hadm_id long, note_id long, charttime timestamp_ntz, text string")


@pytest.mark.parametrize("texts, expected", [
    (("LVEF 99999999999999999999",), None),
    (("LVEF 95", "LVEF 30"), None),
    (("LVEF: 35%",), 35),
    (("nothing", "Ejection fraction = 55"), 55),
    (("showed 35% EF and LVEF unknown",), 35),
    (("LVEF\x0b40",), None),
    (("LVEF 9",), None),
])
def test_ejection_fraction(spark, texts, expected):
    assert first_note_values(note_facts(notes(spark, *texts))).first()["lvef"] == expected


@pytest.mark.parametrize("body, expected", [
    ("Cardiogenic shock on arrival", 1),
    ("no evidence of cardiogenic shock", 0),
    ("cardiogenic shock ... ruled out cardiogenic shock", 0),
    ("septic", 0),
])
def test_shock_mention(spark, body, expected):
    assert first_note_values(note_facts(notes(spark, body))).first()["cs_from_nlp"] == expected


@pytest.mark.parametrize("body, drug, expected", [
    ("furosemide 40 mg daily. lasix 20 mg bid", "furosemide", 80),
    ("furosemide 12.5 mg", "furosemide", None),
    ("bumex 0.5 mg 2 times", "bumetanide", 1.0),
    ("torsemide 20 mg daily", "torsemide", 20),
    ("Lasix 99999999999999999999 mg", "furosemide", None),
])
def test_home_dose(spark, body, drug, expected):
    df = spark.createDataFrame([(body,)], "med_section string")
    assert home_doses(df).first()[f"{drug}_daily_mg"] == expected


def test_missing_output_modes(spark):
    df = spark.createDataFrame([(None,), (3000.0,), (3000.1,)], "v double")
    neg = df.select(numeric.low_output(F.col("v"), 3000, "negative").alias("f"))
    pos = df.select(numeric.low_output(F.col("v"), 3000, "positive").alias("f"))
    assert values(neg, "f") == [0, 1, 0]
    assert values(pos, "f") == [1, 1, 0]


@pytest.mark.parametrize("mode, expected", [("up_to", 111.0), ("half_open", 10.0),
                                            ("closed", 110.0)])
def test_windows(spark, mode, expected):
    times = [dt(2019, 12, 31, 23), T0, dt(2020, 1, 2), dt(2020, 1, 2, 0, 0, 1)]
    ev = spark.createDataFrame(
        [(1, t, v) for t, v in zip(times, (1.0, 10.0, 100.0, 1000.0))],
        "stay_id long, t timestamp_ntz, v double")
    st = spark.createDataFrame([(1, T0), (1, T0)], "stay_id long, t0 timestamp_ntz")
    out = windowed_sums(ev, st, "stay_id", "t", "t0", F.col("v"), {"s": 24}, mode)
    assert values(out, "s") == [expected]  # a stay listed twice counts once


def test_phenotype_levels(spark):
    df = spark.createDataFrame([(None,), (39,), (40,), (50,), (51,)], "ef long")
    assert values(df.select(numeric.phenotype(F.col("ef")).alias("p")), "p") == [
        "Missing", "HFrEF", "HFmrEF", "HFmrEF", "HFpEF"]


@pytest.mark.parametrize("name, cases", [
    ("points_creatinine", [(1.19, 0), (1.2, 2), (1.6, 4), (None, 0)]),
    ("points_bun", [(19.9, 0), (20.0, 2), (40.0, 3)]),
    ("points_ntprobnp", [(4999.0, 0), (5000.0, 2), (12000.0, 2), (12001.0, 4)]),
    ("points_dbp", [(60.0, 0), (50.0, 1), (49.9, 3), (None, 0)]),
    ("points_home_diuretic", [(0.0, 0), (120.0, 3), (250.0, 6)]),
])
def test_bands(spark, name, cases):
    source, cuts, rest = config.SCORE_BANDS[name]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v double")
    out = df.select(numeric.band_points(F.col("v"), cuts, rest).alias("p"))
    assert values(out, "p") == [p for _, p in cases]


def test_risk_levels(spark):
    df = spark.createDataFrame([(7,), (8,), (12,), (13,)], "s int")
    assert values(df.select(numeric.risk_level(F.col("s"), 7, 12).alias("r")), "r") == [
        "Low", "Moderate", "Moderate", "High"]


def test_lookback_edges_and_self(spark):
    start = dt(2021, 1, 1, 12)
    index = [(1, 10, start, dt(2021, 1, 5)), (2, 20, start, dt(2021, 1, 5)),
             (3, 30, start, dt(2021, 1, 5)), (4, 40, start, dt(2020, 12, 1))]
    hist = [(1, 11, dt(2020, 1, 1), dt(2020, 1, 2, 12)),    # exactly 365 days before
            (2, 21, dt(2020, 12, 1), start),                 # ends at the start
            (3, 31, dt(2019, 12, 1), dt(2020, 1, 1, 12))]    # 366 days before
    schema = "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz"
    history = spark.createDataFrame(hist + index, schema)
    out = joins.lookback_keys(spark.createDataFrame(index, schema), history, "subject_id",
                              "hadm_id", "admittime", "dischtime", 365)
    # 40 ends before it starts but must not count as its own predecessor
    assert values(out, "hadm_id") == [10]


def test_lookback_against_pairs(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(400):
        a = dt(2018, 1, 1).timestamp() + rng.randint(0, 3 * 365 * 86400)
        rows.append((rng.choice([1, 1, 1, rng.randint(2, 40)]), i, dt.fromtimestamp(a),
                     dt.fromtimestamp(a + rng.randint(-2, 20) * 86400)))
    schema = "p long, e long, s timestamp_ntz, t timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    got = sorted(r.e for r in joins.lookback_keys(df, df, "p", "e", "s", "t", 365).collect())
    want = sorted({a[1] for a in rows for b in rows
                   if a[0] == b[0] and a[1] != b[1] and b[3] < a[2]
                   and (a[2] - b[3]).total_seconds() <= 365 * 86400})
    assert got == want


def test_quantile_and_sample_sd(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double")
    for bounded in (True, False):
        r = quantiles(df, "v", {"p20": 0.2, "m": 0.5}, bounded=bounded).first()
        assert (round(r.p20, 9), r.m) == (1.6, 2.5)
    assert round(describe(df, "v").first()["sd"], 4) == 4.0825


def test_cut_bins_are_right_closed(spark):
    df = spark.createDataFrame([(20.0,), (20.1,), (None,)], "v double")
    out = df.select(numeric.cut_bins(F.col("v"), [20.0, 40.0], ["a", "b", "c"]).alias("x"))
    assert values(out, "x") == ["a", "b", None]
