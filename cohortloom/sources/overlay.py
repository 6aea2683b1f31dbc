"""Stand-in hospital tables defined over the generic test tables.

Each entry is one SQL text that means the same in Spark SQL and in DuckDB, so the
engine under test and its SQL check read identical input.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Sources

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

_UNIT = """CASE h%6 WHEN 0 THEN 'Coronary Care Unit (CCU)'
 WHEN 1 THEN 'Cardiac Vascular Intensive Care Unit (CVICU)'
 WHEN 2 THEN 'Medical Intensive Care Unit (MICU)'
 WHEN 3 THEN 'Medical/Surgical Intensive Care Unit (MICU/SICU)'
 WHEN 4 THEN 'Surgical Intensive Care Unit (SICU)' ELSE 'Trauma SICU (TSICU)' END"""
_STAY_EVENTS = "FROM li JOIN icustays i ON l_orderkey=i.hadm_id AND (i.stay_id%10=0 OR g%2=0)"

VIEWS: dict[str, str] = {
    "ord": "SELECT *, (o_orderkey*7919)%10007 AS h FROM orders",
    "li": "SELECT *, (l_partkey*31+l_suppkey*7+l_linenumber*3)%9973 AS g FROM lineitem",
    "patients": "SELECT c_custkey AS subject_id, CASE WHEN c_custkey%2=0 THEN 'M' ELSE 'F' END AS gender, 18+c_custkey%73 AS anchor_age FROM customer",
    "admissions": "SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate + (h%24)*INTERVAL '1' HOUR + (h%60)*INTERVAL '1' MINUTE AS admittime, o_orderdate + (h%24+30+h%400)*INTERVAL '1' HOUR + ((h*7)%60)*INTERVAL '1' MINUTE AS dischtime, CASE WHEN h%9=0 THEN 1 ELSE 0 END AS hospital_expire_flag FROM ord",
    "icustays": f"""SELECT o_orderkey*10 AS stay_id, o_orderkey AS hadm_id, o_custkey AS subject_id, {_UNIT} AS first_careunit, o_orderdate + (h%24+h%5)*INTERVAL '1' HOUR + (h%60)*INTERVAL '1' MINUTE AS intime, o_orderdate + (h%24+h%5+4+h%150)*INTERVAL '1' HOUR + ((h*11)%60)*INTERVAL '1' MINUTE AS outtime FROM ord
UNION ALL SELECT o_orderkey*10+1, o_orderkey, o_custkey, {_UNIT}, o_orderdate + 200*INTERVAL '1' HOUR, o_orderdate + (230+h%90)*INTERVAL '1' HOUR FROM ord WHERE h%10=3""",
    "icd_book": "SELECT * FROM (VALUES (0,'I5021',10),(1,'I5023',10),(2,'I5031',10),(3,'I5033',10),(4,'J810',10),(5,'42821',9),(6,'42833',9),(7,'I10',10),(8,'I110',10),(9,'4019',9),(10,'I480',10),(11,'42731',9),(12,'R570',10),(13,'78551',9),(14,'N186',10),(15,'5854',9),(16,'I509',10),(17,'4280',9),(18,'E119',10),(19,'I5021',9),(20,'R571',10),(21,'N184',10),(22,'J449',10),(23,'Z992',10)) AS t(k,icd_code,icd_version)",
    "diagnoses_icd": "SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, icd_code, icd_version FROM li JOIN icd_book ON g%24=k",
    "chemistry": "SELECT l_orderkey AS hadm_id, o_orderdate + (g%4)*INTERVAL '6' HOUR AS charttime, l_partkey*1000+l_suppkey AS specimen_id, CASE WHEN g%11=0 THEN NULL ELSE CAST(4+l_partkey%40 AS DOUBLE)/10 END AS creatinine, CASE WHEN g%13=0 THEN NULL ELSE CAST(5+l_suppkey%70 AS DOUBLE) END AS bun FROM li JOIN ord ON l_orderkey=o_orderkey",
    "cardiac_marker": "SELECT l_orderkey AS hadm_id, o_orderdate + (g%4)*INTERVAL '6' HOUR AS charttime, l_partkey*1000+l_suppkey AS specimen_id, CASE WHEN g%5=0 OR l_linenumber>2 THEN NULL ELSE CAST(200+(l_partkey*13)%20000 AS DOUBLE) END AS ntprobnp FROM li JOIN ord ON l_orderkey=o_orderkey",
    "inputevents": f"SELECT i.stay_id, CASE g%9 WHEN 0 THEN 221794 WHEN 1 THEN 221794 WHEN 2 THEN 228340 WHEN 3 THEN 229639 WHEN 4 THEN 221906 WHEN 5 THEN 221653 WHEN 6 THEN 221986 WHEN 7 THEN 222315 ELSE 225158 END AS itemid, i.intime + (g%90-4)*INTERVAL '1' HOUR AS starttime, CASE WHEN g%9=3 THEN l_quantity/20 ELSE l_quantity*2 END AS amount {_STAY_EVENTS}",
    "outputevents": f"SELECT i.stay_id, CASE g%5 WHEN 0 THEN 226559 WHEN 1 THEN 226560 WHEN 2 THEN 226561 WHEN 3 THEN 227488 ELSE 226599 END AS itemid, i.intime + ((g*3)%100-4)*INTERVAL '1' HOUR AS charttime, l_quantity*40 AS value {_STAY_EVENTS}",
    "urine_output": "SELECT stay_id, charttime, CASE WHEN itemid=227488 THEN -1*value ELSE value END AS urineoutput FROM outputevents WHERE itemid<>226599",
    "vitalsign": f"SELECT i.stay_id, i.intime + (g%48)*INTERVAL '1' HOUR AS charttime, CASE WHEN g%7=0 THEN NULL ELSE CAST(15+g%90 AS DOUBLE) END AS dbp {_STAY_EVENTS}",
    "edstays": "SELECT o_orderkey+5000000 AS stay_id, o_custkey AS subject_id, CASE WHEN h%19=0 OR h%3=0 THEN NULL ELSE o_orderkey END AS hadm_id, o_orderdate - (h%9)*INTERVAL '1' HOUR AS intime FROM ord",
    "triage": "SELECT stay_id, CASE WHEN stay_id%4=0 THEN NULL ELSE CAST(10+(stay_id*17)%120 AS DOUBLE) END AS dbp FROM edstays",
    "ed_vitalsign": "SELECT stay_id, intime + (stay_id%3)*INTERVAL '1' HOUR AS charttime, CAST(30+(stay_id*23)%100 AS DOUBLE) AS dbp, CASE stay_id%7 WHEN 0 THEN 'Atrial Fibrillation' WHEN 1 THEN 'AFib' WHEN 2 THEN 'Sinus' WHEN 3 THEN 'af with rvr' ELSE NULL END AS rhythm FROM edstays",
    "chartevents": f"SELECT i.stay_id, CASE WHEN g%3=0 AND l_linenumber=1 THEN 220048 ELSE 220045 END AS itemid, CASE g%5 WHEN 0 THEN 'AF (Atrial Fibrillation)' WHEN 1 THEN 'SR (Sinus Rhythm)' WHEN 2 THEN 'AFL' ELSE 'ST (Sinus Tachycardia)' END AS value {_STAY_EVENTS}",
    "charlson": "SELECT o_orderkey AS hadm_id, CAST(k%5=0 AS INT) AS myocardial_infarct, CAST(k%2=0 AS INT) AS congestive_heart_failure, CAST(k%9=0 AS INT) AS cerebrovascular_disease, CAST(k%4=0 AS INT) AS diabetes_without_cc, CAST(k%7=0 AS INT) AS diabetes_with_cc, CAST(k%3=0 AS INT) AS renal_disease, CAST(k%6=0 AS INT) AS chronic_pulmonary_disease, k%12 AS charlson_comorbidity_index FROM (SELECT o_orderkey, CASE WHEN h%23=0 THEN NULL ELSE h END AS k FROM ord)",
    "ventilation": "SELECT stay_id, CASE WHEN hadm_id%2=1 THEN 'None' WHEN stay_id%5=0 THEN 'InvasiveVent' ELSE 'SupplementalOxygen' END AS ventilation_status FROM icustays",
    "procedureevents": "SELECT stay_id, CASE WHEN hadm_id%29<>0 THEN 225400 WHEN hadm_id%3=0 THEN 225153 WHEN hadm_id%3=1 THEN 229529 ELSE 225792 END AS itemid FROM icustays",
    # every document is the body of one note; an admission without one has a note of findings
    "document_notes": "SELECT (SELECT min(o_orderkey) FROM orders) + doc_id%(SELECT count(*) FROM orders) AS hadm_id, 10*doc_id + 1 AS note_id, text AS body, 1 + doc_id%28 AS day FROM documents",
    "all_notes": "SELECT hadm_id, note_id, body, day, (hadm_id*7919)%10007 AS h FROM document_notes UNION ALL SELECT o_orderkey, -10*o_orderkey, '', 1, h FROM ord WHERE NOT EXISTS (SELECT 1 FROM document_notes d WHERE d.hadm_id = o_orderkey)",
    "discharge": """SELECT hadm_id, note_id, TIMESTAMP '2001-01-01 08:00:00' + day*INTERVAL '24' HOUR AS charttime,
 COALESCE(body, '') || chr(10)
 || CASE h%5 WHEN 0 THEN 'LVEF: '||CAST(5+h%90 AS STRING)||'%.' WHEN 1 THEN 'Ejection fraction = '||CAST(20+h%50 AS STRING) WHEN 2 THEN 'showed 35% EF and LVEF unknown.' WHEN 3 THEN 'LVEF not assessed.' ELSE '' END || chr(10)
 || CASE h%7 WHEN 0 THEN 'No evidence of cardiogenic shock.' WHEN 1 THEN 'Cardiogenic shock on arrival.' WHEN 2 THEN 'Cardiogenic shock; later ruled out cardiogenic shock.' ELSE '' END || chr(10)
 || CASE h%4 WHEN 0 THEN '' WHEN 1 THEN 'Preadmission Medication list:'||chr(10) ELSE 'Medications on Admission:'||chr(10) END
 || CASE h%6 WHEN 0 THEN '1. Furosemide '||CAST(20*(1+h%9) AS STRING)||' mg PO BID' WHEN 1 THEN '1. Lasix '||CAST(40*(1+h%4) AS STRING)||'mg daily' WHEN 2 THEN '1. Torsemide '||CAST(20*(1+h%5) AS STRING)||' mg PO twice daily' WHEN 3 THEN '1. Bumex '||CAST(CAST(1+h%4 AS DOUBLE)/2 AS STRING)||' mg 2 times a day' WHEN 4 THEN '1. furosemide 12.5 mg daily' ELSE '1. Aspirin 81 mg' END
 || chr(10)||'Discharge Medications:'||chr(10)||'1. Furosemide 500 mg BID' AS text
 FROM all_notes""",
    "norepinephrine_equivalent_dose": "SELECT DISTINCT stay_id FROM inputevents WHERE itemid IN (221906,222315)",
    "dobutamine": "SELECT DISTINCT stay_id FROM inputevents WHERE itemid=221653",
    "milrinone": "SELECT DISTINCT stay_id FROM inputevents WHERE itemid=221986",
    "invasive_line": "SELECT stay_id, CASE WHEN hadm_id%31<>0 THEN 'PICC' WHEN hadm_id%4=0 THEN 'IABP' WHEN hadm_id%4=1 THEN 'Impella Line' ELSE 'Arterial' END AS line_type FROM icustays",
    "first_day_urine_output": "SELECT i.stay_id, SUM(u.urineoutput) AS urineoutput FROM icustays i JOIN urine_output u ON i.stay_id=u.stay_id AND u.charttime>=i.intime AND u.charttime<=i.intime + 24*INTERVAL '1' HOUR GROUP BY i.stay_id",
}


def with_clause(sql: str, views: dict[str, str], extra: dict[str, str] | None = None) -> str:
    """``sql`` behind a WITH list of exactly the views it needs, in order."""
    known = {**(extra or {}), **views}
    picked: dict[str, str] = {}

    def visit(text: str, above: tuple[str, ...] = ()) -> None:
        for name in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if name in known and name not in picked and name not in above:
                visit(known[name], (*above, name))
                picked[name] = known[name]

    visit(sql)
    if not picked:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in picked.items()) + "\n" + sql


#: Base tables that hold rows of admissions, and the column with the admission's id.
ADMISSION_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
#: Views that look at all admissions, whichever are wanted.
WHOLE_VIEWS = {"document_notes", "all_notes", "discharge"}


def overlay_sources(spark: SparkSession, sf_dir: str,
                    stored: dict[str, DataFrame] | None = None) -> Sources:
    """The stand-in tables of one scale folder, as lazy frames resolved once each.

    ``stored`` are frames that stand for base tables of that name.
    """
    files = {name: f"SELECT * FROM {{{name}}}" for name in BASE_TABLES}
    base: dict[str, DataFrame] = dict(stored or {})
    views: dict[str, DataFrame] = {}

    def file(name: str) -> DataFrame:
        if name not in base:
            base[name] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        return base[name]

    def read(name: str) -> DataFrame:
        if name not in views:
            sql = with_clause(f"SELECT * FROM {name}", VIEWS, files)
            used = {n: file(n) for n in BASE_TABLES if f"{{{n}}}" in sql}
            views[name] = spark.sql(sql, **used)
        return views[name]

    def used(name: str) -> DataFrame:
        texts = " ".join(VIEWS.values())
        rows = file(name)
        return rows.select(*[c for c in rows.columns if re.search(rf"\b{c}\b", texts)])

    def deal(save: Callable) -> Sources:
        """Each large base table crosses one exchange, for all views over it together."""
        return overlay_sources(spark, sf_dir, {
            **base, **{name: save(used(name), f"{name}_dealt", key)
                       for name, key in ADMISSION_KEYS.items()}})

    def reduce(admissions: DataFrame, save: Callable) -> Sources:
        keys = admissions.select(F.col("hadm_id").alias("_key")).distinct()
        near = overlay_sources(spark, sf_dir, {
            name: save(used(name).join(keys, F.col(key) == F.col("_key"), "left_semi"),
                       f"{name}_kept", key) for name, key in ADMISSION_KEYS.items()})
        return Sources(lambda name: read(name) if name in WHOLE_VIEWS else near._reader(name))

    return Sources(read, reduce, deal)


def admission_buckets(spark: SparkSession, sf_dir: str, rows: int = 500_000) -> int:
    """Parts for tables dealt by admission: ``rows`` of the largest in each, one a core at least."""
    most = max(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").count()
               for name in ADMISSION_KEYS)
    return max(spark.sparkContext.defaultParallelism, -(-most // rows))
