"""The source tables, their used columns, and readers that prune to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# column -> type, only what the pipelines read
SCHEMAS: dict[str, dict[str, str]] = {
    "icustays": {
        "stay_id": "bigint", "hadm_id": "bigint", "subject_id": "bigint",
        "first_careunit": "string", "intime": "timestamp_ntz",
        "outtime": "timestamp_ntz"},
    "admissions": {
        "hadm_id": "bigint", "subject_id": "bigint", "admittime": "timestamp_ntz",
        "dischtime": "timestamp_ntz", "hospital_expire_flag": "int"},
    "diagnoses_icd": {
        "hadm_id": "bigint", "seq_num": "int", "icd_code": "string",
        "icd_version": "int"},
    "patients": {"subject_id": "bigint", "gender": "string", "anchor_age": "int"},
    "inputevents": {
        "stay_id": "bigint", "itemid": "int", "starttime": "timestamp_ntz",
        "amount": "double"},
    "outputevents": {
        "stay_id": "bigint", "itemid": "int", "charttime": "timestamp_ntz",
        "value": "double"},
    "chartevents": {"stay_id": "bigint", "itemid": "int", "value": "string"},
    "procedureevents": {"stay_id": "bigint", "itemid": "int"},
    "chemistry": {
        "hadm_id": "bigint", "charttime": "timestamp_ntz", "specimen_id": "bigint",
        "creatinine": "double", "bun": "double"},
    "cardiac_marker": {
        "hadm_id": "bigint", "charttime": "timestamp_ntz", "specimen_id": "bigint",
        "ntprobnp": "double"},
    "vitalsign": {
        "stay_id": "bigint", "charttime": "timestamp_ntz", "dbp": "double"},
    "charlson": {
        "hadm_id": "bigint", "myocardial_infarct": "int",
        "congestive_heart_failure": "int", "cerebrovascular_disease": "int",
        "diabetes_without_cc": "int", "diabetes_with_cc": "int",
        "renal_disease": "int", "chronic_pulmonary_disease": "int",
        "charlson_comorbidity_index": "int"},
    "ventilation": {"stay_id": "bigint", "ventilation_status": "string"},
    "discharge": {
        "hadm_id": "bigint", "note_id": "bigint", "charttime": "timestamp_ntz",
        "text": "string"},
    "edstays": {
        "stay_id": "bigint", "subject_id": "bigint", "hadm_id": "bigint",
        "intime": "timestamp_ntz"},
    "triage": {"stay_id": "bigint", "dbp": "double"},
    "ed_vitalsign": {
        "stay_id": "bigint", "charttime": "timestamp_ntz", "dbp": "double",
        "rhythm": "string"},
    "first_day_urine_output": {"stay_id": "bigint", "urineoutput": "double"},
    "urine_output": {
        "stay_id": "bigint", "charttime": "timestamp_ntz", "urineoutput": "double"},
    "norepinephrine_equivalent_dose": {"stay_id": "bigint"},
    "dobutamine": {"stay_id": "bigint"},
    "milrinone": {"stay_id": "bigint"},
    "invasive_line": {"stay_id": "bigint", "line_type": "string"},
}


class Sources:
    """Named source tables over any reader ``name -> DataFrame``."""

    def __init__(self, reader: Callable[[str], DataFrame],
                 reduce: Callable[[DataFrame, Callable], Sources] | None = None,
                 deal: Callable[[Callable], Sources] | None = None):
        self._reader, self._reduce, self._deal = reader, reduce, deal

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Sources:
        return cls(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str | None = None) -> Sources:
        prefix = f"{schema}." if schema else ""
        return cls(lambda name: spark.read.table(prefix + name))

    def of_admissions(self, admissions: DataFrame, save: Callable) -> Sources:
        """These tables with, of those kept by admission or stay, at least the rows of
        ``admissions`` (hadm_id), and fewer others where the reader can leave them out at its
        files; what is read for that is stored with ``save``."""
        return self if self._reduce is None else self._reduce(admissions, save)

    def by_admission(self, save: Callable) -> Sources:
        """These tables, all their rows, read from files that ``save`` dealt by admission where
        the reader knows which those are."""
        return self if self._deal is None else self._deal(save)

    def table(self, name: str, *columns: str) -> DataFrame:
        """One source table, pruned to ``columns`` (default: the used ones), typed."""
        schema = SCHEMAS[name]
        wanted = columns or tuple(schema)
        df = self._reader(name)
        return df.select(*[F.col(c).cast(schema[c]).alias(c) for c in wanted])
