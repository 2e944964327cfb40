"""SRC-01/02. TSV export: one file per table, every cell a string."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.operators.windows import with_file_order, with_source_order

# The tables an export is read for, and their key columns.
KNOWN_TABLES = {
    "patient-demographics": ("PatientPracticeGuid",),
    "patient-race": ("PatientPracticeGuid", "RaceName"),
    "patient-ethnicity": ("PatientPracticeGuid", "EthnicityName"),
    "patient-gender-identity-sexual-orientation": ("PatientPracticeGuid",),
    "patient-smokingstatus": ("PatientPracticeGuid",),
    "occupation-industry": ("PatientPracticeGuid",),
    "patient-education": ("PatientPracticeGuid",),
    "patient-financial-resources": ("PatientPracticeGuid",),
    "tribal-affiliation": ("PatientPracticeGuid",),
    "patient-encounters": ("PatientPracticeGuid", "EncounterGuid"),
    "patient-encounter-addendums": ("PatientPracticeGuid", "EncounterGuid"),
    "patient-encounter-observations": ("PatientPracticeGuid", "EncounterGuid"),
    "patient-diagnoses": ("PatientPracticeGuid", "DiagnosisGuid"),
    "patient-encounter-diagnoses": ("PatientPracticeGuid", "EncounterGuid", "DiagnosisGuid"),
    "patient-allergy": ("PatientPracticeGuid", "AllergyGuid"),
    "patient-allergy-reactions": ("PatientPracticeGuid", "AllergyGuid"),
    "patient-medications": ("PatientPracticeGuid", "MedicationGuid"),
    "patient-prescriptions": ("PatientPracticeGuid", "PrescriptionGuid", "MedicationGuid"),
    "prescription-transactions": ("PrescriptionGuid",),
    "patient-insurances": ("PatientInsurancePlanGuid", "PatientPracticeGuid"),
    "superbill-insurances": ("PatientInsurancePlanGuid", "PatientPracticeGuid"),
    "patient-guarantor": ("PatientPracticeGuid",),
    "patient-family-medical-history": ("PatientPracticeGuid", "RelativeGuid"),
    "patient-family-history-diagnoses": ("PatientPracticeGuid", "RelativeGuid"),
    "patient-immunizations": ("PatientPracticeGuid", "ImmunizationGuid"),
    "patient-advance-directives": ("PatientPracticeGuid",),
    "patient-documents": ("PatientPracticeGuid", "DocumentGuid"),
    "providers": ("ProviderGuid",),
    "facilities": ("FacilityGuid",),
    "pinned-notes": ("PatientPracticeGuid",),
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, on any file system Spark can reach, exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _has_open_quote(spark: SparkSession, path: str) -> bool:
    """Whether any line leaves a quote open, so that a cell spans lines."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).limit(1).isEmpty()


def read_tsv_table(
    spark: SparkSession, root: str, name: str, keys: Sequence[str] = (), multi_line: bool | None = None
) -> DataFrame:
    """SRC-01. One table with its row order; a missing file is an empty table.

    Lines are read in parallel splits. Only a file whose cells really span
    lines (checked by a cheap scan unless ``multi_line`` is given) is read
    as one stream.
    """
    path = f"{root.rstrip('/')}/{name}.tsv"
    if not path_exists(spark, path):
        columns = list(keys) or list(KNOWN_TABLES.get(name, ()))
        empty = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return with_source_order(spark.createDataFrame([], empty))
    if multi_line is None:
        multi_line = _has_open_quote(spark, path)
    reader = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    reader = reader.option("nullValue", "\u0000").option("maxCharsPerColumn", -1).option("encoding", "UTF-8")
    return with_file_order(reader.csv(path))


def read_tsv_export(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SRC-02. Every known table; nothing is read before a job asks for it."""
    return {name: read_tsv_table(spark, root, name, keys) for name, keys in KNOWN_TABLES.items()}
