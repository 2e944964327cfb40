"""Loud date handling for whole tables: unreadable cells become rows.

Raising inside an executor would end a job for one bad cell, so the mappings
give NULL and this job lists every cell they could not read. A run is only
good when the list is empty (``require_clean``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.functions.dates import parse_problem
from chartweave.functions.text import clean_cell

# Columns of each raw table that hold a date or a timestamp.
DATE_COLUMNS = {
    "patient-demographics": ("BirthDate",),
    "patient-encounters": ("DateOfService", "SignedDateTimeUtc", "LastModifiedDateTimeUtc"),
    "patient-encounter-addendums": ("LastModifiedDateTimeUtc",),
    "patient-encounter-observations": ("ObservationDateTimeUtc", "LastModifiedDateTimeUtc"),
    "patient-diagnoses": ("StartDate", "StopDate", "LastModifiedDateTimeUtc"),
    "patient-allergy": ("StartDate",),
    "patient-medications": ("StartDate", "StopDate", "LastModifiedDateTimeUtc"),
    "patient-prescriptions": ("DateOfService",),
    "prescription-transactions": ("TransactionDisplayDateTimeUtc",),
    "patient-insurances": ("EffectiveFromDate", "EffectiveToDate"),
    "patient-guarantor": ("DateOfBirth",),
    "patient-family-history-diagnoses": ("OnsetDate",),
    "patient-immunizations": ("DateAdministered", "AdministeredDate", "AdministeredDateTimeUtc", "ExpirationDate"),
    "patient-advance-directives": ("DateRecorded",),
    "patient-documents": ("DocumentDate",),
    "patient-smokingstatus": ("EffectiveDate",),
    "occupation-industry": ("EffectiveDate", "EffectiveDateFrom"),
    "patient-education": ("EffectiveDate",),
    "patient-financial-resources": ("EffectiveDate",),
    "tribal-affiliation": ("EffectiveDate",),
    "PERSON": ("BIRTH_DT_TM", "DECEASED_DT_TM"),
    "ENCOUNTER": ("REG_DT_TM", "DISCH_DT_TM"),
    "CLINICAL_EVENT": ("EVENT_END_DT_TM", "VALID_FROM_DT_TM", "VALID_UNTIL_DT_TM"),
}


def unreadable_dates(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Cells of one table that no date rule reads: table, row, column, reason, raw text."""
    cols = [c for c in cols if c in df.columns]
    checks = [
        F.struct(F.lit(c).alias("column_name"), parse_problem(clean_cell(c)).alias("reason"), F.col(c).cast("string").alias("raw_value"))
        for c in cols
    ]
    empty = F.array().cast("array<struct<column_name:string,reason:string,raw_value:string>>")
    bad = F.filter(F.array(*checks), lambda x: x["reason"].isNotNull()) if checks else empty
    rows = df.select("_ord", F.explode(bad).alias("p"))
    return rows.select(F.lit(table).alias("table_name"), "_ord", "p.column_name", "p.reason", "p.raw_value")


def date_problems(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Unreadable date cells of a whole export."""
    pieces = [unreadable_dates(tables[t], t, cols) for t, cols in DATE_COLUMNS.items() if t in tables]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def require_clean(problems: DataFrame) -> None:
    """End the run when anything was quarantined. Names columns, never values."""
    counts = problems.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))
    worst = counts.orderBy(F.desc("n"), "table_name", "column_name").collect()  # a row for each date column at most
    if worst:
        listed = ", ".join(f"{r.table_name}.{r.column_name}: {r.n}" for r in worst)
        raise ValueError(f"unrecognized date/time cells were quarantined ({listed})")
