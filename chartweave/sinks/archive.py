"""SNK-02/03/04. Archive index, encounter rows and patient rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.text import safe_token, strip
from chartweave.operators.joins import match_documents
from chartweave.operators.windows import block_scan, order_block

# Complaints and note texts on one page of a patient's search entry.
PAGE_PARTS = 200


def display_name() -> Column:
    return F.nullif(F.concat_ws(" ", "given_name", "family_name"), F.lit(""))


def archive_index(patients: DataFrame, encounters: DataFrame, page_parts: int = PAGE_PARTS) -> DataFrame:
    """SNK-02. Searchable entries: the whole text of a patient, in pages.

    Page 0 also holds the name and the birth date. A part is never cut, and no
    more than ``page_parts`` of them are gathered in one row.
    """
    enc = encounters.select("patient_id", "_ord", "chief_complaint", "sections")
    complaints = enc.select("patient_id", F.lit(0).alias("tier"), "_ord", F.lit(0).alias("i"), F.col("chief_complaint").alias("part"))
    notes = enc.select("patient_id", F.lit(1).alias("tier"), "_ord", F.posexplode("sections.text").alias("i", "part"))
    parts = complaints.unionByName(notes).filter(F.coalesce("part", F.lit("")) != "")
    numbered = block_scan(parts, ["patient_id"], ["tier", "_ord", "i"], F.struct("tier", order_block("_ord")), {"rn": ("row_number", None)})
    paged = numbered.select("patient_id", F.floor((F.col("rn") - 1) / page_parts).alias("page"), F.struct("rn", "part").alias("p"))
    text = paged.groupBy("patient_id", "page").agg(F.sort_array(F.collect_list("p")).alias("_p")).select("patient_id", "page", F.array_join("_p.part", " ").alias("_text"))
    counts = encounters.groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounter_count"))
    p = patients.join(text, "patient_id", "left").join(counts, "patient_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))
    dob = F.col("birth_date").cast("string")
    first = F.col("page") == 0
    hay = F.lower(F.concat_ws(" ", F.when(first, display_name()), F.when(first, dob), F.nullif("_text", F.lit(""))))
    return p.select(safe_token("patient_id", "unknown").alias("id"), F.coalesce(display_name(), F.col("patient_id")).alias("display_name"), dob.alias("dob"), F.coalesce("encounter_count", F.lit(0)).alias("encounter_count"), "page", hay.alias("search"))


def encounter_label() -> Column:
    kind = F.coalesce(F.nullif("note_type", F.lit("")), F.nullif("encounter_type", F.lit("")))
    label = F.concat_ws(" — ", F.col("date_of_service").cast("string"), kind)
    return F.coalesce(F.nullif(label, F.lit("")), F.col("encounter_id"))


def archive_encounters(encounters: DataFrame, docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """SNK-03. Encounter rows with their file and verdict.

    ``docs`` has ``patient_id, file_name``; ``verdicts`` has ``encounter_id, verdict``.
    """
    files = match_documents(encounters, docs).select("encounter_id", F.col("file_name").alias("pdf_name"))
    # Files and verdicts grow with the encounters: sorted, never sent to the driver.
    e = encounters.join(files.hint("merge"), "encounter_id", "left").join(verdicts.select("encounter_id", F.col("verdict").alias("qa_verdict")).hint("merge"), "encounter_id", "left")
    texts = F.transform("sections", lambda s: F.struct(s["kind"].alias("kind"), s["title"].alias("title"), F.coalesce(strip(s["text"]), F.lit("")).alias("text")))
    return e.select("patient_id", "encounter_id", encounter_label().alias("label"), "date_of_service", "chief_complaint", "note_type", "pdf_name", "qa_verdict", texts.alias("sections"))


def archive_patients(patients: DataFrame, conditions: DataFrame, allergies: DataFrame, medications: DataFrame) -> DataFrame:
    """SNK-04. Named problems, allergies and medications, one row per name in order."""
    def names(df: DataFrame, kind: str, col: str) -> DataFrame:
        rows = df.filter(F.coalesce(F.col(col), F.lit("")) != "").select("patient_id", F.lit(kind).alias("list"), F.col(col).alias("name"), "_ord")
        return block_scan(rows, ["patient_id"], ["_ord"], order_block("_ord"), {"position": ("row_number", None)}).drop("_ord")

    lists = names(conditions, "conditions", "display").unionByName(names(allergies, "allergies", "substance")).unionByName(names(medications, "medications", "display_name"))
    return lists.join(patients.select("patient_id", F.coalesce(display_name(), F.lit("Unknown")).alias("display_name")), "patient_id")
