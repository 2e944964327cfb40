"""SQL-dump export to canonical tables (MAP-13..16, JN-03, JN-16, AGG-08)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.functions.codes import VITALS, lookup
from chartweave.functions.dates import parse_date, parse_dt
from chartweave.functions.text import clean_cell, html_to_text
from chartweave.operators.filters import ALLERGY_PREFIXES, current_versions, route_event
from chartweave.operators.folds import assemble_blobs
from chartweave.operators.joins import PAGE_ROWS, assemble_records, keyed, resolve_codes
from chartweave.operators.sets import residual
from chartweave.operators.windows import order_block
from chartweave.sources.sqldump import dump_block

NS = "dump"
STORAGE_SET = "25"
# Titles of remotely stored documents by storage meaning.
REMOTE_TITLES = {"DICOM_SIUID": "DICOM study (remote)", "OTG": "Document Imaging document (remote)"}
VITAL_BY_TITLE = {display.lower(): code for _, code, display, _, _ in VITALS}


def _prov(table: str, source_id: Column) -> Column:
    return F.struct(F.lit(NS).alias("source_system"), F.lit(f"{table}.sql").alias("source_file"), source_id.alias("source_id")).alias("provenance")


def _ext(df: DataFrame, mapped: str) -> Column:
    """SET-02, with cells beyond the declared columns."""
    tail = residual(df.columns, mapped.split(), NS, skip=("_ord", "_extra", *[c for c in df.columns if c.startswith("_") or c.islower()]))
    if "_extra" not in df.columns:
        return tail
    return F.map_concat(tail, F.transform_keys(F.coalesce("_extra", F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit(f"{NS}:"), k)))


def _put(base: Column, *pairs: tuple[str, Column]) -> Column:
    """Add filled entries to a map."""
    entries = F.filter(F.array(*[F.struct(F.lit(f"{NS}:{k}").alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull())
    return F.map_concat(base, F.map_from_entries(entries))


def unpivot_aliases(alias: DataFrame, key: str = "PERSON_ID") -> DataFrame:
    """NST-12. Every filled column of an alias row is one identifier."""
    cols = [c for c in alias.columns if c != key and not c.startswith("_")]
    entries = F.array(*[F.struct(F.lit("other").alias("kind"), clean_cell(c).alias("value"), F.lit(f"{NS}:{c}").alias("system")) for c in cols])
    found = F.filter(entries, lambda e: e["value"].isNotNull())
    rows = keyed(alias, key).select(F.col(key).alias("patient_id"), F.posexplode(found).alias("position", "i"), "_ord")
    return rows.select("patient_id", "i.kind", "i.value", "i.system", "position", "_ord")


def map_persons(person: DataFrame, code_value: DataFrame) -> DataFrame:
    """MAP-13. Persons; the alias identifiers are ``unpivot_aliases``."""
    p = resolve_codes(keyed(person, "PERSON_ID"), {"SEX_CD": "sex"}, code_value)
    deceased = parse_dt(clean_cell("DECEASED_DT_TM"))
    ext = _put(_ext(p, "PERSON_ID NAME_FULL_FORMATTED BIRTH_DT_TM SEX_CD DECEASED_DT_TM"), ("DECEASED_DT_TM", F.date_format(deceased, "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return p.select(
        F.col("PERSON_ID").alias("patient_id"), F.lit(None).cast("string").alias("given_name"), clean_cell("NAME_FULL_FORMATTED").alias("family_name"),
        parse_date(clean_cell("BIRTH_DT_TM")).alias("birth_date"), F.col("sex_display").alias("sex"),
        F.when(deceased.isNotNull(), "Deceased").alias("status"), ext.alias("extensions"), _prov("PERSON", F.col("PERSON_ID")), "_ord",
    )


def map_dump_encounters(enc: DataFrame, code_value: DataFrame) -> DataFrame:
    """MAP-14. Encounters; the calendar date of registration is the service date."""
    e = resolve_codes(keyed(keyed(enc, "ENCNTR_ID"), "PERSON_ID"), {"ENCNTR_TYPE_CD": "type"}, code_value)
    disch = parse_dt(clean_cell("DISCH_DT_TM"))
    ext = _put(_ext(e, "ENCNTR_ID PERSON_ID ENCNTR_TYPE_CD REG_DT_TM DISCH_DT_TM REASON_FOR_VISIT"), ("DISCH_DT_TM", F.date_format(disch, "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return e.select(
        F.col("ENCNTR_ID").alias("encounter_id"), F.col("PERSON_ID").alias("patient_id"), parse_date(clean_cell("REG_DT_TM")).alias("date_of_service"),
        clean_cell("REASON_FOR_VISIT").alias("chief_complaint"), F.col("type_display").alias("encounter_type"), ext.alias("extensions"),
        _prov("ENCOUNTER", F.col("ENCNTR_ID")), "_ord",
    )


EVENT_MAPPED = "EVENT_ID PERSON_ID ENCNTR_ID EVENT_TITLE_TEXT RESULT_VAL RESULT_UNITS_CD RESULT_STATUS_CD EVENT_END_DT_TM VALID_FROM_DT_TM VALID_UNTIL_DT_TM"


def split_events(events: DataFrame, blobs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document events, discrete events, superseded versions)."""
    keyed_events = keyed(events, "PERSON_ID").withColumn("EVENT_ID", clean_cell("EVENT_ID"))
    current, closed = current_versions(keyed_events)
    current = current.filter(F.col("EVENT_ID").isNotNull())
    bodies = keyed(blobs, "EVENT_ID").select("EVENT_ID").unionByName(keyed(results, "EVENT_ID").select("EVENT_ID")).distinct()
    return current.join(bodies, "EVENT_ID", "left_semi"), current.join(bodies, "EVENT_ID", "left_anti"), closed


def map_events(discrete: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MAP-15. (observations, conditions, allergies) by the shape of the event."""
    title, result = clean_cell("EVENT_TITLE_TEXT"), clean_cell("RESULT_VAL")
    ev = discrete.withColumn("_route", route_event(title)).withColumn("_x", _ext(discrete, EVENT_MAPPED))
    base = [F.col("EVENT_ID"), F.col("PERSON_ID").alias("patient_id")]
    prov = _prov("CLINICAL_EVENT", F.col("EVENT_ID"))
    code = lookup(VITAL_BY_TITLE, F.lower(title))
    measured = result.isNotNull() & clean_cell("RESULT_UNITS_CD").isNotNull()
    obs = ev.filter(F.col("_route") == "other").select(
        *base, clean_cell("ENCNTR_ID").alias("encounter_id"),
        F.when(code.isNotNull(), "vital-signs").when(measured, "laboratory").otherwise("other").alias("category"),
        code.alias("code"), title.alias("display"), result.alias("value"), clean_cell("RESULT_UNITS_CD").alias("unit"),
        parse_dt(clean_cell("EVENT_END_DT_TM")).alias("effective_at"), parse_dt(clean_cell("VALID_FROM_DT_TM")).alias("recorded_at"),
        F.col("_x").alias("extensions"), prov, "_ord",
    ).withColumnRenamed("EVENT_ID", "observation_id")
    cond = ev.filter(F.col("_route") == "problem").select(
        *base, F.coalesce(title, result).alias("display"), parse_dt(clean_cell("VALID_FROM_DT_TM")).alias("recorded_at"), F.lit(True).alias("active"),
        _put(F.col("_x"), ("RESULT_VAL", result)).alias("extensions"), prov, "_ord",
    ).withColumnRenamed("EVENT_ID", "condition_id")
    prefix = "|".join(ALLERGY_PREFIXES)
    rest = F.trim(F.regexp_replace(title, f"(?i)^(?:{prefix})", ""))
    allergy = ev.filter(F.col("_route") == "allergy").select(
        *base, F.coalesce(F.nullif(rest, F.lit("")), title).alias("substance"), F.lit("other").alias("category"),
        F.filter(F.array(result), lambda r: r.isNotNull()).alias("reactions"), F.lit(True).alias("active"), F.col("_x").alias("extensions"), prov, "_ord",
    ).withColumnRenamed("EVENT_ID", "allergy_id")
    return obs, cond, allergy


def map_event_documents(doc_events: DataFrame, blobs: DataFrame, results: DataFrame, code_value: DataFrame, page_rows: int = PAGE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MAP-16, JN-16. (note sections, document artifacts, undecoded parts).

    A section row is one page of the joined text of an event.
    """
    text, undecoded = assemble_blobs(blobs, page_rows)
    base = doc_events.select("EVENT_ID", F.col("PERSON_ID").alias("patient_id"), clean_cell("ENCNTR_ID").alias("encounter_id"),
                             clean_cell("EVENT_TITLE_TEXT").alias("title"), parse_dt(clean_cell("EVENT_END_DT_TM")).alias("generated_at"), "_ord")
    sections = base.join(text, "EVENT_ID").select(
        "EVENT_ID", "patient_id", "encounter_id", "page", F.lit("narrative").alias("kind"), F.col("body").alias("html"), html_to_text("body").alias("text"), "title", "_ord")
    local = sections.filter(F.col("page") == 0).select(
        F.col("EVENT_ID").alias("document_id"), "patient_id", "encounter_id", F.lit("text/plain").alias("mime_type"), "title",
        F.lit(None).cast("string").alias("storage_class"), F.lit(None).cast("string").alias("blob_handle"), "_ord")
    local = local.join(base.select(F.col("EVENT_ID").alias("document_id"), "generated_at"), "document_id")
    r = resolve_codes(keyed(results, "EVENT_ID"), {"STORAGE_CD": "store"}, code_value)
    meaning = F.when(F.col("store_set") == STORAGE_SET, F.col("store_meaning"))
    remote = r.select("EVENT_ID", clean_cell("BLOB_HANDLE").alias("blob_handle"), meaning.alias("storage_class"), F.col("_ord").alias("_rord"))
    remote = base.join(remote, "EVENT_ID").select(
        F.coalesce("blob_handle", "EVENT_ID").alias("document_id"), "patient_id", "encounter_id", F.lit("application/octet-stream").alias("mime_type"),
        lookup(REMOTE_TITLES, "storage_class").alias("title"), "storage_class", "blob_handle", F.col("_rord").alias("_ord"), F.lit(None).cast("timestamp").alias("generated_at"))
    return sections, local.unionByName(remote), undecoded


def superseded(closed: DataFrame, blobs: DataFrame, encounters: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """AGG-08. Closed versions with their text, kept with their encounter."""
    payload = _ext(closed, "")
    rows = closed.select("EVENT_ID", clean_cell("ENCNTR_ID").alias("encounter_id"), payload.alias("payload"), "_ord")
    rows = rows.join(encounters.select("encounter_id").distinct(), "encounter_id", "left_semi")
    text, _ = assemble_blobs(blobs, page_rows)
    return rows.join(text, "EVENT_ID", "left").select("encounter_id", "EVENT_ID", "payload", F.coalesce("page", F.lit(0)).alias("page"), "body", "_ord")


def map_dump_export(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every canonical table of a SQL-dump export."""
    codes = tables["CODE_VALUE"]
    encounters = map_dump_encounters(tables["ENCOUNTER"], codes)
    docs, discrete, closed = split_events(tables["CLINICAL_EVENT"], tables["CE_BLOB"], tables["CE_BLOB_RESULT"])
    obs, cond, allergy = map_events(discrete)
    sections, artifacts, undecoded = map_event_documents(docs, tables["CE_BLOB"], tables["CE_BLOB_RESULT"], codes)
    return {
        "patients": map_persons(tables["PERSON"], codes), "identifiers": unpivot_aliases(tables["PERSON_ALIAS"]), "encounters": encounters,
        "observations": obs, "conditions": cond, "allergies": allergy, "sections": sections, "documents": artifacts, "undecoded_blobs": undecoded,
        "superseded": superseded(closed, tables["CE_BLOB"], encounters),
        "event_patients": docs.select("EVENT_ID", F.col("PERSON_ID").alias("patient_id")),
    }


def assemble(canonical: Mapping[str, DataFrame], page_rows: int = PAGE_ROWS) -> DataFrame:
    """JN-03. Whole records of a dump export, one row per patient and page.

    Note sections and closed versions come with their encounter, parts that can't be decoded
    with their event; the patient of a closed version is that of its encounter.
    """
    tables = {n: canonical[n] for n in ("identifiers", "encounters", "observations", "conditions", "allergies", "documents", "sections")}
    owner = canonical["encounters"].select("encounter_id", "patient_id").dropDuplicates(["encounter_id"])
    tables["superseded"] = canonical["superseded"].join(owner, "encounter_id")
    of_event = canonical["sections"].select("EVENT_ID", "patient_id").unionByName(canonical["event_patients"]).dropDuplicates(["EVENT_ID"])
    tables["undecoded_blobs"] = canonical["undecoded_blobs"].join(of_event, "EVENT_ID")
    second = {"identifiers": "position", "sections": "page", "superseded": "page"}
    children = {}
    for name, df in tables.items():
        item = F.struct(*[c for c in df.columns if c not in ("patient_id", "_ord")])
        block = dump_block() if isinstance(df.schema["_ord"].dataType, T.StructType) else order_block("_ord")
        children[name] = (df, item, ["_ord", second[name]] if name in second else ["_ord"], block)
    return assemble_records(canonical["patients"].drop("_ord"), children, "patient_id", page_rows)
