"""TSV export to canonical tables (MAP-01..12, JN-02).

Tables stay normalised: a list that can grow with the data (addenda, diagnosis
links, transactions) is a child table keyed by its parent. ``assemble`` nests
them for a sink that needs whole records.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.codes import (
    BENEFIT_ORDER, PAIN_CODES, VITAL_DISPLAY_BY_CODE, extract_icd10, extract_snomed, lookup, pain_display, plan_type_suffix,
)
from chartweave.functions.dates import parse_date, parse_dt
from chartweave.functions.text import clean_cell, clean_numeric, format_phone, with_html_text, with_note_html
from chartweave.operators.filters import has_note, skip_reason, split_by_reason
from chartweave.operators.folds import (
    derive_bmi, display_date, distinct_in_order, paged_concat, resolve_status, script_prefix, social_history,
)
from chartweave.operators.joins import PAGE_ROWS, assemble_records, attach_first, attach_last, first_per_key, keyed, tiered_lookup
from chartweave.operators.sets import residual
from chartweave.operators.windows import order_block

NS = "tsv"
Tables = Mapping[str, DataFrame]


class Row:
    """Cleaned columns of one raw table; a column the file lacks is NULL."""

    def __init__(self, df: DataFrame, table: str, mapped: str) -> None:
        self.table, self.mapped = table, mapped.split()
        self.columns = [c for c in df.columns if not c.startswith("__")]
        # Each consumed cell is cleaned once, in a column of its own.
        used = [c for c in self.columns if c in self.mapped]
        self.df = df.withColumns({f"__{c}": clean_cell(F.col(f"`{c}`")) for c in used}) if used else df

    def has(self, col: str) -> bool:
        return col in self.columns

    def raw(self, col: str) -> Column:
        return F.col(f"`{col}`") if self.has(col) else F.lit(None).cast("string")

    def text(self, col: str) -> Column:
        if not self.has(col):
            return F.lit(None).cast("string")
        return F.col(f"`__{col}`") if col in self.mapped else clean_cell(self.raw(col))

    def number(self, col: str) -> Column:
        return clean_numeric(self.raw(col))

    def flag(self, col: str) -> Column:
        return F.coalesce(F.lower(self.text(col)) == "true", F.lit(False))

    def date(self, col: str) -> Column:
        return parse_date(self.raw(col)) if self.has(col) else F.lit(None).cast("date")

    def moment(self, col: str) -> Column:
        return parse_dt(self.raw(col)) if self.has(col) else F.lit(None).cast("timestamp")

    def extensions(self, keep: tuple[str, ...] = ()) -> Column:
        return residual(self.columns, [m for m in self.mapped if m not in keep], NS).alias("extensions")

    def provenance(self, source_id: Column) -> Column:
        return F.struct(
            F.lit(NS).alias("source_system"), F.lit(f"{self.table}.tsv").alias("source_file"), source_id.alias("source_id")
        ).alias("provenance")

    def select(self, *cols: Column, source_id: Column, keep: tuple[str, ...] = ()) -> DataFrame:
        return self.df.select(*cols, self.extensions(keep), self.provenance(source_id), "_ord")


def present_text(*parts: Column) -> Column:
    """Parts joined by a space, NULL when all are missing."""
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def contact_list(*pairs: tuple[str, Column]) -> Column:
    """NST-14. ``ARRAY<STRUCT<kind,value>>`` without empty entries."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs])
    return F.filter(entries, lambda e: e["value"].isNotNull())


def address(line1: Column, line2: Column, city: Column, state: Column, postal: Column) -> Column:
    return F.struct(
        line1.alias("line1"), line2.alias("line2"), city.alias("city"), state.alias("state"), postal.alias("postal_code")
    )


def map_guarantors(tables: Tables) -> DataFrame:
    """MAP-01. Guarantor struct of each patient; the last row wins."""
    r = Row(keyed(tables["patient-guarantor"], "PatientPracticeGuid"), "patient-guarantor", (
        "PatientPracticeGuid FirstName LastName BillingPatientRelationshipOption BillingPaymentType DateOfBirth "
        "BillingGenderOption SSNumber Address1 City State Zip PrimaryPhoneNumber SecondaryPhoneNumber"
    ))
    guarantor = F.struct(
        present_text(r.text("FirstName"), r.text("LastName")).alias("name"),
        r.text("BillingPatientRelationshipOption").alias("relationship"),
        r.text("BillingPaymentType").alias("payment_preference"),
        r.date("DateOfBirth").alias("birth_date"),
        r.text("BillingGenderOption").alias("sex"),
        r.text("SSNumber").alias("ssn"),
        address(r.text("Address1"), F.lit(None).cast("string"), r.text("City"), r.text("State"), r.text("Zip")).alias("address"),
        contact_list(
            ("phone-home", format_phone(r.text("PrimaryPhoneNumber"))), ("phone-other", format_phone(r.text("SecondaryPhoneNumber")))
        ).alias("phones"),
        r.extensions(),
    )
    return r.df.select(F.col("PatientPracticeGuid").alias("patient_id"), guarantor.alias("guarantor"), "_ord")


def map_patients(tables: Tables) -> DataFrame:
    """MAP-01. Demographics with race, ethnicity, gender identity and guarantor."""
    r = Row(keyed(tables["patient-demographics"], "PatientPracticeGuid"), "patient-demographics", (
        "PatientPracticeGuid FirstName MiddleName LastName NameSuffix Gender BirthDate IsActive MothersMaidenName "
        "PreferredLanguage Address1 Address2 AddressCity AddressState AddressZipCode HomePhone MobilePhone OfficePhone "
        "Email SSN UnPinnedNote"
    ))
    pid = F.col("PatientPracticeGuid")
    ids = F.array(
        F.struct(F.lit("source-guid").alias("kind"), pid.alias("value"), F.lit(NS).alias("system")),
        F.struct(F.lit("ssn").alias("kind"), r.text("SSN").alias("value"), F.lit(None).cast("string").alias("system")),
    )
    home = address(r.text("Address1"), r.text("Address2"), r.text("AddressCity"), r.text("AddressState"), r.text("AddressZipCode"))
    no_home = F.coalesce(r.text("Address1"), r.text("Address2"), r.text("AddressCity"), r.text("AddressState"), r.text("AddressZipCode")).isNull()
    patients = r.select(
        pid.alias("patient_id"),
        r.text("FirstName").alias("given_name"), r.text("MiddleName").alias("middle_name"),
        r.text("LastName").alias("family_name"), r.text("NameSuffix").alias("suffix"),
        r.date("BirthDate").alias("birth_date"), r.text("Gender").alias("sex"),
        r.text("PreferredLanguage").alias("language"), r.text("MothersMaidenName").alias("mothers_maiden_name"),
        F.when(r.flag("IsActive"), "Active").otherwise("Inactive").alias("status"),
        F.filter(ids, lambda i: i["value"].isNotNull()).alias("identifiers"),
        contact_list(
            ("phone-home", format_phone(r.text("HomePhone"))), ("phone-mobile", format_phone(r.text("MobilePhone"))),
            ("phone-work", format_phone(r.text("OfficePhone"))), ("email", r.text("Email")),
        ).alias("telecom"),
        F.when(no_home, F.array().cast("array<struct<line1:string,line2:string,city:string,state:string,postal_code:string>>"))
        .otherwise(F.array(home)).alias("addresses"),
        source_id=pid,
    )
    giso = keyed(tables["patient-gender-identity-sexual-orientation"], "PatientPracticeGuid")
    g = Row(giso, "", "")
    giso = giso.select(
        F.col("PatientPracticeGuid").alias("patient_id"), g.text("GenderIdentity").alias("gender_identity"),
        g.text("SexualOrientation").alias("sexual_orientation"), F.col("_ord").alias("_gord"),
    )
    patients = attach_first(patients, giso, "patient_id", ["_gord"]).drop("_gord")
    for table, col, out in (("patient-race", "RaceName", "race"), ("patient-ethnicity", "EthnicityName", "ethnicity")):
        rows = keyed(tables[table], "PatientPracticeGuid").withColumnRenamed("PatientPracticeGuid", "patient_id")
        names = distinct_in_order(rows, "patient_id", clean_cell(col), "_ord", out)
        patients = patients.join(names, "patient_id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    guarantors = map_guarantors(tables).withColumnRenamed("_ord", "_gord")
    return attach_last(patients, guarantors, "patient_id", ["_gord"]).drop("_gord")


def map_patient_notes(tables: Tables, page_rows: int = PAGE_ROWS) -> DataFrame:
    """AGG-05. Un-pinned note, then typed pinned notes, one line each."""
    demo = keyed(tables["patient-demographics"], "PatientPracticeGuid")
    first = demo.select(
        F.col("PatientPracticeGuid").alias("patient_id"), Row(demo, "", "").text("UnPinnedNote").alias("note"),
        F.lit(0).alias("_tier"), "_ord",
    )
    pins = keyed(tables["pinned-notes"], "PatientPracticeGuid")
    p = Row(pins, "", "")
    pinned = F.when(p.text("NoteText").isNotNull(), F.concat(F.coalesce(p.text("NoteType"), F.lit("Note")), F.lit(": "), p.text("NoteText")))
    second = pins.select(F.col("PatientPracticeGuid").alias("patient_id"), pinned.alias("note"), F.lit(1).alias("_tier"), "_ord")
    block = F.struct(F.col("_tier"), order_block("_ord"))
    return paged_concat(first.unionByName(second), ["patient_id"], F.col("note"), ["_tier", "_ord"], block, "\n", page_rows, "notes")


SOAP = (("Subjective", "subjective"), ("Objective", "objective"), ("Assessment", "assessment"), ("Plan", "plan"))


def add_section_text(r: Row) -> None:
    """Rich HTML and plain text of each note column, as columns of the row."""
    r.df = with_note_html(r.df, {f"__html_{col}": r.text(col) for col, _ in SOAP})
    r.df = with_html_text(r.df, {f"__text_{col}": r.text(col) for col, _ in SOAP})


def build_sections(r: Row) -> Column:
    """NST-13. Four sections of a SOAP note, or one narrative section."""

    def section(col: str, kind: str, title: str | None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(title).cast("string").alias("title"),
            F.nullif(F.col(f"__html_{col}"), F.lit("")).alias("html"), F.col(f"__text_{col}").alias("text"),
        )

    soap = F.array(*[section(col, kind, col) for col, kind in SOAP])
    return F.when(r.flag("IsSoapNote"), soap).otherwise(F.array(section("Subjective", "narrative", None)))


def map_encounters(tables: Tables) -> DataFrame:
    """MAP-02. Encounters with their note sections."""
    r = Row(keyed(keyed(tables["patient-encounters"], "PatientPracticeGuid"), "EncounterGuid"), "patient-encounters", (
        "PatientPracticeGuid EncounterGuid DateOfService ChiefComplaint Subjective Objective Assessment Plan "
        "SignedByProviderGuid SignedDateTimeUtc SeenByProviderGuid FacilityGuid ChartNoteType IsSoapNote LastModifiedDateTimeUtc"
    ))
    add_section_text(r)
    return r.select(
        F.col("EncounterGuid").alias("encounter_id"), F.col("PatientPracticeGuid").alias("patient_id"),
        r.date("DateOfService").alias("date_of_service"), r.text("ChiefComplaint").alias("chief_complaint"),
        F.when(r.flag("IsSoapNote"), "SOAP").otherwise("SIMPLE").alias("encounter_type"),
        r.text("ChartNoteType").alias("note_type"), r.text("SeenByProviderGuid").alias("provider_id"),
        r.text("FacilityGuid").alias("facility_id"), r.text("SignedByProviderGuid").alias("signed_by_id"),
        r.moment("SignedDateTimeUtc").alias("signed_at"), r.moment("LastModifiedDateTimeUtc").alias("last_modified_at"),
        build_sections(r).alias("sections"), source_id=F.col("EncounterGuid"),
    )


def map_addenda(tables: Tables) -> DataFrame:
    """MAP-02. Addenda of encounters, in source order."""
    r = Row(keyed(tables["patient-encounter-addendums"], "EncounterGuid"), "patient-encounter-addendums", "EncounterGuid Addendum")
    r.df = with_html_text(r.df, {"__text": r.text("Addendum")})
    return r.df.select(
        F.col("EncounterGuid").alias("encounter_id"), F.col("__text").alias("text"),
        r.text("AmendmentStatus").alias("status"), F.lit(None).cast("string").alias("author_name"),
        F.lit(None).cast("string").alias("author_credential"), r.text("AmendmentSource").alias("source"),
        r.moment("LastModifiedDateTimeUtc").alias("at"), "_ord",
    )


def map_diagnosis_links(tables: Tables) -> DataFrame:
    """MAP-02. Encounter to diagnosis links."""
    r = Row(keyed(tables["patient-encounter-diagnoses"], "EncounterGuid"), "", "")
    links = r.df.select(F.col("EncounterGuid").alias("encounter_id"), r.text("DiagnosisGuid").alias("diagnosis_id"), "_ord")
    return links.filter(F.col("diagnosis_id").isNotNull())


def select_encounters(encounters: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-01. (shown, skipped with a reason)."""
    births = patients.select("patient_id", F.col("birth_date").alias("_birth"))
    marked = encounters.join(births, "patient_id")
    kept, skipped = split_by_reason(marked, skip_reason(has_note("sections"), "chief_complaint", "_birth", "date_of_service"))
    return kept.drop("_birth"), skipped.drop("_birth")


def map_observations(obs: DataFrame) -> DataFrame:
    """MAP-03. Charted observations; a known vital code makes it a vital sign."""
    r = Row(obs, "patient-encounter-observations", (
        "PatientPracticeGuid EncounterGuid ObservationCodeSystem ObservationCode Value UnitOfObservation "
        "ObservationDateTimeUtc LastModifiedDateTimeUtc"
    ))
    code = r.text("ObservationCode")
    display = lookup(VITAL_DISPLAY_BY_CODE, code)
    return r.select(
        r.text("PatientPracticeGuid").alias("patient_id"), r.text("EncounterGuid").alias("encounter_id"),
        F.when(display.isNotNull(), "vital-signs").otherwise("other").alias("category"),
        code.alias("code"), display.alias("display"),
        F.when(code.isin(*PAIN_CODES), pain_display(r.text("Value"))).otherwise(r.text("Value")).alias("value"),
        r.text("UnitOfObservation").alias("unit"), r.moment("ObservationDateTimeUtc").alias("effective_at"),
        r.moment("LastModifiedDateTimeUtc").alias("recorded_at"), source_id=r.text("ObservationSetGuid"),
    )


def all_observations(tables: Tables, kept: DataFrame) -> DataFrame:
    """MAP-03, AGG-04, AGG-06. Charted, derived and social rows together."""
    charted = map_observations(keyed(tables["patient-encounter-observations"], "PatientPracticeGuid"))
    derived = derive_bmi(charted, kept).select(
        "*", F.create_map(F.lit(f"{NS}:computed"), F.lit("bmi_auto_calc")).alias("extensions"),
        F.struct(F.lit(NS).alias("source_system"), F.lit("(derived)").alias("source_file"), F.lit(None).cast("string").alias("source_id")).alias("provenance"),
    )

    def extra(df: DataFrame, table: str, value_col: str) -> list[Column]:
        r = Row(df, table, f"PatientPracticeGuid {value_col}")
        return [r.extensions(), r.provenance(clean_cell("PatientPracticeGuid"))]

    social = social_history(tables, extra=extra).drop("source_table")
    out = charted.unionByName(derived, allowMissingColumns=True)
    return out.unionByName(social, allowMissingColumns=True)


def map_conditions(dx: DataFrame) -> DataFrame:
    """MAP-04. Codes are taken by shape, and the raw cell is kept too."""
    r = Row(dx, "patient-diagnoses", (
        "PatientPracticeGuid DiagnosisGuid Diagnosis DiagnosisCodeEquivalents DiagnosisAcuity StartDate StopDate LastModifiedDateTimeUtc"
    ))
    codes = F.coalesce(r.text("DiagnosisCodeEquivalents"), F.lit(""))
    return r.select(
        F.coalesce(r.text("DiagnosisGuid"), F.lit("")).alias("condition_id"), r.text("PatientPracticeGuid").alias("patient_id"),
        extract_icd10(codes).alias("icd10"), extract_snomed(codes).alias("snomed"), r.text("Diagnosis").alias("display"),
        r.text("DiagnosisAcuity").alias("acuity"), r.date("StartDate").alias("onset"), r.date("StopDate").alias("stopped"),
        r.moment("LastModifiedDateTimeUtc").alias("recorded_at"), r.date("StopDate").isNull().alias("active"),
        source_id=r.text("DiagnosisGuid"), keep=("DiagnosisCodeEquivalents",),
    )


ALLERGY_CATEGORIES = {"drug": "drug", "food": "food", "environment": "environment"}


def map_allergies(allergy: DataFrame, reactions: DataFrame) -> DataFrame:
    """MAP-05. Allergies with their distinct reactions."""
    r = Row(allergy, "patient-allergy", "PatientPracticeGuid AllergyGuid AllergenCategory Substance Severity StartDate IsActive")
    rows = r.select(
        F.coalesce(r.text("AllergyGuid"), F.lit("")).alias("allergy_id"), r.text("PatientPracticeGuid").alias("patient_id"),
        r.text("Substance").alias("substance"),
        F.coalesce(lookup(ALLERGY_CATEGORIES, F.lower(r.text("AllergenCategory"))), F.lit("other")).alias("category"),
        r.text("Severity").alias("severity"), r.date("StartDate").alias("onset"), r.flag("IsActive").alias("active"),
        source_id=r.text("AllergyGuid"),
    )
    kids = keyed(reactions, "AllergyGuid").withColumnRenamed("AllergyGuid", "allergy_id")
    names = distinct_in_order(kids, "allergy_id", clean_cell("Reaction") if "Reaction" in kids.columns else F.lit(None).cast("string"), "_ord", "reactions")
    return rows.join(names, "allergy_id", "left").withColumn("reactions", F.coalesce("reactions", F.array().cast("array<string>")))


def map_medications(med: DataFrame) -> DataFrame:
    """MAP-06. Medications; active without a stop or a discontinue reason."""
    r = Row(med, "patient-medications", (
        "PatientPracticeGuid MedicationGuid MedicationName StartDate StopDate Sig TradeName GenericName DoseForm Route "
        "ProductStrength MedicationDiscontinuedReasonName LastModifiedDateTimeUtc"
    ))
    return r.select(
        F.coalesce(r.text("MedicationGuid"), F.lit("")).alias("medication_id"), r.text("PatientPracticeGuid").alias("patient_id"),
        r.text("GenericName").alias("generic_name"), r.text("TradeName").alias("brand_name"), r.text("ProductStrength").alias("strength"),
        r.text("Route").alias("route"), r.text("DoseForm").alias("dose_form"), r.text("MedicationName").alias("display_name"),
        r.text("Sig").alias("sig"), r.date("StartDate").alias("start"), r.date("StopDate").alias("stop"),
        r.moment("LastModifiedDateTimeUtc").alias("last_modified_at"),
        (r.date("StopDate").isNull() & r.text("MedicationDiscontinuedReasonName").isNull()).alias("active"),
        source_id=r.text("MedicationGuid"),
    )


def map_transactions(tx: DataFrame) -> DataFrame:
    """MAP-07. Script transitions."""
    r = Row(keyed(tx, "PrescriptionGuid"), "prescription-transactions", "PrescriptionGuid")
    return r.df.select(
        F.col("PrescriptionGuid").alias("prescription_id"),
        F.coalesce(r.text("Status"), r.text("TransactionDescription"), F.lit("")).alias("kind"),
        r.text("TransactionDescription").alias("description"), r.text("TransactionNote").alias("note"),
        r.moment("TransactionDisplayDateTimeUtc").alias("at"), "_ord",
    )


def map_prescriptions(rx: DataFrame, tx: DataFrame) -> DataFrame:
    """MAP-07. Scripts with the status resolved from their transitions."""
    r = Row(rx, "patient-prescriptions", (
        "PatientPracticeGuid PrescriptionGuid MedicationGuid PrescribingProviderGuid DestinationTypeCode DateOfService "
        "MedicationDisplayName Sig Quantity NumberOfRefills Refills"
    ))
    rows = r.select(
        F.coalesce(r.text("PrescriptionGuid"), F.lit("")).alias("prescription_id"), r.text("PatientPracticeGuid").alias("patient_id"),
        r.text("MedicationGuid").alias("medication_id"), r.text("PrescribingProviderGuid").alias("prescriber_id"),
        r.text("DestinationTypeCode").alias("_dest"), r.moment("DateOfService").alias("_service"), r.text("Sig").alias("sig"),
        F.coalesce(r.number("NumberOfRefills"), r.number("Refills")).alias("refills"), r.text("Quantity").alias("quantity"),
        source_id=r.text("PrescriptionGuid"),
    )
    status = resolve_status(map_transactions(tx), "prescription_id")
    out = rows.join(status, "prescription_id", "left").withColumn("prefix", F.coalesce("label_prefix", script_prefix("_dest")))
    out = out.withColumn("display_date", display_date("prefix", "order_sent_at", "_service"))
    return out.drop("label_prefix", "order_sent_at", "_dest", "_service")


def map_coverages(ins: DataFrame, superbill: DataFrame) -> DataFrame:
    """MAP-08. Coverages; the plan type comes from three lookups, then the name."""
    r = Row(ins, "patient-insurances", (
        "PatientInsurancePlanGuid PatientPracticeGuid PayerName InsurancePlanName InsuranceCoverageType RelationshipToInsured "
        "MemberId GroupId OrderOfBenefits EffectiveFromDate EffectiveToDate CopayFixedAmount InsurancePlanIsActive EmployerName"
    ))
    rows = r.select(
        F.coalesce(r.text("PatientInsurancePlanGuid"), F.lit("")).alias("coverage_id"), r.text("PatientPracticeGuid").alias("patient_id"),
        r.text("PayerName").alias("payer"), r.text("InsurancePlanName").alias("plan_name"),
        r.text("InsuranceCoverageType").alias("coverage_type"), r.text("MemberId").alias("member_id"), r.text("GroupId").alias("group_number"),
        lookup(BENEFIT_ORDER, F.lower(r.text("OrderOfBenefits"))).alias("order_of_benefits"),
        F.concat(F.upper(r.text("OrderOfBenefits")), F.lit(" PAYER")).alias("priority_label"), r.text("EmployerName").alias("employer"),
        r.text("RelationshipToInsured").alias("relationship"), r.number("CopayFixedAmount").alias("copay"),
        r.date("EffectiveFromDate").alias("start"), r.date("EffectiveToDate").alias("end"), r.flag("InsurancePlanIsActive").alias("active"),
        source_id=r.text("PatientInsurancePlanGuid"),
    )
    return resolve_plan_type(rows, superbill)


def resolve_plan_type(coverages: DataFrame, superbill: DataFrame) -> DataFrame:
    """JN-05. By plan id, then plan name, then payer name, then the name's suffix."""
    s = Row(superbill, "superbill-insurances", "")
    by_id = first_per_key(superbill, s.text("PatientInsurancePlanGuid"), s.text("PlanType"), ("k", "v"))
    by_name = first_per_key(superbill, F.lower(s.text("PlanName")), s.text("PlanType"), ("k", "v"))
    tiers = [
        (F.nullif(F.col("coverage_id"), F.lit("")), by_id, "k", "v"),
        (F.lower("plan_name"), by_name, "k", "v"),
        (F.lower("payer"), by_name, "k", "v"),
    ]
    return tiered_lookup(coverages, tiers, plan_type_suffix("plan_name"), "plan_type")


def map_family_history(relatives: DataFrame, dx: DataFrame) -> DataFrame:
    """MAP-09, JN-07. Diagnoses of relatives, carried to the patient."""
    rel = keyed(keyed(relatives, "PatientPracticeGuid"), "RelativeGuid")
    r = Row(rel, "", "")
    mid = rel.select(
        F.col("RelativeGuid").alias("relative_id"), F.col("PatientPracticeGuid").alias("patient_id"),
        r.text("Relationship").alias("relation"), F.col("_ord").alias("_rel_ord"),
    )
    d = Row(keyed(dx, "RelativeGuid"), "patient-family-history-diagnoses", "PatientPracticeGuid RelativeGuid")
    kids = d.select(
        F.col("RelativeGuid").alias("relative_id"), F.coalesce(d.text("Diagnosis"), d.text("SnomedCode")).alias("diagnosis"),
        d.date("OnsetDate").alias("onset_date"), source_id=F.col("RelativeGuid"),
    )
    return mid.join(kids, "relative_id").drop("_rel_ord")


def map_immunizations(imm: DataFrame) -> DataFrame:
    """MAP-10, WIN-10. The first filled date column counts."""
    dates = ("DateAdministered", "AdministeredDate", "AdministeredDateTimeUtc")
    r = Row(imm, "patient-immunizations", "PatientPracticeGuid ImmunizationGuid Vaccine Lot Type Comment ExpirationDate " + " ".join(dates))
    return r.select(
        F.coalesce(r.text("ImmunizationGuid"), F.lit("")).alias("immunization_id"), r.text("PatientPracticeGuid").alias("patient_id"),
        r.text("Vaccine").alias("vaccine"), F.coalesce(*[r.date(c) for c in dates]).alias("administered_on"), r.text("Type").alias("source"),
        r.text("Lot").alias("lot_number"), r.date("ExpirationDate").alias("expires"), r.text("Comment").alias("comment"),
        source_id=r.text("ImmunizationGuid"),
    )


def map_directives(ad: DataFrame) -> DataFrame:
    """MAP-11. Advance directives."""
    r = Row(ad, "patient-advance-directives", "PatientPracticeGuid Directive DateRecorded")
    return r.select(
        r.text("PatientPracticeGuid").alias("patient_id"), r.text("Directive").alias("directive"), r.moment("DateRecorded").alias("recorded_at"),
        source_id=r.text("PatientPracticeGuid"),
    )


def map_documents(docs: DataFrame) -> DataFrame:
    """MAP-11. Stored documents; their date is kept typed and raw."""
    r = Row(docs, "patient-documents", "PatientPracticeGuid DocumentGuid DocumentName")
    return r.select(
        F.coalesce(r.text("DocumentGuid"), F.lit("")).alias("document_id"), r.text("PatientPracticeGuid").alias("patient_id"),
        r.text("DocumentName").alias("title"), F.lit("application/octet-stream").alias("mime_type"),
        r.moment("DocumentDate").alias("generated_at"), source_id=r.text("DocumentGuid"),
    )


def map_practitioners(providers: DataFrame) -> DataFrame:
    """MAP-12. Providers."""
    r = Row(providers, "providers", "ProviderGuid FirstName LastName")
    return r.select(
        F.coalesce(r.text("ProviderGuid"), F.lit("")).alias("practitioner_id"), r.text("FirstName").alias("given_name"),
        r.text("LastName").alias("family_name"), present_text(r.text("FirstName"), r.text("LastName")).alias("name"),
        source_id=r.text("ProviderGuid"),
    )


def map_facilities(facilities: DataFrame) -> DataFrame:
    """MAP-12. Facilities, phones normalised."""
    r = Row(facilities, "facilities", (
        "FacilityGuid FacilityName Address1 Address2 AddressCity AddressState AddressZipCode PhoneNumber FaxNumber"
    ))
    return r.select(
        F.coalesce(r.text("FacilityGuid"), F.lit("")).alias("facility_id"), r.text("FacilityName").alias("name"),
        r.text("Address1").alias("address_line1"), r.text("Address2").alias("address_line2"), r.text("AddressCity").alias("city"),
        r.text("AddressState").alias("state"), r.text("AddressZipCode").alias("postal_code"),
        format_phone(r.text("PhoneNumber")).alias("phone"), format_phone(r.text("FaxNumber")).alias("fax"), source_id=r.text("FacilityGuid"),
    )


def map_export(tables: Tables) -> dict[str, DataFrame]:
    """Every canonical table of a TSV export (lazy; a job runs only what it uses)."""
    patients = map_patients(tables)
    kept, skipped = select_encounters(map_encounters(tables), patients)

    def of_patients(name: str) -> DataFrame:
        return keyed(tables[name], "PatientPracticeGuid")

    return {
        "patients": patients,
        "patient_notes": map_patient_notes(tables),
        "encounters": kept,
        "skipped_encounters": skipped,
        "addenda": map_addenda(tables),
        "encounter_diagnoses": map_diagnosis_links(tables),
        "observations": all_observations(tables, kept),
        "conditions": map_conditions(of_patients("patient-diagnoses")),
        "allergies": map_allergies(of_patients("patient-allergy"), tables["patient-allergy-reactions"]),
        "medications": map_medications(of_patients("patient-medications")),
        "prescriptions": map_prescriptions(of_patients("patient-prescriptions"), tables["prescription-transactions"]),
        "transactions": map_transactions(tables["prescription-transactions"]),
        "coverages": map_coverages(of_patients("patient-insurances"), tables["superbill-insurances"]),
        "family_history": map_family_history(tables["patient-family-medical-history"], tables["patient-family-history-diagnoses"]),
        "immunizations": map_immunizations(of_patients("patient-immunizations")),
        "directives": map_directives(of_patients("patient-advance-directives")),
        "documents": map_documents(of_patients("patient-documents")),
        "practitioners": map_practitioners(tables["providers"]),
        "facilities": map_facilities(tables["facilities"]),
    }


RECORD_CHILDREN = (
    "encounters", "observations", "conditions", "allergies", "medications", "prescriptions", "coverages",
    "family_history", "immunizations", "directives", "documents",
)


def with_prescription_ids(medications: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """JN-17, MAP-06. Medications with ``prescription_ids``: their different prescriptions, in the order they were first written."""
    first = prescriptions.filter(F.col("medication_id").isNotNull()).groupBy("medication_id", "prescription_id").agg(F.min("_ord").alias("_ord"))
    ids = first.groupBy("medication_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "prescription_id"))), lambda x: x["prescription_id"]).alias("prescription_ids"))
    return medications.join(ids, "medication_id", "left").withColumn("prescription_ids", F.coalesce("prescription_ids", F.array().cast("array<string>")))


def record_children(canonical: Mapping[str, DataFrame]) -> dict[str, tuple]:
    """Every table that belongs to a patient's record, with its items and their order.

    Addenda and diagnosis links get their patient from the encounter, transactions theirs from
    the prescription, and of practitioners and facilities a record holds those that its
    encounters and prescriptions name. Tables that ``canonical`` lacks are left out.
    """
    tables = {name: canonical[name] for name in RECORD_CHILDREN if name in canonical}
    patient_of = lambda name, key: canonical[name].select(key, "patient_id").dropDuplicates([key])
    for name in ("addenda", "encounter_diagnoses"):
        if name in canonical and "encounters" in canonical:
            tables[name] = canonical[name].join(patient_of("encounters", "encounter_id"), "encounter_id")
    if "transactions" in canonical and "prescriptions" in canonical:
        tables["transactions"] = canonical["transactions"].join(patient_of("prescriptions", "prescription_id"), "prescription_id")
    if "patient_notes" in canonical:
        tables["patient_notes"] = canonical["patient_notes"].withColumnRenamed("page", "_ord")
    for name, key, roles in (("practitioners", "practitioner_id", {"encounters": ("provider_id", "signed_by_id"), "prescriptions": ("prescriber_id",)}), ("facilities", "facility_id", {"encounters": ("facility_id",)})):
        cited = [canonical[t].select("patient_id", F.col(c).alias(key)) for t, cols in roles.items() if t in canonical for c in cols if c in canonical[t].columns]
        if name in canonical and cited:
            tables[name] = reduce(DataFrame.unionByName, cited).filter(F.col(key).isNotNull()).distinct().join(canonical[name], key)
    return {name: (df, F.struct(*[c for c in df.columns if c not in ("patient_id", "_ord")]), ["_ord"], None) for name, df in tables.items()}


def assemble(canonical: Mapping[str, DataFrame], page_rows: int = PAGE_ROWS) -> DataFrame:
    """JN-02. Whole records, one row per patient and page."""
    return assemble_records(canonical["patients"].drop("_ord"), record_children(canonical), "patient_id", page_rows)
