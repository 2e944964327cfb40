"""FHIR R4 resources to canonical tables (MAP-22..28, JN-10/14/15, NST-01..07).

``resources`` is the table ``read_fhir`` gives. Each mapping reads only the
elements it lifts; all other top-level elements stay as JSON text in
``extensions``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.codes import lookup
from chartweave.functions.dates import fhir_date, fhir_datetime
from chartweave.functions.references import ref_id
from chartweave.functions.text import decode_attachment, num_str, strip, with_html_text
from chartweave.operators.joins import adopt_unanchored, anchor, cited_actors, paged_collect
from chartweave.operators.windows import order_block
from chartweave.session import cut_lineage

NS = "fhir_r4"
# Code systems with the spellings exports use.
LOINC = ("http://loinc.org",)
ICD10 = ("http://hl7.org/fhir/sid/icd-10-cm",)
SNOMED = ("http://snomed.info/sct", "http://www.snomed.info/sct")
RXNORM = ("http://www.nlm.nih.gov/research/umls/rxnorm", "http://rxnorm.info/sct")
CVX = ("http://hl7.org/fhir/sid/cvx",)
SSN = ("http://hl7.org/fhir/sid/us-ssn",)
NPI = "http://hl7.org/fhir/sid/us-npi"
US_CORE = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-"
SMOKING = "72166-2"
# Categories of observations and allergies.
OBS_CATEGORIES = {"vital-signs": "vital-signs", "social-history": "social-history", "laboratory": "laboratory", "screening": "screening"}
ALLERGY_CATEGORIES = {"medication": "drug", "food": "food", "environment": "environment"}
# Resource types that have a canonical table.
SHARED = ("Patient", "Practitioner", "Location", "Organization")
HANDLED = (
    "Encounter", "Observation", "Condition", "MedicationRequest", "MedicationStatement", "AllergyIntolerance",
    "Immunization", "Coverage", "Goal", "FamilyMemberHistory", "DocumentReference",
)
STRUCTURAL = ("resourceType", "id", "subject", "patient", "beneficiary")

CODING = "array<struct<system:string,code:string,display:string>>"
CONCEPT = f"struct<text:string,coding:{CODING}>"
REF = "struct<reference:string,display:string>"
PERIOD = "struct<start:string,`end`:string>"


def parsed(resources: DataFrame, types: tuple[str, ...] | str, schema: str) -> DataFrame:
    types = (types,) if isinstance(types, str) else types
    rows = resources.filter(F.col("resource_type").isin(*types) & F.col("id").isNotNull())
    return rows.withColumn("r", F.from_json("body", schema))


def fhir_residual(consumed: str, body: Column | str = "body") -> Column:
    """NST-01. Top-level elements nothing consumed, namespaced, as JSON text."""
    skip = [*consumed.split(), *STRUCTURAL]
    every = F.from_json(body, "map<string,string>")
    kept = F.map_filter(every, lambda k, v: ~k.isin(*skip) & v.isNotNull())
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit(f"{NS}:"), k))


def _put(base: Column, key: str, value: Column) -> Column:
    one = F.filter(F.array(F.struct(F.lit(f"{NS}:{key}").alias("key"), value.cast("string").alias("value"))), lambda e: e["value"].isNotNull())
    return F.map_concat(base, F.map_from_entries(one))


def _prov() -> Column:
    return F.struct(F.lit(NS).alias("source_system"), F.col("source_file").alias("source_file"), F.col("id").alias("source_id")).alias("provenance")


def _coding(concept: Column) -> Column:
    return F.coalesce(concept["coding"], F.array().cast(CODING))


def code_in(concept: Column, systems: tuple[str, ...]) -> Column:
    """NST-02. First code whose system is one of ``systems``."""
    hit = F.filter(_coding(concept), lambda c: c["system"].isin(*systems) & (F.coalesce(c["code"], F.lit("")) != ""))
    return F.get(hit, F.lit(0))["code"]


def concept_text(concept: Column) -> Column:
    """NST-03. Label of a concept: its text, else the first coding display."""
    shown = F.filter(_coding(concept), lambda c: F.coalesce(c["display"], F.lit("")) != "")
    return F.coalesce(F.nullif(concept["text"], F.lit("")), F.get(shown, F.lit(0))["display"])


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def filled(array: Column) -> Column:
    return F.filter(array, lambda x: F.coalesce(x, F.lit("")) != "")


def status_active(concept: Column) -> Column:
    """FLT-05. A clinical status that reads active."""
    return F.exists(_coding(concept), lambda c: F.coalesce(c["code"] == "active", F.lit(False)))


def race_list(ext: Column, kind: str) -> Column:
    """AGG-18. Race or ethnicity: the text, else the category displays."""
    mine = first(F.filter(ext, lambda e: e["url"] == f"{US_CORE}{kind}"))["extension"]
    texts = F.filter(mine, lambda e: (e["url"] == "text") & (F.coalesce(e["valueString"], F.lit("")) != ""))
    shown = F.filter(mine, lambda e: (e["url"] == "ombCategory") & (F.coalesce(e["valueCoding"]["display"], F.lit("")) != ""))
    last_text = F.element_at(texts, -1)["valueString"]
    picked = F.when(F.size(texts) > 0, F.array(last_text)).otherwise(F.transform(shown, lambda e: e["valueCoding"]["display"]))
    return F.coalesce(picked, F.array().cast("array<string>"))


PATIENT = f"""name array<struct<given:array<string>,family:string,suffix:array<string>>>, birthDate string, gender string, maritalStatus {CONCEPT},
 communication array<struct<language:{CONCEPT}>>, identifier array<struct<system:string,value:string,type:{CONCEPT},assigner:struct<display:string>>>,
 telecom array<struct<system:string,use:string,value:string>>, address array<struct<line:array<string>,city:string,state:string,postalCode:string>>,
 extension array<struct<url:string,extension:array<struct<url:string,valueString:string,valueCoding:struct<display:string>>>>>"""


def map_patients(resources: DataFrame) -> DataFrame:
    """MAP-22. Patients."""
    p = parsed(resources, "Patient", PATIENT)
    name = first(F.col("r.name"))
    given = filled(name["given"])
    mrn = lambda i: F.exists(_coding(i["type"]), lambda c: F.coalesce(c["code"] == "MR", F.lit(False)))
    ids = F.transform(
        F.filter("r.identifier", lambda i: F.coalesce(i["value"], F.lit("")) != ""),
        lambda i: F.struct(F.when(i["system"].isin(*SSN), "ssn").when(mrn(i), "mrn").otherwise("other").alias("kind"), i["value"].alias("value"),
                           F.coalesce(i["assigner"]["display"], i["system"]).alias("system")))
    phone = lambda t: F.when(t["system"] == "email", "email").when(t["use"].isin("home", "mobile", "work"), F.concat(F.lit("phone-"), t["use"])).otherwise("phone-other")
    telecom = F.transform(F.filter("r.telecom", lambda t: F.coalesce(t["value"], F.lit("")) != ""), lambda t: F.struct(phone(t).alias("kind"), t["value"].alias("value")))
    addresses = F.transform("r.address", lambda a: F.struct(first(filled(a["line"])).alias("line1"), F.get(filled(a["line"]), F.lit(1)).alias("line2"), a["city"].alias("city"), a["state"].alias("state"), a["postalCode"].alias("postal_code")))
    return p.select(
        F.col("id").alias("patient_id"), first(given).alias("given_name"), F.get(given, F.lit(1)).alias("middle_name"), name["family"].alias("family_name"),
        first(name["suffix"]).alias("suffix"), fhir_date("r.birthDate").alias("birth_date"), F.col("r.gender").alias("sex"),
        race_list(F.col("r.extension"), "race").alias("race"), race_list(F.col("r.extension"), "ethnicity").alias("ethnicity"),
        concept_text(first(F.col("r.communication"))["language"]).alias("language"), concept_text(F.col("r.maritalStatus")).alias("marital_status"),
        ids.alias("identifiers"), telecom.alias("telecom"), addresses.alias("addresses"),
        fhir_residual("name birthDate gender maritalStatus communication identifier telecom address extension").alias("extensions"), _prov(), "_ord",
    )


def map_practitioners(resources: DataFrame) -> DataFrame:
    """MAP-22. Practitioners."""
    p = parsed(resources, "Practitioner", "name array<struct<given:array<string>,family:string,text:string>>, identifier array<struct<system:string,value:string>>")
    name = first(F.col("r.name"))
    npi = first(F.filter("r.identifier", lambda i: i["system"] == NPI))["value"]
    return p.select(F.col("id").alias("practitioner_id"), first(filled(name["given"])).alias("given_name"), name["family"].alias("family_name"), name["text"].alias("display_name"),
                    F.nullif(npi, F.lit("")).alias("npi"), fhir_residual("name identifier").alias("extensions"), _prov(), "_ord")


def map_facilities(resources: DataFrame) -> DataFrame:
    """MAP-22. Facilities from locations (one address) and organizations (a list)."""
    addr = "struct<line:array<string>,city:string,state:string,postalCode:string>"
    base = "name string, telecom array<struct<system:string,value:string>>"
    loc = parsed(resources, "Location", f"{base}, address {addr}").withColumn("a", F.col("r.address"))
    org = parsed(resources, "Organization", f"{base}, address array<{addr}>").withColumn("a", first(F.col("r.address")))

    def rows(df: DataFrame) -> DataFrame:
        def tel(kind: str) -> Column:
            mine = F.transform(F.filter("r.telecom", lambda t: t["system"] == kind), lambda t: t["value"])
            return F.try_element_at(mine, F.lit(-1))

        line = filled(F.col("a.line"))
        return df.select(F.col("id").alias("facility_id"), F.col("r.name").alias("name"), first(line).alias("address_line1"), F.get(line, F.lit(1)).alias("address_line2"),
                         F.col("a.city").alias("city"), F.col("a.state").alias("state"), F.col("a.postalCode").alias("postal_code"),
                         tel("phone").alias("phone"), tel("fax").alias("fax"), fhir_residual("name address telecom").alias("extensions"), _prov(), "_ord")

    return rows(loc).unionByName(rows(org))


ENCOUNTER = f"""class struct<code:string,text:string,coding:{CODING}>, type array<{CONCEPT}>, reasonCode array<{CONCEPT}>, period {PERIOD},
 participant array<struct<individual:{REF}>>, location array<struct<location:{REF}>>, diagnosis array<struct<condition:{REF}>>"""


def map_encounters(resources: DataFrame) -> DataFrame:
    """MAP-23. Encounters; notes are attached by ``attach_notes``."""
    e = parsed(resources, "Encounter", ENCOUNTER)
    return e.select(
        F.col("id").alias("encounter_id"), "patient_id", fhir_date("r.period.start").alias("date_of_service"), concept_text(first(F.col("r.reasonCode"))).alias("chief_complaint"),
        F.coalesce(concept_text(F.col("r.class")), F.col("r.class.code")).alias("encounter_type"), concept_text(first(F.col("r.type"))).alias("note_type"),
        ref_id(first(F.col("r.participant"))["individual"]["reference"]).alias("provider_id"), ref_id(first(F.col("r.location"))["location"]["reference"]).alias("facility_id"),
        F.filter(F.transform("r.diagnosis", lambda d: ref_id(d["condition"]["reference"])), lambda i: i.isNotNull()).alias("diagnosis_ids"),
        fhir_residual("class participant location diagnosis").alias("extensions"), _prov(), "_ord",
    )


VALUES = (("valueQuantity", "struct<value:double,unit:string,code:string>"), ("valueCodeableConcept", CONCEPT), ("valueString", "string"), ("valueBoolean", "boolean"))
OBSERVATION = (
    f"category array<{CONCEPT}>, code {CONCEPT}, encounter {REF}, effectiveDateTime string, effectivePeriod {PERIOD}, "
    + f"component array<struct<code:{CONCEPT},{','.join(f'{n}:{t}' for n, t in VALUES)}>>, " + ", ".join(f"{n} {t}" for n, t in VALUES)
)


def value_unit(node: Column) -> tuple[Column, Column]:
    """NST-05. (value, unit) of whichever value element is present."""
    q = node["valueQuantity"]
    flag = F.when(node["valueBoolean"], "True").when(~node["valueBoolean"], "False")
    value = F.when(q.isNotNull(), num_str(q["value"])).when(node["valueCodeableConcept"].isNotNull(), concept_text(node["valueCodeableConcept"])).otherwise(F.coalesce(node["valueString"], flag))
    return value, F.when(q.isNotNull(), F.coalesce(F.nullif(q["unit"], F.lit("")), q["code"]))


def explode_panels(resources: DataFrame) -> DataFrame:
    """MAP-24, NST-04. One row per value: the panel's own and each component's."""
    o = parsed(resources, "Observation", OBSERVATION)
    known = F.filter(F.transform("r.category", lambda c: lookup(OBS_CATEGORIES, first(_coding(c))["code"])), lambda c: c.isNotNull())
    loinc = code_in(F.col("r.code"), LOINC)
    category = F.coalesce(first(known), F.when(loinc == SMOKING, F.lit("social-history")), F.lit("other"))
    value, unit = value_unit(F.col("r"))
    o = o.withColumns({
        "_cat": category, "_loinc": loinc, "_code": F.coalesce(loinc, first(_coding(F.col("r.code")))["code"]), "_text": concept_text(F.col("r.code")),
        "_v": value, "_u": unit, "_enc": ref_id("r.encounter.reference"),
        "_at": fhir_datetime(F.coalesce(F.nullif("r.effectiveDateTime", F.lit("")), F.col("r.effectivePeriod.start"))),
        "_x": fhir_residual("category code valueQuantity valueCodeableConcept valueString valueBoolean effectiveDateTime effectivePeriod encounter component"),
    })
    top = F.struct(F.lit(-1).alias("i"), F.col("id").alias("oid"), F.col("_code").alias("code"), F.col("_text").alias("display"), F.col("_v").alias("value"), F.col("_u").alias("unit"))

    def part(c: Column, i: Column) -> Column:
        v, u = value_unit(c)
        code = F.coalesce(code_in(c["code"], LOINC), F.col("_loinc"))
        oid = F.concat(F.col("id"), F.lit(":"), i.cast("string"), F.lit(":"), F.coalesce(code, F.lit("c")))
        return F.struct(i.cast("int").alias("i"), oid.alias("oid"), code.alias("code"), concept_text(c["code"]).alias("display"), v.alias("value"), u.alias("unit"))

    empty = F.array().cast("array<struct<i:int,oid:string,code:string,display:string,value:string,unit:string>>")
    parts = F.coalesce(F.transform("r.component", part), empty)
    own = F.col("_v").isNotNull() | (F.size(parts) == 0)
    o = o.withColumn("_e", F.explode(F.concat(F.when(own, F.array(top)).otherwise(empty), parts)))
    return o.select(
        F.col("_e.oid").alias("observation_id"), "patient_id", F.col("_enc").alias("encounter_id"), F.col("_cat").alias("category"), "_e.code", "_e.display", "_e.value", "_e.unit",
        F.col("_at").alias("effective_at"), F.col("_x").alias("extensions"), _prov(), "_ord", F.col("_e.i").alias("position"),
    )


def map_conditions(resources: DataFrame) -> DataFrame:
    """MAP-25. Conditions; a refuted one keeps its verification status."""
    c = parsed(resources, "Condition", f"code {CONCEPT}, clinicalStatus {CONCEPT}, onsetDateTime string, abatementDateTime string, recordedDate string")
    return c.select(
        F.col("id").alias("condition_id"), "patient_id", code_in(F.col("r.code"), ICD10).alias("icd10"), code_in(F.col("r.code"), SNOMED).alias("snomed"), concept_text(F.col("r.code")).alias("display"),
        fhir_date("r.onsetDateTime").alias("onset"), fhir_date("r.abatementDateTime").alias("stopped"), fhir_datetime("r.recordedDate").alias("recorded_at"), status_active(F.col("r.clinicalStatus")).alias("active"),
        fhir_residual("code clinicalStatus onsetDateTime abatementDateTime recordedDate").alias("extensions"), _prov(), "_ord")


def map_allergies(resources: DataFrame) -> DataFrame:
    """MAP-25. Allergies."""
    a = parsed(resources, "AllergyIntolerance", f"code {CONCEPT}, category array<string>, criticality string, clinicalStatus {CONCEPT}, onsetDateTime string, reaction array<struct<severity:string,manifestation:array<{CONCEPT}>>>")
    cats = F.filter(F.transform("r.category", lambda c: lookup(ALLERGY_CATEGORIES, c)), lambda c: c.isNotNull())
    signs = F.flatten(F.transform("r.reaction", lambda r: F.coalesce(F.transform(r["manifestation"], concept_text), F.array().cast("array<string>"))))
    severity = first(filled(F.transform("r.reaction", lambda r: r["severity"])))
    return a.select(
        F.col("id").alias("allergy_id"), "patient_id", concept_text(F.col("r.code")).alias("substance"), F.coalesce(first(cats), F.lit("other")).alias("category"),
        F.coalesce(filled(signs), F.array().cast("array<string>")).alias("reactions"), F.coalesce(severity, F.col("r.criticality")).alias("severity"), fhir_date("r.onsetDateTime").alias("onset"),
        status_active(F.col("r.clinicalStatus")).alias("active"), fhir_residual("code category reaction clinicalStatus onsetDateTime").alias("extensions"), _prov(), "_ord")


def map_immunizations(resources: DataFrame) -> DataFrame:
    """MAP-25. Immunizations."""
    i = parsed(resources, "Immunization", f"vaccineCode {CONCEPT}, occurrenceDateTime string, lotNumber string, expirationDate string, note array<struct<text:string>>")
    ext = _put(fhir_residual("vaccineCode occurrenceDateTime lotNumber expirationDate note"), "cvx", code_in(F.col("r.vaccineCode"), CVX))
    return i.select(F.col("id").alias("immunization_id"), "patient_id", concept_text(F.col("r.vaccineCode")).alias("vaccine"), fhir_date("r.occurrenceDateTime").alias("administered_on"),
                    F.col("r.lotNumber").alias("lot_number"), fhir_date("r.expirationDate").alias("expires"), first(F.col("r.note"))["text"].alias("comment"), ext.alias("extensions"), _prov(), "_ord")


def map_goals(resources: DataFrame) -> DataFrame:
    """MAP-25. Goals."""
    g = parsed(resources, "Goal", "description struct<text:string>, startDate string, lifecycleStatus string")
    return g.select(F.col("id").alias("goal_id"), "patient_id", F.col("r.description.text").alias("description"), fhir_date("r.startDate").alias("effective"),
                    F.coalesce(F.col("r.lifecycleStatus").isin("active", "accepted", "in-progress"), F.lit(False)).alias("active"), fhir_residual("description startDate lifecycleStatus").alias("extensions"), _prov(), "_ord")


def map_family_history(resources: DataFrame) -> DataFrame:
    """MAP-25. Family history: a row for each condition; those after the first have ``#n`` behind their id."""
    f = parsed(resources, "FamilyMemberHistory", f"relationship {CONCEPT}, condition array<struct<code:{CONCEPT},onsetDateTime:string,onsetString:string>>")
    f = f.select("*", F.posexplode_outer("r.condition").alias("_i", "c"))
    ext = _put(fhir_residual("relationship condition"), "onset_string", F.nullif(F.col("c.onsetString"), F.lit("")))
    name = F.when(F.col("_i") > 0, F.concat("id", F.lit("#"), F.col("_i").cast("string"))).otherwise(F.col("id"))
    return f.select(name.alias("history_id"), "patient_id", concept_text(F.col("c.code")).alias("diagnosis"), concept_text(F.col("r.relationship")).alias("relation"), fhir_date("c.onsetDateTime").alias("onset_date"), ext.alias("extensions"), _prov(), "_ord")


def map_medications(resources: DataFrame) -> DataFrame:
    """MAP-26. Requests and statements; ``completed`` counts as active."""
    m = parsed(resources, ("MedicationRequest", "MedicationStatement"), f"medicationCodeableConcept {CONCEPT}, dosageInstruction array<struct<text:string>>, dosage array<struct<text:string>>, effectivePeriod {PERIOD}, authoredOn string, dateAsserted string, status string")
    dosage = F.when(F.size(F.coalesce("r.dosageInstruction", F.array().cast("array<struct<text:string>>"))) > 0, first(F.col("r.dosageInstruction"))).otherwise(first(F.col("r.dosage")))
    ext = _put(fhir_residual("medicationCodeableConcept dosageInstruction dosage effectivePeriod authoredOn dateAsserted"), "resource_type", F.col("resource_type"))
    blank = F.lit("")
    start = F.coalesce(F.nullif("r.effectivePeriod.start", blank), F.nullif("r.authoredOn", blank), F.col("r.dateAsserted"))
    return m.select(F.col("id").alias("medication_id"), "patient_id", concept_text(F.col("r.medicationCodeableConcept")).alias("display_name"), code_in(F.col("r.medicationCodeableConcept"), RXNORM).alias("rxnorm"), dosage["text"].alias("sig"),
                    fhir_date(start).alias("start"), fhir_date("r.effectivePeriod.end").alias("stop"), F.coalesce(F.col("r.status").isin("active", "completed"), F.lit(False)).alias("active"), F.col("r.status").alias("status"), ext.alias("extensions"), _prov(), "_ord")


def map_coverages(resources: DataFrame) -> DataFrame:
    """MAP-27, NST-06. Coverages; the 1-based order becomes 0-based, 0 is no order."""
    c = parsed(resources, "Coverage", f"payor array<{REF}>, period {PERIOD}, class array<struct<type:{CONCEPT},value:string,name:string>>, subscriberId string, `order` int, status string")
    typed = lambda code: F.element_at(F.concat(F.array(F.lit(None).cast(f"struct<type:{CONCEPT},value:string,name:string>")), F.filter("r.class", lambda x: first(_coding(x["type"]))["code"] == code)), -1)
    c = c.withColumn("_g", typed("group")).withColumn("_p", typed("plan"))
    plan = F.when(F.col("_g").isNotNull(), F.col("_g.name")).otherwise(F.col("_p.name"))
    return c.select(F.col("id").alias("coverage_id"), "patient_id", first(F.col("r.payor"))["display"].alias("payer"), plan.alias("plan_name"), F.col("_g.value").alias("group_number"), F.col("r.subscriberId").alias("member_id"),
                    F.when(F.col("r.order") >= 1, F.col("r.order") - 1).alias("order_of_benefits"), fhir_date("r.period.start").alias("start"), fhir_date("r.period.end").alias("end"),
                    F.coalesce(F.col("r.status") == "active", F.lit(False)).alias("active"), fhir_residual("payor period class subscriberId order status").alias("extensions"), _prov(), "_ord")


DOCUMENT = f"type {CONCEPT}, date string, context struct<encounter:array<{REF}>>, content array<struct<attachment:struct<contentType:string,data:string,title:string,url:string>>>"


def map_documents(resources: DataFrame, trim: Callable[[Column], Column] = strip) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MAP-28. (notes, artifacts, leftovers) of document references.

    A note is the first attachment of a text kind that decodes to visible
    text, without what ``trim`` takes off its ends. Markup is reduced to text
    and never kept as HTML. References that repeat an id or an order stay apart.
    """
    d = parsed(resources, "DocumentReference", DOCUMENT).withColumn("_row", F.monotonically_increasing_id())
    parts = d.select(
        "_row", "id", "patient_id", "source_file", "_ord", "body", concept_text(F.col("r.type")).alias("_type"), F.col("r.date").alias("_date"),
        ref_id(first(F.col("r.context.encounter"))["reference"]).alias("encounter_id"), F.posexplode_outer("r.content").alias("i", "c"))
    ct = F.lower(F.coalesce("c.attachment.contentType", F.lit("")))
    has = F.col("c.attachment").isNotNull()
    wordy = ct.startswith("text/") | ct.contains("html") | (ct == "")
    parts = parts.withColumns({"ct": ct, "_raw": F.when(has & wordy, decode_attachment("c.attachment.data")), "_bin": has & ~(ct.startswith("text/") | ct.contains("html"))})
    parts = with_html_text(parts, {"_html": F.when(F.col("ct").contains("html"), F.col("_raw"))})
    text = F.nullif(trim(F.when(F.col("ct").contains("html"), F.col("_html")).otherwise(F.col("_raw"))), F.lit(""))
    parts = parts.withColumn("text", text)
    # One aggregation per document picks its first readable and first binary part.
    keep = ["id", "patient_id", "source_file", "body", "_type", "_date", "encounter_id", "_ord"]
    full = parts.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in keep],
        F.min_by(F.struct(F.col("c.attachment.title").alias("title"), "text"), F.when(F.col("text").isNotNull(), F.col("i"))).alias("n"),
        F.min_by(F.struct(F.col("c.attachment").alias("a"), "ct"), F.when(F.col("_bin"), F.col("i"))).alias("b"))
    ext = fhir_residual("content context")
    note_rows = full.filter(F.col("n").isNotNull()).select(
        "id", "patient_id", "encounter_id", F.coalesce("n.title", "_type").alias("title"), F.col("n.text").alias("text"), fhir_date("_date").alias("date_of_service"), ext.alias("extensions"), "source_file", "_ord")
    rest = full.filter(F.col("n").isNull())
    x = _put(_put(ext, "url", F.nullif("b.a.url", F.lit(""))), "has_inline_data", F.when(F.coalesce("b.a.data", F.lit("")) != "", F.lit("true")))
    artifacts = rest.filter(F.col("b").isNotNull()).select(
        F.col("id").alias("document_id"), "patient_id", "encounter_id", F.coalesce(F.nullif("b.ct", F.lit("")), F.lit("application/octet-stream")).alias("mime_type"),
        F.coalesce("b.a.title", "_type").alias("title"), x.alias("extensions"), _prov(), "_ord")
    leftover = rest.filter(F.col("b").isNull()).select("id", "patient_id", "body", "_ord")
    return note_rows, artifacts, leftover


def attach_notes(notes: DataFrame, encounters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-15. (sections of known encounters, new encounters for the other notes)."""
    known = encounters.select("encounter_id", "patient_id").distinct()
    placed = notes.join(known, ["encounter_id", "patient_id"], "left_semi").select("encounter_id", "patient_id", F.col("id").alias("note_id"), F.lit("narrative").alias("kind"), "title", "text", "extensions", "_ord")
    loose = notes.join(known, ["encounter_id", "patient_id"], "left_anti")
    section = F.struct(F.lit("narrative").alias("kind"), F.col("title"), F.lit(None).cast("string").alias("html"), F.col("text"))
    made = loose.select(F.concat(F.lit("docref:"), "id").alias("encounter_id"), "patient_id", "date_of_service", F.col("title").alias("note_type"), F.array(section).alias("sections"),
                        _put(F.col("extensions"), "synthetic_from", F.lit("DocumentReference")).alias("extensions"), _prov(), "_ord")
    return placed, made


def preserve_unmapped(resources: DataFrame, page_rows: int = 1000) -> DataFrame:
    """NST-07. Resources without a canonical table, kept whole per patient and type."""
    rest = resources.filter(~F.col("resource_type").isin(*HANDLED, *SHARED) & F.col("patient_id").isNotNull())
    return paged_collect(rest, ["patient_id", "resource_type"], F.col("body"), ["_ord"], order_block("_ord"), page_rows, "bodies")


def map_fhir(resources: DataFrame, materialise: bool = True) -> dict[str, DataFrame]:
    """Every canonical table of a FHIR export.

    The tables share the parsed resources, so those are written once to the
    checkpoint folder instead of being parsed again by each of them. Pass
    ``materialise=False`` for a table that is already stored.
    """
    resources = cut_lineage(resources) if materialise else resources
    patients = map_patients(resources)
    scoped = resources.filter(~F.col("resource_type").isin(*SHARED))
    anchored, loose = anchor(scoped, patients)
    anchored, loose = anchored.select(*scoped.columns), loose.select(*scoped.columns)
    encounters = map_encounters(anchored)
    notes, artifacts, leftover = map_documents(anchored)
    placed, made = attach_notes(notes, encounters)
    all_enc = encounters.unionByName(made, allowMissingColumns=True)
    return {
        "patients": patients, "encounters": all_enc, "note_sections": placed, "observations": explode_panels(anchored), "conditions": map_conditions(anchored),
        "allergies": map_allergies(anchored), "medications": map_medications(anchored), "immunizations": map_immunizations(anchored), "goals": map_goals(anchored),
        "family_history": map_family_history(anchored), "coverages": map_coverages(anchored), "documents": artifacts, "leftover_documents": leftover,
        "unmapped": preserve_unmapped(anchored), "unanchored": adopt_unanchored(loose, patients),
        "practitioners": cited_actors(all_enc, map_practitioners(resources), "patient_id", "provider_id", "practitioner_id", F.col("_ord")),
        "facilities": cited_actors(all_enc, map_facilities(resources), "patient_id", "facility_id", "facility_id", F.col("_ord")),
    }
