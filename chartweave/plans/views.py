"""Chart content as tables (VW-01..15, WIN-02, WIN-04).

Each view is one DataFrame keyed by patient or encounter. A chart is the set
of its views; nothing is rendered here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions import dates as D
from chartweave.functions.codes import VITAL_LABEL_BY_CODE, VITAL_ROW_ORDER, lookup
from chartweave.functions.text import fmt_copay, strip
from chartweave.operators.windows import block_scan, last_row, order_block
from chartweave.session import cut_lineage

FLOWSHEET_COLUMNS = 10
# Chart sections and whether they show by default.
SECTIONS = {
    "insurance": True, "payment": True, "vitals": True, "vitals_flowsheet": True, "immunizations": True, "social_history": True,
    "past_medical_history": True, "family_history": True, "advance_directives": True, "devices": True, "health_concerns": True,
    "goals": True, "orders": True, "addenda": True,
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dash(col: Column | str) -> Column:
    """``-`` for an absent or empty value."""
    c = _c(col)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("-")).otherwise(c)


def med_display_name(display: Column, generic: Column, brand: Column, strength: Column, route: Column, form: Column) -> Column:
    """VW-01. Source name, or ``Generic (Brand) Strength Route Form``."""
    g, b = F.trim(F.coalesce(generic, F.lit(""))), F.trim(F.coalesce(brand, F.lit("")))
    head = (
        F.when((g != "") & (b != "") & (F.lower(g) != F.lower(b)), F.concat(g, F.lit(" ("), b, F.lit(")")))
        .when(g != "", g).when(b != "", b).otherwise("-")
    )
    blank = F.lit("")
    built = F.concat_ws(" ", head, F.nullif(strength, blank), F.nullif(route, blank), F.nullif(form, blank))
    return F.coalesce(F.nullif(display, blank), built)


def start_stop(start: Column | str, stop: Column | str) -> Column:
    """VW-02. ``start - stop``, ``- stop``, ``start`` or ``-``."""
    a, b = D.fmt_date_short(start), D.fmt_date_short(stop)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" - "), b)).when(b.isNotNull(), F.concat(F.lit("- "), b)).otherwise(F.coalesce(a, F.lit("-")))


def script_lines(rx: DataFrame, practitioners: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """VW-03. One line per script."""
    names = practitioners.select(F.col("practitioner_id").alias("prescriber_id"), F.col("name").alias("_name"))
    r = rx.join(names, "prescriber_id", "left")
    blank = F.lit("")
    return r.select(
        "patient_id", "prescription_id", "medication_id", F.coalesce(F.nullif("prefix", blank), F.lit("ESCRIPT")).alias("prefix"), F.coalesce(F.nullif("status_label", blank), F.lit("VERIFIED")).alias("status"),
        F.coalesce(D.fmt_date_short(D.to_local("display_date", zone)), F.lit("-")).alias("date"), F.coalesce("_name", F.lit("-")).alias("prescriber"), dash("sig").alias("sig"),
        F.coalesce(F.nullif("refills", blank), F.lit("0")).alias("refills"), dash("quantity").alias("quantity"), "_ord")


def medication_view(med: DataFrame) -> DataFrame:
    """VW-04. Medication rows; their scripts are ``script_lines`` by medication id."""
    name = med_display_name(*[F.col(c) for c in ("display_name", "generic_name", "brand_name", "strength", "route", "dose_form")])
    return med.select("patient_id", "medication_id", name.alias("name"), "sig", start_stop("start", "stop").alias("start_stop"), F.when(F.col("active"), "active").otherwise("historical").alias("list"), "_ord")


def order_coverages(cov: DataFrame) -> DataFrame:
    """WIN-04. Rank by order of benefits within patient and status, unknown last."""
    o = F.coalesce(F.col("order_of_benefits"), F.lit(99))
    return block_scan(cov.withColumn("_bo", o), ["patient_id", "active"], ["_bo", "_ord"], F.struct("_bo", order_block("_ord")), {"rank": ("row_number", None)}).drop("_bo")


def insurance_view(cov: DataFrame) -> DataFrame:
    """VW-05. Insurance rows; TYPE is the plan type, never the generic coverage type."""
    priority = F.trim(F.coalesce("priority_label", F.lit("")))
    kind = F.upper(F.coalesce(F.nullif("coverage_type", F.lit("")), F.lit("MEDICAL")))
    c = order_coverages(cov)
    return c.select(
        "patient_id", "coverage_id", "active", "rank", F.when(priority != "", F.concat(priority, F.lit(" - "), kind)).otherwise(kind).alias("sub_header"), dash("payer").alias("payer"), dash("member_id").alias("member_id"),
        dash(priority).alias("priority"), dash("group_number").alias("group_number"), dash("plan_type").alias("type"), dash("employer").alias("employer"), dash("relationship").alias("relationship"),
        dash(D.fmt_date_short("start")).alias("start_date"), dash(D.fmt_date_short("end")).alias("end_date"), fmt_copay("copay").alias("copay"), F.when(F.col("active"), "Active").otherwise("Inactive").alias("status"))


def payment_view(patients: DataFrame) -> DataFrame:
    """VW-06. Payment cells with their exact empty states."""
    g = F.col("guarantor")
    phone = lambda kind: F.get(F.filter("guarantor.phones", lambda p: p["kind"] == kind), F.lit(0))["value"]
    tagged = F.exists("guarantor.phones", lambda p: p["kind"].isin("phone-home", "phone-other"))
    primary = F.when(tagged, phone("phone-home")).otherwise(F.get("guarantor.phones", F.lit(0))["value"])
    secondary = F.when(tagged, phone("phone-other")).otherwise(F.get("guarantor.phones", F.lit(1))["value"])
    a = g["address"]
    addr = F.when(a["line1"].isNotNull(), F.concat_ws(", ", a["line1"], a["city"], a["state"], a["postal_code"]))
    return patients.select(
        "patient_id", F.coalesce(g["payment_preference"], F.lit("Primary Insurance")).alias("preference"), dash(g["relationship"]).alias("relationship"), dash(g["name"]).alias("guarantor_name"), dash(addr).alias("guarantor_addr"),
        dash(D.fmt_date_us(g["birth_date"])).alias("dob"), dash(g["sex"]).alias("sex"), dash(g["ssn"]).alias("ssn"), dash(primary).alias("primary_phone"), dash(secondary).alias("secondary_phone"))


def vital_label(code: Column | str = "code", display: Column | str = "display") -> Column:
    """Chart label of a vital by code, else its own display or code."""
    return F.coalesce(lookup(VITAL_LABEL_BY_CODE, code), F.nullif(_c(display), F.lit("")), _c(code), F.lit(""))


def vitals_view(obs: DataFrame) -> DataFrame:
    """VW-07. Vital rows per encounter: fixed order, combined blood pressure, unknown ones last.

    The last charted value of a label counts.
    """
    v = obs.filter((F.col("category") == "vital-signs") & F.col("value").isNotNull() & F.col("encounter_id").isNotNull())
    shown = F.trim(F.concat_ws(" ", "value", F.nullif("unit", F.lit(""))))
    v = v.select("encounter_id", vital_label().alias("label"), shown.alias("shown"), "_ord")
    last = last_row(v, ["encounter_id", "label"], ["_ord"])
    pressure = last.filter(F.col("label").isin("Systolic BP", "Diastolic BP")).groupBy("encounter_id").agg(
        F.max(F.when(F.col("label") == "Systolic BP", F.substring_index("shown", " ", 1))).alias("s"), F.max(F.when(F.col("label") == "Diastolic BP", F.substring_index("shown", " ", 1))).alias("d"))
    both = F.regexp_replace(F.concat(F.coalesce("s", F.lit("")), F.lit("/"), F.coalesce("d", F.lit(""))), "^/+|/+$", "")
    rows = last.filter(~F.col("label").isin("Systolic BP", "Diastolic BP")).select("encounter_id", "label", "shown").unionByName(pressure.select("encounter_id", F.lit("Blood Pressure").alias("label"), both.alias("shown")))
    rank = F.coalesce(lookup({name: i for i, name in enumerate(VITAL_ROW_ORDER)}, "label"), F.lit(99))
    return rows.select("encounter_id", rank.alias("position"), F.col("label").alias("name"), F.col("shown").alias("value"))


def vitals_flowsheet(enc: DataFrame, obs: DataFrame, k: int = FLOWSHEET_COLUMNS) -> DataFrame:
    """WIN-02. Vitals of the ``k`` latest strictly earlier encounters, long form.

    No pairs of encounters are built. Encounters with vitals get their
    position in time per patient; an encounter with ``n`` earlier ones shows
    positions ``n-k+1 .. n``, which is an equality join on (patient, position).
    Vitals and dated encounters are read several times, so both are written first.
    """
    v = obs.filter((F.col("category") == "vital-signs") & F.col("value").isNotNull() & F.col("encounter_id").isNotNull())
    v = v.select("encounter_id", F.coalesce(lookup(VITAL_LABEL_BY_CODE, "code"), "display", F.lit("")).alias("label"), "value", "_ord")
    v = cut_lineage(v)
    cells = last_row(v, ["encounter_id", "label"], ["_ord"]).select("encounter_id", "label", "value")
    first_seen = v.groupBy("encounter_id").agg(F.min("_ord").alias("_seen"))
    dated = cut_lineage(enc.filter(F.col("date_of_service").isNotNull()).select("patient_id", "encounter_id", "date_of_service"))
    prior = dated.join(first_seen, "encounter_id").withColumn("_late", -F.col("_seen"))
    block = F.trunc("date_of_service", "month")
    placed = block_scan(prior, ["patient_id"], ["date_of_service", "_late"], block, {"pos": ("row_number", None)}).select(
        "patient_id", "pos", F.col("encounter_id").alias("prior_id"), F.col("date_of_service").alias("prior_date"))
    per_day = prior.groupBy("patient_id", "date_of_service").agg(F.count(F.lit(1)).alias("_n"))
    days = dated.select("patient_id", "date_of_service").distinct().join(per_day, ["patient_id", "date_of_service"], "left").fillna(0, ["_n"])
    earlier = block_scan(days, ["patient_id"], ["date_of_service"], block, {"_upto": ("sum", "_n")}).withColumn("_before", F.col("_upto") - F.col("_n"))
    spans = dated.join(earlier.select("patient_id", "date_of_service", "_before"), ["patient_id", "date_of_service"]).filter(F.col("_before") > 0)
    wanted = spans.select("patient_id", "encounter_id", "_before", F.explode(F.sequence(F.greatest(F.col("_before") - k + 1, F.lit(1)), F.col("_before"))).alias("pos"))
    columns = wanted.join(placed, ["patient_id", "pos"])
    columns = columns.select("patient_id", "encounter_id", (F.col("_before") - F.col("pos") + 1).alias("column_no"), "prior_id", D.fmt_date_short("prior_date").alias("column_date"))
    filled = cells.filter(F.col("label").isin(*VITAL_ROW_ORDER) & (F.col("value") != "")).withColumnRenamed("encounter_id", "prior_id")
    return columns.join(filled, "prior_id").select("patient_id", "encounter_id", "column_no", "column_date", F.col("label").alias("name"), "value")


def diagnosis_view(cond: DataFrame) -> DataFrame:
    """VW-08. Diagnosis rows, current and historical."""
    return cond.select("patient_id", "condition_id", F.col("display").alias("description"), dash("acuity").alias("acuity"), dash(D.fmt_date_short("onset")).alias("start"), dash(D.fmt_date_short("stopped")).alias("stop"),
                       F.when(F.col("active"), "current").otherwise("historical").alias("list"))


def encounter_diagnoses(links: DataFrame, cond: DataFrame) -> DataFrame:
    """VW-08, JN-08. Diagnoses attached to an encounter with their codes."""
    codes = F.concat_ws(", ", F.concat(F.lit("ICD-10: "), F.nullif("icd10", F.lit(""))), F.concat(F.lit("SNOMED: "), F.nullif("snomed", F.lit(""))))
    full = F.when(codes != "", F.concat(F.lit("["), codes, F.lit("]"))).otherwise("")
    c = cond.select(F.col("condition_id").alias("diagnosis_id"), dash("display").alias("description"), full.alias("full_codes"))
    return links.select("encounter_id", "diagnosis_id", "_ord").join(c, "diagnosis_id")


def allergy_view(allergies: DataFrame) -> DataFrame:
    """VW-09. Allergy rows by category and status."""
    blank = F.lit("")
    reactions = F.nullif(F.array_join("reactions", ", "), blank)
    return allergies.select("patient_id", "allergy_id", "category", F.when(F.col("active"), "active").otherwise("inactive").alias("list"), F.col("substance").alias("name"),
                            dash(F.concat_ws(" / ", F.nullif("severity", blank), reactions)).alias("severity_reactions"), dash(D.fmt_date_short("onset")).alias("onset"))


def list_views(tables: Mapping[str, DataFrame], zone: str = "America/New_York") -> dict[str, DataFrame]:
    """VW-10. Goals, immunizations, directives and family history rows."""
    out = {}
    if "immunizations" in tables:
        out["immunizations"] = tables["immunizations"].select("patient_id", dash(D.fmt_date_short("administered_on")).alias("date"), dash("vaccine").alias("vaccine"), dash("source").alias("source"), dash("lot_number").alias("lot"),
                                                              dash(D.fmt_date_short("expires")).alias("expires"), F.coalesce("comment", F.lit("")).alias("comment"))
    if "directives" in tables:
        out["directives"] = tables["directives"].filter(F.col("directive").isNotNull()).select("patient_id", "directive", F.coalesce(D.fmt_signed_at("recorded_at", zone), F.lit("")).alias("recorded"))
    if "family_history" in tables:
        out["family_history"] = tables["family_history"].filter(F.col("diagnosis").isNotNull()).select("patient_id", "diagnosis", D.fmt_date_short("onset_date").alias("onset"))
    if "goals" in tables:
        out["goals"] = tables["goals"].select("patient_id", "description", dash(D.fmt_date_short("effective")).alias("date"), F.when(F.col("active"), "active").otherwise("inactive").alias("list"))
    return out


def addenda_view(addenda: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """VW-11. Addenda with text; status line and local time."""
    blank = F.lit("")
    status, author, cred = F.coalesce("status", blank), F.coalesce("author_name", blank), F.coalesce("author_credential", blank)
    line = F.when((status != "") | (author != ""), F.trim(F.concat(status, F.lit(" by "), author))).otherwise("")
    full = F.when(cred != "", strip(F.concat(line, F.lit("\n"), cred))).otherwise(line)
    rows = addenda.filter(F.coalesce(strip("text"), blank) != "")
    return rows.select("encounter_id", "text", full.alias("status"), F.coalesce("source", blank).alias("source"), D.fmt_addendum_at("at", zone).alias("datetime"), "_ord")


def view_index(tables: Mapping[str, DataFrame]) -> DataFrame:
    """VW-12. Rows per patient, list and group in one pass over each table.

    ``tables`` may hold conditions, medications, allergies and coverages.
    """
    groups = {"conditions": F.lit("all"), "medications": F.lit("all"), "allergies": F.col("category"), "coverages": F.lit("all")}
    pieces = [df.groupBy("patient_id", F.lit(name).alias("list"), groups[name].alias("group")).agg(F.count_if("active").alias("n_active"), F.count_if(~F.col("active")).alias("n_inactive")) for name, df in tables.items() if name in groups]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def header_view(enc: DataFrame, patients: DataFrame, practitioners: DataFrame, facilities: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """VW-13. Header and demographics of each encounter."""
    p = patients.select("patient_id", F.nullif(F.concat_ws(" ", "given_name", "family_name"), F.lit("")).alias("_name"), "birth_date", "sex", "status", F.array_join("race", ", ").alias("race"), F.array_join("ethnicity", ", ").alias("ethnicity"))
    prov = practitioners.select(F.col("practitioner_id").alias("provider_id"), F.col("name").alias("seen_by_name"))
    sign = practitioners.select(F.col("practitioner_id").alias("signed_by_id"), F.col("name").alias("signed_by_name"))
    fac = facilities.select("facility_id", F.col("name").alias("fac_name"), F.col("phone").alias("fac_phone"), F.nullif(F.concat_ws(" ", "city", "state", "postal_code"), F.lit("")).alias("fac_city_state_zip"))
    e = enc.join(p, "patient_id").join(prov, "provider_id", "left").join(sign, "signed_by_id", "left").join(fac, "facility_id", "left")
    return e.select(
        "encounter_id", "patient_id", F.coalesce("_name", F.lit("Unknown patient")).alias("patient_name"), D.fmt_date_us("birth_date").alias("dob"), D.age_display("birth_date", "date_of_service", mode="null").alias("age"), "sex",
        F.nullif("race", F.lit("")).alias("race"), F.nullif("ethnicity", F.lit("")).alias("ethnicity"), F.coalesce(D.fmt_date_long("date_of_service"), F.lit("Undated")).alias("dos"), "encounter_type", "note_type", "chief_complaint",
        "seen_by_name", "signed_by_name", D.fmt_signed_at("signed_at", zone).alias("signed_at"), "fac_name", "fac_phone", "fac_city_state_zip")


def generic_chart(header: DataFrame, sections: DataFrame, vitals: DataFrame, flags: Mapping[str, bool]) -> DataFrame:
    """VW-14. Chart lines of an encounter: header, filled sections, vitals, in order.

    ``sections`` has ``encounter_id, sections``. Blocks whose flag is off give
    no lines.
    """
    h = header.select("encounter_id", F.posexplode(F.array(
        F.col("patient_name"), F.concat(F.lit("DOB: "), F.col("dob")), F.concat(F.lit("Age: "), F.col("age")), F.concat(F.lit("Sex: "), F.col("sex")), F.concat(F.lit("Date of service: "), F.col("dos")),
        F.concat(F.lit("Provider: "), F.col("seen_by_name")), F.concat(F.lit("Facility: "), F.col("fac_name")), F.concat(F.lit("Chief complaint: "), F.col("chief_complaint")))).alias("line_no", "line"))
    out = h.withColumn("block", F.lit(0))
    filled = F.filter("sections", lambda s: F.coalesce(strip(s["text"]), F.lit("")) != "")
    body = sections.select("encounter_id", F.posexplode(filled).alias("line_no", "s")).select("encounter_id", "line_no", F.concat_ws("\n", "s.title", "s.text").alias("line"), F.lit(1).alias("block"))
    out = out.unionByName(body)
    if flags.get("vitals", True):
        out = out.unionByName(vitals.select("encounter_id", F.col("position").alias("line_no"), F.concat_ws(": ", "name", "value").alias("line"), F.lit(2).alias("block")))
    signed = header.filter(F.col("signed_by_name").isNotNull() & F.col("signed_at").isNotNull()).select(
        "encounter_id", F.lit(0).alias("line_no"), F.concat(F.lit("Signed by "), F.col("signed_by_name"), F.lit(" on "), F.col("signed_at")).alias("line"), F.lit(3).alias("block"))
    return out.unionByName(signed).filter(F.col("line").isNotNull())


def chart_text(lines: DataFrame) -> DataFrame:
    """VW-15. The text an encounter's document must hold.

    An encounter has a fixed set of header lines, its sections and one line
    per vital label, so its lines are few.
    """
    grouped = lines.groupBy("encounter_id").agg(F.sort_array(F.collect_list(F.struct("block", "line_no", "line"))).alias("_l"))
    return grouped.select("encounter_id", F.array_join("_l.line", "\n").alias("text"))


# View sets by name: tables and settings in, views out.
VIEW_SETS: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def build_views(tables: Mapping[str, DataFrame], zone: str = "America/New_York") -> dict[str, DataFrame]:
    """Every view of a canonical export."""
    out = {
        "header": header_view(tables["encounters"], tables["patients"], tables["practitioners"], tables["facilities"], zone),
        "vitals": vitals_view(tables["observations"]), "flowsheet": vitals_flowsheet(tables["encounters"], tables["observations"]),
        "medications": medication_view(tables["medications"]), "scripts": script_lines(tables["prescriptions"], tables["practitioners"], zone), "insurance": insurance_view(tables["coverages"]),
        "payment": payment_view(tables["patients"]), "diagnoses": diagnosis_view(tables["conditions"]), "encounter_diagnoses": encounter_diagnoses(tables["encounter_diagnoses"], tables["conditions"]),
        "allergies": allergy_view(tables["allergies"]), "addenda": addenda_view(tables["addenda"], zone),
    }
    return {**out, **list_views(tables, zone)}


VIEW_SETS["full"] = build_views
