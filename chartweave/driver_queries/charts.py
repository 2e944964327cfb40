"""Chart views over the driver export."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.driver_queries.base import load, query
from chartweave.driver_queries.exports import DriverExport
from chartweave.driver_queries.mapping import ENC_SQL, OBS_SQL, PLAN_SQL, STATUS_SQL
from chartweave.plans import tsv_mapping as M
from chartweave.plans import views as V


@query("medication_view", """
SELECT 'm-' || p_partkey AS medication_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || CASE WHEN p_partkey % 3 <> 0 THEN ' (' || p_brand || ')' ELSE '' END || ' ' || p_size || ' mg Oral' || CASE WHEN p_partkey % 4 = 0 THEN ' Tablet' ELSE '' END END AS name,
  '03/04/15' || CASE WHEN p_partkey % 7 = 0 THEN ' - 05/06/16' ELSE '' END AS start_stop, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN 'active' ELSE 'historical' END AS list FROM part""")
def medication_view(spark, sf):
    return V.medication_view(M.map_medications(DriverExport(spark, sf)["patient-medications"])).select("medication_id", "name", "start_stop", "list")


@query("script_lines", f"""
WITH {STATUS_SQL},
r AS (SELECT (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS ord, coalesce(prefix, CASE WHEN l_linenumber % 3 = 0 THEN 'SCRIPT' ELSE 'ESCRIPT' END) AS p, coalesce(label, known, last_word, 'VERIFIED') AS status, sent,
  CASE WHEN l_suppkey % 13 = 12 THEN NULL ELSE l_shipdate END AS service, l_suppkey, l_linenumber, l_quantity, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN st ON rx = 'rx-' || l_orderkey)
SELECT l_orderkey, ord, p AS prefix, status, coalesce(strftime(((CASE WHEN p = 'ESCRIPT' THEN coalesce(sent, service) ELSE service END) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%m/%d/%y'), '-') AS date, coalesce('Dr ' || s_name, '-') AS prescriber,
  CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '9' ELSE CAST(l_linenumber AS VARCHAR) END AS refills, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity FROM r LEFT JOIN supplier ON s_suppkey = l_suppkey % 10""")
def script_lines(spark, sf):
    t = DriverExport(spark, sf)
    rx = M.map_prescriptions(t["patient-prescriptions"], t["prescription-transactions"])
    s = V.script_lines(rx, M.map_practitioners(t["providers"]))
    return s.select(F.substring("prescription_id", 4, 20).cast("bigint").alias("l_orderkey"), F.col("_ord").alias("ord"), "prefix", "status", "date", "prescriber", "refills", "quantity")


@query("insurance_view", PLAN_SQL + """,
k AS (SELECT c_custkey AS k, 'plan-' || c_custkey AS coverage_id FROM customer)
SELECT c.coverage_id, CASE c_custkey % 6 WHEN 0 THEN 'PRIMARY PAYER - MEDICAL' WHEN 1 THEN 'SECONDARY PAYER - MEDICAL' WHEN 2 THEN 'TERTIARY PAYER - MEDICAL' WHEN 3 THEN 'OTHER PAYER - MEDICAL' WHEN 4 THEN 'WEIRD PAYER - MEDICAL' ELSE 'MEDICAL' END AS sub_header,
  coalesce(byid.t, n1.t, n2.t, CASE WHEN c_custkey % 3 = 0 THEN 'PPO' END, '-') AS type, CASE c_custkey % 4 WHEN 1 THEN '25' WHEN 2 THEN '12.5' ELSE '-' END AS copay, '01/05/12' AS start_date, '-' AS end_date, '-' AS group_number
FROM c LEFT JOIN byid ON g = coverage_id LEFT JOIN byname n1 ON n1.n = lower(plan_name) LEFT JOIN byname n2 ON n2.n = lower(payer)""")
def insurance_view(spark, sf):
    t = DriverExport(spark, sf)
    return V.insurance_view(M.map_coverages(t["patient-insurances"], t["superbill-insurances"])).select("coverage_id", "sub_header", "type", "copay", "start_date", "end_date", "group_number")


@query("payment_view", """
SELECT 'p-' || c_custkey AS patient_id, CASE WHEN k % 3 = 0 THEN 'Self pay' ELSE 'Primary Insurance' END AS preference, coalesce('Gee Payer' || k, '-') AS guarantor_name, CASE WHEN k IS NULL THEN '-' ELSE 'Line 1, Town, NY, 10001' END AS guarantor_addr,
  CASE WHEN k IS NULL OR k % 13 = 12 THEN '-' ELSE strftime(d, '%m/%d/%Y') END AS dob, '-' AS ssn, '-' AS secondary_phone FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderdate, o_orderkey) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def payment_view(spark, sf):
    return V.payment_view(M.map_patients(DriverExport(spark, sf))).select("patient_id", "preference", "guarantor_name", "guarantor_addr", "dob", "ssn", "secondary_phone")


VITALS_SQL = f"""
o AS ({OBS_SQL}), v AS (SELECT encounter_id, ord, value, unit, CASE code WHEN '8302-2' THEN 'Height' WHEN '3141-9' THEN 'Weight' WHEN '29463-7' THEN 'Weight' WHEN '39156-5' THEN 'BMI' WHEN '8480-6' THEN 'S' WHEN '8462-4' THEN 'D' WHEN '8310-5' THEN 'Temperature' WHEN '72514-3' THEN 'Pain' END AS label FROM o WHERE category = 'vital-signs'),
l AS (SELECT encounter_id, label, arg_max(value || coalesce(' ' || unit, ''), ord) AS shown, arg_max(value, ord) AS value FROM v GROUP BY 1, 2)"""


@query("vitals_view", f"""
WITH {VITALS_SQL}
SELECT encounter_id, label AS name, shown AS value, CASE label WHEN 'Height' THEN 0 WHEN 'Weight' THEN 1 WHEN 'BMI' THEN 2 WHEN 'Temperature' THEN 5 WHEN 'Pain' THEN 9 END AS position FROM l WHERE label NOT IN ('S', 'D')
UNION ALL SELECT encounter_id, 'Blood Pressure', trim(coalesce(max(CASE WHEN label = 'S' THEN value END), '') || '/' || coalesce(max(CASE WHEN label = 'D' THEN value END), ''), '/'), 4 FROM l WHERE label IN ('S', 'D') GROUP BY 1""")
def vitals_view(spark, sf):
    return V.vitals_view(M.map_observations(DriverExport(spark, sf)["patient-encounter-observations"])).select("encounter_id", "name", "value", "position")


@query("vitals_flowsheet", f"""
WITH {VITALS_SQL},
seen AS (SELECT encounter_id, min(ord) AS s FROM v GROUP BY 1),
e AS (SELECT encounter_id, patient_id, date_of_service AS d FROM ({ENC_SQL}) WHERE date_of_service IS NOT NULL),
pr AS (SELECT e.*, s FROM e JOIN seen USING (encounter_id)),
pairs AS (SELECT c.encounter_id, p.encounter_id AS prior_id, p.d AS pd, row_number() OVER (PARTITION BY c.encounter_id ORDER BY p.d DESC, p.s) AS column_no FROM e c JOIN pr p ON p.patient_id = c.patient_id AND p.d < c.d)
SELECT pairs.encounter_id, column_no, strftime(pd, '%m/%d/%y') AS column_date, label AS name, value FROM pairs JOIN l ON l.encounter_id = prior_id WHERE column_no <= 10 AND label NOT IN ('S', 'D')""")
def vitals_flowsheet(spark, sf):
    t = DriverExport(spark, sf)
    enc = M.map_encounters(t).select("patient_id", "encounter_id", "date_of_service")
    return V.vitals_flowsheet(enc, M.map_observations(t["patient-encounter-observations"])).select("encounter_id", "column_no", "column_date", "name", "value")


@query("flowsheet_top10", """
WITH p AS (SELECT c.o_orderkey AS encounter_id, p.o_orderkey AS prior_id, row_number() OVER (PARTITION BY c.o_orderkey ORDER BY p.o_orderdate DESC, p.o_orderkey) AS column_no, p.o_orderstatus AS value FROM orders c JOIN orders p ON p.o_custkey = c.o_custkey AND p.o_orderdate < c.o_orderdate)
SELECT encounter_id, column_no, value FROM p WHERE column_no <= 10""")
def flowsheet_top10(spark, sf):
    o = load(spark, sf, "orders")
    enc = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").cast("date").alias("date_of_service"))
    obs = o.select(F.col("o_orderkey").alias("encounter_id"), F.lit("vital-signs").alias("category"), F.lit("8302-2").alias("code"), F.lit("h").alias("display"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("_ord"))
    return V.vitals_flowsheet(enc, obs).select("encounter_id", "column_no", "value")


@query("diagnosis_view", """
SELECT 'd-' || p_partkey AS condition_id, p_name AS description, CASE WHEN p_partkey % 4 = 0 THEN 'Chronic' ELSE '-' END AS acuity, strftime(DATE '2010-01-01' + CAST(p_partkey % 3000 AS INT), '%m/%d/%y') AS start,
  CASE WHEN p_partkey % 5 = 0 THEN '01/31/20' ELSE '-' END AS stop, CASE WHEN p_partkey % 5 = 0 THEN 'historical' ELSE 'current' END AS list FROM part""")
def diagnosis_view(spark, sf):
    return V.diagnosis_view(M.map_conditions(DriverExport(spark, sf)["patient-diagnoses"])).drop("patient_id")


@query("encounter_diagnoses", """
SELECT 'e-' || l_orderkey AS encounter_id, 'd-' || l_partkey AS diagnosis_id, CASE p_partkey % 3 WHEN 0 THEN '[ICD-10: E' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || p_partkey % 10 || ', SNOMED: ' || (1000000 + p_partkey) || ']' WHEN 1 THEN '[SNOMED: ' || (2000000 + p_partkey) || ']' ELSE '' END AS full_codes, count(*) AS n
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 7 GROUP BY 1, 2, 3""")
def encounter_diagnoses(spark, sf):
    t = DriverExport(spark, sf)
    v = V.encounter_diagnoses(M.map_diagnosis_links(t), M.map_conditions(t["patient-diagnoses"]))
    return v.groupBy("encounter_id", "diagnosis_id", "full_codes").agg(F.count(F.lit(1)).alias("n"))


@query("allergy_view", """
SELECT 'a-' || s_suppkey AS allergy_id, CASE s_suppkey % 4 WHEN 0 THEN 'drug' WHEN 1 THEN 'food' WHEN 2 THEN 'environment' ELSE 'other' END AS category, CASE WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'inactive' END AS list,
  CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN r IS NULL THEN 'Severe' ELSE 'Severe / ' || r END ELSE coalesce(r, '-') END AS severity_reactions
FROM supplier LEFT JOIN (SELECT l_suppkey, string_agg('Reaction' || l_linenumber, ', ' ORDER BY o) AS r FROM (SELECT l_suppkey, l_linenumber, min((l_partkey * 100000 + l_orderkey) * 8 + l_linenumber) AS o FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2) GROUP BY 1) ON l_suppkey = s_suppkey""")
def allergy_view(spark, sf):
    t = DriverExport(spark, sf)
    return V.allergy_view(M.map_allergies(t["patient-allergy"], t["patient-allergy-reactions"])).select("allergy_id", "category", "list", "severity_reactions")


@query("list_views", """
SELECT 'immunization' AS kind, 'p-' || p_partkey % 100 AS patient_id, p_brand AS label, CASE WHEN p_partkey % 2 = 0 THEN '06/07/18' WHEN p_partkey % 3 = 0 THEN '01/02/17' ELSE '-' END AS date FROM part
UNION ALL SELECT 'directive', 'p-' || c_custkey, 'Living will', 'Feb 3, 2019 11:05 AM' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'family', 'p-' || o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE CAST(700000 + o_orderkey AS VARCHAR) END, CASE WHEN o_orderkey % 3 = 0 THEN '04/05/99' END FROM orders JOIN customer ON c_custkey = o_custkey""")
def list_views(spark, sf):
    t = DriverExport(spark, sf)
    v = V.list_views({"immunizations": M.map_immunizations(t["patient-immunizations"]), "directives": M.map_directives(t["patient-advance-directives"]),
                      "family_history": M.map_family_history(t["patient-family-medical-history"], t["patient-family-history-diagnoses"])})
    a = v["immunizations"].select(F.lit("immunization").alias("kind"), "patient_id", F.col("vaccine").alias("label"), "date")
    b = v["directives"].select(F.lit("directive").alias("kind"), "patient_id", F.col("directive").alias("label"), F.col("recorded").alias("date"))
    c = v["family_history"].select(F.lit("family").alias("kind"), "patient_id", F.col("diagnosis").alias("label"), F.col("onset").alias("date"))
    return a.unionByName(b).unionByName(c)


@query("addenda_view", """
SELECT 'e-' || conv_id AS encounter_id, turn, CASE WHEN turn % 2 = 0 THEN 'Accepted by' ELSE '' END AS status, role AS source, '01/02/2024 10:04 am' AS datetime FROM conversations WHERE trim(text) <> ''""")
def addenda_view(spark, sf):
    return V.addenda_view(M.map_addenda(DriverExport(spark, sf))).select("encounter_id", (F.col("_ord") % 4096).alias("turn"), "status", "source", "datetime")


@query("view_index", """
SELECT 'p-' || p_partkey % 100 AS patient_id, 'conditions' AS list, 'all' AS "group", count(*) FILTER (p_partkey % 5 <> 0) AS n_active, count(*) FILTER (p_partkey % 5 = 0) AS n_inactive FROM part GROUP BY 1
UNION ALL SELECT 'p-' || s_suppkey % 50, 'allergies', CASE s_suppkey % 4 WHEN 0 THEN 'drug' WHEN 1 THEN 'food' WHEN 2 THEN 'environment' ELSE 'other' END, count(*) FILTER (s_suppkey % 2 = 0), count(*) FILTER (s_suppkey % 2 = 1) FROM supplier GROUP BY 1, 3""")
def view_index(spark, sf):
    t = DriverExport(spark, sf)
    return V.view_index({"conditions": M.map_conditions(t["patient-diagnoses"]), "allergies": M.map_allergies(t["patient-allergy"], t["patient-allergy-reactions"])})


HEADER_SQL = f"""
e AS ({ENC_SQL}), c AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || c_name AS patient_name, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
  CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INT) END AS bd FROM customer),
j AS (SELECT *, (year(date_of_service) - year(bd)) * 12 + month(date_of_service) - month(bd) - CASE WHEN day(date_of_service) < day(bd) THEN 1 ELSE 0 END AS mo FROM e JOIN c ON c_custkey = o_custkey),
h AS (SELECT encounter_id, patient_name, sex, strftime(bd, '%m/%d/%Y') AS dob, coalesce(strftime(date_of_service, '%B %d, %Y'), 'Undated') AS dos,
  CASE WHEN date_of_service >= bd THEN CASE WHEN mo < 1 THEN (date_of_service - bd) || CASE WHEN date_of_service - bd = 1 THEN ' day' ELSE ' days' END WHEN mo < 24 THEN mo || CASE WHEN mo = 1 THEN ' mo' ELSE ' mos' END ELSE mo // 12 || CASE WHEN mo // 12 = 1 THEN ' yr' ELSE ' yrs' END END END AS age,
  'Dr ' || s1.s_name AS seen_by_name, 'Dr ' || s2.s_name AS signed_by_name, strftime((signed_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%b %-d, %Y %-I:%M %p') AS signed_at, n_name AS fac_name, 'City' || n_nationkey || ' NY 10001' AS fac_city_state_zip, chief_complaint, o_orderkey, o_custkey, note_text, kinds
  FROM j LEFT JOIN supplier s1 ON s1.s_suppkey = o_custkey % 10 LEFT JOIN supplier s2 ON s2.s_suppkey = o_orderkey % 10 LEFT JOIN nation ON n_nationkey = o_custkey % 25)"""


@query("header_view", f"WITH {HEADER_SQL} SELECT encounter_id, patient_name, sex, dob, dos, age, seen_by_name, signed_by_name, signed_at, fac_name, fac_city_state_zip FROM h")
def header_view(spark, sf):
    return _header(DriverExport(spark, sf)).select("encounter_id", "patient_name", "sex", "dob", "dos", "age", "seen_by_name", "signed_by_name", "signed_at", "fac_name", "fac_city_state_zip")


def _header(t):
    return V.header_view(M.map_encounters(t), M.map_patients(t), M.map_practitioners(t["providers"]), M.map_facilities(t["facilities"]))


@query("chart_text", f"""
WITH {HEADER_SQL}, {VITALS_SQL.replace('o AS', 'ob AS').replace('FROM o WHERE', 'FROM ob WHERE')},
vit AS (SELECT encounter_id, string_agg(name || ': ' || value, chr(10) ORDER BY position) AS t FROM (
  SELECT encounter_id, label AS name, shown AS value, CASE label WHEN 'Height' THEN 0 WHEN 'Weight' THEN 1 WHEN 'BMI' THEN 2 WHEN 'Temperature' THEN 5 WHEN 'Pain' THEN 9 END AS position FROM l WHERE label NOT IN ('S', 'D')
  UNION ALL SELECT encounter_id, 'Blood Pressure', trim(coalesce(max(CASE WHEN label = 'S' THEN value END), '') || '/' || coalesce(max(CASE WHEN label = 'D' THEN value END), ''), '/'), 4 FROM l WHERE label IN ('S', 'D') GROUP BY 1) GROUP BY 1)
SELECT h.encounter_id, md5(patient_name || coalesce(chr(10) || 'DOB: ' || dob, '') || coalesce(chr(10) || 'Age: ' || age, '') || chr(10) || 'Sex: ' || sex || chr(10) || 'Date of service: ' || dos || coalesce(chr(10) || 'Provider: ' || seen_by_name, '') || coalesce(chr(10) || 'Facility: ' || fac_name, '')
  || chr(10) || 'Chief complaint: ' || chief_complaint
  || CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN chr(10) || note_text ELSE chr(10) || 'Subjective' || chr(10) || replace(note_text, '|stable', chr(10) || 'Assessment' || chr(10) || 'stable') END
  || coalesce(chr(10) || vit.t, '') || coalesce(chr(10) || 'Signed by ' || signed_by_name || ' on ' || signed_at, '')) AS digest
FROM h LEFT JOIN vit ON vit.encounter_id = h.encounter_id""")
def chart_text(spark, sf):
    t = DriverExport(spark, sf)
    sections = M.map_encounters(t).select("encounter_id", "sections")
    lines = V.generic_chart(_header(t), sections, V.vitals_view(M.map_observations(t["patient-encounter-observations"])), {"vitals": True})
    return V.chart_text(lines).select("encounter_id", F.md5(F.col("text").cast("binary")).alias("digest"))
