"""TSV mapping jobs over the driver export (MAP-01..12 and what they use)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.driver_queries.base import ntz, query
from chartweave.driver_queries.exports import DriverExport
from chartweave.functions.codes import SCRIPT_LABELS
from chartweave.functions.dates import date_spellings
from chartweave.functions.text import present
from chartweave.operators import folds, joins
from chartweave.operators.sets import column_coverage
from chartweave.plans import quarantine, tsv_mapping as M

KEYS = "patient_id"


def ext(name: str):
    return F.try_element_at("extensions", F.lit(f"tsv:{name}")).alias(f"x_{name.lower()}")


PATIENT_SQL = """
SELECT 'p-' || c_custkey AS patient_id, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS given_name,
  CASE WHEN c_custkey % 3 = 2 THEN 'Q' END AS middle_name, c_name AS family_name,
  CASE WHEN c_custkey % 5 = 0 THEN 'Jr' END AS suffix,
  CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INT) END AS birth_date,
  CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
  CASE WHEN c_custkey % 4 = 0 THEN 'Inactive' ELSE 'Active' END AS status,
  '(' || substr(lpad(CAST(c_custkey AS VARCHAR), 10, '5'), 1, 3) || ') ' || substr(lpad(CAST(c_custkey AS VARCHAR), 10, '5'), 4, 3) || '-' || substr(lpad(CAST(c_custkey AS VARCHAR), 10, '5'), 7, 4)
    || '|x' || c_custkey || '|u' || c_custkey || '@example.com' AS telecom,
  'p-' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '|999-00-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE '' END AS identifiers,
  c_custkey || ' Main St' AS line1, CASE WHEN c_custkey % 6 <> 0 THEN 'Unit 2' END AS line2,
  CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment END AS x_preferredname,
  g.gi AS gender_identity, g.so AS sexual_orientation,
  CASE c_custkey % 3 WHEN 0 THEN 'Race' || c_nationkey % 5
     WHEN 1 THEN 'Race' || c_nationkey % 5 || ',Race' || (c_nationkey + 1) % 5
     ELSE 'Race' || c_nationkey % 5 || ',Race' || (c_nationkey + 1) % 5 || ',Race' || (c_nationkey + 2) % 5 END AS race,
  'Eth' || c_nationkey % 3 AS ethnicity, q.name AS guarantor, q.pay AS payment, q.phone AS guarantor_phone
FROM customer
LEFT JOIN (SELECT o_custkey, 'GI' || min(o_orderkey) % 4 AS gi, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'SO' END AS so FROM orders GROUP BY 1) g ON g.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, 'Gee Payer' || max(o_orderkey) AS name, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'Self pay' END AS pay,
   '(' || substr(lpad(CAST(max(o_orderkey) AS VARCHAR), 10, '5'), 1, 3) || ') ' || substr(lpad(CAST(max(o_orderkey) AS VARCHAR), 10, '5'), 4, 3) || '-' || substr(lpad(CAST(max(o_orderkey) AS VARCHAR), 10, '5'), 7, 4) AS phone
   FROM orders GROUP BY 1) q ON q.o_custkey = c_custkey"""


@query("map_patients", PATIENT_SQL)
def map_patients(spark, sf):
    p = M.map_patients(DriverExport(spark, sf))
    return p.select(
        "patient_id", "given_name", "middle_name", "family_name", "suffix", "birth_date", "sex", "status",
        F.array_join("telecom.value", "|").alias("telecom"), F.array_join("identifiers.value", "|").alias("identifiers"),
        F.col("addresses")[0]["line1"].alias("line1"), F.col("addresses")[0]["line2"].alias("line2"), ext("PreferredName"),
        "gender_identity", "sexual_orientation", F.array_join("race", ",").alias("race"), F.array_join("ethnicity", ",").alias("ethnicity"),
        F.col("guarantor.name").alias("guarantor"), F.col("guarantor.payment_preference").alias("payment"),
        F.col("guarantor.phones")[0]["value"].alias("guarantor_phone"),
    )


@query("patient_notes", """
WITH lines AS (
  SELECT 'p-' || c_custkey AS patient_id, 0 AS tier, c_custkey AS o, 'first note ' || c_custkey AS line FROM customer WHERE c_custkey % 4 = 1
  UNION ALL SELECT 'p-' || conv_id, 1, conv_id * 4096 + turn, CASE WHEN role = 'user' THEN 'Call' ELSE 'Note' END || ': ' || trim(text, ' ' || chr(10)) FROM conversations)
, numbered AS (SELECT *, (row_number() OVER (PARTITION BY patient_id ORDER BY tier, o) - 1) // 3 AS page FROM lines)
SELECT patient_id, page, string_agg(line, chr(10) ORDER BY tier, o) AS notes FROM numbered GROUP BY 1, 2""")
def patient_notes(spark, sf):
    return M.map_patient_notes(DriverExport(spark, sf), page_rows=3)


ENC_SQL = """
SELECT 'e-' || o_orderkey AS encounter_id, 'p-' || o_custkey AS patient_id,
  CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date_of_service,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Growth Chart review' ELSE o_orderpriority END AS chief_complaint,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SIMPLE' ELSE 'SOAP' END AS encounter_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Office Visit' END AS note_type,
  CASE WHEN o_custkey % 13 = 12 THEN NULL ELSE o_orderdate END AS signed_at,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Status ' || o_orderstatus || chr(10) || chr(10) || 'Total ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END
    || CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 9 <> 0 THEN '|stable' ELSE '' END AS note_text,
  CASE WHEN o_orderkey % 3 = 0 THEN 'narrative' ELSE 'subjective,objective,assessment,plan' END AS kinds,
  o_orderstatus AS x_isvirtualvisit, o_orderkey, o_custkey, o_orderdate FROM orders"""


@query("map_encounters", f"SELECT * EXCLUDE (o_orderkey, o_custkey, o_orderdate) FROM ({ENC_SQL})")
def map_encounters(spark, sf):
    e = M.map_encounters(DriverExport(spark, sf))
    texts = F.filter("sections.text", lambda t: t.isNotNull())
    return e.select(
        "encounter_id", "patient_id", "date_of_service", "chief_complaint", "encounter_type", "note_type",
        ntz("signed_at").alias("signed_at"), F.array_join(texts, "|").alias("note_text"),
        F.array_join("sections.kind", ",").alias("kinds"), ext("IsVirtualVisit"),
    )


@query("note_html_sections", """
SELECT 'e-' || o_orderkey AS encounter_id,
  CASE WHEN o_orderkey % 9 = 0 THEN '<div class="pf-rich-text"></div>' ELSE '<div class="pf-rich-text"><p>Status ' || o_orderstatus || '</p><p>Total ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '</p></div>' END AS first_html,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'stable' END AS assessment_html FROM orders""")
def note_html_sections(spark, sf):
    e = M.map_encounters(DriverExport(spark, sf))
    return e.select("encounter_id", F.col("sections")[0]["html"].alias("first_html"), F.get("sections", F.lit(2))["html"].alias("assessment_html"))


@query("encounter_selection", f"""
WITH e AS ({ENC_SQL}), b AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INT) END AS bd FROM customer)
SELECT encounter_id, CASE WHEN o_orderkey % 9 = 0 THEN 'empty_soap'
   WHEN o_orderkey % 10 = 0 AND bd IS NOT NULL AND date_of_service IS NOT NULL
     AND year(date_of_service) - year(bd) - CASE WHEN (month(date_of_service), day(date_of_service)) < (month(bd), day(bd)) THEN 1 ELSE 0 END >= 18 THEN 'adult_growth_chart' END AS skip_reason
FROM e JOIN b ON o_custkey = c_custkey""")
def encounter_selection(spark, sf):
    t = DriverExport(spark, sf)
    kept, skipped = M.select_encounters(M.map_encounters(t), M.map_patients(t))
    return kept.select("encounter_id", F.lit(None).cast("string").alias("skip_reason")).unionByName(skipped.select("encounter_id", "skip_reason"))


@query("map_addenda", """
SELECT 'e-' || conv_id AS encounter_id, turn, length(trim(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'))) AS n_chars,
  CASE WHEN turn % 2 = 0 THEN 'Accepted' END AS status, role AS source, TIMESTAMP '2024-01-02 15:04:05' AS at FROM conversations""")
def map_addenda(spark, sf):
    a = M.map_addenda(DriverExport(spark, sf))
    return a.select("encounter_id", (F.col("_ord") % 4096).alias("turn"), F.length("text").cast("bigint").alias("n_chars"), "status", "source", ntz("at").alias("at"))


@query("link_details", """
SELECT 'e-' || l_orderkey AS encounter_id, 'd-' || l_partkey AS diagnosis_id, p_name AS display, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 7 GROUP BY 1, 2, 3""")
def link_details(spark, sf):
    t = DriverExport(spark, sf)
    out = joins.link_details(M.map_diagnosis_links(t), M.map_conditions(t["patient-diagnoses"]), "diagnosis_id", "condition_id")
    return out.groupBy("encounter_id", "diagnosis_id", "display").agg(F.count(F.lit(1)).alias("n"))


OBS_SQL = """
SELECT 'p-' || o_custkey AS patient_id, 'e-' || l_orderkey AS encounter_id, o_orderkey, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS ord,
  CASE l_linenumber WHEN 1 THEN '8302-2' WHEN 2 THEN CASE WHEN l_partkey % 2 = 0 THEN '3141-9' ELSE '29463-7' END WHEN 3 THEN '8480-6' WHEN 4 THEN '8462-4'
    WHEN 5 THEN '72514-3' WHEN 6 THEN CASE WHEN l_partkey % 4 = 0 THEN '39156-5' ELSE '8310-5' END ELSE 'X-' || l_partkey % 3 END AS code,
  CASE l_linenumber WHEN 1 THEN 'Body height' WHEN 2 THEN 'Body weight' WHEN 3 THEN 'Systolic blood pressure' WHEN 4 THEN 'Diastolic blood pressure'
    WHEN 5 THEN 'Pain severity - 0-10 verbal numeric rating [Score]' WHEN 6 THEN CASE WHEN l_partkey % 4 = 0 THEN 'Body mass index (BMI) [Ratio]' ELSE 'Body temperature' END END AS display,
  CASE WHEN l_linenumber = 7 THEN 'other' ELSE 'vital-signs' END AS category,
  CASE WHEN l_linenumber = 5 THEN CASE l_partkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '6' WHEN 2 THEN '7' ELSE 'severe' END
    ELSE CAST(CAST(l_quantity AS INT) + CASE l_linenumber WHEN 1 THEN 40 WHEN 2 THEN 90 WHEN 3 THEN 100 ELSE 50 END AS VARCHAR) END AS value,
  CASE l_linenumber WHEN 1 THEN 'in' WHEN 2 THEN 'lbs' WHEN 3 THEN 'mmHg' WHEN 4 THEN 'mmHg' END AS unit,
  CASE WHEN l_partkey % 13 = 12 THEN NULL ELSE l_shipdate END AS effective_at,
  CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS x_comment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("map_observations", f"SELECT * EXCLUDE (o_orderkey) FROM ({OBS_SQL})")
def map_observations(spark, sf):
    o = M.map_observations(DriverExport(spark, sf)["patient-encounter-observations"])
    return o.select("patient_id", "encounter_id", F.col("_ord").alias("ord"), "code", "display", "category", "value", "unit", ntz("effective_at").alias("effective_at"), ext("Comment"))


@query("derived_bmi", f"""
WITH o AS ({OBS_SQL}), g AS (
  SELECT encounter_id, any_value(o_orderkey) AS k, arg_max(patient_id, ord) AS patient_id,
    CAST(arg_max(value, ord) FILTER (code = '8302-2') AS DOUBLE) * 2.54 AS h,
    CAST(coalesce(arg_max(value, ord) FILTER (code = '3141-9'), arg_max(value, ord) FILTER (code = '29463-7')) AS DOUBLE) * 0.45359237 AS w,
    bool_or(code = '39156-5') AS has FROM o GROUP BY 1)
SELECT encounter_id, patient_id, CAST(round(w / ((h / 100) * (h / 100)), 2) AS DOUBLE) AS bmi FROM g WHERE NOT has AND h > 0 AND w > 0 AND k % 9 <> 0""")
def derived_bmi(spark, sf):
    t = DriverExport(spark, sf)
    kept = M.map_encounters(t).filter(F.exists("sections", lambda s: s["text"].isNotNull()))
    return folds.derive_bmi(M.map_observations(t["patient-encounter-observations"]), kept).select("encounter_id", "patient_id", F.col("value").cast("double").alias("bmi"))


@query("social_history", """
SELECT 'p-' || c_custkey AS patient_id, display, value, TIMESTAMP '2020-01-02' AS effective_at FROM customer, (SELECT 'Tobacco use' AS display, 'Never smoker' AS value) WHERE c_custkey % 2 = 0
UNION ALL SELECT 'p-' || c_custkey, 'Occupation', c_mktsegment, TIMESTAMP '2021-03-04' FROM customer
UNION ALL SELECT 'p-' || c_custkey, 'Industry', 'Retail', TIMESTAMP '2021-03-04' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'p-' || c_custkey, 'Education', 'College', NULL FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'p-' || c_custkey, 'Financial resources', 'Low', TIMESTAMP '2022-02-02' FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'p-' || c_custkey, 'Tribal affiliation', 'Affiliation', TIMESTAMP '2022-02-03' FROM customer WHERE c_custkey % 50 = 0""")
def social_history(spark, sf):
    s = folds.social_history(DriverExport(spark, sf))
    return s.select("patient_id", "display", "value", ntz("effective_at").alias("effective_at"))


@query("map_conditions", """
SELECT 'd-' || p_partkey AS condition_id, 'p-' || p_partkey % 100 AS patient_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'E' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || p_partkey % 10 END AS icd10,
  CASE p_partkey % 3 WHEN 0 THEN CAST(1000000 + p_partkey AS VARCHAR) WHEN 1 THEN CAST(2000000 + p_partkey AS VARCHAR) END AS snomed,
  p_name AS display, CASE WHEN p_partkey % 4 = 0 THEN 'Chronic' END AS acuity,
  DATE '2010-01-01' + CAST(p_partkey % 3000 AS INT) AS onset, CASE WHEN p_partkey % 5 = 0 THEN DATE '2020-01-31' END AS stopped,
  p_partkey % 5 <> 0 AS active,
  CASE p_partkey % 3 WHEN 0 THEN 'ICD10:E' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || p_partkey % 10 || ' SNOMED ' || (1000000 + p_partkey) WHEN 1 THEN 'SNOMED ' || (2000000 + p_partkey) END AS x_diagnosiscodeequivalents
FROM part""")
def map_conditions(spark, sf):
    c = M.map_conditions(DriverExport(spark, sf)["patient-diagnoses"])
    return c.select("condition_id", "patient_id", "icd10", "snomed", "display", "acuity", "onset", "stopped", "active", ext("DiagnosisCodeEquivalents"))


@query("map_allergies", """
SELECT 'a-' || s_suppkey AS allergy_id, s_name AS substance, CASE s_suppkey % 4 WHEN 0 THEN 'drug' WHEN 1 THEN 'food' WHEN 2 THEN 'environment' ELSE 'other' END AS category,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Severe' END AS severity, DATE '2001-01-01' + CAST(s_suppkey AS INT) AS onset, s_suppkey % 2 = 0 AS active, coalesce(r.reactions, '') AS reactions
FROM supplier LEFT JOIN (SELECT l_suppkey, string_agg('Reaction' || l_linenumber, ',' ORDER BY o) AS reactions FROM
  (SELECT l_suppkey, l_linenumber, min((l_partkey * 100000 + l_orderkey) * 8 + l_linenumber) AS o FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2) GROUP BY 1) r ON l_suppkey = s_suppkey""")
def map_allergies(spark, sf):
    t = DriverExport(spark, sf)
    a = M.map_allergies(t["patient-allergy"], t["patient-allergy-reactions"])
    return a.select("allergy_id", "substance", "category", "severity", "onset", "active", F.array_join("reactions", ",").alias("reactions"))


@query("map_medications", """
SELECT 'm-' || p_partkey AS medication_id, p_type AS generic_name, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_brand END AS brand_name,
  p_size || ' mg' AS strength, CASE WHEN p_partkey % 4 = 0 THEN 'Tablet' END AS dose_form, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS display_name,
  DATE '2015-03-04' AS start, CASE WHEN p_partkey % 7 = 0 THEN DATE '2016-05-06' END AS stop, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS active FROM part""")
def map_medications(spark, sf):
    m = M.map_medications(DriverExport(spark, sf)["patient-medications"])
    return m.select("medication_id", "generic_name", "brand_name", "strength", "dose_form", "display_name", "start", "stop", "active")


STATUS_SQL = """
tx AS (SELECT 'rx-' || user_id AS rx, event_id AS ord, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS tat,
    CASE event_type WHEN 'signup' THEN 'VERIFIED' WHEN 'view' THEN 'REFILL REQUEST RECEIVED' WHEN 'click' THEN 'PRINTED' WHEN 'purchase' THEN 'CANCELLATION DENIED' END AS label,
    CASE event_type WHEN 'signup' THEN 50 WHEN 'view' THEN 10 WHEN 'click' THEN 48 WHEN 'purchase' THEN 85 END AS pri,
    CASE event_type WHEN 'click' THEN 'SCRIPT' WHEN 'error' THEN NULL ELSE 'ESCRIPT' END AS prefix,
    CASE WHEN event_id % 3 = 0 THEN event_type ELSE CASE event_type WHEN 'signup' THEN 'Order Sent' WHEN 'view' THEN 'Refill request received'
        WHEN 'click' THEN 'Prescription printed' WHEN 'purchase' THEN 'Cancellation denied by pharmacy' ELSE 'Unknown step' END END AS word, event_type FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rx ORDER BY (pri IS NULL), pri DESC, (tat IS NULL), tat, ord) AS r,
    row_number() OVER (PARTITION BY rx ORDER BY (lower(word) <> 'error'), (tat IS NULL), tat, ord) AS e,
    row_number() OVER (PARTITION BY rx ORDER BY (tat IS NULL) DESC, tat DESC, ord DESC) AS l FROM tx),
st AS (SELECT rx, max(CASE WHEN r = 1 THEN label END) AS label, max(CASE WHEN r = 1 AND label IS NOT NULL THEN prefix END) AS prefix,
    max(CASE WHEN e = 1 AND lower(word) = 'error' THEN 'ERROR' END) AS known, max(CASE WHEN l = 1 THEN upper(word) END) AS last_word,
    min(CASE WHEN event_type = 'signup' THEN tat END) AS sent FROM ranked GROUP BY rx)"""


@query("status_priority_fold", f"WITH {STATUS_SQL} SELECT rx AS prescription_id, coalesce(label, known, last_word) AS status_label, prefix AS label_prefix, sent AS order_sent_at FROM st")
def status_priority_fold(spark, sf):
    s = folds.resolve_status(M.map_transactions(DriverExport(spark, sf)["prescription-transactions"]))
    return s.withColumn("order_sent_at", ntz("order_sent_at"))


@query("map_prescriptions", f"""
WITH {STATUS_SQL}
SELECT 'rx-' || l_orderkey AS prescription_id, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS ord, coalesce(label, known, last_word) AS status_label,
  coalesce(prefix, CASE WHEN l_linenumber % 3 = 0 THEN 'SCRIPT' ELSE 'ESCRIPT' END) AS prefix,
  CASE WHEN coalesce(prefix, CASE WHEN l_linenumber % 3 = 0 THEN 'SCRIPT' ELSE 'ESCRIPT' END) = 'ESCRIPT' AND sent IS NOT NULL THEN sent
    WHEN l_suppkey % 13 = 12 THEN NULL ELSE l_shipdate END AS display_date,
  CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '9' ELSE CAST(l_linenumber AS VARCHAR) END AS refills, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN st ON rx = 'rx-' || l_orderkey""")
def map_prescriptions(spark, sf):
    t = DriverExport(spark, sf)
    p = M.map_prescriptions(t["patient-prescriptions"], t["prescription-transactions"])
    return p.select("prescription_id", F.col("_ord").alias("ord"), "status_label", "prefix", ntz("display_date").alias("display_date"), "refills", "quantity")


PLAN_SQL = """
WITH s AS (SELECT o_orderkey AS o, CASE WHEN o_custkey % 4 = 0 THEN 'plan-' || o_custkey END AS g,
    CASE WHEN o_custkey % 4 = 1 THEN 'segment ' || CASE o_orderkey % 2 WHEN 0 THEN 'building' ELSE 'machinery' END WHEN o_custkey % 4 = 2 THEN 'payer ' || o_custkey % 12 END AS n,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'T' || o_orderkey % 7 END AS t FROM orders),
byid AS (SELECT g, arg_min(t, o) AS t FROM s WHERE g IS NOT NULL AND t IS NOT NULL GROUP BY 1),
byname AS (SELECT n, arg_min(t, o) AS t FROM s WHERE n IS NOT NULL AND t IS NOT NULL GROUP BY 1),
c AS (SELECT 'plan-' || c_custkey AS coverage_id, 'PAYER ' || c_nationkey AS payer, CASE WHEN c_custkey % 3 = 0 THEN 'Plan ' || c_nationkey || ' (ppo)' ELSE 'Segment ' || c_mktsegment END AS plan_name, c_custkey FROM customer)"""


@query("three_tier_lookup", PLAN_SQL + """
SELECT coverage_id, payer, plan_name, coalesce(byid.t, n1.t, n2.t, CASE WHEN c_custkey % 3 = 0 THEN 'PPO' END) AS plan_type
FROM c LEFT JOIN byid ON g = coverage_id LEFT JOIN byname n1 ON n1.n = lower(plan_name) LEFT JOIN byname n2 ON n2.n = lower(payer)""")
def three_tier_lookup(spark, sf):
    t = DriverExport(spark, sf)
    return M.map_coverages(t["patient-insurances"], t["superbill-insurances"]).select("coverage_id", "payer", "plan_name", "plan_type")


@query("map_coverages", """
SELECT 'plan-' || c_custkey AS coverage_id, 'p-' || c_custkey % 200 AS patient_id, CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 99 END AS order_of_benefits,
  CASE c_custkey % 6 WHEN 0 THEN 'PRIMARY PAYER' WHEN 1 THEN 'SECONDARY PAYER' WHEN 2 THEN 'TERTIARY PAYER' WHEN 3 THEN 'OTHER PAYER' WHEN 4 THEN 'WEIRD PAYER' END AS priority_label,
  CASE c_custkey % 4 WHEN 1 THEN '25.00' WHEN 2 THEN '12.50' END AS copay, DATE '2012-01-05' AS start, c_custkey % 2 = 0 AS active FROM customer""")
def map_coverages(spark, sf):
    t = DriverExport(spark, sf)
    c = M.map_coverages(t["patient-insurances"], t["superbill-insurances"])
    return c.select("coverage_id", "patient_id", "order_of_benefits", "priority_label", "copay", "start", "active")


@query("map_family_history", """
SELECT 'p-' || c_custkey AS patient_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE CAST(700000 + o_orderkey AS VARCHAR) END AS diagnosis,
  CASE WHEN c_custkey % 2 = 0 THEN 'Mother' END AS relation, CASE WHEN o_orderkey % 3 = 0 THEN DATE '1999-04-05' END AS onset_date FROM customer JOIN orders ON o_custkey = c_custkey""")
def map_family_history(spark, sf):
    t = DriverExport(spark, sf)
    f = M.map_family_history(t["patient-family-medical-history"], t["patient-family-history-diagnoses"])
    return f.select("patient_id", "diagnosis", "relation", "onset_date")


@query("map_immunizations", """
SELECT 'i-' || p_partkey AS immunization_id, p_brand AS vaccine, CASE WHEN p_partkey % 2 = 0 THEN DATE '2018-06-07' WHEN p_partkey % 3 = 0 THEN DATE '2017-01-02' END AS administered_on,
  p_type AS source, CAST(p_size AS VARCHAR) AS lot_number, DATE '2030-01-01' AS expires, p_name AS x_bodysite FROM part""")
def map_immunizations(spark, sf):
    i = M.map_immunizations(DriverExport(spark, sf)["patient-immunizations"])
    return i.select("immunization_id", "vaccine", "administered_on", "source", "lot_number", "expires", ext("BodySite"))


@query("map_directives_documents", """
SELECT 'directive' AS kind, 'p-' || c_custkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'Living will' END AS title, TIMESTAMP '2019-02-03 16:05:06' AS at, NULL AS x FROM customer
UNION ALL SELECT 'document', 'doc-' || doc_id, source || '-' || lang, TIMESTAMP '2019-03-14 18:59:26', CAST(n_chars AS VARCHAR) FROM documents""")
def map_directives_documents(spark, sf):
    t = DriverExport(spark, sf)
    a = M.map_directives(t["patient-advance-directives"]).select(
        F.lit("directive").alias("kind"), F.col("patient_id").alias("owner"), F.col("directive").alias("title"), ntz("recorded_at").alias("at"), F.lit(None).cast("string").alias("x"))
    d = M.map_documents(t["patient-documents"]).select(
        F.lit("document").alias("kind"), F.col("document_id").alias("owner"), "title", ntz("generated_at").alias("at"), ext("FileSizeBytes").alias("x"))
    return a.unionByName(d)


@query("map_actors", """
SELECT 's-' || s_suppkey AS id, 'Dr ' || s_name AS name, NULL AS phone, 'true' AS x FROM supplier
UNION ALL SELECT 'f-' || n_nationkey, n_name, '(555) 010-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), NULL FROM nation""")
def map_actors(spark, sf):
    t = DriverExport(spark, sf)
    p = M.map_practitioners(t["providers"]).select(F.col("practitioner_id").alias("id"), "name", F.lit(None).cast("string").alias("phone"), ext("IsActive").alias("x"))
    f = M.map_facilities(t["facilities"]).select(F.col("facility_id").alias("id"), "name", "phone", F.lit(None).cast("string").alias("x"))
    return p.unionByName(f)


@query("medication_history", f"""
WITH {STATUS_SQL}
SELECT 'm-' || p_partkey AS medication_id, count(DISTINCT 'rx-' || l_orderkey) AS n_scripts, count(label) AS n_resolved
FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey LEFT JOIN st ON rx = 'rx-' || l_orderkey GROUP BY 1""")
def medication_history(spark, sf):
    t = DriverExport(spark, sf)
    rx = M.map_prescriptions(t["patient-prescriptions"], t["prescription-transactions"]).select("medication_id", "prescription_id", "status_label", "_ord")
    med = M.with_prescription_ids(M.map_medications(t["patient-medications"]).select("medication_id"), rx).filter(F.size("prescription_ids") > 0)
    labels = [label for _, _, label, _ in SCRIPT_LABELS]
    resolved = rx.filter(F.col("status_label").isin(*labels)).groupBy("medication_id").agg(F.count(F.lit(1)).alias("n_resolved"))
    return med.join(resolved, "medication_id", "left").select("medication_id", F.size("prescription_ids").cast("bigint").alias("n_scripts"), F.coalesce("n_resolved", F.lit(0)).alias("n_resolved"))


def record_sql(children: dict[str, str], page_rows: int) -> str:
    """Rows of each child table as ``(patient_id, id, o)``, cut into pages; page 0 is there for each parent."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS child, patient_id, CAST(id AS VARCHAR) AS id, o FROM ({sql}) x" for name, sql in children.items())
    return f"""k AS ({rows}), p AS (SELECT child, patient_id, id, o, (row_number() OVER (PARTITION BY child, patient_id ORDER BY o) - 1) // {page_rows} AS page FROM k),
g AS (SELECT patient_id, page, child, count(*) AS n, string_agg(id, ',' ORDER BY o) AS ids FROM p WHERE patient_id IN (SELECT patient_id FROM parents) GROUP BY ALL)
SELECT patient_id, 0 AS page, 'patient' AS child, 1 AS n, name AS ids FROM parents UNION ALL SELECT patient_id, page, child, n, ids FROM g"""


def record_rows(record, name: str, ids: dict[str, str]):
    """A row for each page and child table of a record: how many items, and their ids in order."""
    one = lambda child, n, ids: F.struct(F.lit(child).alias("child"), n.cast("bigint").alias("n"), ids.alias("ids"))
    text = lambda i: lambda e: e[i].cast("string")
    listed = [one(c, F.size(c), F.array_join(F.transform(c, text(i)), ",") if i else F.lit(None).cast("string")) for c, i in ids.items()]
    parts = record.select("patient_id", "page", F.explode(F.array(one("patient", F.col("parent").isNotNull().cast("int"), F.col(f"parent.{name}")), *listed)).alias("c"))
    return parts.select("patient_id", "page", "c.*").filter("n > 0")


# Of tables whose rows may share a place in the order only the number is compared.
RECORD_CHILDREN_SQL = {
    "encounters": "SELECT 'p-' || o_custkey AS patient_id, 'e-' || o_orderkey AS id, o_orderkey AS o FROM orders",
    "observations": "SELECT 'p-' || o_custkey AS patient_id, NULL AS id, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "conditions": "SELECT 'p-' || p_partkey % 100 AS patient_id, 'd-' || p_partkey AS id, p_partkey AS o FROM part",
    "allergies": "SELECT 'p-' || s_suppkey % 50 AS patient_id, 'a-' || s_suppkey AS id, s_suppkey AS o FROM supplier",
    "medications": "SELECT 'p-' || p_partkey % 100 AS patient_id, 'm-' || p_partkey AS id, p_partkey AS o FROM part",
    "prescriptions": "SELECT 'p-' || o_custkey AS patient_id, NULL AS id, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "coverages": "SELECT 'p-' || c_custkey % 200 AS patient_id, 'plan-' || c_custkey AS id, c_custkey AS o FROM customer",
    "family_history": "SELECT 'p-' || o_custkey AS patient_id, 'r-' || o_custkey AS id, o_orderkey AS o FROM orders",
    "immunizations": "SELECT 'p-' || p_partkey % 100 AS patient_id, 'i-' || p_partkey AS id, p_partkey AS o FROM part",
    "directives": "SELECT 'p-' || c_custkey AS patient_id, NULL AS id, c_custkey AS o FROM customer",
    "documents": "SELECT 'p-' || doc_id % 100 AS patient_id, 'doc-' || doc_id AS id, doc_id AS o FROM documents",
    "addenda": "SELECT 'p-' || o_custkey AS patient_id, 'e-' || o_orderkey AS id, conv_id * 4096 + turn AS o FROM conversations JOIN orders ON o_orderkey = conv_id",
    "encounter_diagnoses": "SELECT 'p-' || o_custkey AS patient_id, NULL AS id, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 7",
    "transactions": "SELECT 'p-' || o_custkey AS patient_id, 'rx-' || user_id AS id, event_id AS o FROM events JOIN orders ON o_orderkey = user_id WHERE user_id IN (SELECT l_orderkey FROM lineitem)",
    "patient_notes": "SELECT 'p-' || c_custkey AS patient_id, NULL AS id, 0 AS o FROM customer WHERE c_custkey % 4 = 1 OR c_custkey IN (SELECT conv_id FROM conversations)",
    "practitioners": "SELECT patient_id, 's-' || s_suppkey AS id, s_suppkey AS o FROM (SELECT 'p-' || o_custkey AS patient_id, o_orderkey % 10 AS k FROM orders UNION SELECT 'p-' || o_custkey, o_custkey % 10 FROM orders UNION SELECT 'p-' || o_custkey, l_suppkey % 10 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN supplier ON s_suppkey = k",
    "facilities": "SELECT DISTINCT 'p-' || o_custkey AS patient_id, 'f-' || n_nationkey AS id, n_nationkey AS o FROM orders JOIN nation ON n_nationkey = o_custkey % 25",
}


@query("record_assembly", "WITH parents AS (SELECT 'p-' || c_custkey AS patient_id, c_name AS name FROM customer), " + record_sql(RECORD_CHILDREN_SQL, 5))
def record_assembly(spark, sf):
    """JN-02 over all child tables, five items a page."""
    t = DriverExport(spark, sf)
    of_patients = lambda name: M.keyed(t[name], "PatientPracticeGuid")
    # Encounters before their selection, and observations as charted: what follows from these has queries of its own.
    raw = {
        "patients": M.map_patients(t), "patient_notes": M.map_patient_notes(t), "encounters": M.map_encounters(t), "addenda": M.map_addenda(t), "encounter_diagnoses": M.map_diagnosis_links(t),
        "observations": M.map_observations(of_patients("patient-encounter-observations")), "conditions": M.map_conditions(of_patients("patient-diagnoses")), "allergies": M.map_allergies(of_patients("patient-allergy"), t["patient-allergy-reactions"]),
        "medications": M.map_medications(of_patients("patient-medications")), "prescriptions": M.map_prescriptions(of_patients("patient-prescriptions"), t["prescription-transactions"]), "transactions": M.map_transactions(t["prescription-transactions"]),
        "coverages": M.map_coverages(of_patients("patient-insurances"), t["superbill-insurances"]), "family_history": M.map_family_history(t["patient-family-medical-history"], t["patient-family-history-diagnoses"]),
        "immunizations": M.map_immunizations(of_patients("patient-immunizations")), "directives": M.map_directives(of_patients("patient-advance-directives")), "documents": M.map_documents(of_patients("patient-documents")),
        "practitioners": M.map_practitioners(t["providers"]), "facilities": M.map_facilities(t["facilities"]),
    }
    ids = {
        "encounters": "encounter_id", "observations": None, "conditions": "condition_id", "allergies": "allergy_id", "medications": "medication_id", "prescriptions": None, "coverages": "coverage_id", "family_history": "relative_id",
        "immunizations": "immunization_id", "directives": None, "documents": "document_id", "addenda": "encounter_id", "encounter_diagnoses": None, "transactions": "prescription_id", "patient_notes": None, "practitioners": "practitioner_id", "facilities": "facility_id",
    }
    return record_rows(M.assemble(raw, page_rows=5), "family_name", ids)


@query("date_problems", """
SELECT table_name, column_name, count(*) AS n FROM (
  SELECT 'patient-encounters' AS table_name, 'DateOfService' AS column_name FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'patient-demographics', 'BirthDate' FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1, 2""")
def date_problems(spark, sf):
    t = DriverExport(spark, sf)
    enc = t["patient-encounters"].withColumn("DateOfService", F.when(F.col("IsVirtualVisit") == "P", F.lit("13/45/2020x")).otherwise(F.col("DateOfService")))
    demo = t["patient-demographics"].withColumn("BirthDate", F.when(F.trim("FirstName") == "Machinery", F.lit("Spring 1999")).otherwise(F.col("BirthDate")))
    p = quarantine.date_problems({"patient-encounters": enc, "patient-demographics": demo})
    return p.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))


_ALWAYS = "PatientPracticeGuid EncounterGuid DateOfService ChiefComplaint Subjective SignedByProviderGuid SignedDateTimeUtc SeenByProviderGuid FacilityGuid IsSoapNote".split()


@query("column_coverage", "".join(f"SELECT 'patient-encounters' AS table_name, '{c}' AS column_name, count(*) AS filled, count(*) AS n_rows, 'consumed' AS fate FROM orders UNION ALL " for c in _ALWAYS) + """
SELECT 'patient-encounters', 'IsVirtualVisit', count(*), count(*), 'carried' FROM orders
UNION ALL SELECT 'patient-encounters', 'Objective', 0, count(*), 'empty' FROM orders UNION ALL SELECT 'patient-encounters', 'Plan', 0, count(*), 'empty' FROM orders
UNION ALL SELECT 'patient-encounters', 'ChartNoteType', count(*) FILTER (o_orderkey % 2 = 0), count(*), 'consumed' FROM orders
UNION ALL SELECT 'patient-encounters', 'Assessment', count(*) FILTER (o_orderkey % 9 <> 0), count(*), 'consumed' FROM orders
UNION ALL SELECT 'patient-allergy', c, count(*) FILTER (c <> 'Severity' OR s_suppkey % 3 = 0), count(*), 'consumed' FROM supplier, (SELECT unnest(['PatientPracticeGuid', 'AllergyGuid', 'AllergenCategory', 'Substance', 'Severity', 'StartDate', 'IsActive']) AS c) GROUP BY c
UNION ALL SELECT 'patient-immunizations', c, count(*) FILTER (CASE c WHEN 'DateAdministered' THEN p_partkey % 2 = 0 WHEN 'AdministeredDate' THEN p_partkey % 3 = 0 WHEN 'Comment' THEN false ELSE true END), count(*), CASE c WHEN 'Comment' THEN 'empty' WHEN 'BodySite' THEN 'carried' ELSE 'consumed' END
  FROM part, (SELECT unnest(['PatientPracticeGuid', 'ImmunizationGuid', 'Vaccine', 'Type', 'Lot', 'DateAdministered', 'AdministeredDate', 'ExpirationDate', 'Comment', 'BodySite']) AS c) GROUP BY c""")
def column_coverage_query(spark, sf):
    """LOSS-04 over every column of three tables, from charted values to columns that nothing reads."""
    t = DriverExport(spark, sf)
    carried = {"patient-encounters": ("IsVirtualVisit",), "patient-allergy": (), "patient-immunizations": ("BodySite",)}
    parts = [column_coverage(t[name], [c for c in t[name].columns if c not in (*kept, "_ord")]).select(F.lit(name).alias("table_name"), "*") for name, kept in carried.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("patient_overview", """
WITH e AS (SELECT 'p-' || o_custkey AS patient_id, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dos FROM orders WHERE o_orderkey % 9 <> 0),
q AS (SELECT patient_id, count(*) AS n, max(dos) AS latest, max(CASE WHEN o_orderstatus = 'P' AND dos IS NOT NULL THEN 2 ELSE 0 END) AS v FROM e GROUP BY 1)
SELECT 'p-' || c_custkey AS patient_id, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || c_name AS name, coalesce(n, 0) AS encounter_count,
  latest AS latest_visit, CASE v WHEN 2 THEN 'fail' WHEN 0 THEN 'pass' END AS worst_verdict FROM customer LEFT JOIN q ON q.patient_id = 'p-' || c_custkey""")
def patient_overview(spark, sf):
    """Name, encounters, latest visit, and the worst verdict of its documents.

    Each encounter's document text carries its visit date, except where the
    status is P; the date check finds it missing there. Encounters are mapped
    once and met by one aggregation.
    """
    t = DriverExport(spark, sf)
    noted = F.exists("sections", lambda s: s["text"].isNotNull())
    shown = F.when(F.try_element_at("extensions", F.lit("tsv:IsVirtualVisit")) != "P", F.date_format("date_of_service", "MMMM d, yyyy")).otherwise("no date")
    text = F.concat_ws("\n", F.lit("Visit"), shown, F.array_join(F.filter("sections.text", lambda x: x.isNotNull()), "\n"))
    docs = M.map_encounters(t).select("patient_id", "date_of_service", noted.alias("noted"), text.alias("text"))
    found = F.exists(date_spellings("date_of_service"), lambda s: present(s, F.col("text")))
    bad = F.col("date_of_service").isNotNull() & ~F.coalesce(found, F.lit(False))
    seen = docs.select("patient_id", "date_of_service", "noted", bad.alias("bad"))
    visits = seen.groupBy("patient_id").agg(F.count_if("noted").alias("encounter_count"), F.max(F.when(F.col("noted"), F.col("date_of_service"))).alias("latest_visit"), F.max(F.when(F.col("noted"), F.col("bad").cast("int"))).alias("_bad"))
    out = M.map_patients(t).select("patient_id", F.concat_ws(" ", "given_name", "family_name").alias("name")).join(visits, "patient_id", "left")
    return out.select("patient_id", "name", F.coalesce("encounter_count", F.lit(0)).alias("encounter_count"), "latest_visit", F.when(F.col("_bad") == 1, "fail").when(F.col("_bad") == 0, "pass").alias("worst_verdict"))
