"""Archive rows and reports over the driver export."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.driver_queries.base import load, query
from chartweave.driver_queries.exchange import canonical
from chartweave.operators.sets import unify
from chartweave.plans import tsv_mapping as M
from chartweave.driver_queries.exports import DriverExport
from chartweave.sinks import archive, reports


@query("archive_index", """
WITH n AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || c_name AS name, CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE CAST(DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INT) AS VARCHAR) END AS dob FROM customer),
parts AS (SELECT o_custkey, 0 AS tier, o_orderkey AS o, 0 AS i, CASE WHEN o_orderkey % 10 = 0 THEN 'Growth Chart review' ELSE o_orderpriority END AS part FROM orders
  UNION ALL SELECT o_custkey, 1, o_orderkey, 0, 'Status ' || o_orderstatus || chr(10) || chr(10) || 'Total ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT o_custkey, 1, o_orderkey, 2, 'stable' FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 3 <> 0),
k AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o, i) - 1) // 7 AS page FROM parts),
t AS (SELECT o_custkey, page, string_agg(part, ' ' ORDER BY tier, o, i) AS txt FROM k GROUP BY 1, 2), c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT 'p-' || c_custkey AS id, name AS display_name, dob, coalesce(n, 0) AS encounter_count, coalesce(page, 0) AS page, md5(lower(CASE WHEN coalesce(page, 0) = 0 THEN concat_ws(' ', name, dob, txt) ELSE txt END)) AS digest FROM n LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""")
def archive_index(spark, sf):
    t = canonical(spark, sf, "patients", "encounters")
    return archive.archive_index(t["patients"], t["encounters"], page_parts=7).select("id", "display_name", "dob", "encounter_count", "page", F.md5(F.col("search").cast("binary")).alias("digest"))


@query("archive_encounters", """
WITH e AS (SELECT *, CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dos FROM orders), f AS (SELECT o_custkey, strftime(o_orderdate, '%m-%d-%Y') AS d, min('x_' || strftime(o_orderdate, '%m-%d-%Y') || '_' || o_orderkey || '.pdf') AS f FROM orders GROUP BY 1, 2)
SELECT 'e-' || o_orderkey AS encounter_id, coalesce(CAST(dos AS VARCHAR) || ' — ', '') || CASE WHEN o_orderkey % 2 = 0 THEN 'Office Visit' WHEN o_orderkey % 3 = 0 THEN 'SIMPLE' ELSE 'SOAP' END AS label, f AS pdf_name, CASE WHEN o_orderstatus = 'P' THEN 'fail' WHEN o_orderstatus = 'F' THEN 'pass' END AS qa_verdict
FROM e LEFT JOIN f ON f.o_custkey = e.o_custkey AND strftime(dos, '%m-%d-%Y') = f.d""")
def archive_encounters(spark, sf):
    o = load(spark, sf, "orders")
    docs = o.select(F.concat(F.lit("p-"), "o_custkey").alias("patient_id"), F.concat(F.lit("x_"), F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit("_"), "o_orderkey", F.lit(".pdf")).alias("file_name"))
    verdicts = o.filter("o_orderstatus IN ('P', 'F')").select(F.concat(F.lit("e-"), "o_orderkey").alias("encounter_id"), F.when(F.col("o_orderstatus") == "P", "fail").otherwise("pass").alias("verdict"))
    return archive.archive_encounters(canonical(spark, sf, "encounters")["encounters"], docs, verdicts).select("encounter_id", "label", "pdf_name", "qa_verdict")


@query("archive_patients", """
WITH l AS (SELECT p_partkey % 100 AS k, 'conditions' AS list, p_name AS name, p_partkey AS o FROM part UNION ALL SELECT s_suppkey % 50, 'allergies', s_name, s_suppkey FROM supplier UNION ALL SELECT p_partkey % 100, 'medications', p_name, p_partkey FROM part WHERE p_partkey % 2 = 0)
SELECT 'p-' || k AS patient_id, list, name, row_number() OVER (PARTITION BY k, list ORDER BY o) AS position FROM l JOIN customer ON c_custkey = k""")
def archive_patients(spark, sf):
    t = DriverExport(spark, sf)
    p = M.map_patients(t).select("patient_id", "given_name", "family_name")
    out = archive.archive_patients(p, M.map_conditions(t["patient-diagnoses"]), M.map_allergies(t["patient-allergy"], t["patient-allergy-reactions"]), M.map_medications(t["patient-medications"]))
    return out.select("patient_id", "list", "name", "position")


@query("qa_report", """
WITH v AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END) AS r FROM labels GROUP BY 1)
SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS verdict, CASE r WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS document_verdict FROM labels l JOIN v USING (doc_id)
UNION ALL SELECT l.doc_id, CASE WHEN quality = 0 THEN 'warn' ELSE 'pass' END, CASE r WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END FROM labels l JOIN v USING (doc_id)""")
def qa_report(spark, sf):
    lab = load(spark, sf, "labels")
    results = unify(lab.selectExpr("doc_id", "'a' AS check", "CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS verdict"), lab.selectExpr("doc_id", "'b' AS check", "CASE WHEN quality = 0 THEN 'warn' ELSE 'pass' END AS verdict"))
    return reports.qa_report(results)[1].select("doc_id", "verdict", "document_verdict")
