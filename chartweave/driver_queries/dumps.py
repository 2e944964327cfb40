"""SQL-dump reading and mapping over text Spark writes from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.driver_queries.base import load, ntz, query
from chartweave.driver_queries.mapping import record_rows, record_sql
from chartweave.plans import dump_mapping as D
from chartweave.sources import sqldump

DDL = """CREATE TABLE `NOTE` (
  `NOTE_ID` double,
  `BODY` longtext,
  PRIMARY KEY (`NOTE_ID`)
) ENGINE=InnoDB;
CREATE TABLE `EVENT` (
  `EVENT_ID` double,
  `CLASS` varchar(10),
  `VAL` double
);"""


def note_lines(spark, sf) -> DataFrame:
    """Each document as an INSERT whose text may hold line breaks and quotes."""
    d = load(spark, sf, "documents")
    quoted = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("INSERT INTO `NOTE` (`BODY`, `NOTE_ID`) VALUES\n")).when(F.col("doc_id") % 3 == 1, F.lit("-- it's a comment\nINSERT IGNORE INTO NOTE VALUES ")).otherwise(F.lit("INSERT INTO NOTE\nVALUES\n"))
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("('"), quoted, F.lit("',"), F.col("doc_id").cast("string"), F.lit("),\n('INSERT INTO NOTE VALUES (1)', -1);")))
    stmt = F.concat(head, F.coalesce(odd, F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(", '"), quoted, F.lit("');"))))
    lines = d.select((F.col("doc_id") % 4).cast("string").alias("_src"), "doc_id", F.posexplode(F.split(stmt, "\n")).alias("i", "value"))
    return lines.select("_src", (F.col("doc_id") * 65536 + F.col("i")).alias("_ord"), "value")


@query("sql_dump_rows", """
SELECT doc_id AS note_id, md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1, 2
UNION ALL SELECT -1, md5('INSERT INTO NOTE VALUES (1)'), count(*) FROM documents WHERE doc_id % 3 = 0""")
def sql_dump_rows(spark, sf):
    ddl = sqldump.ddl_columns(spark.range(1).select(F.lit(DDL).alias("value")))
    rows = sqldump.as_table(sqldump.parse_dump_lines(note_lines(spark, sf), ddl), "NOTE", ["NOTE_ID", "BODY"])
    return rows.groupBy(F.col("NOTE_ID").cast("bigint").alias("note_id"), F.md5(F.col("BODY").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("sql_dump_events", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS class, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id * 2 AS VARCHAR) END AS val FROM events""")
def sql_dump_events(spark, sf):
    """One tuple per line, a new statement every 100 rows: the plain layout."""
    e = load(spark, sf, "events")
    body = F.concat(F.lit("("), F.col("event_id").cast("string"), F.lit(",'"), "event_type", F.lit("',"), F.when(F.col("event_id") % 5 == 0, "NULL").otherwise((F.col("event_id") * 2).cast("string")), F.lit(")"), F.when(F.col("event_id") % 100 == 99, ";").otherwise(","))
    line = F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("INSERT INTO `EVENT` VALUES "), body)).otherwise(body)
    ddl = sqldump.ddl_columns(spark.range(1).select(F.lit(DDL).alias("value")))
    lines = e.select(F.lit("EVENT_01.sql").alias("_src"), F.col("event_id").alias("_ord"), line.alias("value"))
    return sqldump.as_table(sqldump.parse_dump_lines(lines, ddl), "EVENT", ["EVENT_ID", "CLASS", "VAL"]).selectExpr("EVENT_ID AS id", "CLASS AS class", "VAL AS val")


@query("ddl_catalogue", """
SELECT upper(s_name) AS table_name, CASE WHEN s_suppkey % 2 = 0 THEN 'ID,NATION,BAL' ELSE 'ID,NATION' END AS columns FROM supplier""")
def ddl_catalogue(spark, sf):
    ddl = F.concat(F.lit("create table `"), F.replace("s_name", F.lit("#"), F.lit("_")), F.lit("` (\n  `ID` double,\n  `NATION` varchar(10) NOT NULL,\n"),
                   F.when(F.col("s_suppkey") % 2 == 0, "  `BAL` decimal(10,2),\n").otherwise(""), F.lit("  PRIMARY KEY (`ID`),\n  KEY `k` (`NATION`)\n) ENGINE=InnoDB;"))
    out = sqldump.ddl_columns(load(spark, sf, "supplier").select(ddl.alias("value")))
    return out.select(F.replace("table_name", F.lit("_"), F.lit("#")).alias("table_name"), F.array_join("columns", ",").alias("columns"))


def dump_tables(spark, sf) -> dict[str, DataFrame]:
    """Dump-shaped raw tables over the driver's tables."""
    for t in ("customer", "orders", "events", "nation", "conversations"):
        load(spark, sf, t).createOrReplaceTempView(f"dmp_{t}")

    def q(sql: str) -> DataFrame:
        return spark.sql(sql)

    return {
        "PERSON": q("""SELECT CAST(c_custkey AS STRING) AS PERSON_ID, concat(c_name, ', ', c_mktsegment) AS NAME_FULL_FORMATTED,
            date_format(date_add(DATE'1940-01-01', CAST(c_custkey * 37 % 25000 AS INT)), 'yyyy-MM-dd HH:mm:ss') AS BIRTH_DT_TM, CAST(c_nationkey AS STRING) AS SEX_CD,
            CASE WHEN c_custkey % 6 = 0 THEN '2023-05-06 07:08:09' WHEN c_custkey % 6 = 1 THEN '0001-01-01 00:00:00' END AS DECEASED_DT_TM, 'x' AS UPDT_CNT, c_custkey AS _ord FROM dmp_customer"""),
        "PERSON_ALIAS": q("SELECT CAST(c_custkey AS STRING) AS PERSON_ID, concat('MRN', c_custkey) AS ALIAS, CASE WHEN c_custkey % 2 = 0 THEN '10' ELSE ' ' END AS PERSON_ALIAS_TYPE_CD, c_custkey AS _ord FROM dmp_customer"),
        "ENCOUNTER": q("""SELECT CAST(o_orderkey AS STRING) AS ENCNTR_ID, CAST(o_custkey AS STRING) AS PERSON_ID, CAST(o_orderkey % 30 AS STRING) AS ENCNTR_TYPE_CD,
            date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS REG_DT_TM, CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS DISCH_DT_TM,
            o_orderpriority AS REASON_FOR_VISIT, o_orderstatus AS UPDT_CNT, o_orderkey AS _ord FROM dmp_orders"""),
        "CLINICAL_EVENT": q("""SELECT CAST(event_id AS STRING) AS EVENT_ID, CAST(user_id AS STRING) AS PERSON_ID, CAST(event_id % 400 AS STRING) AS ENCNTR_ID, CAST(event_id % 40 AS STRING) AS EVENT_CD,
            CASE event_type WHEN 'signup' THEN concat('Problem: p', event_id % 9) WHEN 'error' THEN concat('ALLERGY: a', event_id % 7) WHEN 'click' THEN 'Body Weight' WHEN 'view' THEN 'Glucose' ELSE 'Comment' END AS EVENT_TITLE_TEXT,
            CASE WHEN event_type = 'purchase' THEN '' ELSE CAST(CAST(value AS INT) AS STRING) END AS RESULT_VAL, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '9001' END AS RESULT_UNITS_CD,
            '25' AS RESULT_STATUS_CD, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS EVENT_END_DT_TM, '' AS VALID_FROM_DT_TM,
            CASE WHEN event_id % 10 = 9 THEN '2024-02-01 00:00:00' WHEN event_id % 10 = 8 THEN '0001-01-01 00:00:00' END AS VALID_UNTIL_DT_TM, event_id AS _ord FROM dmp_events"""),
        "CE_BLOB": q("""SELECT CAST(conv_id * 3 AS STRING) AS EVENT_ID, CAST(turn AS STRING) AS BLOB_SEQ_NUM, concat('<p>', text, '</p>') AS BLOB_CONTENTS, CASE WHEN turn % 5 = 4 THEN '728' END AS COMPRESSION_CD,
            conv_id * 4096 + turn AS _ord FROM dmp_conversations"""),
        "CE_BLOB_RESULT": q("""SELECT CAST(o_orderkey * 7 AS STRING) AS EVENT_ID, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('h-', o_orderkey) END AS BLOB_HANDLE, CAST(o_orderkey % 30 AS STRING) AS STORAGE_CD,
            '1' AS FORMAT_CD, o_orderkey AS _ord FROM dmp_orders"""),
        "CODE_VALUE": q("""SELECT CAST(n_nationkey AS STRING) AS CODE_VALUE, CASE WHEN n_nationkey % 2 = 0 THEN '25' ELSE '71' END AS CODE_SET, n_name AS DISPLAY,
            CASE n_nationkey % 4 WHEN 0 THEN 'OTG' WHEN 1 THEN 'OTG' WHEN 2 THEN 'DICOM_SIUID' ELSE '' END AS CDF_MEANING, CAST(n_nationkey AS BIGINT) AS _ord FROM dmp_nation"""),
    }


@query("map_persons", """
SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name || ', ' || c_mktsegment AS family_name, DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INT) AS birth_date, n_name AS sex,
  CASE WHEN c_custkey % 6 = 0 THEN 'Deceased' END AS status, CASE WHEN c_custkey % 6 = 0 THEN '2023-05-06T07:08:09Z' END AS deceased, 'x' AS cnt FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def map_persons(spark, sf):
    t = dump_tables(spark, sf)
    p = D.map_persons(t["PERSON"], t["CODE_VALUE"])
    return p.select("patient_id", "family_name", "birth_date", "sex", "status", F.try_element_at("extensions", F.lit("dump:DECEASED_DT_TM")).alias("deceased"), F.try_element_at("extensions", F.lit("dump:UPDT_CNT")).alias("cnt"))


@query("alias_identifiers", """
SELECT CAST(c_custkey AS VARCHAR) AS patient_id, 'MRN' || c_custkey AS value, 'dump:ALIAS' AS system FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), '10', 'dump:PERSON_ALIAS_TYPE_CD' FROM customer WHERE c_custkey % 2 = 0""")
def alias_identifiers(spark, sf):
    return D.unpivot_aliases(dump_tables(spark, sf)["PERSON_ALIAS"]).select("patient_id", "value", "system")


@query("map_dump_encounters", """
SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderdate AS DATE) AS date_of_service, o_orderpriority AS chief_complaint, n_name AS encounter_type,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS discharged FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30""")
def map_dump_encounters(spark, sf):
    t = dump_tables(spark, sf)
    e = D.map_dump_encounters(t["ENCOUNTER"], t["CODE_VALUE"])
    return e.select("encounter_id", "patient_id", "date_of_service", "chief_complaint", "encounter_type", F.try_element_at("extensions", F.lit("dump:DISCH_DT_TM")).alias("discharged"))


BODIES = "(SELECT conv_id * 3 AS e FROM conversations UNION SELECT o_orderkey * 7 FROM orders)"


@query("map_events", f"""
WITH d AS (SELECT * FROM events WHERE event_id % 10 <> 9 AND event_id NOT IN (SELECT e FROM {BODIES}))
SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'signup' THEN 'condition' WHEN 'error' THEN 'allergy' WHEN 'click' THEN 'vital-signs' WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'other' ELSE 'laboratory' END ELSE 'other' END AS kind,
  CASE event_type WHEN 'signup' THEN 'Problem: p' || event_id % 9 WHEN 'error' THEN 'a' || event_id % 7 WHEN 'click' THEN 'Body Weight' WHEN 'view' THEN 'Glucose' ELSE 'Comment' END AS label,
  CASE WHEN event_type = 'click' THEN '3141-9' END AS code, CASE WHEN event_type <> 'purchase' THEN CAST(CAST(trunc(value) AS INT) AS VARCHAR) END AS val FROM d""")
def map_events(spark, sf):
    t = dump_tables(spark, sf)
    _, discrete, _ = D.split_events(t["CLINICAL_EVENT"], t["CE_BLOB"], t["CE_BLOB_RESULT"])
    obs, cond, allergy = D.map_events(discrete)
    none = F.lit(None).cast("string").alias("code")
    o = obs.select(F.col("observation_id").alias("id"), F.col("category").alias("kind"), F.col("display").alias("label"), "code", F.col("value").alias("val"))
    c = cond.select(F.col("condition_id").alias("id"), F.lit("condition").alias("kind"), F.col("display").alias("label"), none, F.try_element_at("extensions", F.lit("dump:RESULT_VAL")).alias("val"))
    a = allergy.select(F.col("allergy_id").alias("id"), F.lit("allergy").alias("kind"), F.col("substance").alias("label"), none, F.col("reactions")[0].alias("val"))
    return o.unionByName(c).unionByName(a)


@query("map_event_documents", """
WITH ev AS (SELECT event_id, ts FROM events WHERE event_id % 10 <> 9),
loc AS (SELECT DISTINCT event_id, CAST(event_id AS VARCHAR) AS document_id, 'text/plain' AS mime_type, NULL AS storage_class, date_trunc('second', ts) AS generated_at FROM ev JOIN conversations ON conv_id * 3 = event_id WHERE turn % 5 <> 4),
rem AS (SELECT event_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'h-' || o_orderkey END AS document_id, 'application/octet-stream' AS mime_type,
  CASE WHEN n_nationkey % 2 = 0 THEN CASE n_nationkey % 4 WHEN 0 THEN 'OTG' WHEN 2 THEN 'DICOM_SIUID' END END AS storage_class, NULL AS generated_at FROM ev JOIN orders ON o_orderkey * 7 = event_id LEFT JOIN nation ON n_nationkey = o_orderkey % 30)
SELECT document_id, mime_type, storage_class, generated_at FROM loc UNION ALL SELECT document_id, mime_type, storage_class, generated_at FROM rem""")
def map_event_documents(spark, sf):
    t = dump_tables(spark, sf)
    docs, _, _ = D.split_events(t["CLINICAL_EVENT"], t["CE_BLOB"], t["CE_BLOB_RESULT"])
    _, artifacts, _ = D.map_event_documents(docs, t["CE_BLOB"], t["CE_BLOB_RESULT"], t["CODE_VALUE"])
    return artifacts.select("document_id", "mime_type", "storage_class", ntz("generated_at").alias("generated_at"))


@query("superseded_versions", """
WITH b AS (SELECT conv_id * 3 AS e, string_agg('<p>' || text || '</p>', chr(10) ORDER BY turn) AS body FROM conversations WHERE turn % 5 <> 4 GROUP BY 1)
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(event_id % 400 AS VARCHAR) AS encounter_id, md5(body) AS body, '2024-02-01 00:00:00' AS valid_until FROM events LEFT JOIN b ON e = event_id WHERE event_id % 10 = 9 AND event_id % 400 IN (SELECT o_orderkey FROM orders)""")
def superseded_versions(spark, sf):
    t = dump_tables(spark, sf)
    _, _, closed = D.split_events(t["CLINICAL_EVENT"], t["CE_BLOB"], t["CE_BLOB_RESULT"])
    s = D.superseded(closed, t["CE_BLOB"], D.map_dump_encounters(t["ENCOUNTER"], t["CODE_VALUE"]))
    return s.select(F.col("EVENT_ID").alias("event_id"), "encounter_id", F.md5(F.col("body").cast("binary")).alias("body"), F.try_element_at("payload", F.lit("dump:VALID_UNTIL_DT_TM")).alias("valid_until"))


RECORD_SQL = {
    "identifiers": "SELECT CAST(c_custkey AS VARCHAR) AS patient_id, 'MRN' || c_custkey AS id, 0 AS o FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), '10', 1 FROM customer WHERE c_custkey % 2 = 0",
    "encounters": "SELECT CAST(o_custkey AS VARCHAR) AS patient_id, o_orderkey AS id, o_orderkey AS o FROM orders",
    "observations": f"SELECT CAST(user_id AS VARCHAR) AS patient_id, event_id AS id, event_id AS o FROM events WHERE event_id % 10 <> 9 AND event_type NOT IN ('signup', 'error') AND event_id NOT IN (SELECT e FROM {BODIES})",
    "conditions": f"SELECT CAST(user_id AS VARCHAR) AS patient_id, event_id AS id, event_id AS o FROM events WHERE event_id % 10 <> 9 AND event_type = 'signup' AND event_id NOT IN (SELECT e FROM {BODIES})",
    "allergies": f"SELECT CAST(user_id AS VARCHAR) AS patient_id, event_id AS id, event_id AS o FROM events WHERE event_id % 10 <> 9 AND event_type = 'error' AND event_id NOT IN (SELECT e FROM {BODIES})",
    "documents": "SELECT CAST(user_id AS VARCHAR) AS patient_id, NULL AS id, 0 AS o FROM (SELECT DISTINCT user_id, event_id FROM events JOIN conversations ON conv_id * 3 = event_id WHERE event_id % 10 <> 9 AND turn % 5 <> 4) UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, 0 FROM events JOIN orders ON o_orderkey * 7 = event_id WHERE event_id % 10 <> 9",
    "sections": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS patient_id, event_id AS id, event_id AS o FROM events JOIN conversations ON conv_id * 3 = event_id WHERE event_id % 10 <> 9 AND turn % 5 <> 4",
    "superseded": "SELECT CAST(o_custkey AS VARCHAR) AS patient_id, event_id AS id, event_id AS o FROM events JOIN orders ON o_orderkey = event_id % 400 WHERE event_id % 10 = 9",
    "undecoded_blobs": "SELECT CAST(user_id AS VARCHAR) AS patient_id, event_id AS id, conv_id * 4096 + turn AS o FROM events JOIN conversations ON conv_id * 3 = event_id WHERE event_id % 10 <> 9 AND turn % 5 = 4",
}


@query("dump_record_assembly", "WITH parents AS (SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name || ', ' || c_mktsegment AS name FROM customer), " + record_sql(RECORD_SQL, 5))
def dump_record_assembly(spark, sf):
    """JN-03 over all child tables, note sections, closed versions and undecoded parts with them; five items a page."""
    record = D.assemble(D.map_dump_export(dump_tables(spark, sf)), page_rows=5)
    ids = {"identifiers": "value", "encounters": "encounter_id", "observations": "observation_id", "conditions": "condition_id", "allergies": "allergy_id", "documents": None, "sections": "EVENT_ID", "superseded": "EVENT_ID", "undecoded_blobs": "EVENT_ID"}
    return record_rows(record, "family_name", ids)
