"""Document checks, verification, scanning and matching over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.driver_queries.base import dealt, load, query, spread
from chartweave.plans import phi, qa, verify

# A name that occurs in its document, one that only occurs inside a longer
# word, and a date written or left out, by key.
INPUT_SQL = """
i AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'Given' || doc_id || ' Family' END AS display_name, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE DATE '1950-01-01' + CAST(doc_id % 9000 AS INT) END AS birth_date,
  DATE '2020-01-01' + CAST(doc_id % 700 AS INT) AS date_of_service, doc_id % 5 AS k5, doc_id % 3 AS k3, doc_id % 4 AS k4 FROM documents)"""


def inputs(spark, sf):
    d = spread(load(spark, sf, "documents")).selectExpr(
        "doc_id", "doc_id AS encounter_id", "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('Given', doc_id, ' Family') END AS display_name",
        "CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE date_add(DATE'1950-01-01', CAST(doc_id % 9000 AS INT)) END AS birth_date",
        "date_add(DATE'2020-01-01', CAST(doc_id % 700 AS INT)) AS date_of_service", "text")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat("display_name", F.lit("son"))).otherwise(F.coalesce("display_name", F.lit("")))
    dob = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1"), F.date_format("birth_date", "M/d/yyyy"))).otherwise(F.date_format("birth_date", "MMMM d, yyyy"))
    dos = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.date_format("date_of_service", "MM-dd-yyyy"))
    return d.withColumn("text", F.concat_ws("\n", F.lit("Chart of"), name, F.concat(F.lit("DOB ("), dob, F.lit(")")), F.concat(F.lit("Seen "), dos), "text"))


@query("check_identity", f"""
WITH {INPUT_SQL}
SELECT doc_id, 'data_integrity' AS "check", 'fail' AS verdict, 'patient name not found on document' AS finding FROM i WHERE display_name IS NOT NULL AND k5 = 0
UNION ALL SELECT doc_id, 'data_integrity', 'fail', 'date of birth not found on document' FROM i WHERE birth_date IS NOT NULL AND k3 = 0
UNION ALL SELECT doc_id, 'data_integrity', 'warn', 'record carries no identity anchors (name/DOB) to verify' FROM i WHERE display_name IS NULL AND birth_date IS NULL
UNION ALL SELECT doc_id, 'data_integrity', 'fail', 'date of service not found on document' FROM i WHERE k4 = 0
UNION ALL SELECT doc_id, 'data_integrity', 'pass', NULL FROM i WHERE NOT (display_name IS NOT NULL AND k5 = 0) AND NOT (birth_date IS NOT NULL AND k3 = 0) AND NOT (display_name IS NULL AND birth_date IS NULL) AND k4 <> 0""")
def check_identity(spark, sf):
    return qa.check_identity(inputs(spark, sf))


@query("anchored_presence", r"""
WITH w AS (SELECT word, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS word FROM benchmark) GROUP BY 1),
r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\w.]+')) AS run FROM documents),
m AS (SELECT word, run FROM w JOIN (SELECT DISTINCT run FROM r) ON contains(run, word)), d AS (SELECT word, doc_id, max(CAST(run = word AS INT)) AS alone FROM m JOIN r USING (run) GROUP BY 1, 2)
SELECT word, CAST(coalesce(sum(alone * times), 0) AS BIGINT) AS standing, CAST(coalesce(sum(times) FILTER (doc_id IS NOT NULL), 0) AS BIGINT) AS anywhere FROM w LEFT JOIN d USING (word) GROUP BY 1""")
def anchored_presence(spark, sf):
    """How often each benchmark word of four letters or more stands alone in a text, and how often it occurs at all.

    The texts are tokenised once. Their different tokens are joined to the words by equality on
    the first four letters at each place of a token, instead of pairing every word with every
    text; what matched is then joined to the texts by the token.
    """
    words = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("word"))
    weight = words.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    runs = spread(load(spark, sf, "documents")).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w.]+"), F.lit(0)))).alias("run")).filter(F.length("run") >= 4)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 3), lambda s: F.substring("run", s, F.lit(4))))
    keyed = runs.select("run").distinct().withColumn("k", F.explode(starts))
    matched = keyed.join(weight.withColumn("k", F.substring("word", 1, 4)), "k").filter(F.contains("run", "word")).select("run", "word", "times").distinct()
    per_doc = runs.join(matched, "run").groupBy("word", "times", "doc_id").agg(F.max((F.col("run") == F.col("word")).cast("int")).alias("alone"))
    found = per_doc.groupBy("word").agg(F.sum(F.col("alone") * F.col("times")).alias("standing"), F.sum("times").alias("anywhere"))
    return weight.select("word").join(found, "word", "left").fillna(0, ["standing", "anywhere"])


@query("check_layout", """
WITH p AS (SELECT doc_id % 600 AS doc_id, doc_id // 600 + 1 AS page_no, doc_id % 10 = 0 AS blank, doc_id % 9 = 0 AS off FROM documents), d AS (SELECT DISTINCT doc_id % 700 AS doc_id FROM documents),
f AS (SELECT doc_id, 'fail' AS verdict, 'page ' || page_no || ' is blank' AS finding FROM p WHERE blank UNION ALL SELECT doc_id, 'warn', 'page ' || page_no || ' is 595x842pt, expected Letter' FROM p WHERE off
  UNION ALL SELECT doc_id, 'fail', 'document has no pages' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT d.doc_id, 'layout_pagination' AS "check", coalesce(verdict, 'pass') AS verdict, finding FROM d LEFT JOIN f ON f.doc_id = d.doc_id""")
def check_layout(spark, sf):
    d = load(spark, sf, "documents")
    pages = d.selectExpr("doc_id % 600 AS doc_id", "doc_id DIV 600 + 1 AS page_no", "CASE WHEN doc_id % 10 = 0 THEN ' \n ' ELSE concat('x', text) END AS text", "CASE WHEN doc_id % 9 = 0 THEN 595.0D ELSE 612.0D END AS width", "CASE WHEN doc_id % 9 = 0 THEN 842.0D ELSE 793.5D END AS height")
    return qa.check_layout(d.selectExpr("doc_id % 700 AS doc_id").distinct(), pages)


@query("check_vitals", """
WITH v AS (SELECT DISTINCT event_id % 300 AS doc_id, event_type AS label, CAST(trunc(value) AS INT) AS val FROM events WHERE event_type <> 'error'),
m AS (SELECT doc_id, 'fail' AS verdict, 'vital ' || label || ' value ''' || val || ''' not found' AS finding FROM v WHERE val % 2 = 1),
d AS (SELECT doc_id FROM documents)
SELECT d.doc_id, 'vitals_loinc' AS "check", coalesce(verdict, 'pass') AS verdict, finding FROM d LEFT JOIN m ON m.doc_id = d.doc_id""")
def check_vitals(spark, sf):
    """Documents list the even values of their events; the odd ones only inside longer numbers."""
    ev = load(spark, sf, "events").selectExpr("event_id % 300 AS encounter_id", "CASE WHEN event_type = 'error' THEN 'other' ELSE 'vital-signs' END AS category", "event_type AS display", "'c' AS code", "CAST(CAST(value AS INT) AS STRING) AS value")
    shown = ev.select("encounter_id", F.when(F.col("value").cast("int") % 2 == 0, F.col("value")).otherwise(F.concat(F.col("value"), F.lit(".5 z"), F.col("value"))).alias("s")).distinct()
    text = shown.groupBy("encounter_id").agg(F.array_join(F.sort_array(F.collect_set("s")), " ; ").alias("text"))
    docs = load(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("encounter_id")).join(text, "encounter_id", "left")
    return qa.check_vitals(docs, ev)


@query("date_staleness", """
WITH s AS (SELECT unnest(list_distinct([strftime(DATE '2020-03-01', '%B %d, %Y'), strftime(DATE '2020-03-01', '%b %d, %Y'), strftime(DATE '2020-03-01', '%B %-d, %Y'), strftime(DATE '2020-03-01', '%b %-d, %Y'), strftime(DATE '2020-03-01', '%m/%d/%Y'), strftime(DATE '2020-03-01', '%m-%d-%Y'), strftime(DATE '2020-03-01', '%-m/%-d/%Y')])) AS sp),
t AS (SELECT doc_id, DATE '2020-01-01' + CAST(doc_id % 700 AS INT) AS dos, CASE doc_id % 5 WHEN 0 THEN 'printed March 1, 2020 ' WHEN 1 THEN 'on 03/01/2020' WHEN 2 THEN 'id 103/01/2020' ELSE '' END AS stamp FROM documents),
h AS (SELECT doc_id, 'run date (' || sp || ') appears on a chart dated ' || dos AS finding FROM t, s WHERE dos <> DATE '2020-03-01' AND regexp_matches(stamp, '(^|[^\\w.])' || sp || '($|[^\\w.])'))
SELECT t.doc_id, 'date_staleness' AS "check", CASE WHEN finding IS NULL THEN 'pass' ELSE 'warn' END AS verdict, finding FROM t LEFT JOIN h ON h.doc_id = t.doc_id""".replace("\\\\", "\\"))
def date_staleness(spark, sf):
    stamp = F.expr("CASE doc_id % 5 WHEN 0 THEN 'printed March 1, 2020 ' WHEN 1 THEN 'on 03/01/2020' WHEN 2 THEN 'id 103/01/2020' ELSE '' END")
    d = load(spark, sf, "documents").select("doc_id", F.expr("date_add(DATE'2020-01-01', CAST(doc_id % 700 AS INT))").alias("date_of_service"), F.concat_ws("\n", "text", stamp).alias("text"))
    return qa.check_staleness(d, "2020-03-01")


@query("run_checks", f"""
WITH {INPUT_SQL}
SELECT doc_id, 'data_integrity' AS "check", CASE WHEN (display_name IS NOT NULL AND k5 = 0) OR (birth_date IS NOT NULL AND k3 = 0) OR k4 = 0 THEN 'fail' WHEN display_name IS NULL AND birth_date IS NULL THEN 'warn' ELSE 'pass' END AS verdict FROM i
UNION ALL SELECT doc_id, 'date_staleness', 'pass' FROM i UNION ALL SELECT doc_id, 'broken', 'fail' FROM i""")
def run_checks(spark, sf):
    results = qa.run_checks(inputs(spark, sf), {"data_integrity": qa.check_identity, "date_staleness": lambda d: qa.check_staleness(d, "1999-12-31"), "broken": lambda d: d.select("no_such_column")})
    return qa.check_verdicts(results)


@query("crashed_checks", """
SELECT doc_id, 'ratio' AS "check", CASE WHEN doc_id = 17 THEN 'fail' WHEN length(text) // abs(doc_id - 17) > 50 THEN 'warn' ELSE 'pass' END AS verdict, CASE WHEN doc_id = 17 THEN 'check crashed (DIVIDE_BY_ZERO)' WHEN length(text) // abs(doc_id - 17) > 50 THEN 'long' END AS finding FROM documents
UNION ALL SELECT doc_id, 'words', CASE WHEN doc_id % 50 = 3 THEN 'fail' WHEN contains(text, '!!') THEN 'warn' ELSE 'pass' END, CASE WHEN doc_id % 50 = 3 THEN 'check crashed (KeyError)' WHEN contains(text, '!!') THEN 'shouting' END FROM documents
UNION ALL SELECT doc_id, 'broken', 'fail', 'check crashed (UNRESOLVED_COLUMN.WITH_SUGGESTION)' FROM documents""")
def crashed_checks(spark, sf):
    """A Spark check that fails on one document, a Python one that fails on some, and one that can't be planned."""

    def ratio(d):
        long = F.expr("length(text) div abs(doc_id - 17)") > 50
        return d.select("doc_id", F.lit("ratio").alias("check"), F.when(long, "warn").otherwise("pass").alias("verdict"), F.when(long, "long").alias("finding"))

    def words(doc):
        if doc["doc_id"] % 50 == 3:
            raise KeyError("a document that it can't read")
        return [("warn", "shouting")] if "!!" in doc["text"] else []

    d = load(spark, sf, "documents").select("doc_id", "text")
    return qa.run_checks(d, {"ratio": ratio, "words": qa.row_check("words", words, ["doc_id", "text"]), "broken": lambda d: d.select("no_such_column")})


# Names by rule: written out; misspelt inside the text, which a short name can't reach with its slack but a long one
# can; misspelt at the end of the text, where no slack is left; halves swapped; somebody else's; none.
@query("fuzzy_identity", """
SELECT CAST(doc_id AS VARCHAR) AS item_key, CASE WHEN doc_id % 7 = 6 THEN 'skip' WHEN doc_id % 5 = 0 THEN 'fail' WHEN doc_id % 7 IN (0, 2, 3) THEN 'pass' ELSE 'fail' END AS status FROM documents""")
def fuzzy_identity(spark, sf):
    """VER-03/04 over whole texts, with the name and the birth date put into their middle or at their end."""
    d = dealt(load(spark, sf, "documents")).withColumn("k", F.col("doc_id") % 7).withColumn("birth_date", F.expr("date_add(DATE'1950-01-01', CAST(doc_id % 9000 AS INT))"))
    short, long = F.concat(F.lit("Name Q"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("Family")), F.concat(F.lit("Maximiliana Theodora Q"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(" von Hohenfels-Wittgenau"))
    name = F.when(F.col("k").isin(1, 3), short).when(F.col("k") == 6, F.lit("")).otherwise(long)
    shown = (
        F.when(F.col("k") == 0, F.replace(F.upper(name), F.lit(" "), F.lit("\n "))).when(F.col("k").isin(1, 3), F.replace(name, F.lit("Fam"), F.lit("Fzm")))
        .when(F.col("k") == 2, F.replace(name, F.lit("Hohen"), F.lit("Hoken"))).when(F.col("k") == 4, F.concat(F.substring_index(name, " ", -2), F.lit(" "), F.substring_index(name, " ", 2))).otherwise("1234567 987654321")
    )
    half = F.floor(F.length("text") / 2).cast("int")
    born = F.when(F.col("doc_id") % 5 != 0, F.date_format("birth_date", "M-d-yyyy"))
    middle = F.concat_ws("\n", F.substring(F.col("text"), F.lit(1), half), born, shown, F.concat(F.lit("later "), F.substring(F.col("text"), half + 1, F.length("text"))), F.lit("and that was all of it, as far as is known"))
    end = F.concat_ws("\n", F.col("text"), born, shown)
    return verify.verify_identity(d.select(F.col("doc_id").cast("string").alias("item_key"), name.alias("display_name"), "birth_date", F.when(F.col("k") == 3, end).otherwise(middle).alias("text"))).select("item_key", "status")


@query("ladder", """
WITH d AS (SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS size, doc_id % 9 = 0 AS gone, doc_id % 8 = 0 AS swapped, doc_id % 4 AS pages, doc_id % 6 = 0 AS reported_off FROM documents),
l AS (SELECT CAST(doc_id AS VARCHAR) AS item_key, CASE WHEN gone OR swapped THEN 'L0' WHEN size <= 1024 OR pages = 0 THEN 'L1' END AS pre_failed, CASE WHEN reported_off THEN 'L5' END AS post_failed FROM d)
SELECT item_key, pre_failed, post_failed, 3 AS levels_run, CASE WHEN pre_failed IS NOT NULL THEN 'pre_verify_failed' WHEN post_failed IS NOT NULL THEN 'post_verify_failed' ELSE 'verified' END AS outcome FROM l""")
def ladder(spark, sf):
    d = load(spark, sf, "documents").withColumn("_bytes", F.encode("text", "utf-8"))
    m = d.select(F.col("doc_id").cast("string").alias("item_key"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("file_path"), F.sha2("_bytes", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"), (F.col("doc_id") % 4).alias("page_count"), "doc_id")
    files = m.filter("doc_id % 9 <> 0").select("file_path", F.when(F.col("doc_id") % 8 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"), "size_bytes")
    reported = m.select("item_key", F.when(F.col("doc_id") % 6 == 0, F.lit(0)).otherwise(F.col("size_bytes")).alias("size_bytes"), F.lit(None).cast("int").alias("page_count"))
    rows = verify.verify_integrity(m, files).unionByName(verify.verify_size(m.drop("page_count"), m.select("item_key", "page_count"))).unionByName(verify.verify_metadata(m, reported))
    return verify.verify_ladder(rows, ("L0", "L1", "L5")).select("item_key", "pre_failed", "post_failed", "levels_run", "outcome")


@query("header_fields", """
SELECT CAST(doc_id AS VARCHAR) AS item_key, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'header fields not found: dob, dos' WHEN doc_id % 3 = 0 THEN 'header fields not found: dob' WHEN doc_id % 4 = 0 THEN 'header fields not found: dos' ELSE 'header fields verified: dob, dos' END AS detail FROM documents""")
def header_fields(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_key"), F.expr("date_add(DATE'1950-01-01', CAST(doc_id % 9000 AS INT))").alias("birth_date"), F.expr("date_add(DATE'2020-01-01', CAST(doc_id % 700 AS INT))").alias("date_of_service"), "doc_id")
    d = d.withColumn("text", F.concat_ws("\n", F.when(F.col("doc_id") % 3 != 0, F.date_format("birth_date", "MMM  d, yyyy")), F.when(F.col("doc_id") % 4 != 0, F.upper(F.date_format("date_of_service", "MMMM dd, yyyy")))))
    return verify.verify_header(d, ["dos", "dob"]).select("item_key", "status", "detail")


@query("banner_check", """
SELECT CAST(o_orderkey AS VARCHAR) AS item_key, CASE WHEN o_custkey % 7 = 0 OR o_custkey % 5 = 0 OR o_custkey % 11 = 0 THEN 'fail' ELSE 'pass' END AS status FROM orders""")
def banner_check(spark, sf):
    o = load(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS item_key", "o_custkey AS patient_id", "concat('Fam', o_custkey) AS family_name", "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE DATE'1960-01-01' END AS birth_date")
    banner = load(spark, sf, "customer").filter("c_custkey % 7 <> 0").selectExpr("c_custkey AS patient_id", "concat('FAM', c_custkey) AS banner_family", "CASE WHEN c_custkey % 5 = 0 THEN DATE'1960-01-02' ELSE DATE'1960-01-01' END AS banner_birth")
    return verify.verify_banner(o, banner).select("item_key", "status")


@query("round_trip_read_back", """
SELECT CAST(doc_id AS VARCHAR) AS item_key, CASE doc_id % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' WHEN 3 THEN 'pass' ELSE 'fail' END AS status,
  CASE doc_id % 5 WHEN 0 THEN 'no destination doc resolved' WHEN 1 THEN 'byte-identical read-back' WHEN 2 THEN 'read-back page_count differs' WHEN 3 THEN 'reprocessed' ELSE 'read-back lost the birth_date (name ratio 1.00)' END AS detail FROM documents""")
def round_trip_read_back(spark, sf):
    m = load(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item_key"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.lit(2).alias("page_count"), F.concat(F.lit("Given Q"), F.col("doc_id").cast("string")).alias("display_name"), F.lit("1970-05-06").cast("date").alias("birth_date"))
    back = m.filter("doc_id % 5 <> 0").select("item_key", F.when(F.col("doc_id") % 5 == 1, F.col("sha256")).otherwise("re").alias("back_sha256"), F.when(F.col("doc_id") % 5 == 2, 3).otherwise(2).alias("back_pages"),
                                                F.concat_ws(" ", F.lit("Page"), F.upper("display_name"), F.when(F.col("doc_id") % 5 == 3, "5/6/1970")).alias("back_text"))
    return verify.verify_round_trip(m, back).select("item_key", "status", "detail")


RESOLVE_SQL = """
s AS (SELECT c_custkey AS patient_id, c_mktsegment || c_custkey % 400 AS fam, CASE WHEN c_custkey % 10 <> 9 THEN 'G' || c_nationkey END AS giv, DATE '1960-01-01' + CAST(c_custkey % 7 AS INT) AS bd, CASE WHEN c_custkey % 3 = 0 THEN 'id' || c_custkey % 1200 END AS ident FROM customer),
d AS (SELECT c_custkey AS dest_id, c_mktsegment || c_custkey % 400 AS fam, 'G' || c_nationkey AS giv, DATE '1960-01-01' + CAST(c_custkey % 7 AS INT) AS bd, 'id' || c_custkey AS ident FROM customer WHERE c_custkey % 5 <> 0)"""


@query("patient_resolution", f"""
WITH {RESOLVE_SQL},
m AS (SELECT s.patient_id, count(DISTINCT d.dest_id) AS n, min(d.dest_id) AS dest_id FROM s LEFT JOIN d ON CASE WHEN s.ident IS NOT NULL THEN d.ident = s.ident ELSE d.fam = s.fam AND d.bd = s.bd AND (s.giv IS NULL OR d.giv = s.giv) END GROUP BY 1)
SELECT patient_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS resolution, CASE WHEN n = 1 THEN dest_id END AS dest_id, n AS n_matches FROM m""")
def patient_resolution(spark, sf):
    c = load(spark, sf, "customer")
    cols = ["concat(c_mktsegment, c_custkey % 400) AS family_name", "date_add(DATE'1960-01-01', CAST(c_custkey % 7 AS INT)) AS birth_date"]
    src = c.selectExpr("c_custkey AS patient_id", "CASE WHEN c_custkey % 10 <> 9 THEN concat('G', c_nationkey) END AS given_name", "CASE WHEN c_custkey % 3 = 0 THEN concat('id', c_custkey % 1200) END AS identifier", *cols)
    dest = c.filter("c_custkey % 5 <> 0").selectExpr("c_custkey AS dest_id", "concat('G', c_nationkey) AS given_name", "concat('id', c_custkey) AS identifier", *cols)
    return verify.resolve_patients(src, dest).drop("matched_on")


@query("row_matching", """
WITH p AS (SELECT c_custkey AS patient_id, c_mktsegment || c_custkey % 300 AS fam, 'g' || c_nationkey AS giv, strftime(DATE '1960-01-01' + CAST(c_custkey % 50 AS INT), '%m/%d/%Y') AS bd FROM customer),
r AS (SELECT c_custkey AS dest_id, lower(c_mktsegment || c_custkey % 300) || ', G' || c_nationkey || ' dob ' || strftime(DATE '1960-01-01' + CAST(c_custkey % 50 AS INT), '%m/%d/%Y') AS t FROM customer WHERE c_custkey % 4 <> 0),
m AS (SELECT patient_id, count(DISTINCT dest_id) AS n, min(dest_id) AS dest_id FROM p LEFT JOIN r ON contains(t, bd) AND contains(lower(t), lower(fam)) AND contains(lower(t), giv) AND regexp_matches(lower(t), '(^|[^a-z0-9])' || lower(fam) || '($|[^a-z0-9])') GROUP BY 1)
SELECT patient_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS resolution, CASE WHEN n = 1 THEN dest_id END AS dest_id FROM m""")
def row_matching(spark, sf):
    c = load(spark, sf, "customer")
    p = c.selectExpr("c_custkey AS patient_id", "concat(c_mktsegment, c_custkey % 300) AS family_name", "concat('g', c_nationkey) AS given_name", "date_add(DATE'1960-01-01', CAST(c_custkey % 50 AS INT)) AS birth_date")
    r = c.filter("c_custkey % 4 <> 0").selectExpr("c_custkey AS dest_id", "concat(lower(concat(c_mktsegment, c_custkey % 300)), ', G', c_nationkey, ' dob ', date_format(date_add(DATE'1960-01-01', CAST(c_custkey % 50 AS INT)), 'MM/dd/yyyy')) AS row_text")
    return verify.match_rows(p, r)


@query("denylist_scan", r"""
WITH words AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda x: lower(x)) AS w FROM documents),
tok AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(list_filter(w, lambda x: length(x) >= 4), list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(regexp_extract_all(text, '\b[A-Za-z0-9_-]{24,}\b'), lambda x: lower(x))))) AS token FROM words JOIN documents USING (doc_id)),
deny AS (SELECT DISTINCT sha256(lower(t)) AS h FROM (SELECT unnest(list_filter(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda x: length(x) >= 4)) AS t FROM benchmark))
SELECT doc_id AS path, sha256(token) AS sha256 FROM tok WHERE sha256(token) IN (SELECT h FROM deny) AND token NOT IN (SELECT lower(p_name) FROM part)""")
def denylist_scan(spark, sf):
    words = F.explode(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.length(w) >= 4))
    deny = load(spark, sf, "benchmark").select(words.alias("w")).select(F.lower("w").alias("t")).select(F.sha2(F.col("t").cast("binary"), 256).alias("sha256")).distinct()
    allow = load(spark, sf, "part").select(F.lower("p_name").alias("token"))
    return phi.denylist_scan(phi.scannable(spread(load(spark, sf, "documents"))), deny, allow, path="doc_id").withColumnRenamed("doc_id", "path")


# Each text gains identifiers of every kind, some of them synthetic by convention.
SEEDED = """concat(text, '\\n', CASE doc_id % 4 WHEN 0 THEN concat('SSN ', lpad(doc_id * 7 % 1000, 3, '0'), '-12-3456') WHEN 1 THEN concat('call (212) ', CASE WHEN doc_id % 8 = 1 THEN '555' ELSE '444' END, '-', lpad(doc_id % 10000, 4, '0'))
  WHEN 2 THEN concat('id ', CASE WHEN doc_id % 8 = 2 THEN 'FEEDFACE' ELSE 'ABCDEF12' END, '-0000-4000-8000-', lpad(doc_id, 12, '0')) ELSE concat('DOB: ', doc_id % 12 + 1, '/', doc_id % 28 + 1, '/1970') END)"""
SEEDED_SQL = """
f AS (SELECT doc_id, 'ssn' AS kind, lpad(CAST(doc_id * 7 % 1000 AS VARCHAR), 3, '0') || '-12-3456' AS value FROM documents WHERE doc_id % 4 = 0 AND doc_id * 7 % 1000 NOT IN (0, 666) AND doc_id * 7 % 1000 < 900
  UNION ALL SELECT doc_id, 'phone', '(212) 444-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') FROM documents WHERE doc_id % 8 = 5
  UNION ALL SELECT doc_id, 'guid', 'abcdef12-0000-4000-8000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') FROM documents WHERE doc_id % 8 = 6
  UNION ALL SELECT doc_id, 'birth_date', doc_id % 12 + 1 || '/' || doc_id % 28 + 1 || '/1970' FROM documents WHERE doc_id % 4 = 3
  UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\\(?\\b\\d{3}\\)?[ .-]\\d{3}[ .-]\\d{4}\\b')) FROM documents)"""


def _findings(spark, sf):
    d = load(spark, sf, "documents").selectExpr("doc_id", f"{SEEDED} AS text")
    return phi.pattern_findings(phi.scannable(d), path="doc_id")


@query("pattern_findings", f"WITH {SEEDED_SQL} SELECT doc_id AS path, kind, value, count(*) AS n FROM f WHERE kind <> 'phone' OR regexp_extract(value, '[ .-](\\d{{3}})[ .-]', 1) <> '555' GROUP BY 1, 2, 3")
def pattern_findings(spark, sf):
    return _findings(spark, sf).groupBy(F.col("doc_id").alias("path"), "kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("scan_summary", f"WITH {SEEDED_SQL} SELECT doc_id AS path, count(*) AS n_findings, 'findings' AS status FROM f WHERE doc_id % 9 <> 0 AND (kind <> 'phone' OR regexp_extract(value, '[ .-](\\d{{3}})[ .-]', 1) <> '555') GROUP BY 1 UNION ALL SELECT doc_id, NULL, 'skipped_binary' FROM documents WHERE doc_id % 9 = 0")
def scan_summary(spark, sf):
    """A ninth of the texts ends in a NUL, however long they are: none is scanned, and each is named."""
    d = load(spark, sf, "documents").selectExpr("doc_id", f"{SEEDED} AS text").withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\u0000"))).otherwise(F.col("text")))
    return phi.scan_summary(phi.pattern_findings(phi.scannable(d), path="doc_id"), "doc_id", phi.skipped_binary(d, "doc_id")).withColumnRenamed("doc_id", "path")


@query("unreadable_documents", f"""
WITH {INPUT_SQL}, u AS (SELECT *, doc_id % 6 = 0 AS gone FROM i), f AS (
SELECT doc_id, 'fail' AS verdict, 'patient name not found on document' AS finding FROM u WHERE display_name IS NOT NULL AND (k5 = 0 OR gone)
UNION ALL SELECT doc_id, 'fail', 'date of birth not found on document' FROM u WHERE birth_date IS NOT NULL AND (k3 = 0 OR gone)
UNION ALL SELECT doc_id, 'warn', 'record carries no identity anchors (name/DOB) to verify' FROM u WHERE display_name IS NULL AND birth_date IS NULL
UNION ALL SELECT doc_id, 'fail', 'date of service not found on document' FROM u WHERE k4 = 0 OR gone)
SELECT doc_id, coalesce(verdict, 'pass') AS verdict, finding FROM u LEFT JOIN f USING (doc_id)""")
def unreadable_documents(spark, sf):
    """A sixth of the documents has no text: everything the record holds is missing on them."""
    gone = inputs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 6 != 0, F.col("text")))
    return qa.check_identity(gone).select("doc_id", "verdict", "finding")


@query("vitals_of_unreadable", """
WITH v AS (SELECT doc_id, CAST(doc_id % 50 + 60 AS VARCHAR) AS value FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN concat('vital Pulse value ', chr(39), value, chr(39), ' not found') END AS finding FROM v""")
def vitals_of_unreadable(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("encounter_id"), (F.col("doc_id") % 50 + 60).cast("string").alias("value"))
    shown = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Pulse "), "value", F.lit("1"))).otherwise(F.concat(F.lit("Pulse "), "value"))
    seen = d.select("encounter_id", F.lit("vital-signs").alias("category"), F.lit("Pulse").alias("display"), F.lit("p").alias("code"), "value")
    return qa.check_vitals(d.select("doc_id", "encounter_id", shown.alias("text")), seen).select("doc_id", "verdict", "finding")


@query("ladder_gaps", """
SELECT CAST(doc_id AS VARCHAR) AS item_key, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'L0' END AS pre_failed, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS levels_run,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'pre_verify_failed' WHEN doc_id % 3 = 0 THEN 'incomplete' ELSE 'verified' END AS outcome FROM documents""")
def ladder_gaps(spark, sf):
    """Manifests without a size or hash fail, and items that a level never ran for aren't verified."""
    d = load(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item_key"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("file_path"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.octet_length("text").alias("size_bytes"))
    m = d.withColumn("size_bytes", F.when(F.col("doc_id") % 5 != 0, F.col("size_bytes"))).withColumn("sha256", F.when(F.col("doc_id") % 7 != 0, F.col("sha256")))
    reported = d.select("item_key", F.lit(None).cast("int").alias("size_bytes"), F.lit(None).cast("int").alias("page_count"))
    some = m.withColumn("page_count", F.lit(1)).filter("doc_id % 3 <> 0")
    rows = verify.verify_integrity(m, d.select("file_path", "sha256", "size_bytes")).unionByName(verify.verify_metadata(some, reported))
    return verify.verify_ladder(rows, ("L0", "L5"), d).select("item_key", "pre_failed", "levels_run", "outcome")


@query("unidentified_patients", """
WITH s AS (SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment || c_custkey % 400 END AS fam, CASE WHEN c_custkey % 13 <> 0 THEN DATE '1960-01-01' + CAST(c_custkey % 7 AS INT) END AS bd FROM customer),
d AS (SELECT c_custkey AS dest_id, c_mktsegment || c_custkey % 400 AS fam, DATE '1960-01-01' + CAST(c_custkey % 7 AS INT) AS bd FROM customer WHERE c_custkey % 5 <> 0),
m AS (SELECT s.patient_id, count(DISTINCT d.dest_id) AS n, min(d.dest_id) AS dest_id FROM s LEFT JOIN d ON d.fam = s.fam AND d.bd = s.bd GROUP BY 1)
SELECT patient_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS resolution, CASE WHEN n = 1 THEN dest_id END AS dest_id, n AS n_matches FROM m""")
def unidentified_patients(spark, sf):
    """Patients without a name, birth date or identifier still have a row: nobody was found."""
    c = load(spark, sf, "customer")
    none = ["CAST(NULL AS STRING) AS given_name", "CAST(NULL AS STRING) AS identifier"]
    dest = c.filter("c_custkey % 5 <> 0").selectExpr("c_custkey AS dest_id", "concat(c_mktsegment, c_custkey % 400) AS family_name", "date_add(DATE'1960-01-01', CAST(c_custkey % 7 AS INT)) AS birth_date", *none)
    src = c.selectExpr("c_custkey AS patient_id", "CASE WHEN c_custkey % 13 <> 0 THEN concat(c_mktsegment, c_custkey % 400) END AS family_name", "CASE WHEN c_custkey % 13 <> 0 THEN date_add(DATE'1960-01-01', CAST(c_custkey % 7 AS INT)) END AS birth_date", *none)
    return verify.resolve_patients(src, dest).drop("matched_on")
