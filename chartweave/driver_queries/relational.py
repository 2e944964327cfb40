"""Joins, windows, sets and folds over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chartweave.driver_queries.base import dealt, load, query
from chartweave.driver_queries.exports import DriverExport
from chartweave.operators import filters, folds, joins, search, sets, windows
from chartweave.plans import tsv_mapping as M
from chartweave.session import staging_folder


@query("coded_lookup", """
SELECT c_custkey, n_name AS nation_display, 'M' || n_regionkey AS nation_meaning, CAST(n_regionkey AS VARCHAR) AS nation_set FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 9 <> 0""")
def coded_lookup(spark, sf):
    book = load(spark, sf, "nation").selectExpr("CAST(n_nationkey AS STRING) AS CODE_VALUE", "n_name AS DISPLAY", "concat('M', n_regionkey) AS CDF_MEANING", "CAST(n_regionkey AS STRING) AS CODE_SET", "CAST(1 AS BIGINT) AS _ord")
    stale = book.withColumn("DISPLAY", F.lit("superseded")).withColumn("_ord", F.lit(0).cast("bigint"))
    df = load(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN '999' ELSE concat(' ', c_nationkey) END AS NATION_CD")
    return joins.resolve_codes(df, {"NATION_CD": "nation"}, stale.unionByName(book)).drop("NATION_CD")


@query("first_last_child", """
SELECT c_custkey, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order, arg_min(o_orderstatus, o_orderkey) AS first_status, arg_max(o_totalprice, o_orderkey) AS last_total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def first_last_child(spark, sf):
    o = load(spark, sf, "orders")
    first = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), F.col("o_orderstatus").alias("first_status"))
    last = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_total"))
    c = load(spark, sf, "customer").select("c_custkey")
    return joins.attach_last(joins.attach_first(c, first, "c_custkey", ["first_order"]), last, "c_custkey", ["last_order"])


@query("attached_children", """
WITH n AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 4 AS page, o_orderdate FROM orders)
SELECT c_custkey, coalesce(page, 0) AS page, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN n ON o_custkey = c_custkey GROUP BY 1, 2""")
def attached_children(spark, sf):
    o = load(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = joins.attach(load(spark, sf, "customer").select("c_custkey"), o, "c_custkey", F.col("o_orderkey").cast("string"), "orders",
                       ["o_orderdate", "o_orderkey"], F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")), page_rows=4)
    return out.select("c_custkey", "page", F.array_join("orders", ",").alias("orders"))


@query("with_actors", """
SELECT o_orderkey, n1.n_name AS facility_name, s1.s_name AS provider_s_name FROM orders LEFT JOIN nation n1 ON n1.n_nationkey = o_custkey % 30 LEFT JOIN supplier s1 ON s1.s_suppkey = o_orderkey % 120""")
def with_actors(spark, sf):
    o = load(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 30 AS INT) AS facility_id", "o_orderkey % 120 AS provider_id")
    o = joins.with_actors(o, load(spark, sf, "nation").withColumnRenamed("n_name", "name"), {"facility_id": "facility"}, "n_nationkey", ["name"])
    return joins.with_actors(o, load(spark, sf, "supplier"), {"provider_id": "provider"}, "s_suppkey", ["s_name"]).select("o_orderkey", "facility_name", "provider_s_name")


@query("cited_actors", """
SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_use, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 5 <> 0 GROUP BY 1, 2, 4""")
def cited_actors(spark, sf):
    actors = load(spark, sf, "supplier").filter("s_suppkey % 5 <> 0").select("s_suppkey", "s_name")
    return joins.cited_actors(load(spark, sf, "lineitem"), actors, "l_orderkey", "l_suppkey", "s_suppkey", "l_linenumber").select("l_orderkey", "l_suppkey", "first_use", "s_name")


@query("attribute_documents", """
WITH p AS (SELECT c_custkey, 'Van_' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '_Jo' ELSE '' END || '_' || c_nationkey || '_' AS prefix FROM customer),
k AS (SELECT DISTINCT prefix FROM p),
d AS (SELECT o_orderkey AS doc_id, 'Van_' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '_Jo' ELSE '' END || '_' || c_nationkey || '_' || strftime(o_orderdate, '%m-%d-%Y') || '_note.pdf' AS f FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT doc_id, arg_max(prefix, length(prefix)) AS prefix FROM d JOIN k ON starts_with(f, prefix) GROUP BY 1)
SELECT doc_id, count(*) AS n_owners, min(c_custkey) AS first_owner, any_value(prefix) AS prefix FROM b JOIN p USING (prefix) GROUP BY 1""")
def attribute_documents(spark, sf):
    c = load(spark, sf, "customer").selectExpr("c_custkey AS patient_id", "concat('Van ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN ' Jo' ELSE '' END) AS family", "CAST(c_nationkey AS STRING) AS given")
    patients = c.withColumn("prefix", joins.patient_prefix("family", "given"))
    docs = load(spark, sf, "orders").join(patients, F.col("o_custkey") == F.col("patient_id")).select(
        F.col("o_orderkey").alias("doc_id"), F.concat("prefix", F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit("_note.pdf")).alias("file_name"))
    return joins.attribute_documents(docs, patients).select("doc_id", "n_owners", "first_owner", "prefix")


@query("match_documents", """
WITH d AS (SELECT o_custkey AS patient_id, strftime(o_orderdate, '%m-%d-%Y') AS dos, 'chart_' || strftime(o_orderdate, '%m-%d-%Y') || CASE WHEN o_orderkey % 2 = 0 THEN '_note-' || substr('e' || o_orderkey, 1, 8) ELSE '_note' END || '.pdf' AS f, o_orderkey FROM orders),
m AS (SELECT patient_id, dos, min(f) AS f FROM d GROUP BY 1, 2),
own AS (SELECT DISTINCT patient_id, dos, substr('e' || o_orderkey, 1, 8) AS s, f FROM d WHERE o_orderkey % 2 = 0)
SELECT d.patient_id, 'e' || d.o_orderkey AS encounter_id, coalesce(own.f, m.f) AS file_name FROM d JOIN m USING (patient_id, dos) LEFT JOIN own ON own.patient_id = d.patient_id AND own.dos = d.dos AND own.s = substr('e' || d.o_orderkey, 1, 8)""")
def match_documents(spark, sf):
    o = load(spark, sf, "orders")
    enc = o.select(F.col("o_custkey").alias("patient_id"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("encounter_id"), F.col("o_orderdate").cast("date").alias("date_of_service"))
    tail = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("_note-"), F.substring(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")), 1, 8))).otherwise("_note")
    docs = o.select(F.col("o_custkey").alias("patient_id"), F.concat(F.lit("chart_"), F.date_format("o_orderdate", "MM-dd-yyyy"), tail, F.lit(".pdf")).alias("file_name"))
    return joins.match_documents(enc, docs)


@query("unanchored", """
SELECT 'labels' AS side, label_doc AS key, n FROM (SELECT doc_id + 300 AS label_doc, count(*) AS n FROM labels GROUP BY 1) WHERE label_doc NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'anchored', doc_id + 300, count(*) FROM labels WHERE doc_id + 300 IN (SELECT doc_id FROM documents) GROUP BY 2""")
def unanchored(spark, sf):
    lab = load(spark, sf, "labels").select((F.col("doc_id") + 300).alias("doc_id"))
    docs = load(spark, sf, "documents").select("doc_id")
    kept, _ = joins.anchor(lab, docs, "doc_id")
    orphans = sets.orphan_keys(lab, docs, "doc_id").select(F.lit("labels").alias("side"), F.col("doc_id").alias("key"), F.col("n_rows").alias("n"))
    return orphans.unionByName(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("anchored").alias("side"), F.col("doc_id").alias("key"), "n"))


@query("duplicate_scan", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) THEN 'duplicate' ELSE 'send' END AS status FROM documents) GROUP BY 1""")
def duplicate_scan(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    send, dup = joins.anti_existing(d, d.filter("doc_id % 3 = 0"), ["fingerprint"])
    both = send.select(F.lit("send").alias("status")).unionByName(dup.select(F.lit("duplicate").alias("status")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("keyed_rows", "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def keyed_rows(spark, sf):
    o = load(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 4 = 0 THEN ' NULL' ELSE concat(' ', o_custkey, ' ') END AS k")
    return joins.keyed(o, "k").groupBy(F.col("k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("notes_concat", """
WITH n AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS page, turn, role || ': ' || text AS t FROM conversations)
SELECT conv_id, page, string_agg(t, chr(10) ORDER BY turn) AS text FROM n GROUP BY 1, 2""")
def notes_concat(spark, sf):
    c = load(spark, sf, "conversations")
    line = F.concat("role", F.lit(": "), "text")
    return folds.paged_concat(c.select("conv_id", "turn", line.alias("line")), ["conv_id"], F.col("line"), ["turn"], F.floor(F.col("turn") / 64), "\n", 2)


@query("blob_text", """
SELECT 'ev' || conv_id AS event_id, string_agg(text, chr(10) ORDER BY turn) FILTER (turn % 5 <> 4) AS body, count(*) FILTER (turn % 5 = 4) AS n_undecoded FROM conversations GROUP BY 1 HAVING count(*) FILTER (turn % 5 <> 4) > 0""")
def blob_text(spark, sf):
    c = load(spark, sf, "conversations").selectExpr("concat(' ev', conv_id) AS EVENT_ID", "CAST(turn AS STRING) AS BLOB_SEQ_NUM", "text AS BLOB_CONTENTS", "CASE WHEN turn % 5 = 4 THEN '728' END AS COMPRESSION_CD", "conv_id * 4096 + turn AS _ord")
    text, kept = folds.assemble_blobs(c)
    n = kept.groupBy("EVENT_ID").agg(F.count(F.lit(1)).alias("n_undecoded"))
    return text.join(n, "EVENT_ID", "left").select(F.col("EVENT_ID").alias("event_id"), "body", F.coalesce("n_undecoded", F.lit(0)).alias("n_undecoded"))


@query("verdict_rollup", """
SELECT d.doc_id, CASE max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def verdict_rollup(spark, sf):
    return folds.document_verdict(_label_results(spark, sf))


def _label_results(spark, sf):
    lab = load(spark, sf, "labels").selectExpr("doc_id", "explode(array(CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END, CASE WHEN quality = 0 THEN 'warn' ELSE 'pass' END)) AS verdict")
    return load(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left")


@query("verdict_summary", """
WITH v AS (SELECT d.doc_id, max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END) AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (r = 0 OR r IS NULL) AS n_pass, count(*) FILTER (r = 1) AS n_warn, count(*) FILTER (r = 2) AS n_fail, count(*) FILTER (r = 2) = 0 AS ok FROM v""")
def verdict_summary(spark, sf):
    return folds.qa_summary(folds.document_verdict(_label_results(spark, sf)))


@query("patient_summary", """
SELECT c_custkey AS patient_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS encounter_count, (SELECT count(*) FROM documents WHERE doc_id % 1000 = c_custkey) AS document_count FROM customer""")
def patient_summary(spark, sf):
    return folds.patient_summary(load(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id")),
                                 load(spark, sf, "documents").select((F.col("doc_id") % 1000).alias("patient_id")), load(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id")))


@query("archive_totals", "SELECT (SELECT count(*) FROM customer) AS patients, (SELECT count(*) FROM orders) AS encounters, (SELECT count(*) FROM documents) AS documents")
def archive_totals(spark, sf):
    return folds.archive_totals(load(spark, sf, "customer"), load(spark, sf, "orders"), load(spark, sf, "documents"))


@query("distinct_in_order", """
SELECT l_orderkey, string_agg(f, ',' ORDER BY o) AS flags FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS f, min((l_partkey * 100000 + l_suppkey) * 8 + l_linenumber) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def distinct_in_order(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("_ord", F.expr("(l_partkey * 100000 + l_suppkey) * 8 + l_linenumber"))
    return folds.distinct_in_order(li, "l_orderkey", F.concat("l_returnflag", "l_linestatus"), "_ord", "flags").withColumn("flags", F.array_join("flags", ","))


@query("longest_match", """
SELECT s_suppkey, arg_max(p_name, (length(p_name), p_name)) AS p_name FROM (SELECT DISTINCT l_suppkey AS s_suppkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def longest_match(spark, sf):
    c = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), "p_name")
    return windows.longest_match(c, ["s_suppkey"], "p_name")


@query("benefit_order", """
SELECT coverage_id, row_number() OVER (PARTITION BY p, a ORDER BY o, k) AS rank FROM (SELECT 'plan-' || c_custkey AS coverage_id, c_custkey AS k, c_custkey % 200 AS p, c_custkey % 2 = 0 AS a,
  CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 99 END AS o FROM customer)""")
def benefit_order(spark, sf):
    from chartweave.plans.views import order_coverages

    t = DriverExport(spark, sf)
    return order_coverages(M.map_coverages(t["patient-insurances"], t["superbill-insurances"])).select("coverage_id", "rank")


@query("ordered_transitions", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 50 = 0), CASE WHEN event_id % 50 <> 0 THEN ts END, event_id) AS position FROM events""")
def ordered_transitions(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("at"))
    e = e.withColumn("late", F.col("at").isNull())
    block = F.struct("late", F.date_trunc("day", F.col("at").cast("timestamp")), F.when(F.col("late"), F.shiftright("event_id", 16)))
    return windows.block_scan(e, ["user_id"], ["late", "at", "event_id"], block, {"position": ("row_number", None)}).select("event_id", "user_id", "position")


@query("pending_items", "SELECT CAST(o_orderkey AS VARCHAR) AS item_key, o_orderstatus AS state FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY 1 LIMIT 100")
def pending_items(spark, sf):
    return windows.pending(load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("item_key"), F.col("o_orderstatus").alias("state")), ["O", "P"], 100)


@query("latest_run", "SELECT arg_max('run-' || o_orderkey, (o_orderdate, 'run-' || o_orderkey)) AS run_id FROM orders")
def latest_run(spark, sf):
    return windows.latest_run(load(spark, sf, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("started_at")))


@query("ranked_search", r"""
WITH i AS (SELECT doc_id AS id, source || ' ' || lang AS display_name, text AS search FROM documents)
SELECT id, display_name, greatest(CASE WHEN starts_with(display_name, 'src1') THEN 3 WHEN contains(display_name, 'src1') THEN 2 ELSE 1 END, CASE WHEN starts_with(display_name, 'en') THEN 3 WHEN contains(display_name, 'en') THEN 2 ELSE 1 END) AS score
FROM i WHERE contains(lower(search) || ' ' || display_name, 'src1') AND contains(lower(search) || ' ' || display_name, 'en')""")
def ranked_search(spark, sf):
    index = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("display_name"), F.col("text").alias("search"))
    return windows.search_patients(index, "SRC1  en").select("id", "display_name", "score")


@query("indexed_search", r"""
WITH i AS (SELECT doc_id AS id, source || ' ' || lang AS display_name, text AS search FROM documents), h AS (SELECT *, lower(search) || ' ' || display_name AS hay FROM i)
SELECT 'src1 thea' AS query, id, display_name, greatest(CASE WHEN starts_with(display_name, 'src1') THEN 3 WHEN contains(display_name, 'src1') THEN 2 ELSE 1 END, CASE WHEN starts_with(display_name, 'thea') THEN 3 WHEN contains(display_name, 'thea') THEN 2 ELSE 1 END) AS score FROM h WHERE contains(hay, 'src1') AND contains(hay, 'thea')
UNION ALL SELECT 'de @', id, display_name, greatest(CASE WHEN starts_with(display_name, 'de') THEN 3 WHEN contains(display_name, 'de') THEN 2 ELSE 1 END, 1) FROM h WHERE contains(hay, 'de') AND contains(hay, '@')
UNION ALL SELECT 'akia', id, display_name, 1 FROM h WHERE contains(hay, 'akia')""")
def indexed_search(spark, sf):
    """WIN-08 from trigram bitmaps over all documents: long words, words shorter than a trigram, and a rare one."""
    index = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("display_name"), F.col("text").alias("search"))
    folder = f"{staging_folder(spark)}/search-{uuid.uuid4().hex}"
    search.write_index(dealt(index, per_core=1), folder)
    parts = [search.search_index(spark, folder, q).select(F.lit(q).alias("query"), "id", "display_name", "score") for q in ("src1 thea", "de @", "akia")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("residual_columns", "SELECT o_orderkey, 'x:o_orderpriority=' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ',x:o_orderstatus=' || o_orderstatus ELSE '' END AS tail FROM orders")
def residual_columns(spark, sf):
    o = load(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderpriority", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'NULL' END AS o_orderstatus")
    tail = sets.residual(o.columns, ["o_orderkey", "o_custkey"], "x")
    pairs = F.transform(F.array_sort(F.map_entries(tail)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return o.select("o_orderkey", F.array_join(pairs, ",").alias("tail"))


@query("overlay", "SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'patched' ELSE p_name END AS name FROM part UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier")
def overlay(spark, sf):
    part = load(spark, sf, "part")
    extra = part.filter("p_partkey % 10 = 0").selectExpr("p_partkey AS k", "'patched' AS name").unionByName(load(spark, sf, "supplier").selectExpr("-s_suppkey - 1 AS k", "s_name AS name"))
    return sets.overlay(part.selectExpr("p_partkey AS k", "p_name AS name"), extra, "k")


@query("unified_sources", """
SELECT 'customer' AS source, c_custkey AS id, c_name AS name, NULL AS brand FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, p_brand FROM part""")
def unified_sources(spark, sf):
    return sets.unify(load(spark, sf, "customer").selectExpr("'customer' AS source", "c_custkey AS id", "c_name AS name"), load(spark, sf, "supplier").selectExpr("'supplier' AS source", "s_suppkey AS id", "s_name AS name"),
                      load(spark, sf, "part").selectExpr("'part' AS source", "p_partkey AS id", "p_name AS name", "p_brand AS brand"))


@query("idempotent_enqueue", "SELECT DISTINCT l_orderkey AS item_key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def idempotent_enqueue(spark, sf):
    items = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_key"))
    return sets.enqueue(items, load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_key")))


@query("current_versions", """
SELECT event_id, user_id, event_id % 3 = 0 OR event_id % 7 = 0 AS is_open FROM events""")
def current_versions(spark, sf):
    e = load(spark, sf, "events").selectExpr("event_id", "user_id", "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 7 = 0 THEN '0001-01-01 00:00:00' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS VALID_UNTIL_DT_TM")
    opened, closed = filters.current_versions(e)
    return opened.select("event_id", "user_id", F.lit(True).alias("is_open")).unionByName(closed.select("event_id", "user_id", F.lit(False).alias("is_open")))


@query("event_routes", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'problem' WHEN 1 THEN 'allergy' ELSE 'other' END AS route FROM documents""")
def event_routes(spark, sf):
    title = F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN 'Diagnosis: ' WHEN 1 THEN 'ALLERGY ' WHEN 2 THEN 'problems ' ELSE 'see allergy: ' END"), "text")
    return load(spark, sf, "documents").select("doc_id", filters.route_event(title).alias("route"))


@query("skiplist", """
SELECT item_key, encounter_id, item_key IN (SELECT 'i' || doc_id FROM labels WHERE toxic = 1) OR encounter_id IN (SELECT 'e' || doc_id FROM labels WHERE quality = 0) AS skipped
FROM (SELECT 'i' || doc_id AS item_key, 'e' || doc_id % 700 AS encounter_id FROM documents)""")
def skiplist(spark, sf):
    items = load(spark, sf, "documents").selectExpr("concat('i', doc_id) AS item_key", "concat('e', doc_id % 700) AS encounter_id")
    lab = load(spark, sf, "labels")
    skip = lab.filter("toxic = 1").selectExpr("concat('i', doc_id) AS skip_key").unionByName(lab.filter("quality = 0").selectExpr("concat('e', doc_id) AS skip_key"))
    todo, skipped = filters.apply_skiplist(items, skip)
    return todo.select("item_key", "encounter_id", F.lit(False).alias("skipped")).unionByName(skipped.select("item_key", "encounter_id", F.lit(True).alias("skipped")))


@query("smoking_rows", "SELECT c_custkey, c_custkey % 7 = 0 OR (c_custkey % 5 <> 0 AND c_custkey % 2 = 0) AS smoking FROM customer")
def smoking_rows(spark, sf):
    c = load(spark, sf, "customer").selectExpr("c_custkey", "'social-history' AS category", "CASE WHEN c_custkey % 7 = 0 THEN '72166-2' WHEN c_custkey % 5 = 0 THEN '1' END AS code", "CASE WHEN c_custkey % 2 = 0 THEN 'Tobacco use' ELSE 'Occupation' END AS display")
    return c.select("c_custkey", filters.is_smoking_status("category", "code", "display").alias("smoking"))


@query("orphan_keys", """
SELECT 'lineitem->part' AS relation, l_partkey AS k, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 2
UNION ALL SELECT 'orders->customer', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 2""")
def orphan_keys(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    od = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    a = sets.orphan_keys(li, load(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("k")), "k").withColumn("relation", F.lit("lineitem->part"))
    b = sets.orphan_keys(od, load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k").withColumn("relation", F.lit("orders->customer"))
    return a.unionByName(b).withColumnRenamed("n_rows", "n")
