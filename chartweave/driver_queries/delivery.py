"""Ledger, routes and layout statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartweave.driver_queries.base import load, query
from chartweave.operators import folds
from chartweave.plans import layout, ledger, routes

# Events as a transition log: the user is the item, the event the new state.
STATE = "CASE event_type WHEN 'signup' THEN 'resolving_patient' WHEN 'view' THEN 'verifying_pre' WHEN 'click' THEN 'uploading' WHEN 'purchase' THEN 'verifying_post' ELSE 'retry_wait' END"
LOG_SQL = f"""
t AS (SELECT event_id AS seq, user_id AS item_key, 'run' || event_id % 3 AS run_id, {STATE} AS to_state, CASE WHEN event_type = 'error' THEN 'E' || event_id % 4 WHEN event_id % 40 = 0 THEN 'CrashRecovery' END AS error_type, CASE WHEN event_type = 'purchase' THEN 'doc' || event_id END AS doc FROM events)"""


def log(spark, sf):
    return load(spark, sf, "events").selectExpr(
        "event_id AS seq", "user_id AS item_key", "concat('run', event_id % 3) AS run_id", f"{STATE} AS to_state",
        "CASE WHEN event_type = 'error' THEN concat('E', event_id % 4) WHEN event_id % 40 = 0 THEN 'CrashRecovery' END AS error_type", "CASE WHEN event_type = 'purchase' THEN concat('doc', event_id) END AS destination_doc_id", "ts AS at")


ITEMS_SQL = f"{LOG_SQL}, items AS (SELECT item_key, arg_max(to_state, seq) AS state, count(*) FILTER (to_state = 'retry_wait') AS attempts, arg_max(error_type, seq) FILTER (error_type IS NOT NULL) AS last_error_type, arg_max(doc, seq) FILTER (doc IS NOT NULL) AS destination_doc_id, arg_max(run_id, seq) AS claimed_by, max(seq) AS last_seq FROM t GROUP BY 1)"


@query("ledger_fold", f"WITH {ITEMS_SQL} SELECT * FROM items")
def ledger_fold(spark, sf):
    return ledger.current_items(log(spark, sf))


@query("illegal_transitions", f"""
WITH {LOG_SQL}, p AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY item_key ORDER BY seq), 'pending') AS previous FROM t)
SELECT seq, item_key, previous, to_state FROM p WHERE coalesce(error_type, '') <> 'CrashRecovery' AND NOT (
  (previous = 'pending' AND to_state = 'resolving_patient') OR (previous = 'resolving_patient' AND to_state IN ('verifying_pre', 'retry_wait')) OR (previous = 'verifying_pre' AND to_state IN ('uploading', 'retry_wait'))
  OR (previous = 'uploading' AND to_state IN ('verifying_post', 'retry_wait')) OR (previous = 'retry_wait' AND to_state = 'resolving_patient') OR (previous = 'verifying_post' AND to_state = 'retry_wait'))""")
def illegal_transitions(spark, sf):
    return ledger.illegal_transitions(log(spark, sf)).select("seq", "item_key", "previous", "to_state")


@query("crash_recovery", f"""
WITH {ITEMS_SQL} SELECT last_seq + 1 AS seq, item_key, 'resume' AS run_id, state AS from_state, CASE WHEN state IN ('resolving_patient', 'verifying_pre') THEN 'pending' ELSE 'upload_interrupted' END AS to_state, 'CrashRecovery' AS error_type FROM items WHERE state <> 'retry_wait'""")
def crash_recovery(spark, sf):
    return ledger.recover(log(spark, sf), "resume")


@query("next_step", """
SELECT CAST(o_orderkey AS VARCHAR) AS item_key, CASE
  WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 'skipped_skiplist' WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 1 THEN 'preflight_failed' WHEN o_orderstatus = 'F' AND o_custkey % 5 >= 3 THEN 'failed'
  WHEN o_custkey % 7 = 0 THEN 'patient_not_found' WHEN o_custkey % 7 = 1 THEN 'failed' WHEN o_custkey % 7 = 2 THEN 'resolving_patient' WHEN o_orderkey % 4 = 0 THEN 'duplicate_at_destination' WHEN o_custkey % 11 = 0 THEN 'pre_verify_failed'
  WHEN o_orderkey % 3 = 0 THEN 'uploading' WHEN o_orderkey % 13 = 0 THEN 'post_verify_failed' ELSE 'completed' END AS next_state,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 'skipped_skiplist' WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 1 THEN 'preflight_failed' WHEN o_orderstatus = 'F' AND o_custkey % 5 >= 3 THEN 'RetriesExhausted'
  WHEN o_custkey % 7 >= 3 AND o_orderkey % 4 <> 0 AND o_custkey % 11 = 0 THEN 'WrongPatientError' WHEN o_custkey % 7 >= 3 AND o_orderkey % 4 <> 0 AND o_custkey % 11 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 13 = 0 THEN 'SizeMismatch' END AS reason FROM orders""")
def next_step(spark, sf):
    e = load(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS item_key", "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'retry_wait' ELSE 'upload_interrupted' END AS state", "o_custkey % 5 AS attempts", "o_orderkey % 10 = 0 AS skiplisted", "o_orderkey % 10 <> 1 AS preflight_ok",
        "CASE o_custkey % 7 WHEN 0 THEN 'not_found' WHEN 1 THEN 'ambiguous' WHEN 2 THEN NULL ELSE 'found' END AS resolution", "o_orderkey % 4 = 0 AS duplicate", "o_custkey % 11 <> 0 AS banner_ok", "true AS pre_ok", "o_orderkey % 3 <> 0 AS sent", "o_orderkey % 13 <> 0 AS size_ok", "true AS post_ok")
    return ledger.next_step(e).select("item_key", "next_state", "reason")


@query("retry_schedule", f"WITH {ITEMS_SQL} SELECT item_key, attempts, CASE WHEN attempts < 15 THEN 'resolving_patient' ELSE 'failed' END AS next_state, CASE WHEN attempts < 15 THEN 2.0 * power(2, attempts - 1) END AS delay_s FROM items WHERE state = 'retry_wait'")
def retry_schedule(spark, sf):
    return ledger.retry_schedule(ledger.current_items(log(spark, sf)), max_attempts=15)


@query("failure_targets", f"WITH {ITEMS_SQL} SELECT item_key, CASE state WHEN 'verifying_pre' THEN 'pre_verify_failed' WHEN 'verifying_post' THEN 'post_verify_failed' ELSE 'failed' END AS target FROM items")
def failure_targets(spark, sf):
    return ledger.current_items(log(spark, sf)).select("item_key", ledger.failure_target("state").alias("target"))


@query("state_counts", f"WITH {ITEMS_SQL} SELECT state, count(*) AS n FROM items GROUP BY 1")
def state_counts(spark, sf):
    return ledger.state_counts(ledger.current_items(log(spark, sf)))


@query("ledger_overview", f"WITH {ITEMS_SQL} SELECT 'active' AS state_group, count(*) AS n FROM items")
def ledger_overview(spark, sf):
    return ledger.ledger_overview(ledger.current_items(log(spark, sf)))


@query("attempts_histogram", f"WITH {ITEMS_SQL} SELECT attempts, count(*) AS n_items FROM items GROUP BY 1")
def attempts_histogram(spark, sf):
    return folds.attempts_histogram(ledger.current_items(log(spark, sf)))


@query("error_histogram", f"WITH {LOG_SQL} SELECT error_type, count(*) AS n FROM t WHERE run_id = 'run1' AND error_type IS NOT NULL GROUP BY 1")
def error_histogram(spark, sf):
    return folds.error_histogram(log(spark, sf), "run1")


@query("run_report", f"""
WITH {ITEMS_SQL} SELECT 'states' AS section, state AS key, count(*) AS n FROM items GROUP BY 2 UNION ALL SELECT 'attempts', CAST(attempts AS VARCHAR), count(*) FROM items GROUP BY 2
UNION ALL SELECT 'errors', error_type, count(*) FROM t WHERE run_id = 'run2' AND error_type IS NOT NULL GROUP BY 2""")
def run_report(spark, sf):
    return ledger.run_report(log(spark, sf), "run2")


@query("delivery_manifest", """
SELECT doc_id % 97 || ':' || substr(sha256(text), 1, 12) AS item_key, doc_id % 97 AS encounter_id, octet_length(encode(text)) AS size_bytes, 'c' || doc_id || '.pdf' AS fingerprint FROM documents""")
def delivery_manifest(spark, sf):
    d = load(spark, sf, "documents").select((F.col("doc_id") % 97).alias("encounter_id"), F.lit(1).alias("patient_id"), F.concat(F.lit("/out/x/c"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_path"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.octet_length("text").alias("size_bytes"))
    return ledger.manifest(d).select("item_key", "encounter_id", "size_bytes", "fingerprint")


@query("hold_mismatched", """
SELECT o_orderkey AS item_key, o_custkey AS patient_id, true AS run_aborted FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def hold_mismatched(spark, sf):
    items = load(spark, sf, "orders").select(F.col("o_orderkey").alias("item_key"), F.col("o_custkey").alias("patient_id"))
    banner = load(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), (F.col("c_acctbal") >= 0).alias("banner_ok"))
    todo, flag = ledger.hold_mismatched(items, banner)
    return todo.crossJoin(flag.withColumnRenamed("aborted", "run_aborted"))  # the flag is one row


@query("hold_unknown_banner", """
SELECT o_orderkey AS item_key, o_custkey AS patient_id, true AS run_aborted FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 11 <> 0""")
def hold_unknown_banner(spark, sf):
    """Banners that are absent (a seventh) or unknown (an eleventh) hold their patients as wrong ones do."""
    items = load(spark, sf, "orders").select(F.col("o_orderkey").alias("item_key"), F.col("o_custkey").alias("patient_id"))
    banner = load(spark, sf, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("patient_id"), F.when(F.col("c_custkey") % 11 != 0, F.lit(True)).alias("banner_ok"))
    todo, flag = ledger.hold_mismatched(items, banner)
    return todo.crossJoin(flag.withColumnRenamed("aborted", "run_aborted"))  # the flag is one row


@query("next_step_unknown", """
SELECT CAST(o_orderkey AS VARCHAR) AS item_key, CASE WHEN o_orderkey % 10 IN (2, 4) THEN 'pending' WHEN o_custkey % 3 = 0 THEN 'resolving_patient' WHEN o_custkey % 5 = 0 THEN 'verifying_pre'
  WHEN o_custkey % 7 = 0 THEN 'uploading' WHEN o_custkey % 11 = 0 THEN 'verifying_post' ELSE 'completed' END AS next_state, CAST(NULL AS VARCHAR) AS reason FROM orders""")
def next_step_unknown(spark, sf):
    """Each fact in turn is unknown for some items: none of them gets past the step that needs it."""
    e = load(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS item_key", "if(o_orderkey % 2 = 0, 'pending', 'retry_wait') AS state", "0 AS attempts", "if(o_orderkey % 10 = 2, NULL, false) AS skiplisted", "if(o_orderkey % 10 = 4, NULL, true) AS preflight_ok", "'found' AS resolution",
        "if(o_custkey % 3 = 0, NULL, false) AS duplicate", "if(o_custkey % 5 = 0, NULL, true) AS banner_ok", "true AS pre_ok", "if(o_custkey % 7 = 0, NULL, true) AS sent", "if(o_custkey % 11 = 0, NULL, true) AS size_ok", "true AS post_ok")
    return ledger.next_step(e).select("item_key", "next_state", "reason")


@query("privacy_view", "SELECT c_custkey AS item_key, c_nationkey AS state FROM customer")
def privacy_view(spark, sf):
    """A fingerprint is a file name with a name and a date in it, and no list knows of ``nick_name``."""
    c = load(spark, sf, "customer")
    return ledger.privacy_view(c.select(F.col("c_custkey").alias("item_key"), F.col("c_nationkey").alias("state"), F.col("c_name").alias("family_name"), F.col("c_name").alias("fingerprint"), F.col("c_name").alias("nick_name"), F.col("c_name").alias("file_path")))


# Suppliers as destinations, their nation and balance as capability evidence.
REGISTRY = [
    "s_name AS destination", "CASE s_suppkey % 4 WHEN 0 THEN 'fhir_documentreference' WHEN 1 THEN 'vendor_rest' WHEN 2 THEN 'unverified' ELSE 'none' END AS doc_write_api_kind",
    "CASE WHEN s_suppkey % 8 = 0 THEN NULL WHEN s_suppkey % 8 = 1 THEN 'ftp://x' ELSE 'https://example.org/api' END AS doc_write_api_url", "date_add(DATE'2026-01-01', CAST(s_nationkey AS INT)) AS doc_write_api_verified",
    "CASE s_suppkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'none' ELSE 'unverified' END AS ccda_import_kind", "'https://example.org/ccda' AS ccda_import_url", "date_add(DATE'2026-03-01', CAST(s_suppkey % 90 AS INT)) AS ccda_import_verified",
    "CASE WHEN s_suppkey % 5 = 0 THEN 'pack' ELSE 'none' END AS browser_kind", "CAST(NULL AS STRING) AS browser_url", "CAST(NULL AS DATE) AS browser_verified"]


def registry(spark, sf):
    base = load(spark, sf, "supplier").selectExpr(*REGISTRY)
    patched = base.filter("destination LIKE '%7'").withColumn("browser_kind", F.lit("pack"))
    return routes.read_registry(base, patched)


@query("route_choice", """
WITH s AS (SELECT s_name AS destination, s_suppkey % 4 IN (0, 1) AS v1, s_suppkey % 3 = 0 AS v2, s_suppkey % 5 = 0 OR s_name LIKE '%7' AS v3, CASE s_suppkey % 4 WHEN 0 THEN 'fhir_documentreference' WHEN 1 THEN 'vendor_rest' WHEN 2 THEN 'unverified' ELSE 'none' END AS k1,
  CASE s_suppkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'none' ELSE 'unverified' END AS k2 FROM supplier)
SELECT destination, 'vendor_api' AS route, k1 AS kind, v1 AS viable, v1 AS chosen FROM s UNION ALL SELECT destination, 'ccda_import', k2, v2, v2 AND NOT v1 FROM s UNION ALL SELECT destination, 'browser', CASE WHEN v3 THEN 'pack' ELSE 'none' END, v3, v3 AND NOT v1 AND NOT v2 FROM s""")
def route_choice(spark, sf):
    return routes.plan_routes(registry(spark, sf))


@query("evidence_gaps", """
SELECT s_name AS destination, 'doc_write_api' AS capability, CASE s_suppkey % 4 WHEN 0 THEN 'fhir_documentreference' ELSE 'vendor_rest' END AS kind FROM supplier WHERE s_suppkey % 8 IN (0, 1)""")
def evidence_gaps(spark, sf):
    r = registry(spark, sf)
    return routes.evidence_report(r, r.select("destination", F.lit("2026-01-01").cast("date").alias("local_date")))[0]


@query("stale_packs", """
SELECT s_name AS destination, greatest(DATE '2026-01-01' + s_nationkey, DATE '2026-03-01' + CAST(s_suppkey % 90 AS INT)) - DATE '2026-01-01' AS gap_days FROM supplier WHERE greatest(DATE '2026-01-01' + s_nationkey, DATE '2026-03-01' + CAST(s_suppkey % 90 AS INT)) - DATE '2026-01-01' > 90""")
def stale_packs(spark, sf):
    r = registry(spark, sf)
    return routes.evidence_report(r, r.select("destination", F.lit("2026-01-01").cast("date").alias("local_date")))[1].select("destination", "gap_days")


# Lineitems as positioned text spans: the order is the sample, numbers are sizes and places.
SPANS = """l_orderkey % 40 AS sample_index, CAST(l_linenumber % 3 AS INT) AS page_index, concat(CASE WHEN l_quantity <= 40 THEN 'Label ' ELSE 'Value ' END, CASE WHEN l_quantity <= 40 THEN CAST(l_quantity AS INT) ELSE l_partkey END, CASE WHEN l_linenumber % 2 = 0 THEN '  x' ELSE ' x' END) AS text,
 concat('F', l_returnflag) AS font, CAST(8 + l_quantity / 10 AS DOUBLE) AS size, l_linestatus = 'O' AS bold, CAST(36 + l_linenumber * 0.5 + 50 * (l_suppkey % 9) AS DOUBLE) AS x0, CAST(50 + l_linenumber * 10 AS DOUBLE) AS y0,
 CAST(136 + l_linenumber + 50 * (l_suppkey % 9) AS DOUBLE) AS x1, CAST(60 + l_quantity * 10 AS DOUBLE) AS y1, CASE WHEN l_orderkey % 40 < 10 THEN 595.0D ELSE 612.0D END AS page_width, CASE WHEN l_orderkey % 40 < 10 THEN 842.0D ELSE 792.0D END AS page_height"""
SPANS_SQL = """
sp AS (SELECT l_orderkey % 40 AS sample_index, l_linenumber % 3 AS page_index, CASE WHEN l_quantity <= 40 THEN 'Label ' || CAST(l_quantity AS INT) ELSE 'Value ' || l_partkey END || ' x' AS line, 'F' || l_returnflag AS font, 8 + l_quantity / 10 AS size, l_linestatus = 'O' AS bold,
  length(CASE WHEN l_quantity <= 40 THEN 'Label ' || CAST(l_quantity AS INT) ELSE 'Value ' || l_partkey END || CASE WHEN l_linenumber % 2 = 0 THEN '  x' ELSE ' x' END) AS w, 36 + l_linenumber * 0.5 + 50 * (l_suppkey % 9) AS x0, 50 + l_linenumber * 10 AS y0, 136 + l_linenumber + 50 * (l_suppkey % 9) AS x1, 60 + l_quantity * 10 AS y1,
  CASE WHEN l_orderkey % 40 < 10 THEN 595.0 ELSE 612.0 END AS pw, CASE WHEN l_orderkey % 40 < 10 THEN 842.0 ELSE 792.0 END AS ph FROM lineitem)"""


def spans(spark, sf):
    load(spark, sf, "lineitem").createOrReplaceTempView("drv_spans_lineitem")
    return spark.sql(f"SELECT {SPANS} FROM drv_spans_lineitem")


# Sizes step by 0.1 from 8.1; a bucket spans 0.25, so it holds three steps.
@query("type_clusters", f"""
WITH {SPANS_SQL}, b AS (SELECT font, bold, CAST(round((size - 8.1) * 10) AS INT) // 3 AS k, size, w FROM sp)
SELECT font, bold, CAST(round(sum(size * w) / sum(w), 1) AS DOUBLE) AS size, sum(w) AS weight FROM b GROUP BY font, bold, k""")
def type_clusters(spark, sf):
    return layout.type_clusters(spans(spark, sf))


@query("type_scale", f"""
WITH {SPANS_SQL}, b AS (SELECT font, bold, CAST(round((size - 8.1) * 10) AS INT) // 3 AS k, size, w FROM sp),
c AS (SELECT font, bold, CAST(round(sum(size * w) / sum(w), 1) AS DOUBLE) AS size, sum(w) AS weight FROM b GROUP BY font, bold, k), m AS (SELECT font AS bf, size AS bs, bold AS bb FROM c ORDER BY weight DESC, size DESC, font DESC LIMIT 1),
j AS (SELECT *, font = bf AND size = bs AND bold = bb AS isb, NOT (font = bf AND size = bs AND bold = bb) AND (size > bs + 0.25 OR (bold AND NOT (font = bf AND abs(size - bs) <= 0.25))) AS h FROM c, m),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY size DESC, font, bold) AS rn FROM j)
SELECT font, bold, size, weight, CASE WHEN isb THEN 'body' WHEN h THEN 'h' || least(rn, 3) ELSE 'small' END AS role FROM r""")
def type_scale(spark, sf):
    return layout.type_scale(spans(spark, sf))


@query("section_taxonomy", f"""
WITH {SPANS_SQL}, b AS (SELECT font, bold, CAST(round((size - 8.1) * 10) AS INT) // 3 AS k, size, w FROM sp),
c AS (SELECT font, bold, CAST(round(sum(size * w) / sum(w), 1) AS DOUBLE) AS size, sum(w) AS weight FROM b GROUP BY font, bold, k), m AS (SELECT font AS bf, size AS bs, bold AS bb FROM c ORDER BY weight DESC, size DESC, font DESC LIMIT 1),
j AS (SELECT *, font = bf AND size = bs AND bold = bb AS isb, NOT (font = bf AND size = bs AND bold = bb) AND (size > bs + 0.25 OR (bold AND NOT (font = bf AND abs(size - bs) <= 0.25))) AS h FROM c, m),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY size DESC, font, bold) AS rn FROM j),
heads AS (SELECT sp.*, 'h' || least(rn, 3) AS role, round(CAST(y0 AS DOUBLE) / CAST(ph AS DOUBLE), 3) AS y FROM sp JOIN r ON sp.font = r.font AND CAST(sp.size AS DOUBLE) = r.size AND sp.bold = r.bold AND r.h),
n AS (SELECT greatest(CAST(ceil(count(DISTINCT sample_index) * 0.6) AS BIGINT), 1) AS t FROM sp),
lines AS (SELECT line AS text, first(role ORDER BY sample_index, page_index, y0, x0, role) AS role, count(DISTINCT sample_index) AS n_samples_with, round(median(y), 3) AS median_y, bool_and(page_index = 0) AS first_page_only FROM heads GROUP BY 1)
SELECT text, role, n_samples_with, median_y, first_page_only FROM lines, n WHERE n_samples_with >= t""")
def section_taxonomy(spark, sf):
    return layout.section_taxonomy(spans(spark, sf))


@query("static_lines", f"""
WITH {SPANS_SQL}, n AS (SELECT greatest(CAST(ceil(count(DISTINCT sample_index) * 0.6) AS BIGINT), 1) AS t FROM sp), c AS (SELECT line AS text, count(DISTINCT sample_index) AS n FROM sp GROUP BY 1)
SELECT text, c.n FROM c, n WHERE c.n >= t AND text NOT IN ('Label 1 x', 'Label 2 x')""")
def static_lines(spark, sf):
    s = spans(spark, sf)
    headings = s.select(F.explode(F.array(F.lit("Label 1 x"), F.lit("Label 2 x"))).alias("text")).distinct()
    return layout.static_text(s, headings)


@query("running_headers", f"""
WITH {SPANS_SQL}, n AS (SELECT greatest(CAST(ceil(count(DISTINCT sample_index) * 0.6) AS BIGINT), 1) AS t FROM sp), c AS (SELECT line AS text, count(DISTINCT sample_index) AS n FROM sp WHERE y0 / ph <= 0.15 GROUP BY 1)
SELECT text, c.n FROM c, n WHERE c.n >= t""")
def running_headers(spark, sf):
    return layout.page_breaks(spans(spark, sf))[2]


@query("page_breaks", f"""
WITH {SPANS_SQL} SELECT pages, count(*) AS n_samples, (SELECT round(max(y1 / ph), 3) FROM sp) AS max_content_y FROM (SELECT sample_index, max(page_index) + 1 AS pages FROM sp GROUP BY 1) GROUP BY 1""")
def page_breaks(spark, sf):
    pages, lowest, _ = layout.page_breaks(spans(spark, sf))
    return pages.crossJoin(lowest)  # one row: the lowest content position


@query("column_grid", f"""
WITH {SPANS_SQL}, d AS (SELECT x0, (l) AS l, g FROM (SELECT x0, CAST((x0 - 36.5) % 50 / 0.5 AS INT) // 3 AS l, CAST(floor((x0 - 36.5) / 50) AS INT) AS g FROM sp)),
c AS (SELECT CAST(round(avg(x0), 1) AS DOUBLE) AS x0, count(*) AS n FROM d GROUP BY g, l) SELECT x0, n FROM c ORDER BY n DESC, x0 LIMIT 6""")
def column_grid(spark, sf):
    return layout.column_grid(spans(spark, sf))


@query("geometry", f"""
WITH {SPANS_SQL}, p AS (SELECT sample_index, page_index, any_value(pw) AS pw, any_value(ph) AS ph FROM sp GROUP BY 1, 2), m AS (SELECT pw, ph FROM p GROUP BY 1, 2 ORDER BY count(*) DESC, pw * ph DESC, pw DESC LIMIT 1),
q AS (SELECT quantile_cont(x0, 0.05) AS l, quantile_cont(x1, 0.95) AS r, quantile_cont(y0, 0.05) AS t, quantile_cont(y1, 0.95) AS b FROM (SELECT CAST(x0 AS DOUBLE) x0, CAST(x1 AS DOUBLE) x1, CAST(y0 AS DOUBLE) y0, CAST(y1 AS DOUBLE) y1 FROM sp))
SELECT CAST(pw AS DOUBLE) AS width, CAST(ph AS DOUBLE) AS height, greatest(round(l, 1), 0) AS margin_left, greatest(round(CAST(pw AS DOUBLE) - r, 1), 0) AS margin_right, greatest(round(t, 1), 0) AS margin_top, greatest(round(CAST(ph AS DOUBLE) - b, 1), 0) AS margin_bottom FROM m, q""")
def geometry(spark, sf):
    s = spans(spark, sf)
    pages = s.groupBy("sample_index", "page_index").agg(F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"))
    return layout.page_geometry(s, pages)


def rects(spark, sf):
    return load(spark, sf, "orders").selectExpr(
        "CASE o_orderpriority WHEN '1-URGENT' THEN 15856113 WHEN '2-HIGH' THEN 16777215 WHEN '3-MEDIUM' THEN 12303291 WHEN '5-LOW' THEN 1710618 END AS fill_color", "CASE WHEN o_orderstatus = 'P' THEN 1 END AS stroke_color",
        "CAST(o_custkey % 4 * 0.25 AS DOUBLE) AS stroke_width", "CAST(40 + o_custkey % 3 * 100 AS DOUBLE) AS x0", "CAST(560.0 AS DOUBLE) AS x1")


@query("design_tokens", """
SELECT 'fill' AS token, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 15856113 WHEN '2-HIGH' THEN 16777215 WHEN '3-MEDIUM' THEN 12303291 WHEN '5-LOW' THEN 1710618 END AS VARCHAR) AS value, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY 2
UNION ALL SELECT 'stroke', CAST(CAST(o_custkey % 4 * 0.25 AS DOUBLE) AS VARCHAR), NULL FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 4 > 0 GROUP BY 2 UNION ALL SELECT 'band', '#f1f1f1', NULL
UNION ALL SELECT 'gutter', CAST(CAST(40 + k * 100 AS DOUBLE) AS VARCHAR), NULL FROM (SELECT DISTINCT o_custkey % 3 AS k FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED') UNION ALL SELECT 'gutter', '560.0', NULL""")
def design_tokens(spark, sf):
    r = rects(spark, sf)
    none = F.lit(None).cast("bigint").alias("n")
    fill = layout.fill_colors(r).select(F.lit("fill").alias("token"), F.col("fill_color").cast("string").alias("value"), "n")
    stroke = layout.stroke_widths(r).select(F.lit("stroke").alias("token"), F.col("stroke_width").cast("string").alias("value"), none)
    band = layout.heading_band(r).select(F.lit("band").alias("token"), F.col("heading_fill").alias("value"), none)
    gut = layout.gutters(r).select(F.lit("gutter").alias("token"), F.col("x").cast("string").alias("value"), none)
    return fill.unionByName(stroke).unionByName(band).unionByName(gut)


@query("single_sample_guard", """
SELECT source, n_lines, CASE WHEN n_samples > 1 THEN line END AS line FROM (SELECT source, lang AS line, count(*) AS n_lines FROM documents GROUP BY 1, 2), (SELECT count(DISTINCT doc_id) AS n_samples FROM documents)""")
def single_sample_guard(spark, sf):
    d = load(spark, sf, "documents")
    counted = d.groupBy("source", F.col("lang").alias("line")).agg(F.count(F.lit(1)).alias("n_lines"))
    return layout.suppress_single_sample(counted, d.withColumn("sample_index", F.col("doc_id")), ["line"])


@query("label_slots", """
SELECT slot, min(label) AS label FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'dob' WHEN 1 THEN 'provider' WHEN 2 THEN 'patient_name' WHEN 3 THEN 'dos' END AS slot, CASE p_size % 5 WHEN 0 THEN 'Date of Birth ' WHEN 1 THEN 'SEEN BY ' WHEN 2 THEN 'name: ' WHEN 3 THEN 'Visit date ' ELSE 'Agenda ' END || p_name AS label FROM part) WHERE slot IS NOT NULL GROUP BY 1""")
def label_slots(spark, sf):
    text = F.concat(F.expr("CASE p_size % 5 WHEN 0 THEN 'Date of Birth ' WHEN 1 THEN 'SEEN BY ' WHEN 2 THEN 'name: ' WHEN 3 THEN 'Visit date ' ELSE 'Agenda ' END"), "p_name")
    return layout.label_slots(load(spark, sf, "part").select(text.alias("text")))
