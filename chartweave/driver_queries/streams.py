"""Streams over the driver tables: each query sends a table in parts, out of order, and lets streams take them in."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from chartweave.driver_queries.base import load, query
from chartweave.driver_queries.delivery import LOG_SQL, log
from chartweave.plans.tsv_mapping import map_practitioners
from chartweave.session import staging_folder
from chartweave.streaming import intake, ledger, store

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stateful(spark):
    """The state provider that the ledger's stream needs, for the time of a query."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ledger.STATE_PROVIDER)
    try:
        yield f"{staging_folder(spark)}/stream-{uuid.uuid4().hex}"
    finally:
        spark.conf.set(_PROVIDER, before)


# Each day's transitions come with a day's delay for one item in three; every 97th has lost its number.
SENDS = 3


@query("live_ledger", f"""
WITH {LOG_SQL}, good AS (SELECT * FROM t WHERE seq % 97 <> 5),
p AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY item_key ORDER BY seq), 'pending') AS previous FROM good),
w AS (SELECT *, coalesce(error_type, '') <> 'CrashRecovery' AND NOT (
  (previous = 'pending' AND to_state = 'resolving_patient') OR (previous = 'resolving_patient' AND to_state IN ('verifying_pre', 'retry_wait')) OR (previous = 'verifying_pre' AND to_state IN ('uploading', 'retry_wait'))
  OR (previous = 'uploading' AND to_state IN ('verifying_post', 'retry_wait')) OR (previous = 'retry_wait' AND to_state = 'resolving_patient') OR (previous = 'verifying_post' AND to_state = 'retry_wait')) AS wrong FROM p),
items AS (SELECT CAST(item_key AS VARCHAR) AS item_key, arg_max(to_state, seq) AS state, CAST(count(*) FILTER (to_state = 'retry_wait') AS INT) AS attempts, arg_max(error_type, seq) FILTER (error_type IS NOT NULL) AS last_error_type, arg_max(doc, seq) FILTER (doc IS NOT NULL) AS destination_doc_id, CAST(count(*) FILTER (wrong) AS INT) AS illegal FROM w GROUP BY 1),
bad AS (SELECT CAST(item_key AS VARCHAR) AS item_key, count(*) AS n_unreadable FROM t WHERE seq % 97 = 5 GROUP BY 1)
SELECT item_key, state, attempts, last_error_type, destination_doc_id, illegal, coalesce(n_unreadable, 0) AS n_unreadable, 0 AS n_late FROM items FULL JOIN bad USING (item_key)""")
def live_ledger(spark, sf):
    """ST-01/05: the log in three sends that overlap in time; items wait for late transitions for half of its time."""
    rows = log(spark, sf).withColumn("at", F.col("at").cast("timestamp"))
    span = rows.agg(F.min(F.unix_millis("at")).alias("low"), F.max(F.unix_millis("at")).alias("high")).first()
    length = max((span.high or 0) - (span.low or 0), 1)
    # A transition's send is its third of the time, or the one after it for some items; some are sent twice.
    third = F.floor((F.unix_millis("at") - F.lit(span.low or 0)) * SENDS / (length + 1)).cast("int")
    sent = F.least(third + F.when(F.col("seq") % 3 == 0, 1).otherwise(0), F.lit(SENDS - 1))
    again = F.when(F.col("seq") % 10 == 0, F.least(sent + 1, F.lit(SENDS - 1)))
    sends = rows.withColumn("seq", F.when(F.col("seq") % 97 != 5, F.col("seq"))).withColumn("send", F.explode(F.array_compact(F.array_distinct(F.array(sent, again)))))
    # A transition without a number can't be told from its copy, so it is sent once.
    sends = sends.filter(F.col("seq").isNotNull() | (F.col("send") == sent))
    with stateful(spark) as folder:
        for i in range(SENDS):
            sends.filter(F.col("send") == i).drop("send").write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(sends.drop("send").schema).parquet(f"{folder}/in")
            ledger.stream_state_counts(stream, f"{folder}/items", f"{folder}/checkpoint", open_for_s=2 * length / 1000, buckets=8).awaitTermination()
    bad = ledger.aside(spark, f"{folder}/items").groupBy("item_key").agg(F.count_if(F.col("kind") == "unreadable").alias("n_unreadable"), F.count_if(F.col("kind") == "late").alias("n_late"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    items = store.read_items(spark, f"{folder}/items").select("item_key", "state", "attempts", "last_error_type", "destination_doc_id", "illegal")
    return items.join(bad, "item_key", "full").select(*items.columns, zero("n_unreadable"), zero("n_late").cast("int").alias("n_late"))


@query("live_enqueue", """
SELECT 'accepted' AS fate, 'o-' || o_orderkey AS item_key, count(*) AS n FROM orders WHERE o_orderkey % 31 <> 7 GROUP BY 2
UNION ALL SELECT 'refused', NULL, count(*) FROM orders WHERE o_orderkey % 31 = 7 HAVING count(*) > 0""")
def live_enqueue(spark, sf):
    """ST-02: orders as items, a fifth of them sent again at once and a fifth far beyond the delay; items without a key are refused."""
    o = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 31 != 7, F.concat(F.lit("o-"), F.col("o_orderkey").cast("string"))).alias("item_key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("o_orderkey") % 600).alias("at"))
    keyed = o.filter(F.col("item_key").isNotNull())
    late = keyed.filter(F.col("o_orderkey") % 5 == 1).withColumn("at", F.col("at") + F.expr("INTERVAL 3 DAYS"))
    sends = [o.unionByName(keyed.filter(F.col("o_orderkey") % 5 == 0)), late, late.filter(F.col("o_orderkey") % 10 == 1)]
    with stateful(spark) as folder:
        for part in sends:
            part.drop("o_orderkey").write.mode("append").parquet(f"{folder}/in")
            ledger.enqueue_new(spark.readStream.schema("item_key string, at timestamp").parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    accepted, refused = store.read_landed(spark, f"{folder}/out")
    count = F.count(F.lit(1)).alias("n")
    return accepted.groupBy("item_key").agg(count).select(F.lit("accepted").alias("fate"), "item_key", "n").unionByName(refused.groupBy("item_key").agg(count).select(F.lit("refused").alias("fate"), "item_key", "n"))


@query("live_intake", """
SELECT 'accepted' AS fate, 's-' || p_partkey AS practitioner_id, 'Dr ' || p_name || CASE WHEN p_partkey % 9 = 0 THEN chr(10) || '"quoted" tab' || chr(9) || 'end' ELSE '' END AS name, count(*) AS n FROM part WHERE p_partkey % 50 <> 9 GROUP BY 2, 3
UNION ALL SELECT 'refused', '', 'Dr ' || p_name || CASE WHEN p_partkey % 9 = 0 THEN chr(10) || '"quoted" tab' || chr(9) || 'end' ELSE '' END, count(*) FROM part WHERE p_partkey % 50 = 9 GROUP BY 3""")
def live_intake(spark, sf):
    """ST-04: parts as provider files in two sends; a tenth comes again, changed, and is told by its key."""
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit('\n"quoted" tab\tend'))).otherwise(F.col("p_name"))
    p = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 == 9, "\\N").otherwise(F.concat(F.lit("s-"), F.col("p_partkey").cast("string"))).alias("ProviderGuid"), F.lit("Dr").alias("FirstName"), name.alias("LastName"))
    again = p.filter((F.col("p_partkey") % 10 == 0) & (F.col("p_partkey") % 2 == 0)).withColumn("LastName", F.lit("Changed"))
    sends = [p.filter(F.col("p_partkey") % 2 == 0), p.filter(F.col("p_partkey") % 2 == 1).unionByName(again)]
    with stateful(spark) as folder:
        for part in sends:
            part.drop("p_partkey").write.mode("append").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/in")
            intake.stream_intake(spark, f"{folder}/in", "ProviderGuid string, FirstName string, LastName string", f"{folder}/out", f"{folder}/checkpoint", map_practitioners, "practitioner_id", F.col("practitioner_id") != "").awaitTermination()
    both = zip(("accepted", "refused"), store.read_landed(spark, f"{folder}/out"), strict=True)
    accepted, refused = (df.groupBy("practitioner_id", "name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(fate).alias("fate"), "practitioner_id", "name", "n") for fate, df in both)
    return accepted.unionByName(refused)
