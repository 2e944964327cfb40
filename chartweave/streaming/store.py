"""What streams write: an item table in buckets, and folders of accepted and refused rows.

A micro-batch may run again after a failure. Everything here gives the same result then:
folders are named by the batch and replaced, and the item table keeps the row of the
highest order, whichever batch brings it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.sources.tsv import path_exists

#: Parts of a stored table by hash of its key. Fix it for the life of a table, at some 100 MB a bucket of its final size.
BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, on any file system Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def upsert(batch: DataFrame, table: str, batch_id: int, key: str, order: str, buckets: int = BUCKETS, name: str = "") -> None:
    """Put a batch's rows into ``table``: of each key the row with the highest ``order`` stays, of equal ones the batch's.

    Only the buckets that the batch touches are read and replaced. Their new content is first
    written whole to a folder named by ``name`` and the batch; if the job is lost while it
    replaces buckets, the batch's next run takes that folder, so no row is lost with the
    bucket it was in. Afterwards the folder is removed, and with it the last copy of what was
    replaced. Batch 0 starts the table; a later one without a table is an error. Rows
    without a key are left out.
    """
    spark, data = batch.sparkSession, f"{table}/items"
    staged = f"{table}/staged/{name}{batch_id}"
    if batch_id > 0 and not path_exists(spark, table):
        raise FileNotFoundError(f"{table}: the item table is missing")
    if not path_exists(spark, f"{staged}/_SUCCESS"):
        rows = batch.filter(F.col(key).isNotNull()).withColumns({"bucket": bucket_of(key, buckets), "fresh": F.lit(1)})
        touched = _touched(rows)
        if path_exists(spark, data) and touched:
            stored = spark.read.schema(rows.drop("fresh").schema).parquet(data)
            rows = rows.unionByName(stored.filter(F.col("bucket").isin(touched)).withColumn("fresh", F.lit(0)))
        rest = [c for c in batch.columns if c != key]
        latest = rows.groupBy(key, "bucket").agg(F.max_by(F.struct(*rest), F.struct(order, "fresh")).alias("r")).select(key, "r.*", "bucket")
        latest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    ready = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(staged)
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(data)
    remove_path(spark, f"{table}/staged")


def read_items(spark: SparkSession, table: str) -> DataFrame:
    """The item table as it stands."""
    return spark.read.parquet(f"{table}/items").drop("bucket")


def land(batch: DataFrame, out: str, batch_id: int, key: str, good: Column, buckets: int = BUCKETS) -> None:
    """SET-05 at the sink: new rows to ``accepted``, rows that fail ``good`` or lack a key to ``refused``.

    A key that an earlier batch accepted is not accepted again, however late it is re-sent;
    only the buckets that the batch touches are looked at. Of several rows of a key one is
    taken. Both folders have a part for each batch, which a repeated run replaces.
    """
    spark, accepted = batch.sparkSession, f"{out}/accepted"
    ok = F.coalesce(good & F.col(key).isNotNull(), F.lit(False))
    rows = batch.filter(ok).dropDuplicates([key]).withColumn("bucket", bucket_of(key, buckets))
    if path_exists(spark, accepted):
        known = spark.read.parquet(accepted).filter((F.col("batch_id") != batch_id) & F.col("bucket").isin(_touched(rows)))
        rows = rows.join(known.select(key), key, "left_anti")
    for name, part in (("accepted", rows), ("refused", batch.filter(~ok))):
        writer = part.write.mode("overwrite")
        (writer.partitionBy("bucket") if name == "accepted" else writer).parquet(f"{out}/{name}/batch_id={batch_id}")


def read_landed(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) rows of all batches so far."""
    accepted = spark.read.parquet(f"{out}/accepted").drop("bucket", "batch_id")
    return accepted, spark.read.parquet(f"{out}/refused").drop("batch_id")
