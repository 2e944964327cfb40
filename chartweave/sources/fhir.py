"""SRC-06. FHIR bundles, NDJSON exports and lone resources as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.functions.references import patient_ref
from chartweave.operators.windows import file_blocks, with_file_order
from chartweave.sources.tsv import path_exists

HEAD = "resourceType string, id string, patient struct<reference:string>, subject struct<reference:string>, beneficiary struct<reference:string>"


def loud_json(df: DataFrame, col: str = "body") -> DataFrame:
    """End the job on text that is not JSON: it must not read as empty."""
    bad = F.raise_error(F.concat(F.lit("malformed JSON in "), F.coalesce("source_file", F.lit("?")))).cast("string")
    return df.withColumn(col, F.when(F.try_parse_json(col).isNull(), bad).otherwise(F.col(col)))


def with_head(df: DataFrame) -> DataFrame:
    """Resource type, id and patient id beside each ``body``."""
    h = F.from_json("body", HEAD)
    df = df.withColumn("_h", h).filter(F.col("_h.resourceType").isNotNull())
    pid = patient_ref(F.col("_h.patient.reference"), F.col("_h.subject.reference"), F.col("_h.beneficiary.reference"))
    return df.select(F.col("_h.resourceType").alias("resource_type"), F.col("_h.id").alias("id"), pid.alias("patient_id"), "body", "source_file", "_ord")


def _files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    statuses = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in statuses if s.getPath().getName().lower().endswith(suffix))


def read_fhir(spark: SparkSession, folder: str) -> DataFrame:
    """Every resource of every file: ``resource_type, id, patient_id, body, source_file, _ord``."""
    if not path_exists(spark, folder):
        raise FileNotFoundError(folder)
    lines, docs = _files(spark, folder, ".ndjson"), _files(spark, folder, ".json")
    scans = {}
    if lines:
        scans["lines"] = spark.read.text(lines)
    if docs:
        scans["docs"] = spark.read.text(docs, wholetext=True)
    if not scans:
        raise ValueError(f"no FHIR files in {folder}")
    # One order over all files, whatever their kind; a row's place in a bundle follows that of its file.
    blocks, pieces = file_blocks(*scans.values()), []
    named = {k: with_file_order(s.select("value", F.col("_metadata.file_name").alias("source_file"), "_metadata"), blocks).drop("_metadata") for k, s in scans.items()}
    if lines:
        pieces.append(named["lines"].select("source_file", F.trim("value").alias("body"), "_ord").filter(F.col("body") != ""))
    if docs:
        raw = loud_json(named["docs"].withColumnRenamed("value", "body").filter(F.col("body").contains('"resourceType"')))
        parsed = F.from_json("body", "resourceType string, entry array<struct<resource:string>>")
        raw = raw.withColumn("_b", parsed)
        many = F.transform(F.coalesce("_b.entry", F.array().cast("array<struct<resource:string>>")), lambda e: e["resource"])
        parts = F.when(F.col("_b.resourceType") == "Bundle", many).otherwise(F.array("body"))
        exploded = raw.select("source_file", F.col("_ord").alias("_file"), F.posexplode(parts).alias("_pos", "body"))
        pieces.append(exploded.filter(F.col("body").isNotNull()).select("source_file", "body", (F.col("_file") + F.col("_pos")).alias("_ord")))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return with_head(loud_json(out))
