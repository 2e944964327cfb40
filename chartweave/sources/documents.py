"""SRC-09. Delivered documents with their size and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Every file of a folder: ``file_path, file_name, sha256, size_bytes``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_path"), F.substring_index("path", "/", -1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def require_files(expected: DataFrame, found: DataFrame, key: str = "file_name") -> DataFrame:
    """``expected`` with size and hash; a missing file ends the job."""
    joined = expected.join(found.select(key, "sha256", "size_bytes"), key, "left")
    gone = F.raise_error(F.concat(F.lit("document is missing: item "), F.xxhash64(key).cast("string"))).cast("string")
    return joined.withColumn("sha256", F.when(F.col("sha256").isNull(), gone).otherwise(F.col("sha256")))
