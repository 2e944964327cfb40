"""Session helpers.

Nothing here overrides what a cluster already sets: the checkpoint folder, the
shuffle width and the time zone are only filled in when they are unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "chartweave", cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the local bench."""
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config(CHECKPOINT_CONF, os.path.join(scratch, "checkpoints"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A cluster must name one that driver and executors share; only a local
    session without the setting gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the staging folder and read it back.

    Later readers take only the columns and rows they need of it.
    """
    path = f"{staging_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
