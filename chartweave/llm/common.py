"""What the text operators share: table loading, stages on shared storage, word tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as ``spark.checkpoint.dir`` names it.

    A cluster must name one. Only a local session without the setting (a unit test) gets a
    temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str = "stage", narrow: bool = True) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    It cuts the lineage, survives lost executors, and a reader still prunes columns.
    ``narrow`` rows are first dealt to as many files as the session has cores: small results
    of many tasks don't become many small files. Wide rows (texts) are written where they are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    out = df.repartition(spark.sparkContext.defaultParallelism) if narrow else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each followed by as many underscores as no column of ``df`` has after it."""
    taken = {c.lower() for c in df.columns}
    end = ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def spread_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows evenly when a scan has fewer splits than the session has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *cols)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in pieces of ``rows``, so that a worker turns few texts at once into Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def byte_table(keep: str) -> bytes:
    """A ``bytes.translate`` table that lower-cases A-Z and turns separators into spaces.

    ``keep="text"``: separators are space and 0x09-0x0D. ``keep="alnum"``: everything
    below 0x80 but digits and letters separates.
    """
    out = bytearray(range(256))
    for c in range(256):
        if 65 <= c <= 90:
            out[c] = c + 32
        elif c == 32 or 9 <= c <= 13 or (keep == "alnum" and c < 128 and not (48 <= c <= 57 or 97 <= c <= 122)):
            out[c] = 32
    return bytes(out)


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit name of a row by id and text; rows that repeat share it, and a null is told from ''."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull())
