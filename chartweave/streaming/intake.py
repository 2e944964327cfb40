"""ST-04. New export files to raw and canonical rows, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartweave.operators.windows import with_source_order
from chartweave.streaming.store import land


def stream_tsv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A stream of TSV files read as SRC-01 reads them: quoted cells may hold tabs, quotes and, with ``multi_line``, line ends.

    A file is then read by one task; turn it off where no cell spans lines.
    """
    reader = spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line).option("nullValue", "\u0000").option("maxCharsPerColumn", -1).option("encoding", "UTF-8")
    return reader.csv(path).withColumn("_src", F.col("_metadata.file_name"))


def stream_intake(
    spark: SparkSession, path: str, schema: str, out: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None, key: str | None = None, good: Column | None = None, multi_line: bool = True,
) -> StreamingQuery:
    """Read TSV files that appeared since the last run and add them to ``out``.

    Without a transform the raw rows go to ``out``. With one, raw rows go to ``out/raw`` and
    canonical ones to ``out/accepted``, once for each ``key``, or to ``out/refused`` where
    ``good`` doesn't hold. The checkpoint remembers the files. A batch that is repeated after
    a failure replaces its own folders, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = f"{out}/raw/batch_id={batch_id}" if transform else f"{out}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(raw)
        if transform:
            canonical = transform(with_source_order(batch.sparkSession.read.schema(batch.schema).parquet(raw)))
            land(canonical, out, batch_id, key or canonical.columns[0], F.lit(True) if good is None else good)

    return stream_tsv(spark, path, schema, multi_line).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
