"""SNK-06, SNK-08, SNK-09, SNK-10. Reports, idempotent writes and delivery."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from chartweave.operators.folds import document_verdict, observe_stage, qa_summary
from chartweave.plans.ledger import privacy_view
from chartweave.sources.tsv import path_exists

DELIVERY_ORDER = ("archive", "bundle", "ccda")


def qa_report(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-06. (summary row, one row per document, check and finding)."""
    verdicts = document_verdict(results, ["doc_id"])
    return qa_summary(verdicts), results.join(verdicts.withColumnRenamed("verdict", "document_verdict"), "doc_id")


def write_qa_report(results: DataFrame, out: str) -> None:
    """SNK-06. Summary and details as JSON."""
    summary, details = qa_report(results)
    summary.write.mode("overwrite").json(f"{out}/summary")
    details.write.mode("overwrite").json(f"{out}/details")


def write_run_report(report: DataFrame, out: str) -> None:
    """SNK-08. A run report without any private column."""
    privacy_view(report).coalesce(1).write.mode("overwrite").json(out)


def write_missing(df: DataFrame, out: str, key: str, force: bool = False, partition_by: Sequence[str] = ()) -> None:
    """SNK-09. Append only rows whose key is not written yet; ``force`` replaces.

    Re-running after a lost job adds what is missing and nothing twice. With
    ``force`` and partitions, only the partitions that occur are replaced.
    """
    spark = df.sparkSession
    writer_mode = "append"
    if force:
        writer_mode = "overwrite"
    elif path_exists(spark, out):
        done = spark.read.parquet(out).select(key).distinct()
        df = df.join(done, key, "left_anti")
    writer = df.write.mode(writer_mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(out)


def deliver(outputs: Mapping[str, tuple[DataFrame, Callable[[DataFrame], None]]]) -> dict[str, int]:
    """SNK-10. Run the chosen deliveries in their fixed order; rows per kind."""
    unknown = set(outputs) - set(DELIVERY_ORDER)
    if unknown:
        raise ValueError(f"unknown deliveries: {', '.join(sorted(unknown))}")
    counts = {}
    for kind in DELIVERY_ORDER:
        if kind in outputs:
            df, write = outputs[kind]
            watched, seen = observe_stage(df, kind)
            write(watched)
            counts[kind] = seen.get["rows"]
    return counts


__all__ = ["DELIVERY_ORDER", "deliver", "qa_report", "write_missing", "write_qa_report", "write_run_report"]
