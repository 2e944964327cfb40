"""SNK-01, SNK-07. Per-patient FHIR bundles and QA slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators.joins import PAGE_ROWS, paged_collect
from chartweave.operators.windows import order_block
from chartweave.plans.fhir_exchange import BASE


def bundles(resources: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """SNK-01. ``patient_id, page, bundle``: collection bundles as JSON text.

    A patient has one bundle; a patient with very many resources has several
    pages, each a valid bundle, so no task holds an unbounded one.
    """
    entry = F.concat(F.lit(f'{{"fullUrl":"{BASE}:'), F.col("id"), F.lit('","resource":'), F.col("body"), F.lit("}"))
    keyed = resources.filter(F.col("patient_id").isNotNull())
    pages = paged_collect(keyed, ["patient_id"], entry, ["resource_type", "_ord", "id"], F.struct("resource_type", order_block("_ord")), page_rows, "entries")
    text = F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join("entries", ","), F.lit("]}"))
    return pages.select("patient_id", "page", F.size("entries").alias("n_entries"), text.alias("bundle"))


def write_bundles(resources: DataFrame, out: str, page_rows: int = PAGE_ROWS) -> None:
    """Bundles as one JSON document per line, spread over files by patient."""
    rows = bundles(resources, page_rows)
    rows.repartition("patient_id").sortWithinPartitions("patient_id", "page").write.mode("overwrite").json(out)


def qa_slices(results: DataFrame, docs: DataFrame, patients: DataFrame) -> DataFrame:
    """SNK-07. Verdict counts of each patient's own documents; empty slices stay.

    ``results`` has ``doc_id, verdict``; ``docs`` has ``doc_id, patient_id``.
    """
    mine = docs.join(results, "doc_id").groupBy("patient_id").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "warn", "fail")])
    out = patients.select("patient_id").join(mine, "patient_id", "left")
    return out.fillna(0, ["n_pass", "n_warn", "n_fail"])
