"""SRC-08. Which format an export folder has: exactly one rule must hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.plans.ccda_mapping import map_ccda
from chartweave.plans.dump_mapping import map_dump_export
from chartweave.plans.fhir_mapping import map_fhir
from chartweave.plans.tsv_mapping import map_export
from chartweave.sources.ccda import NAMESPACE, read_ccda
from chartweave.sources.fhir import read_fhir
from chartweave.sources.sqldump import read_dump_export
from chartweave.sources.tsv import path_exists, read_tsv_export


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Full paths of the entries of a folder (names only, no content)."""
    if not path_exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def _any_text(spark: SparkSession, files: list[str], *markers: str) -> bool:
    """Whether any file holds every marker; stops at the first that does."""
    if not files:
        return False
    hit = F.lit(True)
    for m in markers:
        hit = hit & F.contains("value", F.lit(m))
    return not spark.read.text(files, wholetext=True).filter(hit).limit(1).isEmpty()


def is_tsv(spark: SparkSession, folder: str) -> bool:
    base = folder.rstrip("/")
    return all(path_exists(spark, f"{base}/{name}.tsv") for name in ("patient-demographics", "patient-encounters"))


def is_dump(spark: SparkSession, folder: str) -> bool:
    base = f"{folder.rstrip('/')}/v500"
    schemas = [n.rsplit("/", 1)[-1] for n in _names(spark, f"{base}/schema")]
    described = any(n.startswith("V500TableSchema") and n.endswith(".sql") for n in schemas)
    return described and (path_exists(spark, f"{base}/activity") or path_exists(spark, f"{base}/reference"))


def is_ccda(spark: SparkSession, folder: str) -> bool:
    return _any_text(spark, [n for n in _names(spark, folder) if n.endswith(".xml")], "ClinicalDocument", NAMESPACE)


def is_fhir(spark: SparkSession, folder: str) -> bool:
    names = _names(spark, folder)
    if _any_text(spark, [n for n in names if n.endswith(".json")], '"resourceType"', '"Bundle"'):
        return True
    lines = [n for n in names if n.endswith(".ndjson")]
    return bool(lines) and not spark.read.text(lines).filter(F.contains("value", F.lit('"resourceType"'))).limit(1).isEmpty()


# Format name to (rule, loader of canonical tables).
FORMATS: dict[str, tuple[Callable[[SparkSession, str], bool], Callable[[SparkSession, str], dict[str, DataFrame]]]] = {
    "tsv": (is_tsv, lambda spark, path: map_export(read_tsv_export(spark, path))),
    "dump": (is_dump, lambda spark, path: map_dump_export(read_dump_export(spark, path))),
    "ccda": (is_ccda, lambda spark, path: map_ccda(read_ccda(spark, path))),
    "fhir": (is_fhir, lambda spark, path: map_fhir(read_fhir(spark, path))),
}


def detect_format(spark: SparkSession, path: str) -> str | None:
    """The one format whose rule holds, or None when none or several do."""
    hits = [name for name, (rule, _) in FORMATS.items() if rule(spark, path)]
    return hits[0] if len(hits) == 1 else None


def load_export(spark: SparkSession, path: str, source: str | None = None) -> dict[str, DataFrame]:
    """Canonical tables of an export folder; an unknown format is an error."""
    name = source or detect_format(spark, path)
    if name not in FORMATS:
        raise ValueError(f"unknown export format at {path}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[name][1](spark, path)
