"""Folds: status resolution, derived values, ordered text, counts.

Every fold is an aggregate with map-side partial results. The two that must
return ordered lists (text, children) return bounded pages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chartweave.functions.codes import (
    SCRIPT_LABELS, STATUS_PRIORITY, VITAL_KIND_BY_CODE, bmi_metric, lookup, to_cm, to_kg,
)
from chartweave.functions.dates import parse_dt
from chartweave.functions.text import blank_to_null, clean_cell
from chartweave.operators.windows import block_scan, order_block

PRACTICE_ZONE = "America/New_York"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def script_prefix(destination: Column | str) -> Column:
    """AGG-03. Paper and print destinations are SCRIPT, the rest ESCRIPT."""
    d = F.lower(F.coalesce(_c(destination), F.lit("")))
    return F.when(d.contains("paper") | d.contains("print"), "SCRIPT").otherwise("ESCRIPT")


def resolve_status(
    tx: DataFrame, key: str = "prescription_id", label_map: Sequence[tuple[str, str, str, int]] = SCRIPT_LABELS,
    status_priority: Mapping[str, int] = STATUS_PRIORITY,
) -> DataFrame:
    """AGG-01/02/03. One status per key from its transitions.

    ``tx`` has ``description``, ``kind``, ``at`` and ``_ord``. The label of the
    highest priority wins, ties go to the earliest. Without a known
    description the status word decides, and failing that the last word.
    Also gives the label's prefix and the first "order sent" instant.
    """
    desc = F.lower(F.trim(F.coalesce("description", F.lit(""))))
    labels = {d: label for d, _, label, _ in label_map}
    prefixes = {d: prefix for d, prefix, _, _ in label_map}
    priorities = {d: p for d, _, _, p in label_map}
    word = F.trim(F.coalesce("kind", F.lit("")))
    position = [F.col("at").isNull().alias("no_time"), F.col("at").alias("at"), F.col("_ord").alias("ord")]
    rows = tx.select(
        key, "at", F.struct(*position).alias("_pos"),
        lookup(labels, desc).alias("_label"), lookup(prefixes, desc).alias("_prefix"),
        lookup(priorities, desc).alias("_pri"),
        word.alias("_word"), lookup(dict(status_priority), F.lower(word)).alias("_rank"), desc.alias("_desc"),
    )
    best = F.when(F.col("_pri").isNotNull(), F.struct((-F.col("_pri")).alias("p"), F.col("_pos").alias("o")))
    worded = F.when(F.col("_rank").isNotNull(), F.struct((-F.col("_rank")).alias("p"), F.col("_pos").alias("o")))
    agg = rows.groupBy(key).agg(
        F.min_by(F.struct("_label", "_prefix"), best).alias("_best"),
        F.min_by("_word", worded).alias("_known"),
        F.max_by("_word", "_pos").alias("_last"),
        F.min(F.when(F.col("_desc") == "order sent", F.col("at"))).alias("order_sent_at"),
    )
    fallback = F.upper(blank_to_null(F.coalesce("_known", "_last")))
    return agg.select(
        key, F.coalesce("_best._label", fallback).alias("status_label"), F.col("_best._prefix").alias("label_prefix"), "order_sent_at"
    )


def display_date(prefix: Column | str, order_sent_at: Column | str, service_at: Column | str) -> Column:
    """AGG-03. First "order sent" instant of an ESCRIPT, else the date of service."""
    return F.when(_c(prefix) == "ESCRIPT", F.coalesce(_c(order_sent_at), _c(service_at))).otherwise(_c(service_at))


def derive_bmi(obs: DataFrame, kept: DataFrame) -> DataFrame:
    """AGG-04. BMI rows for kept encounters with height and weight but no BMI.

    The last value of a code wins; the main code wins over an alias.
    """
    kind = lookup(VITAL_KIND_BY_CODE, "code")

    def last_of(code: str) -> Column:
        row = F.struct("patient_id", "value", "unit", "effective_at")
        return F.max_by(row, F.when(F.col("code") == code, F.col("_ord")))

    wanted = obs.filter(F.col("encounter_id").isNotNull() & kind.isin("height", "weight", "bmi"))
    agg = wanted.groupBy("encounter_id").agg(
        last_of("8302-2").alias("_h"), last_of("3141-9").alias("_w1"), last_of("29463-7").alias("_w2"),
        F.max(F.col("code") == "39156-5").alias("_has_bmi"), F.max("_ord").alias("_ord"),
    )
    agg = agg.filter("NOT _has_bmi").withColumn("_w", F.coalesce("_w1", "_w2"))
    agg = agg.join(kept.select("encounter_id").distinct(), "encounter_id", "left_semi")
    height = to_cm(F.col("_h.value").try_cast("double"), F.col("_h.unit"))
    weight = to_kg(F.col("_w.value").try_cast("double"), F.col("_w.unit"))
    out = agg.withColumn("_bmi", bmi_metric(weight, height)).filter(F.col("_bmi").isNotNull())
    return out.select(
        F.col("_w.patient_id").alias("patient_id"), "encounter_id", F.lit("vital-signs").alias("category"),
        F.lit("39156-5").alias("code"), F.lit("Body mass index (BMI) [Ratio]").alias("display"),
        F.format_string("%.2f", "_bmi").alias("value"), F.lit("kg/m2").alias("unit"),
        F.col("_w.effective_at").alias("effective_at"), "_ord",
    )


def paged_concat(
    df: DataFrame, keys: Sequence[str], text: Column, order: Sequence[Column | str] = ("_ord",),
    block: Column | None = None, separator: str = "\n", page_rows: int = 1000, out: str = "text",
) -> DataFrame:
    """AGG-05/07. Text of a key in order, in parts of at most ``page_rows`` lines."""
    block = order_block(order[-1]) if block is None else block
    lines = df.withColumn("_t", text).filter(F.col("_t").isNotNull() & (F.col("_t") != ""))
    numbered = block_scan(lines, keys, order, block, {"_rn": ("row_number", None)})
    numbered = numbered.withColumn("page", F.floor((F.col("_rn") - 1) / page_rows).cast("bigint"))
    parts = numbered.groupBy(*keys, "page").agg(F.sort_array(F.collect_list(F.struct("_rn", "_t"))).alias("_l"))
    return parts.select(*keys, "page", F.array_join(F.col("_l._t"), separator).alias(out))


def assemble_blobs(blob: DataFrame, page_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """AGG-07. (text per event in sequence order, parts kept undecoded).

    A part with a compression code is never guessed at: it is returned as is.
    """
    seq = F.coalesce(clean_cell("BLOB_SEQ_NUM").try_cast("double"), F.lit(0.0))
    rows = blob.withColumn("EVENT_ID", clean_cell("EVENT_ID")).withColumn("_seq", seq)
    plain = clean_cell("COMPRESSION_CD").isNull()
    text = paged_concat(
        rows.filter(plain), ["EVENT_ID"], clean_cell("BLOB_CONTENTS"), ["_seq", "_ord"],
        F.floor(F.col("_seq") / 4096).cast("bigint"), "\n", page_rows, "body",
    )
    return text, rows.filter(~plain).drop("_seq")


# Table, value column and label of each social-history row.
SOCIAL_TABLES = (
    ("patient-smokingstatus", "TobaccoUseDescription", "Tobacco use"),
    ("occupation-industry", "Occupation", "Occupation"),
    ("occupation-industry", "IndustryName", "Industry"),
    ("patient-education", "EducationLevel", "Education"),
    ("patient-financial-resources", "FinancialResource", "Financial resources"),
    ("tribal-affiliation", "TribalAffiliation", "Tribal affiliation"),
)


def social_history(
    tables: Mapping[str, DataFrame], key: str = "PatientPracticeGuid",
    rules: Sequence[tuple[str, str, str]] = SOCIAL_TABLES, extra=None,
) -> DataFrame:
    """AGG-06. The six (table, column, label) rules as one long table.

    ``extra(df, table, value_column)`` may add columns to each piece.
    """
    out = None
    for name, value_col, label in rules:
        df = tables.get(name)
        if df is None or value_col not in df.columns:
            continue
        dates = [parse_dt(clean_cell(c)) for c in ("EffectiveDate", "EffectiveDateFrom") if c in df.columns]
        piece = df.select(
            clean_cell(key).alias("patient_id"), F.lit("social-history").alias("category"), F.lit(label).alias("display"),
            clean_cell(value_col).alias("value"),
            (F.coalesce(*dates) if dates else F.lit(None).cast("timestamp")).alias("effective_at"),
            F.lit(name).alias("source_table"), "_ord", *(extra(df, name, value_col) if extra else []),
        ).filter(F.col("value").isNotNull() & F.col("patient_id").isNotNull())
        out = piece if out is None else out.unionByName(piece)
    return out


def distinct_in_order(df: DataFrame, key: str, value: Column, order: str = "_ord", out: str = "names") -> DataFrame:
    """AGG-18. Distinct values of a coded vocabulary per key, by first use.

    Repeats collapse in a partial aggregate first, so the list is bounded by
    the vocabulary and not by the rows.
    """
    firsts = df.select(key, value.alias("_v"), order).filter(F.col("_v").isNotNull()).groupBy(key, "_v").agg(F.min(order).alias("_o"))
    lists = firsts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_o", "_v"))).alias("_l"))
    return lists.select(key, F.col("_l._v").alias(out))


def patient_summary(encounters: DataFrame, documents: DataFrame, patients: DataFrame) -> DataFrame:
    """AGG-09. Encounter and document counts per patient, zero included."""
    e = encounters.groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounter_count"))
    d = documents.groupBy("patient_id").agg(F.count(F.lit(1)).alias("document_count"))
    out = patients.join(e, "patient_id", "left").join(d, "patient_id", "left")
    return out.fillna(0, ["encounter_count", "document_count"])


VERDICT_RANK = {"pass": 0, "warn": 1, "fail": 2}


def document_verdict(results: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """AGG-10. Worst verdict per document; no result counts as pass."""
    rank = F.max(F.coalesce(lookup(VERDICT_RANK, "verdict"), F.lit(0)))
    agg = results.groupBy(*keys).agg(rank.alias("_r"))
    names = F.array(F.lit("pass"), F.lit("warn"), F.lit("fail"))
    return agg.select(*keys, F.element_at(names, F.col("_r") + 1).alias("verdict"))


def qa_summary(documents: DataFrame) -> DataFrame:
    """AGG-11. Counts per verdict and the overall flag."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICT_RANK],
        F.coalesce(F.bool_and(F.col("verdict") != "fail"), F.lit(True)).alias("ok"),
    )


def attempts_histogram(items: DataFrame) -> DataFrame:
    """AGG-13. Items per attempt count."""
    return items.groupBy("attempts").agg(F.count(F.lit(1)).alias("n_items"))


def error_histogram(transitions: DataFrame, run_id: str | None = None) -> DataFrame:
    """AGG-14. Transitions per error type, for one run or all."""
    rows = transitions.filter(F.col("error_type").isNotNull())
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    return rows.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def observe_stage(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """AGG-16. The same rows, with a row count collected as they pass."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def archive_totals(patients: DataFrame, encounters: DataFrame, documents: DataFrame) -> DataFrame:
    """AGG-17. Patients, encounters and documents, as one row."""
    def tally(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    rows = tally(patients, "patients").unionByName(tally(encounters, "encounters")).unionByName(tally(documents, "documents"))
    return rows.agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("patients", "encounters", "documents")])
