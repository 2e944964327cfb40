"""Delivery ledger as tables (LG-01..10, AGG-12/15, SNK-08).

``transitions`` is the only written truth: ``seq, item_key, run_id, from_state,
to_state, error_type, destination_doc_id, at``. Everything else is a fold of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.codes import lookup
from chartweave.operators.windows import block_scan, order_block

# States, legal moves, recovery targets and permanent failures.
EDGES = {
    "pending": ("skipped_skiplist", "preflight_failed", "resolving_patient"),
    "resolving_patient": ("patient_not_found", "duplicate_at_destination", "verifying_pre", "retry_wait", "failed"),
    "verifying_pre": ("pre_verify_failed", "uploading", "retry_wait", "failed"),
    "uploading": ("verifying_post", "retry_wait", "upload_interrupted", "failed"),
    "upload_interrupted": ("resolving_patient",),
    "retry_wait": ("resolving_patient", "failed"),
    "verifying_post": ("completed", "post_verify_failed", "retry_wait", "failed"),
}
TERMINAL = (
    "skipped_skiplist", "preflight_failed", "patient_not_found", "duplicate_at_destination",
    "pre_verify_failed", "failed", "post_verify_failed", "completed",
)
STATES = (*EDGES, *TERMINAL)
PICKUP = ("pending", "retry_wait", "upload_interrupted")
RECOVERY = {"resolving_patient": "pending", "verifying_pre": "pending", "uploading": "upload_interrupted", "verifying_post": "upload_interrupted"}
RECOVERY_TAG = "CrashRecovery"
PERMANENT = {"verifying_pre": "pre_verify_failed", "verifying_post": "post_verify_failed"}
# Columns that a report may show; every other one is left out.
SHOWN = (
    "item_key", "run_id", "seq", "last_seq", "state", "next_state", "from_state", "to_state", "state_group", "attempts", "error_type", "last_error_type",
    "reason", "delay_s", "level", "status", "outcome", "pre_failed", "post_failed", "levels_run", "section", "key", "n",
)


def manifest(docs: DataFrame) -> DataFrame:
    """LG-01. Upload items: key from encounter and content hash, name as fingerprint."""
    return docs.select(
        F.concat_ws(":", F.col("encounter_id").cast("string"), F.substring("sha256", 1, 12)).alias("item_key"), "encounter_id", "patient_id", "file_path", "sha256", "size_bytes",
        F.substring_index("file_path", "/", -1).alias("fingerprint"))


def current_items(transitions: DataFrame) -> DataFrame:
    """LG-02. State, attempts, last error, document id and claim of every item.

    One aggregation with partial results per item; nothing is sorted.
    """
    def last_known(col: str) -> Column:
        return F.max_by(col, F.when(F.col(col).isNotNull(), F.col("seq")))

    agg = transitions.groupBy("item_key").agg(
        F.max_by("to_state", "seq").alias("state"), F.count_if(F.col("to_state") == "retry_wait").alias("attempts"),
        last_known("error_type").alias("last_error_type"), last_known("destination_doc_id").alias("destination_doc_id"),
        F.max_by("run_id", "seq").alias("_run"), F.max("seq").alias("last_seq"))
    return agg.withColumn("claimed_by", F.when(~F.col("state").isin(*TERMINAL), F.col("_run"))).drop("_run")


def legal(from_state: Column, to_state: Column) -> Column:
    """Whether a move is in the edge list."""
    moves = F.create_map(*[x for a, targets in EDGES.items() for x in (F.lit(a), F.array(*[F.lit(t) for t in targets]))])
    return F.coalesce(F.array_contains(F.try_element_at(moves, F.coalesce(from_state, F.lit(""))), to_state), F.lit(False))


def with_previous(transitions: DataFrame) -> DataFrame:
    """Each transition with the state its item was in; the first starts at pending."""
    scanned = block_scan(transitions, ["item_key"], ["seq"], order_block("seq"), {"previous": ("lag", "to_state")})
    return scanned.withColumn("previous", F.coalesce("previous", F.lit("pending")))


def illegal_transitions(transitions: DataFrame) -> DataFrame:
    """LG-03. Moves outside the edge list; recovery rows are exempt."""
    rows = with_previous(transitions)
    exempt = F.coalesce(F.col("error_type") == RECOVERY_TAG, F.lit(False))
    return rows.filter(~exempt & ~legal(F.col("previous"), F.col("to_state")))


def recover(transitions: DataFrame, run_id: str) -> DataFrame:
    """LG-04. Rows to append so that no item is left in mid-flight."""
    items = current_items(transitions)
    target = lookup(RECOVERY, "state")
    return items.filter(target.isNotNull()).select(
        (F.col("last_seq") + 1).alias("seq"), "item_key", F.lit(run_id).alias("run_id"), F.col("state").alias("from_state"), target.alias("to_state"), F.lit(RECOVERY_TAG).alias("error_type"))


def next_step(evidence: DataFrame, max_attempts: int = 3) -> DataFrame:
    """LG-05. What should happen next to each item, and why.

    ``evidence`` has ``item_key, state, attempts`` and nullable facts:
    ``skiplisted, preflight_ok, resolution, duplicate, banner_ok, pre_ok, sent,
    size_ok, post_ok``. An unknown fact stops the walk at that step.
    """
    f = F.col
    start = (
        F.when(f("state") != "pending", None).when(f("skiplisted"), "skipped_skiplist").when(f("skiplisted").isNull(), "pending")
        .when(~f("preflight_ok"), "preflight_failed").when(f("preflight_ok").isNull(), "pending")
    )
    spent = (f("state") == "retry_wait") & (f("attempts") >= max_attempts)
    walk = (
        F.when(f("resolution") == "not_found", "patient_not_found").when(f("resolution") == "ambiguous", "failed").when(f("resolution").isNull(), "resolving_patient")
        .when(f("duplicate"), "duplicate_at_destination").when(f("duplicate").isNull(), "resolving_patient")
        .when(~f("banner_ok") | ~f("pre_ok"), "pre_verify_failed").when(f("banner_ok").isNull() | f("pre_ok").isNull(), "verifying_pre")
        .when(f("sent").isNull() | ~f("sent"), "uploading").when(~f("size_ok") | ~f("post_ok"), "post_verify_failed").when(f("size_ok").isNull() | f("post_ok").isNull(), "verifying_post").otherwise("completed")
    )
    reason = (
        F.when(start == "pending", None).when(start.isNotNull(), start).when(spent, "RetriesExhausted").when((f("resolution") == "found") & ~f("duplicate") & ~f("banner_ok"), "WrongPatientError")
        .when((walk == "post_verify_failed") & ~f("size_ok"), "SizeMismatch")
    )
    done = f("state").isin(*TERMINAL)
    step = F.when(done, f("state")).when(start.isNotNull(), start).when(spent, "failed").when(f("state").isin(*PICKUP), walk).otherwise(f("state"))
    return evidence.select("item_key", "state", step.alias("next_state"), F.when(~done, reason).alias("reason"))


def retry_schedule(items: DataFrame, max_attempts: int = 3, base_s: float = 2.0) -> DataFrame:
    """LG-06. Waiting items: retry after ``base * 2^(n-1)`` seconds, or give up."""
    waiting = items.filter(F.col("state") == "retry_wait")
    again = F.col("attempts") < max_attempts
    return waiting.select("item_key", "attempts", F.when(again, "resolving_patient").otherwise("failed").alias("next_state"),
                          F.when(again, F.lit(base_s) * F.pow(F.lit(2.0), F.col("attempts") - 1)).alias("delay_s"))


def failure_target(state: Column | str) -> Column:
    """LG-07. Where a permanent failure puts an item, by its current state."""
    return F.coalesce(lookup(PERMANENT, state), F.lit("failed"))


def by_patient(items: DataFrame, partitions: int | None = None) -> DataFrame:
    """LG-08. Each patient's items in one partition."""
    return items.repartition("patient_id") if partitions is None else items.repartition(partitions, "patient_id")


def hold_mismatched(items: DataFrame, banner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LG-09. (items to go on with, run flag): an item goes on only if its patient's banner is known to be right.

    ``banner`` has ``patient_id, banner_ok``. A wrong, unknown or absent banner
    holds the patient's items and sets the flag.
    """
    right = banner.groupBy("patient_id").agg(F.bool_and(F.coalesce("banner_ok", F.lit(False))).alias("_ok")).filter("_ok").select("patient_id")
    held = items.join(right, "patient_id", "left_anti")
    doubts = banner.select((~F.coalesce("banner_ok", F.lit(False))).alias("_d")).unionByName(held.select(F.lit(True).alias("_d")))
    return items.join(right, "patient_id", "left_semi"), doubts.agg(F.coalesce(F.bool_or("_d"), F.lit(False)).alias("aborted"))


def privacy_view(df: DataFrame) -> DataFrame:
    """LG-10. Only the columns that are known to carry no name, date or path."""
    return df.select(*[c for c in df.columns if c in SHOWN])


def state_counts(items: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """AGG-12. Items per state in a fixed order, empty states dropped."""
    rank = lookup({s: i for i, s in enumerate(states)}, "state")
    return items.groupBy("state").agg(F.count(F.lit(1)).alias("n")).withColumn("_r", rank).orderBy("_r").drop("_r")


def state_group(state: Column | str) -> Column:
    """AGG-15. pending, active or terminal."""
    s = F.col(state) if isinstance(state, str) else state
    return F.when(s.isin(*TERMINAL), "terminal").when(s == "pending", "pending").otherwise("active")


def ledger_overview(items: DataFrame) -> DataFrame:
    """AGG-15. Items per group of states."""
    return items.groupBy(state_group("state").alias("state_group")).agg(F.count(F.lit(1)).alias("n"))


def run_report(transitions: DataFrame, run_id: str) -> DataFrame:
    """SNK-08. State counts, attempts and error types of a run, as long rows."""
    items = current_items(transitions)
    states = items.groupBy(F.col("state").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("states").alias("section"), "key", "n")
    tries = items.groupBy(F.col("attempts").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("attempts").alias("section"), "key", "n")
    errors = transitions.filter((F.col("run_id") == run_id) & F.col("error_type").isNotNull()).groupBy(F.col("error_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return states.unionByName(tries).unionByName(errors.select(F.lit("errors").alias("section"), "key", "n"))
