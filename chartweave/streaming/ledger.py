"""ST-01/02/03/05. The delivery ledger over a stream of transitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chartweave.plans.ledger import EDGES, RECOVERY_TAG, TERMINAL
from chartweave.streaming.store import BUCKETS, land, read_items, upsert

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: ``kind``: ``item`` (the item as it stands), ``late`` (a transition that came after its place was closed) or ``unreadable``.
ITEM_SCHEMA = "item_key string, seq long, state string, attempts int, last_error_type string, destination_doc_id string, claimed_by string, illegal int, retry_at_ms long, kind string"
_COLUMNS = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]
_MOVE = "to_state string, run_id string, error_type string, destination_doc_id string, at_ms long"
_CLOSED = "seq long, state string, attempts int, error string, doc string, run string, illegal int, newest_ms long"
_FIRST = -(2**63)


def _text(value) -> str | None:
    return None if value is None or value != value else str(value)


def _step(item: tuple, seq: int, move: tuple) -> tuple:
    """The item after one more transition; fields as in ``_CLOSED`` without the last."""
    _, state, attempts, error, doc, run, illegal = item
    to_state, run_id, tag, doc_id = move[:4]
    wrong = tag != RECOVERY_TAG and to_state not in EDGES.get(state, ())
    return seq, to_state, attempts + (to_state == "retry_wait"), tag or error, doc_id or doc, run_id, illegal + wrong


class ItemState(StatefulProcessor):
    """Current state of each item, illegal moves counted, retries timed.

    An item is a snapshot and a tail of open transitions. Transitions are folded in seq order,
    and those older than the item's newest by ``open_ms`` are closed: the snapshot takes them
    and the tail drops them, up to the first that is still open. So the state of an item holds
    the transitions of that time at most, a late one counts where it belongs as long as its
    place is open, and one that comes later is given out as ``late`` and changes nothing.
    A re-sent transition is told by its seq while it is open, and is late afterwards.
    """

    def __init__(self, base_s: float = 2.0, timers: bool = True, open_ms: int = 3_600_000) -> None:
        self.base_s, self.timers, self.open_ms = base_s, timers, open_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", _CLOSED)
        self.open = handle.getMapState("open", "seq long", _MOVE)
        self.due = handle.getValueState("due", "retry_at_ms long")

    def _load(self) -> tuple[tuple, int, dict]:
        """The snapshot, the newest time seen, and the tail by seq."""
        *item, newest = self.closed.get() if self.closed.exists() else (_FIRST, "pending", 0, None, None, None, 0, _FIRST)
        return tuple(item), newest, {int(at): tuple(move) for (at,), move in self.open.iterator()}

    @staticmethod
    def _now(item: tuple, tail: dict) -> tuple:
        for seq in sorted(tail):
            item = _step(item, seq, tail[seq])
        return item

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        item, newest, tail = self._load()
        before, out = max([item[0], *tail]), []
        for frame in rows:
            columns = [frame[c].tolist() for c in ("seq", "to_state", "run_id", "error_type", "destination_doc_id", "at_ms")]
            for seq, to_state, run_id, tag, doc_id, at in zip(*columns, strict=True):
                seq, at = int(seq), int(at)
                if seq <= item[0]:
                    out.append((str(key[0]), seq, to_state, 0, _text(tag), _text(doc_id), _text(run_id), 0, None, "late"))
                elif seq not in tail:
                    tail[seq] = (to_state, _text(run_id), _text(tag), _text(doc_id), at)
                    self.open.updateValue((seq,), tail[seq])
                    newest = max(newest, at)
        for seq in sorted(tail):
            if tail[seq][4] > newest - self.open_ms:
                break
            item = _step(item, seq, tail.pop(seq))
            self.open.removeKey((seq,))
        self.closed.update((*item, newest))
        now = self._now(item, tail)
        retry_at = self.due.get()[0] if self.due.exists() else 0
        if now[1] == "retry_wait" and now[0] > before and self.timers:
            retry_at = timerValues.getCurrentProcessingTimeInMs() + int(self.base_s * 1000 * 2 ** (now[2] - 1))
            self.handle.registerTimer(retry_at)
            self.due.update((retry_at,))
        if now[0] != _FIRST:
            out.append(self._row(key[0], now, now[1], retry_at))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """ST-03. The wait is over: the item is due again, unless it moved on."""
        if not self.due.exists():
            return
        item, _, tail = self._load()
        now, retry_at = self._now(item, tail), self.due.get()[0]
        if now[1] == "retry_wait" and expiredTimerInfo.getExpiryTimeInMs() >= retry_at:
            yield pd.DataFrame([self._row(key[0], now, "retry_due", retry_at)], columns=_COLUMNS)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, now: tuple, state: str, retry_at: int) -> tuple:
        seq, _, attempts, error, doc, run, illegal = now
        return str(key), seq, state, attempts, error, doc, None if state in TERMINAL else run, illegal, retry_at if state.startswith("retry") else None, "item"


def stream_item_state(transitions: DataFrame, base_s: float = 2.0, timers: bool = True, open_for_s: float = 3600.0) -> DataFrame:
    """ST-01/03. Latest state per item, emitted whenever it changes; late and unreadable transitions beside it.

    A transition without item, seq, state or time is ``unreadable`` and never reaches an
    item. ``open_for_s`` is how long, in the time of the transitions, an item waits for
    late ones. The session needs the RocksDB state provider (``STATE_PROVIDER``). Turn
    ``timers`` off for a run that ends by itself: processing-time timers keep
    a query going for as long as it lives.
    """
    at = F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms")
    rows = transitions.select(F.col("item_key").cast("string").alias("item_key"), F.col("seq").cast("long").alias("seq"), "to_state", "run_id", "error_type", "destination_doc_id", at)
    whole = F.col("item_key").isNotNull() & F.col("seq").isNotNull() & F.col("to_state").isNotNull() & F.col("at_ms").isNotNull()
    items = rows.filter(whole).groupBy("item_key").transformWithStateInPandas(
        statefulProcessor=ItemState(base_s, timers, int(open_for_s * 1000)), outputStructType=ITEM_SCHEMA, outputMode="update", timeMode="processingTime" if timers else "none")
    none = lambda kind: F.lit(None).cast(kind)
    unreadable = rows.filter(~whole).select("item_key", "seq", F.col("to_state").alias("state"), none("int").alias("attempts"), F.col("error_type").alias("last_error_type"), "destination_doc_id", F.col("run_id").alias("claimed_by"), none("int").alias("illegal"), none("long").alias("retry_at_ms"), F.lit("unreadable").alias("kind"))
    return items.unionByName(unreadable)


def stream_enqueue(items: DataFrame, delay: str = "1 hour", time_col: str = "at") -> DataFrame:
    """ST-02. Items of a stream, re-sent ones ignored within the delay."""
    return items.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["item_key"])


def enqueue_new(items: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", good: Column | None = None) -> StreamingQuery:
    """ST-02. Each item of a stream once in ``out/accepted``, unreadable ones in ``out/refused``.

    Within the delay re-sent items go before they are written; later ones are told by the
    keys that ``out`` holds. ``good`` is what an item must satisfy besides having a key and a time.
    """
    whole = F.col("item_key").isNotNull() & F.col("at").isNotNull()
    fine = F.coalesce(whole if good is None else whole & good, F.lit(False))
    fresh = stream_enqueue(items.filter(fine), delay).withColumn("fine", F.lit(True))
    broken = items.filter(~fine).withColumn("at", F.col("at").cast("timestamp")).withColumn("fine", F.lit(False))

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        land(held, out, batch_id, "item_key", F.col("fine"))
        held.unpersist()

    return fresh.unionByName(broken).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_items(batch: DataFrame, table: str, batch_id: int, buckets: int = BUCKETS, name: str = "") -> None:
    """ST-05. Fold a micro-batch of item states into the stored item table, the latest seq of an item stays."""
    upsert(batch, table, batch_id, "item_key", "seq", buckets, name)


def stream_state_counts(transitions: DataFrame, table: str, checkpoint: str, open_for_s: float = 3600.0, buckets: int = BUCKETS) -> StreamingQuery:
    """ST-05. Keep the item table current, and late and unreadable transitions beside it; ``counts`` reads the live counters."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12] + "-"

    def fold(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        upsert_items(held.filter((F.col("kind") == "item") & (F.col("state") != "retry_due")), table, batch_id, buckets, name)
        held.filter(F.col("kind") != "item").write.mode("overwrite").parquet(f"{table}/aside/batch_id={batch_id}")
        held.unpersist()

    writer = stream_item_state(transitions, timers=False, open_for_s=open_for_s).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(fold).trigger(availableNow=True).start()


def counts(spark: SparkSession, table: str) -> DataFrame:
    """ST-05. Items per state, as the table stands."""
    return read_items(spark, table).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def aside(spark: SparkSession, table: str) -> DataFrame:
    """Late and unreadable transitions of all batches so far."""
    return spark.read.parquet(f"{table}/aside").drop("batch_id")
