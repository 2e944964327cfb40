"""Streams against the batch fold, with restarts and re-sent rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chartweave.plans import ledger
from chartweave.plans.tsv_mapping import map_practitioners
from chartweave.sinks import reports
from chartweave.streaming import intake, store
from chartweave.streaming import ledger as live

SCHEMA = "seq long, item_key string, run_id string, to_state string, error_type string, destination_doc_id string, at timestamp"
MOVES = [
    (1, "a", "r1", "resolving_patient", None, None), (2, "a", "r1", "verifying_pre", None, None), (3, "a", "r1", "retry_wait", "Timeout", None), (4, "b", "r1", "uploading", None, None),
    (5, "a", "r1", "resolving_patient", None, None), (6, "a", "r1", "verifying_pre", None, None), (7, "a", "r1", "uploading", None, None), (8, "a", "r1", "verifying_post", None, None),
    (9, "a", "r1", "completed", None, "doc9"), (10, "b", "r2", "upload_interrupted", "CrashRecovery", None), (11, "c", "r2", "skipped_skiplist", None, None),
]


def rows(spark, moves):
    return spark.createDataFrame([(*m, None) for m in moves], SCHEMA).withColumn("at", F.timestamp_seconds("seq"))


SAME = ("state", "attempts", "last_error_type", "destination_doc_id", "claimed_by")


def send(spark, tmp_path, parts, **how):
    """Each part as one micro-batch; the item table's folder."""
    src, table = str(tmp_path / "in"), str(tmp_path / "items")
    for part in parts:
        rows(spark, part).coalesce(1).write.mode("append").parquet(src)
        live.stream_state_counts(spark.readStream.schema(SCHEMA).parquet(src), table, str(tmp_path / "ckpt"), **how).awaitTermination()
    return table


def items(spark, table):
    return {r.item_key: r for r in store.read_items(spark, table).collect()}


def folded(spark, moves):
    want = {r.item_key: r for r in ledger.current_items(rows(spark, moves)).collect()}
    wrong = {r.item_key: r["count"] for r in ledger.illegal_transitions(rows(spark, moves)).groupBy("item_key").count().collect()}
    return {k: [*(r[c] for c in SAME), wrong.get(k, 0)] for k, r in want.items()}


def test_live_state_equals_the_batch_fold(spark, tmp_path):
    # A restart with the rest, and with rows that were sent before.
    table = send(spark, tmp_path, [MOVES[:6], MOVES[4:]])
    got = {k: [*(r[c] for c in SAME), r.illegal] for k, r in items(spark, table).items()}
    assert got == folded(spark, MOVES) and {k: v[-1] for k, v in got.items()} == {"a": 0, "b": 1, "c": 0}
    assert {r.state: r.n for r in live.counts(spark, table).collect()} == {"completed": 1, "upload_interrupted": 1, "skipped_skiplist": 1}
    assert live.aside(spark, table).count() == 0


def test_resent_items_are_ignored(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows(spark, MOVES).write.parquet(src)
    q = live.stream_enqueue(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.item_key for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_items_resent_after_the_delay_stay_out(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = 86_400
    sends = [[("a", 0), ("b", 5), (None, 6), ("a", 7)], [("c", 2 * day), ("x", None)], [("a", 4 * day), ("d", 4 * day), (None, 4 * day), ("b", 4 * day)]]
    for part in sends:
        spark.createDataFrame(part, "item_key string, t long").select("item_key", F.timestamp_seconds("t").alias("at")).coalesce(1).write.mode("append").parquet(src)
        live.enqueue_new(spark.readStream.schema("item_key string, at timestamp").parquet(src), out, str(tmp_path / "c")).awaitTermination()
    accepted, refused = store.read_landed(spark, out)
    assert sorted((r.item_key, r.at.day) for r in accepted.collect()) == [("a", 1), ("b", 1), ("c", 3), ("d", 5)]
    assert sorted(str(r.item_key) for r in refused.collect()) == ["None", "None", "x"]


def test_a_landed_batch_that_runs_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 1)], "k string, v int")
    store.land(first, out, 0, "k", F.col("v") < 9)
    second = spark.createDataFrame([("b", 2), ("c", 4), ("d", 9)], "k string, v int")
    for _ in range(2):
        store.land(second, out, 1, "k", F.col("v") < 9)
        accepted, refused = store.read_landed(spark, out)
        assert sorted((r.k, r.v) for r in accepted.collect()) == [("a", 1), ("b", 2), ("c", 4)] and sorted(r.v for r in refused.collect()) == [3, 9]


def test_intake_reads_each_file_once(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    src.mkdir()
    (src / "a.tsv").write_text("k\tv\n1\tx\n2\ty\n")
    intake.stream_intake(spark, str(src), "k string, v string", out, ckpt).awaitTermination()
    (src / "b.tsv").write_text("k\tv\n3\tz\n")
    intake.stream_intake(spark, str(src), "k string, v string", out, ckpt).awaitTermination()
    assert sorted((r.k, r.v, r._src) for r in spark.read.parquet(out).collect()) == [("1", "x", "a.tsv"), ("2", "y", "a.tsv"), ("3", "z", "b.tsv")]


def test_every_edge(spark):
    moves = [(a, b) for a in ledger.STATES for b in ledger.STATES]
    df = spark.createDataFrame(moves, "a string, b string")
    legal = {(r.a, r.b) for r in df.filter(ledger.legal(F.col("a"), F.col("b"))).collect()}
    assert legal == {(a, b) for a, targets in ledger.EDGES.items() for b in targets}
    for t in ledger.TERMINAL:
        assert not any(a == t for a, _ in legal)


def test_recovery_rewinds_and_is_exempt(spark):
    log = rows(spark, MOVES[:4])
    fixed = ledger.recover(log, "r9")
    assert [(r.item_key, r.from_state, r.to_state) for r in fixed.collect()] == [("b", "uploading", "upload_interrupted")]
    whole = log.unionByName(fixed.drop("from_state"), allowMissingColumns=True)
    assert {r.item_key for r in ledger.illegal_transitions(whole).collect()} == {"b"} and ledger.illegal_transitions(whole).count() == 1
    assert "upload_interrupted" in {r.state for r in ledger.current_items(whole).collect()}


def test_reports_carry_no_private_column(spark):
    df = spark.createDataFrame([("k", "n", "/p", "x")], "item_key string, family_name string, file_path string, state string")
    assert ledger.privacy_view(df).columns == ["item_key", "state"]


def test_missing_rows_are_written_once(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    reports.write_missing(df, out, "k")
    reports.write_missing(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")).withColumn("v", F.upper("v")), out, "k")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_deliveries_run_in_order(spark, tmp_path):
    seen = []

    def sink(name):
        def write(df):
            seen.append(name)
            df.write.mode("overwrite").parquet(str(tmp_path / name))
        return write

    df = spark.range(5).toDF("id")
    assert reports.deliver({"ccda": (df, sink("ccda")), "archive": (df, sink("archive"))}) == {"archive": 5, "ccda": 5} and seen == ["archive", "ccda"]


def test_late_transitions_count_where_they_belong(spark, tmp_path):
    # The later half comes first, then the rest with a re-sent row.
    table = send(spark, tmp_path, [MOVES[5:], MOVES[:6]])
    assert {k: [*(r[c] for c in SAME), r.illegal] for k, r in items(spark, table).items()} == folded(spark, MOVES)


def test_a_closed_place_takes_no_more(spark, tmp_path):
    # Open for two seconds: 'a' has closed its places up to seq 7 by the time of 9, so its 5 is late; 'b' has closed none.
    table = send(spark, tmp_path, [[m for m in MOVES if m[0] not in (5, 4)], [m for m in MOVES if m[0] in (5, 4)]], open_for_s=2.0)
    assert [(r.item_key, r.seq, r.state, r.kind) for r in live.aside(spark, table).collect()] == [("a", 5, "resolving_patient", "late")]
    got = items(spark, table)
    assert got["a"].state == "completed" and got["a"].attempts == 1 and got["a"].illegal == 1


def test_unreadable_transitions_are_set_aside(spark, tmp_path):
    bad = [(None, "a", "r1", "completed", None, None), (12, None, "r1", "completed", None, None), (13, "c", "r1", None, None, None)]
    table = send(spark, tmp_path, [MOVES[:6] + bad, MOVES[6:]])
    assert {k: [*(r[c] for c in SAME), r.illegal] for k, r in items(spark, table).items()} == folded(spark, MOVES)
    assert sorted((str(r.item_key), r.kind) for r in live.aside(spark, table).collect()) == [("None", "unreadable"), ("a", "unreadable"), ("c", "unreadable")]


def test_state_of_an_item_is_bounded():
    """The tail holds the transitions of the open time only, whatever the length of the log."""

    class Held(dict):
        def get_state(self):
            return self

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    class Moves:
        def __init__(self):
            self.held = {}

        def iterator(self):
            return iter(list(self.held.items()))

        def updateValue(self, k, v):
            self.held[k] = v

        def removeKey(self, k):
            del self.held[k]

    state = live.ItemState(timers=False, open_ms=50_000)
    state.closed, state.open, state.due = Value(), Moves(), Value()
    names, most = sorted(ledger.STATES), 0
    moves = [(i, f"k{i}", names[i % len(names)]) for i in range(2000)]
    for at in range(0, 2000, 20):
        part = moves[at : at + 20][::-1]
        frame = pd.DataFrame([(i, to, "r", None, None, i * 1000) for i, _, to in part], columns=["seq", "to_state", "run_id", "error_type", "destination_doc_id", "at_ms"])
        (out,) = state.handleInputRows(("a",), iter([frame]), None)
        most = max(most, len(state.open.held))
    assert most <= 51 and out.iloc[-1].seq == 1999 and out.iloc[-1].attempts == sum(to == "retry_wait" for _, _, to in moves)


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = str(tmp_path / "items")
    frame = lambda rows: spark.createDataFrame(rows, "item_key string, seq long, state string")
    live.upsert_items(frame([(f"k{i}", 1, "pending") for i in range(100)]), table, 0, buckets=8)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "items").rglob("*.parquet")}
    before = files()
    batch = frame([("k3", 2, "failed"), ("k3", 0, "late"), ("new", 5, "pending")])
    live.upsert_items(batch, table, 1, buckets=8)
    after = files()
    kept = {p.parent.name for p in before.keys() & after.keys()}
    assert 6 <= len(kept) <= 7 and all(after[p] == before[p] for p in before.keys() & after.keys())
    got = items(spark, table)
    assert len(got) == 101 and got["k3"].state == "failed" and not (tmp_path / "items" / "staged").exists()
    live.upsert_items(batch, table, 1, buckets=8)
    assert items(spark, table) == got


def test_a_batch_lost_while_buckets_are_replaced(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "items")
    frame = lambda rows: spark.createDataFrame(rows, "item_key string, seq long, state string")
    live.upsert_items(frame([(f"k{i}", 1, "pending") for i in range(40)]), table, 0, buckets=2)
    batch = frame([(f"k{i}", 2, "failed") for i in range(12)])  # some in each bucket

    def lost(*_):
        # The staged content is complete; one bucket is gone from the table.
        import shutil

        shutil.rmtree(tmp_path / "items" / "items" / "bucket=0")
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "remove_path", lost)
    with pytest.raises(RuntimeError):
        live.upsert_items(batch, table, 1, buckets=2)
    monkeypatch.undo()
    live.upsert_items(batch, table, 1, buckets=2)
    got = items(spark, table)
    assert len(got) == 40 and sum(r.state == "failed" for r in got.values()) == 12


def test_missing_table_is_an_error(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1, "pending")], "item_key string, seq long, state string")
    with pytest.raises(FileNotFoundError):
        live.upsert_items(batch, str(tmp_path / "items"), 3)


def test_new_files_arrive_as_canonical_rows(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    src.mkdir()
    run = lambda: intake.stream_intake(spark, str(src), "ProviderGuid string, FirstName string, LastName string", out, ckpt, map_practitioners, "practitioner_id", F.col("practitioner_id") != "").awaitTermination()
    (src / "a.tsv").write_text('ProviderGuid\tFirstName\tLastName\np1\tAnn\t"Le ""e"""\n\\N\tNo\tKey\np2\t"two\nlines"\tB\n')
    run()
    (src / "b.tsv").write_text("ProviderGuid\tFirstName\tLastName\np1\tAnn\tAgain\np3\tC\t\n")
    run()
    accepted, refused = store.read_landed(spark, out)
    assert sorted((r.practitioner_id, r.name) for r in accepted.collect()) == [("p1", 'Ann Le "e"'), ("p2", "two\nlines B"), ("p3", "C")]
    assert [r.name for r in refused.collect()] == ["No Key"] and spark.read.parquet(f"{out}/raw").count() == 5
