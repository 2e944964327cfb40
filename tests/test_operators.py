"""Ordered operators against brute force, with one key that holds a third of the rows."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from chartweave.operators import filters, folds, joins, search, selection, sets, windows
from chartweave.plans import layout, verify, views


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(200)}", i, rng.randrange(5), None if rng.random() < 0.3 else f"v{i}") for i in range(6000)]
    return rows, spark.createDataFrame(rows, "k string, o long, n long, v string").repartition(16)


def test_block_scan_matches_a_plain_pass(spark, skewed):
    rows, df = skewed
    got = {r.o: r for r in windows.block_scan(df, ["k"], ["o"], windows.order_block("o", 7), {"rn": ("row_number", None), "s": ("sum", "n"), "p": ("lag", "v"), "l": ("last", "v")}).collect()}
    assert len(got) == len(rows)
    state = {}
    for k, o, n, v in sorted(rows, key=lambda r: r[1]):
        rn, total, prev, last = state.get(k, (0, 0, None, None))
        rn, total, last = rn + 1, total + n, v if v is not None else last
        r = got[o]
        assert (r.rn, r.s, r.p, r.l) == (rn, total, prev, last)
        state[k] = (rn, total, v, last)


def test_pages_hold_every_child_in_order(spark, skewed):
    rows, df = skewed
    pages = joins.paged_collect(df, ["k"], F.col("o"), ["o"], windows.order_block("o", 6), 50, "os").collect()
    assert max(len(p.os) for p in pages) == 50
    by_key = {}
    for p in sorted(pages, key=lambda p: (p.k, p.page)):
        by_key.setdefault(p.k, []).extend(p.os)
    want = {}
    for k, o, _, _ in rows:
        want.setdefault(k, []).append(o)
    assert by_key == want


def test_record_pages_and_childless_parents(spark):
    parent = spark.createDataFrame([("a", "A"), ("b", "B")], "patient_id string, name string")
    child = spark.createDataFrame([("a", i, i) for i in range(5)] + [("zz", 9, 9)], "patient_id string, x int, _ord long")
    rows = joins.assemble_records(parent, {"xs": (child, F.col("x"), ["_ord"], None)}, page_rows=2).orderBy("patient_id", "page").collect()
    assert [(r.patient_id, r.page, r.parent.name if r.parent else None, list(r.xs)) for r in rows] == [("a", 0, "A", [0, 1]), ("a", 1, None, [2, 3]), ("a", 2, None, [4]), ("b", 0, "B", [])]


def test_record_rows_of_a_parent_move_once(spark):
    # Rows with their items went through two shuffles, one to be numbered and one to meet on their pages.
    parent = spark.sql("SELECT concat('p', id) AS patient_id, id AS name FROM range(20)")
    xs = spark.sql("SELECT concat('p', pmod(hash(id), 25)) AS patient_id, id AS x, id AS _ord FROM range(3000)")
    ys = spark.sql("SELECT IF(id % 7 = 0, NULL, concat('p', id % 3)) AS patient_id, concat('y', id) AS y, -id AS _ord FROM range(500)")
    children = {"xs": (xs, F.col("x"), ["_ord"], None), "ys": (ys, F.struct("y", F.create_map(F.lit("k"), "y").alias("m")), ["_ord"], None)}
    got = {}
    for whole_rows in (1 << 16, 200, 0):
        df = joins.assemble_records(parent, children, page_rows=7, whole_rows=whole_rows)
        got[whole_rows] = sorted(str(r) for r in df.collect())
        # The pages of whole parents need the exchange by parent only; the known parents have one of their own.
        if whole_rows > 200:
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert sum("Exchange hashpartitioning(" in line and "page" in line for line in plan.splitlines()) == 0
            assert sum("Exchange hashpartitioning(patient_id" in line and "REPARTITION_BY_COL" in line for line in plan.splitlines()) == 1
    assert got[1 << 16] == got[200] == got[0]
    first = joins.assemble_records(parent, children, page_rows=7).filter("patient_id = 'p1'").orderBy("page").collect()
    assert [x for r in first for x in r.xs] == sorted(r.x for r in xs.filter("patient_id = 'p1'").collect())
    assert [y.y for r in first for y in r.ys] == [r.y for r in ys.filter("patient_id = 'p1'").orderBy("_ord").collect()]


def test_longest_prefix_wins(spark):
    docs = spark.createDataFrame([("d1", "Van_Buren_John_01-02-2020_x.pdf"), ("d2", "Van_Buren_Jo_01-02-2020.pdf"), ("d3", "Nobody_x.pdf"), ("d4", "plain")], "doc_id string, file_name string")
    people = spark.createDataFrame([("p1", "Van Buren", "John"), ("p2", "Van", "Buren"), ("p3", "Van Buren", "Jo"), ("p4", None, "x")], "patient_id string, f string, g string").withColumn("prefix", joins.patient_prefix("f", "g"))
    got = {(r.doc_id, r.n_owners, r.first_owner) for r in joins.attribute_documents(docs, people).collect()}
    assert got == {("d1", 1, "p1"), ("d2", 1, "p3")}


def test_names_of_a_collision(spark):
    docs = spark.createDataFrame([(f"feedface-{i:04d}", "a.pdf", i) for i in range(300)] + [("x-1", "b.pdf", 0)], "id string, name string, o int")
    got = {r.id: r.file_name for r in windows.allocate_names(docs, "name", "id", ["o"]).collect()}
    assert got["feedface-0000"] == "a.pdf" and got["feedface-0001"] == "a-feedface.pdf" and got["x-1"] == "b.pdf"


def test_status_fold(spark):
    tx = [("a", "Order sent", "x", 1, 1), ("a", "Refill request received", "x", 2, 2), ("b", "Order sent", "x", 1, 3), ("b", "Prescription dispensed", "x", 2, 4), ("b", "Cancellation approved by pharmacy", "x", 3, 5),
          ("c", "odd", "Cancelled", 1, 6), ("c", "odd", "sent", 2, 7), ("d", "odd", "weird one", None, 8), ("d", "odd", "first", 1, 9), ("e", None, "", 1, 10)]
    df = spark.createDataFrame(tx, "prescription_id string, description string, kind string, s int, _ord long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    got = {r.prescription_id: (r.status_label, r.label_prefix) for r in folds.resolve_status(df).collect()}
    assert got == {"a": ("VERIFIED", "ESCRIPT"), "b": ("DISPENSED", "ESCRIPT"), "c": ("CANCELLED", None), "d": ("WEIRD ONE", None), "e": (None, None)}


def test_bmi_only_where_it_is_missing(spark):
    rows = [("e1", "8302-2", "64", "in", 1), ("e1", "29463-7", "150", "lbs", 2), ("e2", "8302-2", "64", "in", 3), ("e2", "3141-9", "150", "lb", 4), ("e2", "39156-5", "30", "x", 5), ("e3", "8302-2", "bad", "in", 6), ("e3", "3141-9", "1", "kg", 7), ("e4", "8302-2", "180", "cm", 8), ("e4", "3141-9", "80", "kg", 9)]
    obs = spark.createDataFrame(rows, "encounter_id string, code string, value string, unit string, _ord long").withColumns({"patient_id": F.lit("p"), "effective_at": F.lit(None).cast("timestamp")})
    kept = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "encounter_id string")
    assert [(r.encounter_id, r.value) for r in folds.derive_bmi(obs, kept).collect()] == [("e1", "25.75")]


def test_flowsheet_matches_pairs(spark):
    rng = random.Random(3)
    enc = [("p" if i % 3 == 0 else f"q{rng.randrange(9)}", f"e{i}", f"2020-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", i) for i in range(240)]
    e = spark.createDataFrame(enc, "patient_id string, encounter_id string, d string, o long").withColumn("date_of_service", F.col("d").cast("date"))
    obs = e.filter("o % 4 <> 0").select("encounter_id", F.lit("vital-signs").alias("category"), F.lit("8302-2").alias("code"), F.lit("h").alias("display"), F.col("o").cast("string").alias("value"), F.col("o").alias("_ord"))
    got = {(r.encounter_id, r.column_no): r.value for r in views.vitals_flowsheet(e, obs, 4).collect()}
    want = {}
    for p, eid, d, _ in enc:
        prior = sorted((x for x in enc if x[0] == p and x[2] < d and x[3] % 4), key=lambda x: (x[2], -x[3]), reverse=True)[:4]
        want.update({(eid, i + 1): str(x[3]) for i, x in enumerate(prior)})
    assert got == want


def test_selection_keeps_what_it_drops(spark):
    df = spark.createDataFrame([(1, True, "Growth chart", "1990-01-01", "2020-01-01"), (2, True, "Growth chart", "2015-01-01", "2020-01-01"), (3, False, "x", "1990-01-01", "2020-01-01"), (4, True, None, None, None)], "i int, c boolean, cc string, b string, s string")
    df = df.select("i", "c", "cc", F.col("b").cast("date").alias("b"), F.col("s").cast("date").alias("s"))
    kept, dropped = filters.split_by_reason(df, filters.skip_reason(F.col("c"), "cc", "b", "s"))
    assert sorted(r.i for r in kept.collect()) == [2, 4]
    assert {r.i: r.skip_reason for r in dropped.collect()} == {1: "adult_growth_chart", 3: "empty_soap"}


def test_flags_are_strict():
    assert filters.resolve_flags({"a": True, "b": False}, {"b": True}) == {"a": True, "b": True}
    with pytest.raises(ValueError, match="unknown sections: z"):
        filters.resolve_flags({"a": True}, {"z": True})


def test_lossless_tail(spark):
    df = spark.createDataFrame([(1, "x", r"\N", "keep"), (2, "y", "", None)], "id int, used string, empty string, rest string")
    tails = [dict(r.t) for r in df.select(sets.residual(df.columns, ["id", "used"], "ns").alias("t")).collect()]
    assert tails == [{"ns:rest": "keep"}, {}]
    fates = {r.column_name: (r.filled, r.fate) for r in sets.column_coverage(df, ["id", "used"]).collect()}
    assert fates == {"id": (2, "consumed"), "used": (2, "consumed"), "empty": (0, "empty"), "rest": (1, "carried")}


def test_greedy_buckets(spark):
    rng = random.Random(5)
    values = sorted(round(rng.uniform(7, 20), 1) for _ in range(400))
    spans = spark.createDataFrame([(0, "x", "F", v, False) for v in values], "sample_index int, text string, font string, size double, bold boolean")
    got = sorted((r["size"], r["weight"]) for r in layout.type_clusters(spans).collect())
    want, bucket = [], []
    for v in values + [float("inf")]:
        if bucket and v - bucket[0] > 0.25:
            want.append((round(sum(bucket) / len(bucket), 1), len(bucket)))
            bucket = []
        bucket.append(v)
    assert len(got) == len(want) and all(abs(a[0] - b[0]) < 0.11 and a[1] == b[1] for a, b in zip(got, sorted(want), strict=True))


def test_greedy_ranges_follow_the_loop(spark):
    rng = random.Random(6)
    rows = [(k, round(rng.uniform(0, 30) if k else rng.gauss(300, 200), rng.choice((0, 1, 2))), rng.randrange(1, 5)) for k in (None, 0, 1) for _ in range(700)] + [(7, 3.0, 1), (8, None, 1)]
    for keys in (["k"], []):
        got = sorted(tuple(r) for r in selection.greedy_ranges(spark.createDataFrame(rows, "k int, v double, w long"), keys, 1.0).select(*(F.coalesce(c, F.lit(-1)) for c in keys), "mean", "total").collect())
        want = []
        for k in {(-1 if r[0] is None else r[0]) if keys else 0 for r in rows}:
            own, bucket = sorted((v, w) for x, v, w in rows if v is not None and (not keys or (-1 if x is None else x) == k)), []
            for v, w in [*own, (float("inf"), 0)]:
                if bucket and round((v - bucket[0][0]) * 1e6 if v < 1e9 else 1e18) > 1e6:
                    want.append(((k,) if keys else ()) + (sum(a * b for a, b in bucket) / sum(b for _, b in bucket), sum(b for _, b in bucket)))
                    bucket = []
                bucket.append((v, w))
        assert len(got) == len(want) and all(a[:-2] == b[:-2] and abs(a[-2] - b[-2]) <= 0.0500001 and a[-1] == b[-1] for a, b in zip(got, sorted(want), strict=True))
    assert selection.greedy_ranges(spark.createDataFrame([], "k int, v double, w long"), ["k"], 1.0).count() == 0


def test_exact_quantiles_and_medians(spark):
    import statistics

    import numpy as np

    rng = np.random.default_rng(3)
    a = np.concatenate((rng.normal(0, 1e3, 3000), rng.normal(0, 1e-9, 3000), [1e300, -1e300, 0.0], np.round(rng.uniform(0, 5, 4000), 1)))
    df = spark.createDataFrame([(float(x), float(x) if i % 3 else None) for i, x in enumerate(a)] + [(float("nan"), None)], "a double, b double").repartition(7)
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = selection.exact_quantiles(df, {f"{c}{q}": (c, q) for c in "ab" for q in shares} | {"none": (F.lit(None), 0.5)})
    for q in shares:
        assert got[f"a{q}"] == pytest.approx(np.quantile(a, q), rel=1e-12) and got[f"b{q}"] == pytest.approx(np.quantile([x for i, x in enumerate(a) if i % 3], q), rel=1e-12)
    assert got["none"] is None
    rows = [(int(rng.integers(0, 9)), round(float(rng.uniform(0, 1)), 3)) for _ in range(999)] + [(100, 0.5), (101, None)]
    medians = {r.k: r["median"] for r in selection.counted_medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    want = {k: statistics.median(v for x, v in rows if x == k) for k in {x for x, v in rows if v is not None}}
    assert medians.keys() == want.keys() and all(math.isclose(medians[k], want[k]) for k in want)


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé@ I") for _ in range(rng.randrange(1, 7)))
    rows = [(i // 2, word() if i % 9 else None, " ".join(word() for _ in range(rng.randrange(0, 30))) if i % 7 else None) for i in range(400)] + [(900, "x", "y" * 2998 + "needle" + "z" * 5000), (901, "", "")]
    index = spark.createDataFrame(rows, "id int, display_name string, search string").repartition(5)
    search.write_index(index, str(tmp_path / "index"))
    for q in ("needle", "ab", "a b", "bcd é", "@", "abcab", "", "AB  ab", "nothing like it"):
        want = [tuple(r) for r in windows.search_patients(index, q).collect()]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in search.search_index(spark, str(tmp_path / "index"), q).collect()), q
    assert search.candidate_pages(spark, str(tmp_path / "index"), "needle").count() == 1


def test_bits_of_a_bitmap(spark):
    want = sorted(random.Random(1).sample(range(search.BITS), 300)) + [search.BITS - 1]
    df = spark.createDataFrame([(i + 1,) for i in want], "slot long").agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("b"))
    assert df.select(search.set_bits("b").alias("x")).first().x == sorted(set(want))


def test_one_sample_shows_no_text(spark):
    spans = spark.createDataFrame([(0, f"secret {i}") for i in range(5)], "sample_index int, text string")
    df = spans.select("text", F.lit(1).alias("n"))
    assert {r.text for r in layout.suppress_single_sample(df, spans, ["text"]).collect()} == {None}


def slow_ratio(needle, haystack):
    from difflib import SequenceMatcher

    n, h = " ".join(needle.split()).lower(), " ".join(haystack.split()).lower()
    if n in h:
        return 1.0
    words, best = h.split(" "), 0.0
    for i in range(len(words)):
        best = max(best, SequenceMatcher(None, " ".join(words[i:])[: len(n) + 8], n, autojunk=False).ratio())
    return best


@pytest.mark.parametrize("least", [0.88, 0.7])
def test_name_ratio_against_brute_force(spark, least):
    rng = random.Random(11)
    words = ["anna", "lee", "smith", "smyth", "clinic", "visit", "jones", "ann", "lees", "theodora", "hohenfels", "wittgenau"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 2, 6, 9)))), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(150)]

    def misspelt(name):
        at = rng.randrange(len(name))
        return name[:at] + rng.choice(["", "x", name[at] + "k"]) + name[at + 1 :]

    rows += [(1000 + i, n, f"{t[: len(t) // 2]} {misspelt(n)} {t[len(t) // 2 :]}" if i % 2 else f"{t} {misspelt(n)}") for i, n, t in rows]
    rows += [(5000, "", "x"), (5001, "x", ""), (5002, "a", "b"), (5003, "ab", "ba"), (5004, "a", "b " * 3000 + "c")]
    got = verify.with_name_ratio(spark.createDataFrame(rows, "i int, n string, t string"), "n", "t", least=least).collect()
    for r in got:
        want = slow_ratio(r.n, r.t) if r.n and r.t else 0.0
        assert (r.ratio or 0.0) == pytest.approx(want if want >= least else 0.0, abs=1e-12), (r.n, r.t)
    assert sum(0 < (r.ratio or 0) < 1 for r in got) > 40


def test_windows_with_a_pair_begin_at_words(spark):
    """As cutting a window at every word would give them, whatever characters the pairs have."""
    rows = [("ab c. d$ e\\ (f ab", ["b ", ". "], 4), ("x (f é\U0001f600 y a|b", ["(f", "|b", "é\U0001f600"], 3), ("one", ["ne"], 2), ("one", ["ne"], 3), ("a" * 50 + " ab", ["ab"], 9)]
    got = spark.createDataFrame(rows, "h string, p array<string>, n int").select("*", verify._windows_with(F.col("h"), F.col("n"), F.col("p")).alias("w")).collect()
    for r in got:
        starts = [0] + [i + 1 for i, c in enumerate(r.h) if c == " "]
        assert r.w == [t for t in (r.h[i : i + r.n] for i in starts) if any(p in t for p in r.p)], r


def test_text_is_normalised_once_for_all_spellings_of_a_date(spark):
    plan = spark.sql("SELECT DATE'2020-01-02' AS d, concat('x ', id) AS t FROM range(1)").select(verify.date_present("d", "t"))._jdf.queryExecution().analyzed().toString()
    hays = [x.lstrip() for x in plan.lower().split("lambdafunction(contains(")[1:]]
    assert hays and all(x.startswith(("lambda x", "namedlambdavariable")) for x in hays)


def test_few_windows_of_a_long_text_are_compared(spark):
    name, text = "maximiliana theodora von hohenfels wittgenau", "the visit was on a rainy day and all went well " * 2000
    rows = [(text,), (f"{text} maximiliana theodore von hohenfels wittgenau {text}",)]
    sizes = [r.n for r in spark.createDataFrame(rows, "t string").select(F.size(verify.candidate_windows(F.lit(name), F.rtrim("t"))).alias("n")).collect()]
    assert sizes[0] <= 6 < sizes[1] <= 24  # of 22,000 and 44,000; the first are those at the end, where no slack is left


@pytest.mark.parametrize("name", ["fuzzy_identity", "indexed_search"])
def test_long_row_groups_are_dealt_over_the_cores(spark, name, tmp_path, monkeypatch):
    """A file of one row group is cut into splits of which only one has rows."""
    from chartweave import driver_queries
    one = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    one.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    written = []
    monkeypatch.setattr(search, "write_index", lambda df, folder, write=search.write_index: (written.append(df), write(df, folder)))
    try:
        got = driver_queries.QUERIES[name](spark, str(tmp_path))
        sizes = [r["count"] for r in (written or [got])[0].groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(sizes) < one.count() / 2


def test_trigrams_of_a_long_chunk_are_cut_in_one_pass(spark, tmp_path, monkeypatch):
    """Cutting each by its place counts characters from the start: quadratic in the chunk."""
    monkeypatch.setattr(search, "CHUNK", 300_000)
    text = "".join(chr(97 + (i * i // 7 + i) % 26) for i in range(250_000)) + " \U0001f600\nzq"
    started = time.monotonic()
    search.write_index(spark.createDataFrame([(1, "n", text)], "id int, display_name string, search string"), str(tmp_path / "i"))
    assert time.monotonic() - started < 30
    hay = text.lower() + " n  "
    assert {r.gram for r in spark.read.parquet(str(tmp_path / "i/postings")).collect()} == {hay[i : i + 3] for i in range(len(hay) - 2)}


def test_swapped_chart_fails_identity(spark):
    page = "Clinic chart. Patient: {} Date of birth: {} Boilerplate that every chart shares."
    rows = [("ok", page.format("Anna Lee", "May 6, 1970"), "Anna Lee", "1970-05-06"), ("swapped", page.format("John Doe", "May 6, 1970"), "Anna Lee", "1970-05-06"), ("dob", page.format("Anna Lee", "May 7, 1970"), "Anna Lee", "1970-05-06"), ("noname", "x", None, None)]
    df = spark.createDataFrame(rows, "item_key string, text string, display_name string, b string").withColumn("birth_date", F.col("b").cast("date"))
    got = {r.item_key: r.status for r in verify.verify_identity(df).collect()}
    assert got == {"ok": "pass", "swapped": "fail", "dob": "fail", "noname": "skip"}


def test_files_of_encounters_are_never_sent_to_the_driver(spark):
    from chartweave.sinks.archive import archive_encounters

    enc = spark.sql("SELECT concat('p', id % 1) AS patient_id, concat('e-', id) AS encounter_id, DATE'2020-01-02' AS date_of_service, 'x' AS encounter_type, 'x' AS note_type, 'x' AS chief_complaint, array(named_struct('kind', 'k', 'title', 't', 'text', 'x')) AS sections FROM range(3)")
    docs = spark.sql("SELECT concat('p', id % 1) AS patient_id, concat('x_01-02-2020_longer-than-eight_e', id, '.pdf') AS file_name FROM range(1, 3)")
    verdicts = spark.sql("SELECT concat('e-', id) AS encounter_id, 'pass' AS verdict FROM range(1, 2)")
    out = archive_encounters(enc, docs, verdicts)
    assert {(r.encounter_id, r.pdf_name, r.qa_verdict) for r in out.collect()} == {
        ("e-0", "x_01-02-2020_longer-than-eight_e1.pdf", None), ("e-1", "x_01-02-2020_longer-than-eight_e1.pdf", "pass"), ("e-2", "x_01-02-2020_longer-than-eight_e2.pdf", None)}
    for df in (joins.match_documents(enc, docs), out):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_flowsheet_maps_its_inputs_once(spark):
    """Encounters and vitals are read several times: what they are mapped from is not in the plan that reads them."""
    enc = spark.range(6).selectExpr("'p' AS patient_id", "id AS encounter_id", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS date_of_service")
    obs = spark.range(6).selectExpr("id AS encounter_id", "'vital-signs' AS category", "'8302-2' AS code", "'h' AS display", "CAST(id AS STRING) AS value", "id AS _ord")
    got = views.vitals_flowsheet(enc, obs, k=2)
    assert "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.encounter_id, r.column_no, r.value) for r in got.collect()) == [(i, n, str(i - n)) for i in range(6) for n in (1, 2) if i >= n]
