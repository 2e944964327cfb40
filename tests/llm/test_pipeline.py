"""The pipeline: each stage on what its predecessor kept, against brute force, and its queries' SQL."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from chartweave.llm import language, mixing, secret_scan
from chartweave.llm.common import load, stage
from chartweave.llm.queries import MIX, SQL
from tests.llm import brute
from tests.llm.test_first_five import odd
from tests.llm.test_shingle_dedup import lowest_ids
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def planted(spark):
    """The given documents with rows added whose fate is known."""
    docs = load(spark, SF, "documents")
    item = load(spark, SF, "benchmark").orderBy("item_id").first().text
    rng = random.Random(7)
    long = " ".join(rng.choice("the of and inanan thonre eredwh tionhe onnder".split()) for _ in range(300))
    near = long.replace("thonre", "thonrx", 1)
    rows = [(9001, long), (9002, long), (9003, near), (9004, item), (9005, long[::-1] + " of the " + item.upper() + " and on"), (9006, None), (9007, "123 --"), (9008, "the inanan of password=abcdef1234 and the thonre"), (9009, "")]
    return docs.unionByName(spark.createDataFrame([(i, t, "en", "src3", len(t or "")) for i, t in rows], docs.schema))


def test_stages_send_small_batches(spark):
    """Each stage limits the rows of a batch itself, as stages are also run alone."""
    for _, step in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert hasattr(step, "__wrapped__")
        with pytest.raises(AttributeError):
            step(spark, None, SF)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(corpus_pipeline.BATCH_ROWS)


def test_stages_one_by_one(spark):
    docs, fate = stage(planted(spark)), {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "source_mixing"]
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(step(spark, docs, SF))
        if name != "source_mixing":
            assert after.columns == docs.columns
        rows = after.collect()
        kept = {r.doc_id for r in rows}
        fate[name] = set(before) - kept
        if name == "language_id":
            assert fate[name] == {9006, 9007, 9009}
        if name == "near_dedup":
            assert sorted(kept) == lowest_ids([(i, r.text) for i, r in before.items()]) and fate[name] >= {9002, 9003}
        if name == "decontamination":
            hit = brute.contamination([(i, r.text) for i, r in before.items()], [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()])
            assert fate[name] == {h[0] for h in hit if h[-1]} and {9004, 9005} <= fate[name]
        if name == "secret_scan":
            found = {i: brute.secrets(r.text, secret_scan.Rules(), secret_scan.WINDOW, secret_scan.KINDS)[-1] for i, r in before.items()}
            for r in rows:
                assert (r.text == before[r.doc_id].text) == (not found[r.doc_id]) and (secret_scan.MARK in r.text) >= bool(found[r.doc_id])
                assert not found[r.doc_id] or r.n_chars == len(r.text)
            assert not fate[name] and any(found.values())
        if name == "source_mixing":
            plain = [tuple(x) for x in mixing.with_tree(docs).collect()]
            assert sorted((r.doc_id, r.epoch) for r in rows) == sorted((x[3], x[-1]) for x in brute.mix_rows(plain, MIX))
            assert all(r.text == before[r.doc_id].text for r in rows)
        docs = after


def test_run_is_all_stages(spark):
    docs = load(spark, SF, "documents")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.epoch, r.text) for r in got.collect()) == sorted((r.doc_id, r.epoch, r.text) for r in docs.collect())


def test_stages_stand_odd_rows_and_empty_tables(spark):
    for docs in (odd(spark), odd(spark).limit(0)):
        for _, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SF))
        assert docs.columns[:-1] == odd(spark).columns


def test_stages_keep_columns_with_clashing_names(spark):
    """Every name that the stages use inside, and those of their results."""
    names = "_text _added secret_base secret_all secret_added clear row gone_key twice_key own_key place _gone _twice _key _n contaminated_key _bad leaf_domain leaf_lang leaf_source leaf_full leaf_last times _domain _lang _full key fp id root component".split()
    docs = load(spark, SF, "documents").filter("doc_id < 60").withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in names})
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
    rows = docs.collect()
    assert docs.columns[5:] == [*names, "epoch"] and rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)


def test_language_stage_refuses_a_table_without_languages(spark):
    docs = load(spark, SF, "documents").withColumn("lang", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="language"):
        language.keep_identified(docs)
    assert language.keep_identified(docs.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    ok, n, _, note = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok and n, note


def test_language_stage_keeps_every_document_with_a_known_language(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    kept = language.keep_identified(docs)
    assert kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_registered():
    ops = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in ops] == list(range(1, 14)) and "pipeline" in entry.queries()
