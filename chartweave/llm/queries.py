"""The operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartweave.llm import decontaminate, divergence, fim, html_text, language, lm, mixing, neighbours, oracle, quality_net, secret_scan, simhash, tokens, toxicity
from chartweave.llm.common import load

MIX = mixing.Mix(share=0.6, epochs=2, seed=17, weights={("web",): 3.0, ("curated",): 1.0, ("web", "en"): 2.0, ("curated", "de"): 3.0, ("web", "en", "src0"): 4.0})


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(load(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_by_id(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths by source, with its suffix sums."""
    counts = tokens.token_counts(load(spark, sf_dir, "documents"), ["source"])
    return tokens.suffix_sums(tokens.length_histogram(counts, ["source"]), ["source"])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a mixture of 60 % of all tokens takes, and in which epochs."""
    return mixing.select_ids(mixing.with_tree(load(spark, sf_dir, "documents")), MIX).withColumnRenamed("id", "doc_id")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(load(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.evaluate(load(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"), ["page_id", "url"])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(load(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(load(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.predict(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


_ALL = (op1_secret_scan, op2_toxicity, op3_nearest_vectors, op4_language_id, op5_decontamination, op6_token_lengths, op7_source_mixing, op8_simhash_groups, op9_lm_score, op10_main_text, op11_fill_in_middle, op12_source_divergence, op13_quality)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op1_secret_scan": oracle.secrets(), "op5_decontamination": oracle.contamination(), "op7_source_mixing": oracle.mixing(MIX), "op11_fill_in_middle": oracle.fill_in_middle(), "op12_source_divergence": oracle.divergence()}
