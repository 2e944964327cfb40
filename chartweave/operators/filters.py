"""Selections that keep the rows they drop."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.functions.dates import age_at, parse_dt
from chartweave.functions.text import clean_cell, strip

ADULT_AGE = 18
PROBLEM_PREFIXES = ("problem:", "problem ", "diagnosis:")
ALLERGY_PREFIXES = ("allergy:", "allergy ", "allergen:")


def has_note(sections: Column | str) -> Column:
    """FLT-04. Any section has visible text."""
    return F.exists(sections, lambda s: F.coalesce(strip(s["text"]), F.lit("")) != "")


def skip_reason(has_content: Column, complaint: Column | str, birth: Column | str, service: Column | str) -> Column:
    """FLT-01. Why an encounter is not shown, NULL when it is."""
    growth = F.lower(F.coalesce(F.col(complaint) if isinstance(complaint, str) else complaint, F.lit(""))).contains("growth chart")
    adult = F.coalesce(age_at(birth, service) >= ADULT_AGE, F.lit(False))
    return F.when(~has_content, F.lit("empty_soap")).when(growth & adult, F.lit("adult_growth_chart"))


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the others with it; nothing is lost."""
    marked = df.withColumn("skip_reason", reason)
    return marked.filter(F.col("skip_reason").isNull()).drop("skip_reason"), marked.filter(F.col("skip_reason").isNotNull())


def is_current(valid_until: Column | str) -> Column:
    """FLT-02. The row is the open version: no real end instant."""
    return parse_dt(clean_cell(valid_until)).isNull()


def current_versions(df: DataFrame, col: str = "VALID_UNTIL_DT_TM") -> tuple[DataFrame, DataFrame]:
    """FLT-02. (open versions, superseded versions)."""
    flagged = df.withColumn("_open", is_current(col))
    return flagged.filter("_open").drop("_open"), flagged.filter("NOT _open").drop("_open")


def route_event(title: Column | str) -> Column:
    """FLT-08. problem / allergy / other, by the title's prefix."""
    t = F.lower(F.col(title) if isinstance(title, str) else title)

    def starts(prefixes: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for p in prefixes:
            test = test | t.startswith(p)
        return F.coalesce(test, F.lit(False))

    return F.when(starts(PROBLEM_PREFIXES), "problem").when(starts(ALLERGY_PREFIXES), "allergy").otherwise("other")


def read_skiplist(spark: SparkSession, path: str) -> DataFrame:
    """FLT-09. Keys of a skiplist file; comments and blanks are ignored."""
    line = strip("value")
    lines = spark.read.text(path).select(line.alias("skip_key"))
    return lines.filter((F.col("skip_key") != "") & ~F.col("skip_key").startswith("#")).distinct()


def apply_skiplist(items: DataFrame, skip: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-09. (items to process, skipped items), by item key or encounter id."""
    k1 = skip.select(F.col("skip_key").alias("item_key"), F.lit(True).alias("_s1")).distinct()
    k2 = skip.select(F.col("skip_key").alias("encounter_id"), F.lit(True).alias("_s2")).distinct()
    marked = items.join(k1, "item_key", "left").join(k2, "encounter_id", "left")
    hit = F.coalesce("_s1", "_s2", F.lit(False))
    marked = marked.withColumn("_hit", hit).drop("_s1", "_s2")
    return marked.filter("NOT _hit").drop("_hit"), marked.filter("_hit").drop("_hit")


def resolve_flags(defaults: Mapping[str, bool], overrides: Mapping[str, bool]) -> dict[str, bool]:
    """FLT-10. Section flags: defaults plus strict overrides."""
    unknown = sorted(set(overrides) - set(defaults))
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(unknown)}; known: {', '.join(sorted(defaults))}")
    return {**defaults, **overrides}


def is_smoking_status(category: Column | str, code: Column | str, display: Column | str) -> Column:
    """FLT-11. A social-history row that states tobacco use."""
    cat, c, d = (F.col(x) if isinstance(x, str) else x for x in (category, code, display))
    return (cat == "social-history") & (F.coalesce(c == "72166-2", F.lit(False)) | (c.isNull() & F.coalesce(d == "Tobacco use", F.lit(False))))
