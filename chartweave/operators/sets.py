"""Set operations and the lossless tail."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.text import clean_cell


def unify(*tables: DataFrame) -> DataFrame:
    """SET-01. Rows of every source in one table, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def residual(columns: Sequence[str], mapped: Sequence[str], namespace: str, skip: Sequence[str] = ("_ord", "_src")) -> Column:
    """SET-02. Map of every filled column that no mapping consumed."""
    rest = [c for c in columns if c not in mapped and c not in skip]
    if not rest:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(f"{namespace}:{c}").alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in rest])
    return F.map_from_entries(F.filter(pairs, lambda p: clean_cell(p["value"]).isNotNull()))


def overlay(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """SET-03. The second set replaces the first by key."""
    return base.join(extra.select(key).distinct(), key, "left_anti").unionByName(extra, allowMissingColumns=True)


def enqueue(items: DataFrame, ledger: DataFrame, key: str = "item_key") -> DataFrame:
    """SET-05. Items the ledger does not know yet, one row per key."""
    fresh = items.join(ledger.select(key).distinct(), key, "left_anti")
    return fresh.dropDuplicates([key])


def column_coverage(df: DataFrame, mapped: Sequence[str], skip: Sequence[str] = ("_ord", "_src")) -> DataFrame:
    """LOSS-04. Filled count and fate of each column, in one pass."""
    cols = [c for c in df.columns if c not in skip]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(clean_cell(F.col(f"`{c}`").cast("string"))).alias(f"n{i}") for i, c in enumerate(cols)],
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("filled"), F.lit(c in mapped).alias("used")) for i, c in enumerate(cols)]
    )
    out = counts.select(F.col("_n").alias("n_rows"), F.explode(entries).alias("e"))
    fate = F.when(F.col("e.filled") == 0, "empty").when(F.col("e.used"), "consumed").otherwise("carried")
    return out.select(F.col("e.column_name"), F.col("e.filled"), "n_rows", fate.alias("fate"))


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """LOSS-05. Child keys with no parent, with their row counts."""
    counts = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(parent.select(key).distinct(), key, "left_anti")
