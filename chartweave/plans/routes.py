"""Delivery routes per destination (LG-11, LG-12, SRC-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators.sets import overlay

# Route preference, and which kinds make a route viable.
ROUTES = (("doc_write_api", "vendor_api", 1), ("ccda_import", "ccda_import", 2), ("browser", "browser", 3))
VIABLE = {"doc_write_api": ("fhir_documentreference", "vendor_rest"), "ccda_import": ("api", "in_product"), "browser": ("pack",)}
NO_EVIDENCE_NEEDED = ("none", "unverified", "pack")


def read_registry(base: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """SRC-10. Capability rows; a user's own entries replace the base by name."""
    return base if extra is None else overlay(base, extra, "destination")


def capabilities(registry: DataFrame) -> DataFrame:
    """One row per destination and capability: kind, source URL, verified date."""
    entries = F.array(*[
        F.struct(F.lit(cap).alias("capability"), F.lit(route).alias("route"), F.lit(rank).alias("preference"), F.col(f"{cap}_kind").alias("kind"), F.col(f"{cap}_url").alias("source_url"), F.col(f"{cap}_verified").alias("verified"))
        for cap, route, rank in ROUTES])
    return registry.select("destination", F.explode(entries).alias("c")).select("destination", "c.*")


def plan_routes(registry: DataFrame) -> DataFrame:
    """LG-11. Every route of every destination, viable or not, and the chosen one."""
    caps = capabilities(registry)
    viable = F.lit(False)
    for cap, kinds in VIABLE.items():
        viable = viable | ((F.col("capability") == cap) & F.col("kind").isin(*kinds))
    routed = caps.withColumn("viable", F.coalesce(viable, F.lit(False)))
    best = routed.filter("viable").groupBy("destination").agg(F.min("preference").alias("_best"))
    out = routed.join(best, "destination", "left")
    return out.select("destination", "route", "kind", "viable", F.coalesce(F.col("preference") == F.col("_best"), F.lit(False)).alias("chosen"))


def evidence_report(registry: DataFrame, local: DataFrame, max_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """LG-12. (claims without evidence, destinations whose local pack is stale).

    ``local`` has ``destination, local_date``.
    """
    caps = capabilities(registry)
    claim = F.col("kind").isNotNull() & ~F.col("kind").isin(*NO_EVIDENCE_NEEDED)
    backed = F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(False)) & F.col("verified").isNotNull()
    gaps = caps.filter(claim & ~backed).select("destination", "capability", "kind")
    newest = caps.groupBy("destination").agg(F.max("verified").alias("evidence_date"))
    aged = newest.join(local, "destination").withColumn("gap_days", F.datediff("evidence_date", "local_date"))
    return gaps, aged.filter(F.col("gap_days") > max_days)
