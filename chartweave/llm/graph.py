"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Each node of an undirected edge table ``(a, b)`` with the smallest node it can reach.

    Large-star and small-star steps in turn until the edges no longer change; every
    round is written to the shared folder, so its cost doesn't add up. Returns
    ``(node, root)``; self loops and repeated edges do no harm, null ends are left out.
    Raises if ``max_rounds`` rounds are not enough (they grow with the log of the diameter).
    """
    cur = stage(_canonical(edges.select("a", "b")), "edges")
    mark = _mark(cur)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        cur = stage(_small_star(_large_star(cur)), "edges")
        new = _mark(cur)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    """Larger end first, each edge once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _canonical(moved.unionByName(low.select("a", F.col("m").alias("b"))))
