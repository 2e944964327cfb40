"""Greedy ranges and exact quantiles of whole tables, without one list or one sort.

``greedy_ranges`` walks from a start to the first value beyond its reach, which looks like
a loop over all values. Here every value knows its successor, and the walk from the first
value is found by pointer doubling: after k rounds all steps up to 2**k are known, so log n
equality joins do. ``exact_quantiles`` counts values in ranges and looks closer at the one
that holds the wanted rank, until it holds one value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.operators.windows import block_scan
from chartweave.session import cut_lineage

#: Values are compared to this fraction of a unit.
MICRO = 1_000_000
#: Reaches of the tolerance in one block of the ordered scans, and ranges counted in a round.
REACHES, CELLS = 64, 1024


def greedy_ranges(values: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Buckets of (``v``, ``w``) rows per key: ``(*keys, mean, total)``, means rounded to 0.1.

    A bucket starts at the smallest value not yet in one and takes all up to ``tolerance``
    beyond it. Values are compared to a millionth. Null values are left out, null keys are keys.
    """
    reach = round(tolerance * MICRO)
    own = ["_k"] if keys else []
    rows = values.filter(F.col("v").isNotNull())
    if keys:
        rows = rows.withColumn("_k", F.to_json(F.struct(*keys)))
    # Distinct values are few where positions are rounded; the rest works on them alone.
    micro = F.round(F.col("v").cast("double") * MICRO).cast("bigint")
    exact = cut_lineage(rows.groupBy(*own, micro.alias("u")).agg(F.sum("w").alias("w"), *(F.first(c).alias(c) for c in keys)))
    marked = _starts(exact, own, reach)
    placed = block_scan(marked, own, ["u"], F.floor(F.col("u") / (REACHES * reach)), {"start": ("last", F.when(F.col("on"), F.col("u")))})
    # Whole numbers, so that the order of the sum doesn't matter.
    total = F.sum("w")
    mean = F.sum(F.col("u").cast("decimal(20,0)") * F.col("w").cast("decimal(18,0)")).cast("double") / total / MICRO
    out = placed.groupBy(*own, "start").agg(F.round(mean, 1).alias("mean"), total.cast("bigint").alias("total"), *(F.first(c).alias(c) for c in keys))
    return out.select(*keys, "mean", "total")


def _starts(exact: DataFrame, own: list[str], reach: int) -> DataFrame:
    """``exact`` with ``on``: whether a bucket starts at the value ``u`` of key ``own``."""
    value = exact.select("*", F.col("u").alias("x"), F.lit(0).alias("probe"))
    probe = exact.select("*", (F.col("u") + reach).alias("x"), F.lit(1).alias("probe"))
    # From above: a probe comes before the value it equals, so it sees what lies beyond only.
    order = [-F.col("x"), -F.col("probe")]
    seen = block_scan(value.unionByName(probe), own, order, -F.floor(F.col("x") / (REACHES * reach)), {"next": ("last", F.when(F.col("probe") == 0, F.col("x")))})
    chain = seen.filter("probe = 1").drop("x", "probe")
    head = exact.groupBy(*own).agg(F.min("u").alias("u")).withColumn("on", F.lit(True))
    now = cut_lineage(chain.join(head, [*own, "u"], "left").withColumn("on", F.coalesce("on", F.lit(False))))
    while not now.filter("on AND next IS NOT NULL").isEmpty():
        now = cut_lineage(_doubled(_doubled(now, own), own))
    return now.drop("next")


def _doubled(now: DataFrame, own: list[str]) -> DataFrame:
    """Each pointer of ``(*own, u, next, on)`` twice as long, and what starts point to marked as starts."""
    further = now.select(*own, F.col("u").alias("next"), F.col("next").alias("after"))
    moved = now.join(further, [*own, "next"], "left").drop("next").withColumnRenamed("after", "next")
    reached = now.filter("on AND next IS NOT NULL").select(*own, F.col("next").alias("u"), F.lit(True).alias("hit")).distinct()
    return moved.join(reached, [*own, "u"], "left").withColumn("on", F.col("on") | F.coalesce("hit", F.lit(False))).drop("hit")


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column | str, float]]) -> dict[str, float | None]:
    """Quantiles with linear interpolation between the two neighbouring ranks, one for each name.

    ``wanted`` maps a name to an expression and a share from 0 to 1. Nulls and NaN are left
    out; without a value the quantile is None. Each round reads the rows once for all names,
    and what comes to the driver is ``CELLS`` counts for each of two ranks a name.
    """
    # Names may be anything, so the columns are numbered.
    names, wanted = {f"c{i}": k for i, k in enumerate(wanted)}, {f"c{i}": x for i, x in enumerate(wanted.values())}
    columns = {k: (F.col(c) if isinstance(c, str) else c).cast("double") for k, (c, _) in wanted.items()}
    rows = df.select(*(F.when(~F.isnan(c), c).alias(k) for k, c in columns.items()))
    first = rows.agg(*(f(k).alias(f"{k}_{n}") for k in wanted for n, f in (("n", F.count), ("low", F.min), ("high", F.max)))).first()
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    for k, (_, q) in wanted.items():
        n = first[f"{k}_n"]
        for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))} if n else ():
            open_[k, rank] = (first[f"{k}_low"], first[f"{k}_high"], 0)
    while open_:
        settled = {t: low for t, (low, high, _) in open_.items() if low == high}
        found |= settled
        open_ = {t: x for t, x in open_.items() if t not in settled}
        if not open_:
            break
        ranges = {(k, low, high) for (k, _), (low, high, _) in open_.items()}
        counts = _counted(rows, sorted(ranges))
        for (k, rank), (low, high, below) in open_.items():
            for _, n, least, most in counts[k, low, high]:
                if rank < below + n:
                    open_[k, rank] = (least, most, below)
                    break
                below += n
    out: dict[str, float | None] = {}
    for k, (_, q) in wanted.items():
        n = first[f"{k}_n"]
        if not n:
            out[names[k]] = None
            continue
        at = q * (n - 1)
        low, high, part = found[k, math.floor(at)], found[k, math.ceil(at)], at - math.floor(at)
        out[names[k]] = low * (1 - part) + high * part
    return out


def _counted(rows: DataFrame, ranges: list[tuple[str, float, float]]) -> dict:
    """For each range its cells in order: ``(cell, values, smallest, largest)``."""
    each = []
    for i, (k, low, high) in enumerate(ranges):
        # Halves before the difference, so that the widest range of doubles stays finite. The
        # largest value has the last cell for itself, so every round tells some values apart.
        share = F.coalesce(F.try_divide(F.col(k) / 2 - low / 2, F.lit(high / 2 - low / 2)), F.lit(0.0))
        cell = F.when(F.col(k) == high, CELLS - 1).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 2))).cast("int")
        each.append(F.when(F.col(k).between(low, high), F.struct(F.lit(i).alias("i"), cell.alias("cell"), F.col(k).alias("v"))))
    cells = rows.select(F.explode(F.array_compact(F.array(*each))).alias("c")).select("c.*").groupBy("i", "cell").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out: dict = {r: [] for r in ranges}
    for r in sorted(cells.collect(), key=lambda r: (r.i, r.cell)):
        out[ranges[r.i]].append((r.cell, r["n"], r.low, r.high))
    return out


def counted_medians(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(*keys, median)`` from the counts of each key's distinct values.

    For values that are rounded, so that a key has few distinct ones: the running count over
    these, not over the rows, tells where the middle lies. Nulls are left out.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    rank = block_scan(counts, keys, [value], F.floor(F.col(value)), {"_upto": ("sum", "_w")})
    size = counts.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    both = rank.join(size, list(keys))
    # The first value whose running count passes half, and the one that holds the next rank.
    low = F.min(F.when(F.col("_upto") * 2 >= F.col("_n"), F.col(value)))
    high = F.min(F.when(F.col("_upto") * 2 > F.col("_n"), F.col(value)))
    return both.groupBy(*keys).agg(((low + high) / 2).alias("median"))
