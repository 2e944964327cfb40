"""Ordered operators that do not depend on the size of one group.

A plain window sends a whole group through one task. Where a key may hold a
large part of the table, ``block_scan`` gives the same answers from bounded
pieces: rows are numbered inside (key, block), each block is summarised once,
and the summaries, one row per block, carry the running state from block to
block. The block must be a function that never decreases along the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def order_block(ord_col: Column | str = "_ord", bits: int = BLOCK_BITS) -> Column:
    """Block of a row id: at most ``2**bits`` consecutive ids share one."""
    return F.shiftright(_c(ord_col).cast("bigint"), bits)


def with_source_order(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Row position of rows that don't come from files: rising within a partition, partition after partition."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Bits of a row's number within its file; the number of the file stands above.
FILE_ROW_BITS = 40


def file_blocks(*scans: DataFrame) -> DataFrame:
    """``(_path, _start, _first, _base)``: a row for each split of the scanned files.

    ``_base`` is the order of the split's first row: files are numbered by path, over all
    scans, and rows within a file by adding up what the splits before hold. ``_first`` is the
    scan's own id of that row. One row for 128 MB of input: 100 TB have 800,000.
    """
    counted = reduce(DataFrame.unionByName, [_located(s).groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")) for s in scans])
    files = counted.select("_path").distinct().withColumn("_file", F.row_number().over(Window.orderBy("_path")) - 1)
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    base = F.shiftleft(F.col("_file").cast("bigint"), FILE_ROW_BITS) + F.coalesce(F.sum("_n").over(before), F.lit(0))
    return counted.join(files, "_path").select("_path", "_start", "_first", base.alias("_base"))


def _located(scan: DataFrame, *cols: str) -> DataFrame:
    return scan.select(*cols, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))


def with_file_order(scan: DataFrame, blocks: DataFrame | None = None, name: str = "_ord") -> DataFrame:
    """SRC-07. Row order of a fresh scan: files by path, rows by their place in the file.

    It is the same on every run and for every split size: the rows of a split stand together
    in the scan's own ids, and ``blocks`` (``file_blocks`` of all scans that share an order)
    says where the split begins. That takes a first pass that only counts rows.
    """
    blocks = file_blocks(scan) if blocks is None else blocks
    # The hint is safe: a row for each split.
    placed = _located(scan, "*").join(F.broadcast(blocks), ["_path", "_start"])
    return placed.select(*scan.columns, (F.col("_base") + F.col("_id") - F.col("_first")).alias(name))


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column | str,
    specs: Mapping[str, tuple[str, Column | str | None]],
) -> DataFrame:
    """Running values per key, in order, added as columns.

    ``specs`` maps a new column to ``(kind, expression)`` where kind is
    ``row_number``, ``sum`` (inclusive), ``lag`` (previous row's value) or
    ``last`` (latest non-null value up to and including the row).
    """
    order = [_c(o) for o in order]
    d = df.withColumn("_blk", _c(block))
    local = Window.partitionBy(*keys, "_blk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    sortable = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])

    partial, summary, carry, final = {}, [], {}, {}
    across = Window.partitionBy(*keys).orderBy("_blk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, (kind, expr)) in enumerate(specs.items()):
        s, c, p = f"_s{i}", f"_c{i}", f"_p{i}"
        if kind == "row_number":
            partial[p] = F.row_number().over(local).cast("bigint")
            summary.append(F.count(F.lit(1)).alias(s))
            carry[c] = F.coalesce(F.sum(s).over(before), F.lit(0))
            final[name] = F.col(p) + F.col(c)
        elif kind == "sum":
            partial[p] = F.coalesce(F.sum(_c(expr)).over(upto), F.lit(0))
            summary.append(F.sum(_c(expr)).alias(s))
            carry[c] = F.coalesce(F.sum(s).over(before), F.lit(0))
            final[name] = F.col(p) + F.col(c)
        elif kind == "lag":
            d = d.withColumn(f"_v{i}", _c(expr))
            partial[p] = F.lag(f"_v{i}").over(local)
            partial[f"_f{i}"] = F.row_number().over(local)
            summary.append(F.max_by(F.struct(F.col(f"_v{i}").alias("v")), sortable).alias(s))
            carry[c] = F.lag(s).over(across)
            final[name] = F.when(F.col(f"_f{i}") == 1, F.col(f"{c}.v")).otherwise(F.col(p))
        elif kind == "last":
            d = d.withColumn(f"_v{i}", _c(expr))
            partial[p] = F.last(f"_v{i}", ignorenulls=True).over(upto)
            summary.append(
                F.max_by(F.col(f"_v{i}"), F.when(F.col(f"_v{i}").isNotNull(), sortable)).alias(s)
            )
            carry[c] = F.last(s, ignorenulls=True).over(before)
            final[name] = F.coalesce(F.col(p), F.col(c))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    numbered = d.withColumns(partial)
    blocks = d.groupBy(*keys, "_blk").agg(*summary).select(*keys, "_blk", *[v.alias(k) for k, v in carry.items()])
    joined = numbered.join(blocks, [*keys, "_blk"], "left")
    return joined.select(*[F.col(c) for c in df.columns], *[v.alias(k) for k, v in final.items()])


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the earliest by order (partial aggregation, no window)."""
    return _pick(df, keys, order, F.min_by)


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the latest by order."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    sortable = F.struct(*[_c(o).alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(by(F.struct(*rest), sortable).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def longest_match(candidates: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """WIN-01. Per key the candidate with the longest text; ties by text."""
    return last_row(candidates, keys, [F.length(text), text])


def allocate_names(
    docs: DataFrame, name: str, id_col: str, order: Sequence[Column | str], out: str = "file_name"
) -> DataFrame:
    """WIN-03. The first claimant keeps a name, later ones get an id suffix.

    The first claimant is found by a partial aggregate per name and joined
    back, so a name claimed by very many documents is not gathered.
    """
    sortable = F.struct(*[_c(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(id_col).alias("oid"))
    first = docs.groupBy(name).agg(F.min_by(id_col, sortable).alias("_first"))
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    extension = F.regexp_extract(F.col(name), r"\.[^.]*$", 0)
    suffix = F.substring(F.replace(F.col(id_col).cast("string"), F.lit("-"), F.lit("")), 1, 8)
    given = F.when(F.col(id_col) == F.col("_first"), F.col(name)).otherwise(
        F.concat(stem, F.lit("-"), suffix, extension)
    )
    return docs.join(first, name).withColumn(out, given).drop("_first")


def pending(items: DataFrame, states: Sequence[str], limit: int | None = None) -> DataFrame:
    """WIN-06. Items that still owe work, in key order."""
    work = items.filter(F.col("state").isin(*states)).orderBy("item_key")
    return work if limit is None else work.limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """WIN-07. The newest run by start time, then id."""
    return runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def search_tokens(query: str) -> list[str]:
    """The different words of a query."""
    return list(dict.fromkeys(t for t in query.lower().split() if t))


def search_hay() -> Column:
    """What a page of a search index is searched in."""
    return F.concat(F.lower(F.coalesce(F.col("search"), F.lit(""))), F.lit(" "), F.lower(F.coalesce(F.col("display_name"), F.lit(""))))


def search_patients(index: DataFrame, query: str) -> DataFrame:
    """WIN-08. Ranked search: every token must occur on some page of an entry; name hits rank higher."""
    tokens = search_tokens(query)
    name, hay = F.lower(F.coalesce(F.col("display_name"), F.lit(""))), search_hay()
    hits = {f"_h{i}": hay.contains(t) for i, t in enumerate(tokens)}
    some, every = F.lit(not tokens), F.lit(True)
    for c in hits:
        some, every = some | F.col(c), every & F.col(c)
    # Only pages with a hit go on, and of them a few flags.
    pages = index.select("id", "display_name", *[h.alias(c) for c, h in hits.items()]).filter(some)
    found = pages.groupBy("id", "display_name").agg(F.count(F.lit(1)).alias("_n"), *[F.bool_or(c).alias(c) for c in hits]).filter(every)
    scores = [F.lit(0), F.lit(0)] if tokens else [F.lit(1), F.lit(1)]
    scores += [F.when(name.startswith(t), 3).when(name.contains(t), 2).otherwise(1) for t in tokens]
    return found.select("id", "display_name", F.greatest(*scores).alias("score")).orderBy(F.desc("score"), "display_name")
