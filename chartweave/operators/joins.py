"""Joins and lookups. Only equality joins: everything shuffles on its keys.

No side is broadcast by hint. Small dimensions become broadcast joins through
the size check of adaptive execution, and large ones stay sort-merge joins with
skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.functions.text import clean_cell, safe_token
from chartweave.operators.windows import BLOCK_BITS, block_scan, first_row, last_row, longest_match, order_block
from chartweave.session import cut_lineage

PAGE_ROWS = 1000


def keyed(df: DataFrame, col: str) -> DataFrame:
    """FLT-03. Rows with a usable join key, cleaned."""
    return df.withColumn(col, clean_cell(col)).filter(F.col(col).isNotNull())


def paged_collect(
    child: DataFrame,
    keys: Sequence[str],
    item: Column,
    order: Sequence[Column | str] = ("_ord",),
    block: Column | None = None,
    page_rows: int = PAGE_ROWS,
    as_: str = "items",
) -> DataFrame:
    """JN-01. Child rows of a key as ordered arrays of at most ``page_rows``.

    A normal key has one page. A key with very many children has more, so no
    array and no task holds an unbounded group.
    """
    block = order_block(order[-1]) if block is None else block
    numbered = block_scan(child, keys, order, block, {"_rn": ("row_number", None)})
    page = F.floor((F.col("_rn") - 1) / page_rows).cast("bigint")
    packed = numbered.withColumn("page", page).withColumn("_e", F.struct(F.col("_rn").alias("rn"), item.alias("v")))
    lists = packed.groupBy(*keys, "page").agg(F.collect_list("_e").alias("_l"))
    in_order = F.array_sort("_l", lambda a, b: F.when(a["rn"] < b["rn"], -1).when(a["rn"] > b["rn"], 1).otherwise(0))
    return lists.select(*keys, "page", F.transform(in_order, lambda e: e["v"]).alias(as_))


def attach(
    parent: DataFrame,
    child: DataFrame,
    on: str,
    item: Column,
    as_: str,
    order: Sequence[Column | str] = ("_ord",),
    block: Column | None = None,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """JN-01. Parent rows with their children; childless parents get an empty array."""
    pages = paged_collect(child, [on], item, order, block, page_rows, as_)
    joined = parent.join(pages, on, "left")
    return joined.withColumn("page", F.coalesce("page", F.lit(0).cast("bigint"))).withColumn(
        as_, F.coalesce(F.col(as_), F.array().cast(joined.schema[as_].dataType))
    )


def assemble_records(
    parent: DataFrame,
    children: Mapping[str, tuple[DataFrame, Column, Sequence[Column | str], Column | None]],
    on: str = "patient_id",
    page_rows: int = PAGE_ROWS,
    whole_rows: int = 1 << BLOCK_BITS,
) -> DataFrame:
    """JN-02/03. One record per parent: its row plus one array per child table.

    ``children`` maps a name to ``(table, item, order, block)``. Each table is written once, and
    their rows become one table, each with its item in a column of its own. Page 0 carries the
    parent row; a record with very many children continues on later pages.

    The rows of a parent with ``whole_rows`` of them at most are dealt by parent: they are numbered
    and meet on their pages in that one shuffle. Of a parent with more, which may hold a third of
    all children, the rows are numbered in bounded blocks and meet in a second shuffle.
    """
    width = max((len(order) for _, _, order, _ in children.values()), default=1)
    places = [f"_o{i}" for i in range(width)]
    row = F.struct(*[c for c in parent.columns if c != on])
    pieces = [parent.select(on, F.lit("").alias("_kind"), row.alias("parent"))]
    for name, (table, item, order, block) in children.items():
        block = order_block(order[-1]) if block is None else block
        given = [(F.col(o) if isinstance(o, str) else o).alias(p) for o, p in zip(order, places, strict=False)]
        pieces.append(table.select(on, F.lit(name).alias("_kind"), *given, block.alias("_b"), item.alias(name)))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [cut_lineage(p.filter(F.col(on).isNotNull())) for p in pieces])
    # A row for every ``whole_rows`` rows at most, so the hints are safe.
    large = F.broadcast(cut_lineage(rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole_rows).select(on)))
    dealt = rows.join(large, on, "left_anti").repartition(F.col(on))
    whole = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(on, "_kind").orderBy(*places)).cast("bigint"))
    blocks = block_scan(rows.join(large, on, "left_semi"), [on, "_kind"], places, "_b", {"_rn": ("row_number", None)})
    entry = lambda n: F.collect_list(F.when(F.col("_kind") == n, F.struct(F.col("_rn").alias("rn"), F.col(n).alias("v")))).alias(n)
    by_number = lambda n: F.transform(F.array_sort(n, lambda x, y: F.when(x["rn"] < y["rn"], -1).when(x["rn"] > y["rn"], 1).otherwise(0)), lambda e: e["v"]).alias(n)

    def records(numbered: DataFrame) -> DataFrame:
        # The parent's row has no place, and stands on the first page.
        page = F.when(F.col("_kind") == "", F.lit(0)).otherwise(F.coalesce(F.floor((F.col("_rn") - 1) / page_rows), F.lit(0))).cast("bigint")
        grouped = numbered.withColumn("page", page).groupBy(on, "page").agg(F.first("parent", ignorenulls=True).alias("parent"), *[entry(n) for n in children])
        known = grouped.join(parent.select(on).distinct(), on, "left_semi")
        return known.select(on, "page", "parent", *[by_number(n) for n in children])

    return records(whole).unionByName(records(blocks))


def resolve_codes(df: DataFrame, cols: Mapping[str, str], code_value: DataFrame) -> DataFrame:
    """JN-04. Add display, meaning and code set for each coded column.

    ``cols`` maps a coded column to the prefix of its new columns. The last
    row of a duplicated code wins; an unknown code resolves to NULL.
    """
    book = last_row(
        keyed(code_value, "CODE_VALUE").select("CODE_VALUE", "DISPLAY", "CDF_MEANING", "CODE_SET", "_ord"),
        ["CODE_VALUE"], ["_ord"],
    )
    for col, prefix in cols.items():
        side = book.select(
            F.col("CODE_VALUE").alias(f"_{prefix}"),
            clean_cell("DISPLAY").alias(f"{prefix}_display"),
            clean_cell("CDF_MEANING").alias(f"{prefix}_meaning"),
            clean_cell("CODE_SET").alias(f"{prefix}_set"),
        )
        df = df.join(side, clean_cell(col) == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    return df


def tiered_lookup(
    df: DataFrame,
    tiers: Sequence[tuple[Column, DataFrame, str, str]],
    fallback: Column,
    out: str,
) -> DataFrame:
    """JN-05. First tier that knows the row's key wins, else ``fallback``.

    Each tier is ``(key of df, table, key column, value column)`` with one row
    per key in the table.
    """
    found = []
    for i, (key, table, key_col, value_col) in enumerate(tiers):
        side = table.select(F.col(key_col).alias(f"_k{i}"), F.col(value_col).alias(f"_v{i}"))
        df = df.join(side, key == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_v{i}"))
    return df.withColumn(out, F.coalesce(*found, fallback)).drop(*[f"_v{i}" for i in range(len(tiers))])


def first_per_key(df: DataFrame, key: Column, value: Column, names: tuple[str, str], order: str = "_ord") -> DataFrame:
    """The first non-null value of each non-blank key, in source order."""
    rows = df.select(key.alias(names[0]), value.alias(names[1]), F.col(order))
    rows = rows.filter(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())
    return rows.groupBy(names[0]).agg(F.min_by(names[1], order).alias(names[1]))


def attach_first(parent: DataFrame, child: DataFrame, on: str, order: Sequence[Column | str] = ("_ord",)) -> DataFrame:
    """JN-06. Left join with the first child row of each key."""
    return parent.join(first_row(child, [on], order), on, "left")


def attach_last(parent: DataFrame, child: DataFrame, on: str, order: Sequence[Column | str] = ("_ord",)) -> DataFrame:
    """JN-06. Left join with the last child row of each key."""
    return parent.join(last_row(child, [on], order), on, "left")


def two_hop(parent: DataFrame, mid_key: str, child: DataFrame) -> DataFrame:
    """JN-07. Carry the parent's columns to the children of a middle key."""
    return parent.join(child, mid_key)


def link_details(links: DataFrame, details: DataFrame, link_key: str, detail_key: str) -> DataFrame:
    """JN-08. Many-to-many links with their details; dangling ids are skipped."""
    return links.join(details, links[link_key] == details[detail_key])


def with_actors(enc: DataFrame, actors: DataFrame, roles: Mapping[str, str], key: str, cols: Sequence[str]) -> DataFrame:
    """JN-09. Actor columns for each role column of an encounter table."""
    for role, prefix in roles.items():
        side = actors.select(F.col(key).alias(f"_{prefix}"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
        enc = enc.join(side, enc[role] == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    return enc


def cited_actors(enc: DataFrame, actors: DataFrame, owner: str, role: str, key: str, order: Column | str) -> DataFrame:
    """JN-10. Actors that an owner's encounters cite, with their first use."""
    use = enc.filter(F.col(role).isNotNull()).groupBy(owner, role).agg(F.min(order).alias("first_use"))
    return use.join(actors, use[role] == actors[key]).drop(actors[key] if role != key else use[role])


def patient_prefix(family: Column | str, given: Column | str) -> Column:
    """``family_given_`` of a patient, NULL when either name is missing."""
    f, g = safe_token(family), safe_token(given)
    return F.when(f.isNotNull() & g.isNotNull(), F.concat(f, F.lit("_"), g, F.lit("_")))


def attribute_documents(docs: DataFrame, patients: DataFrame, file_col: str = "file_name") -> DataFrame:
    """JN-11. Each document with the longest matching prefix and who owns it.

    Namesakes share a prefix, so owners are counted (``n_owners``), with the
    smallest as ``first_owner``; ``prefix_owners`` lists them once a prefix,
    never once a document.

    ``startswith`` over every pair would be a nested loop. A file name only
    has as many prefixes as underscores, so those become an equality join.
    ``docs`` needs ``doc_id``; ``patients`` needs ``patient_id`` and ``prefix``.
    """
    known = prefix_owners(patients).groupBy("prefix").agg(F.count_distinct("patient_id").alias("n_owners"), F.min("patient_id").alias("first_owner"))
    parts = F.split(F.col(file_col), "_")
    starts = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "_"), F.lit("_")),
    )
    starts = F.when(F.size(parts) > 1, starts)
    candidates = docs.select("doc_id", F.explode(starts).alias("prefix")).join(known.select("prefix"), "prefix", "left_semi")
    best = longest_match(candidates, ["doc_id"], "prefix")
    return docs.join(best, "doc_id").join(known, "prefix")


def prefix_owners(patients: DataFrame) -> DataFrame:
    """JN-11. ``(prefix, patient_id)`` of all patients that have a prefix."""
    return patients.filter(F.col("prefix").isNotNull()).select("prefix", "patient_id")


def match_documents(enc: DataFrame, docs: DataFrame) -> DataFrame:
    """JN-12. File of each encounter by the date in its name.

    Both sides carry ``patient_id``. The id-suffixed name wins, then the first
    name in order. The pick is one aggregate per encounter.
    """
    dated = docs.select("patient_id", "file_name").withColumn(
        "_dos", F.explode(F.array_distinct(F.regexp_extract_all("file_name", F.lit(r"(?=(\d{2}-\d{2}-\d{4}))"), 1)))
    )
    left = enc.select("patient_id", "encounter_id", F.date_format("date_of_service", "MM-dd-yyyy").alias("_dos"))
    # One candidate per (patient, date) suffices for the plain pick; the
    # id-suffixed candidates join on the suffix, so no pair list is built. A
    # longer part of a name can't be a suffix.
    plain = dated.groupBy("patient_id", "_dos").agg(F.min("file_name").alias("_plain"))
    suffix = F.substring(F.replace(F.col("encounter_id").cast("string"), F.lit("-"), F.lit("")), 1, 8)
    tagged = (
        dated.withColumn("_sfx", F.explode(F.array_distinct(F.split(F.col("file_name"), r"[^A-Za-z0-9]+"))))
        .filter(F.length("_sfx") <= 8)
        .groupBy("patient_id", "_dos", "_sfx")
        .agg(F.min("file_name").alias("_tagged"))
    )
    # Both sides grow with the export. A compressed file looks small enough to
    # be sent to the driver when its rows are not, so the joins are told to sort.
    out = left.withColumn("_sfx", suffix).join(plain.hint("merge"), ["patient_id", "_dos"]).join(
        tagged.hint("merge"), ["patient_id", "_dos", "_sfx"], "left"
    )
    return out.select("patient_id", "encounter_id", F.coalesce("_tagged", "_plain").alias("file_name"))


def anchor(resources: DataFrame, patients: DataFrame, key: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """JN-14. Split into rows whose patient exists and rows whose does not."""
    ids = patients.select(key).distinct()
    return resources.join(ids, key, "left_semi"), resources.join(ids, key, "left_anti")


def adopt_unanchored(unanchored: DataFrame, patients: DataFrame, key: str = "patient_id") -> DataFrame:
    """JN-14. The owner of unanchored rows: the only patient, or nobody."""
    sole = patients.agg(
        F.count(F.lit(1)).alias("_n"), F.min(key).alias("_only")
    ).select(F.when(F.col("_n") == 1, F.col("_only")).alias("adopted_by"))
    return unanchored.crossJoin(sole)


def anti_existing(items: DataFrame, existing: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """JN-18. Split items into (to send, already at the destination)."""
    known = existing.select(*on).distinct()
    return items.join(known, list(on), "left_anti"), items.join(known, list(on), "left_semi")
