"""Mixing sources to target weights, with DataFrame functions only.

A tree of domain, language and source gets a token budget from the top. At each node the
budget is shared by weight; a child that can't use its share is filled to its capacity and
the rest goes to its siblings (water filling in closed form over children sorted by
capacity per weight). Because a node's capacity is that of all its leaves, only what the
siblings together can't use is a shortage for the ancestors. A leaf then takes whole
epochs of its documents and, of one more epoch in seeded order, the prefix that fits.

No order over a leaf is ever sorted whole: documents fall into buckets by their hash, bucket
totals tell where the budget ends, and only the bucket it ends in is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import free, stage

TREE = ("domain", "lang", "source")
BUCKETS = 4096
_SEP = "\u0001"


@dataclass(frozen=True)
class Mix:
    """``budget`` tokens, or ``share`` of all tokens if None; at most ``epochs`` passes over a leaf.

    ``weights`` maps a path of node names, from the top, to its weight among its siblings;
    others weigh 1. A weight of 0 leaves a node out.
    """

    budget: int | None = None
    share: float = 0.5
    epochs: int = 2
    seed: int = 17
    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)


def domain_of(source: Column) -> Column:
    """The domain of a source by the number its name ends in: below 10 ``web``, else ``curated``; without one ``other``."""
    n = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(n.isNull() | (n == ""), "other").when(n.cast("int") < 10, "web").otherwise("curated")


def n_tokens(text: Column) -> Column:
    """Words between blanks; a null or empty text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(id_text: Column, seed: int, epoch: Column) -> Column:
    """Order of a document in an epoch: 60 bits of an MD5 of seed, epoch and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), id_text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _weight(path: Sequence[Column], weights: Mapping[tuple[str, ...], float]) -> Column:
    key = F.concat_ws(_SEP, *path)
    of = {_SEP.join(k): float(v) for k, v in weights.items() if len(k) == len(path)}
    out = F.lit(1.0)
    for k, v in of.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def budgets(leaves: DataFrame, mix: Mix, tree: Sequence[str] = TREE) -> DataFrame:
    """Leaves ``(*tree, tokens)`` with their ``target`` of whole tokens.

    One level after the other: with children sorted by capacity per weight, all up to the
    last that can't use its share are filled and the others divide what is left by weight.
    Each level is written out, as the next one reads it twice.
    """
    usable = leaves
    for depth in range(1, len(tree) + 1):
        usable = usable.withColumn(f"_w{depth}", _weight([F.col(c) for c in tree[:depth]], mix.weights))
    used = F.lit(True)
    for depth in range(1, len(tree) + 1):
        used = used & (F.col(f"_w{depth}") > 0)
    usable = usable.withColumn("_cap", F.when(used, F.col("tokens") * mix.epochs).otherwise(0).cast("double"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all"))
    want = F.lit(float(mix.budget)) if mix.budget is not None else F.floor(F.col("_all") * mix.share).cast("double")
    level = usable.select(*tree, "_cap", *(f"_w{d}" for d in range(1, len(tree) + 1))).crossJoin(total.select(want.alias("_budget")))
    for depth in range(1, len(tree) + 1):
        parent, node = list(tree[: depth - 1]), list(tree[:depth])
        nodes = level.groupBy(*node).agg(F.sum("_cap").alias("_node"), F.max(f"_w{depth}").alias("_w"), F.max("_budget").alias("_budget")).filter("_w > 0 AND _node > 0")
        order = Window.partitionBy(*parent, F.lit(depth)).orderBy(F.col("_node") / F.col("_w"), node[-1])
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        after = Window.partitionBy(*parent, F.lit(depth))
        filled = nodes.withColumn("_full", F.sum("_node").over(upto)).withColumn("_rest", F.sum("_w").over(after) - F.sum("_w").over(upto) + F.col("_w")).withColumn("_line", (F.col("_budget") - F.col("_full") + F.col("_node")) / F.col("_rest"))
        # The first child that can use its share sets the line for itself and all after it.
        # Behind it the lines only fall, as each such child takes more than the line gives.
        line = F.max(F.when(F.col("_node") > F.col("_w") * F.col("_line"), F.col("_line"))).over(after)
        shared = filled.withColumn("_got", F.least("_node", F.coalesce(F.col("_w") * line, F.col("_node")))).select(*node, "_got")
        level = stage(level.drop("_budget").join(shared.withColumnRenamed("_got", "_budget"), node), f"budgets-{depth}")
    got = level.select(*tree, F.floor(F.col("_budget") + 1e-6).cast("long").alias("target"))
    return leaves.join(got, list(tree), "left").withColumn("target", F.coalesce("target", F.lit(0).cast("long")))


def cuts(docs: DataFrame, planned: DataFrame, mix: Mix, tree: Sequence[str] = TREE) -> DataFrame:
    """Leaves with ``full`` (whole epochs) and ``last``: the largest hash that still fits in epoch ``full``, or null.

    ``docs`` has ``(*tree, id, tokens)``. The prefix may not exceed what the whole epochs leave.
    At most one bucket of a leaf is the one it ends in.
    """
    leaf = planned.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("left", F.when(F.col("tokens") > 0, F.col("target") - F.col("full") * F.col("tokens")).otherwise(F.lit(0)))
    rows = docs.select(*tree, "id", F.col("tokens").alias("n")).join(leaf.filter("left > 0").select(*tree, "full", "left"), list(tree)).withColumn("h", seeded(F.coalesce(F.col("id").cast("string"), F.lit("")), mix.seed, F.col("full")))
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - BUCKETS.bit_length() + 1))
    sums = rows.groupBy(*tree, "bucket").agg(F.sum("n").alias("n"), F.max("left").alias("left"), F.max("h").alias("h"))
    order = Window.partitionBy(*tree).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("sum", F.sum("n").over(order))
    ends = F.expr("sum > left AND sum - n <= left")
    edge = stage(run.groupBy(*tree).agg(F.max(F.when(F.col("sum") <= F.col("left"), F.col("h"))).alias("below"), F.max(F.when(ends, F.col("bucket"))).alias("bucket"), F.max(F.when(ends, F.col("left") - F.col("sum") + F.col("n"))).alias("room")), "leaf-edges")
    inside = rows.join(edge.filter("bucket IS NOT NULL").drop("below"), [*tree, "bucket"]).groupBy(*tree, "h").agg(F.sum("n").alias("n"), F.max("room").alias("room"))
    order = Window.partitionBy(*tree).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = inside.withColumn("sum", F.sum("n").over(order)).filter("sum <= room").groupBy(*tree).agg(F.max("h").alias("within"))
    return leaf.join(edge.select(*tree, "below"), list(tree), "left").join(fit, list(tree), "left").withColumn("last", F.coalesce("within", "below")).drop("below", "within", "left")


def with_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(domain, lang, source, id, tokens)``; a null language or source is the node ``other``."""
    named = lambda c: F.coalesce(F.col(c), F.lit("other"))
    return docs.select(domain_of(F.col(source_col)).alias("domain"), named(lang_col).alias("lang"), named(source_col).alias("source"), F.col(id_col).alias("id"), n_tokens(F.col(text_col)).alias("tokens"))


def plan(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """For each leaf its tokens, target, whole epochs and the cut of the last one."""
    leaves = stage(rows.groupBy(*TREE).agg(F.sum("tokens").alias("tokens")), "leaf-sums")
    return cuts(rows, stage(budgets(leaves, mix), "leaf-targets"), mix)


def select_ids(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(domain, lang, source, id, tokens, epoch)``: one row for each epoch a document is taken in.

    ``rows`` is what ``with_tree`` gives. Documents that repeat an id have one place in the
    order and are taken together; those without tokens cost nothing and follow the same order.
    """
    rows = stage(rows, "leaf-rows")
    leaf = plan(rows, mix).select(*TREE, "full", "last")
    return _epochs(rows.join(leaf, list(TREE)), mix).select(*TREE, "id", "tokens", "epoch")


def _epochs(rows: DataFrame, mix: Mix) -> DataFrame:
    more = F.coalesce(seeded(F.coalesce(F.col("id").cast("string"), F.lit("")), mix.seed, F.col("full")) <= F.col("last"), F.lit(False))
    taken = rows.withColumn("_n", F.col("full") + more.cast("int")).filter("_n > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` as the mixture takes them, with the ``epoch`` of each copy.

    The table of leaves, a row for each source, is written out first: its size is known
    before the texts are read, and while it is small they aren't shuffled for it. A column
    ``epoch`` of ``docs`` is replaced; columns of any other name are kept.
    """
    own = [F.col(c) for c in docs.columns if c.lower() != "epoch"]
    domain, lang, source, full, last, times = free(docs, "leaf_domain", "leaf_lang", "leaf_source", "leaf_full", "leaf_last", "times")
    leaf = plan(stage(with_tree(docs, id_col, text_col, lang_col, source_col), "leaf-rows"), mix).select(*(F.col(c).alias(to) for c, to in zip((*TREE, "full", "last"), (domain, lang, source, full, last), strict=True)))
    leaf = stage(leaf, "leaves")
    named = lambda c: F.coalesce(F.col(c), F.lit("other"))
    at = (domain_of(F.col(source_col)) == F.col(domain)) & (named(lang_col) == F.col(lang)) & (named(source_col) == F.col(source))
    joined = docs.join(leaf, at)
    more = F.coalesce(seeded(F.coalesce(F.col(id_col).cast("string"), F.lit("")), mix.seed, F.col(full)) <= F.col(last), F.lit(False))
    return joined.withColumn(times, F.col(full) + more.cast("int")).filter(F.col(times) > 0).select(*own, F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias("epoch"))
