"""Benchmark decontamination over a distributed positional inverted index.

Training texts are turned into postings ``(term, row, position)`` of the terms that test
items use, kept as a table whose files are sorted by term. Each window of an item is looked up from its
rarest terms: the postings of the rarest one give starts, those of the next ones, moved by
their offset, thin them out, and the remaining terms are compared in the stored run.

A posting is only stored where a whole window could lie: inside a run of consecutive item
terms at least as long as the shortest window. No exact match is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import byte_table, free, row_key, slices, spread_rows, stage

WINDOW = 10
#: Item words that one pass over the texts looks for; larger item tables take several passes.
BLOCK_WORDS = 500_000
#: Terms that are intersected before the rest of a window is compared.
RAREST = 2
#: Positions in one stored piece of a run, without its overlap.
PIECE = 512
_ALNUM = byte_table("alnum")


@dataclass
class Index:
    """``lengths``: (key, n_words). ``pieces``: (key, piece, start, terms). ``postings``: (term, key, piece, at)."""

    lengths: DataFrame
    pieces: DataFrame
    postings: DataFrame


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(item, size, terms, words)`` for each distinct window of an item; terms are hashes of its words."""

    def run(batches: Iterator):
        import pyarrow as pa
        import xxhash

        for b in slices(batches):
            out: dict[str, list] = {"item": [], "size": [], "words": [], "terms": []}
            for item, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (raw or b"").translate(_ALNUM).split()
                k = min(size, len(words))
                for window in dict.fromkeys(tuple(words[i : i + k]) for i in range(len(words) - k + 1 if k else 0)):
                    out["item"].append(item)
                    out["size"].append(k)
                    out["words"].append(list(window))
                    out["terms"].append([_signed(xxhash.xxh64_intdigest(w)) for w in window])
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["size"], pa.int32()), pa.array(out["words"], pa.list_(pa.binary())), pa.array(out["terms"], pa.list_(pa.int64()))], ["item", "size", "words", "terms"])

    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "item string, size int, words array<binary>, terms array<long>")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def build_index(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, prune: bool = True) -> Index:
    """The index of ``docs`` for the terms of ``windows``, written to the shared folder.

    ``prune=False`` keeps every posting of those terms, as proximity search over single
    words needs. The terms are sent to the executors; ``item_blocks`` bounds their number.
    """
    used = windows.select(F.explode("words").alias("word"), (F.col("size") == size).alias("long"), "size")
    terms = used.groupBy("word").agg(F.max("long").alias("long"), F.min(F.when(~F.col("long"), F.col("size"))).alias("short")).collect()
    shortest = min((t.short for t in terms if t.short is not None), default=0)
    held = docs.sparkSession.sparkContext.broadcast(([bytes(t.word) for t in terms], [t.long for t in terms], [t.short is not None for t in terms]))

    def run(batches: Iterator):
        from itertools import repeat

        import numpy as np
        import pyarrow as pa
        import xxhash

        words, long, short = held.value
        number = {w: i for i, w in enumerate(words, 1)}.get
        ids = np.array([0, *(_signed(xxhash.xxh64_intdigest(w)) for w in words)], np.int64)
        is_long, is_short = np.array([False, *long]), np.array([False, *short])

        def kept(mask, least):
            """The mask without runs shorter than ``least``."""
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
            starts, ends = edge[::2], edge[1::2]
            ok = ends - starts >= least
            return starts[ok], ends[ok]

        for b in slices(batches):
            n_words, starts, pieces = [], [], []
            for raw in b.column(1).to_pylist():
                found = (raw or b"").translate(_ALNUM).split()
                n_words.append(len(found))
                seq = np.fromiter(map(number, found, repeat(0)), np.int32, len(found))
                if prune:
                    mask = np.zeros(len(seq), bool)
                    for s, e in zip(*kept(is_long[seq], size), strict=True):
                        mask[s:e] = True
                    if shortest:
                        for s, e in zip(*kept(is_short[seq], shortest), strict=True):
                            mask[s:e] = True
                else:
                    mask = seq > 0
                at, cut = [], []
                for s, e in zip(*kept(mask, 1), strict=True):
                    for p in range(s, max(s + 1, e - size + 1), PIECE):
                        at.append(p)
                        cut.append(ids[seq[p : min(e, p + PIECE + size - 1)]])
                starts.append(at)
                pieces.append(cut)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(pieces, pa.list_(pa.list_(pa.int64())))], ["key", "n_words", "starts", "pieces"])

    rows = spread_rows(docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("raw")))
    scanned = stage(rows.mapInArrow(run, "key long, n_words long, starts array<int>, pieces array<array<long>>"), "runs")
    # Rows that repeat share a key and its postings; one of them is enough.
    first = Window.partitionBy("key").orderBy("key")
    once = scanned.filter(F.size("starts") > 0).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    pieces = stage(once.select("key", F.posexplode(F.arrays_zip("starts", "pieces")).alias("piece", "p")).select("key", "piece", F.col("p.starts").alias("start"), F.col("p.pieces").alias("terms")), "pieces")
    postings = pieces.select("key", "piece", F.posexplode("terms").alias("at", "term")).select("term", "key", "piece", "at")
    # Each file is sorted by term, so that a lookup skips the row groups of other terms.
    files = postings.repartition(docs.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("term", "key", "piece", "at")
    return Index(scanned.select("key", "n_words"), pieces, stage(files, "postings", narrow=False))


def rarest_terms(windows: DataFrame, index: Index, n: int = RAREST) -> DataFrame:
    """Distinct windows with their ``n`` rarest terms, rarest first; those with a term that has no posting go."""
    seen = index.postings.groupBy("term").count()
    distinct = windows.groupBy("terms").agg(F.first("size").alias("size")).withColumn("window", F.xxhash64("terms"))
    each = distinct.select("window", "size", F.posexplode("terms").alias("offset", "term")).join(seen, "term")
    ranked = each.groupBy("window", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))), 1, n).alias("rare"), F.count("*").alias("n"))
    return stage(ranked.filter("n = size").select("window", "rare").join(distinct, "window"), "plan")


def phrase_matches(windows: DataFrame, index: Index, n: int = RAREST) -> DataFrame:
    """``(key, start, size, window)``: every place where a whole window occurs."""
    plan = rarest_terms(windows, index, n)
    pick = lambda k: F.coalesce(F.get("rare", F.lit(k)), F.col("rare")[0])  # noqa: E731  a window of few terms repeats its first
    asked = plan.select("window", *(pick(k)["term"].alias(f"term{k}") for k in range(n)), *(pick(k)["offset"].alias(f"offset{k}") for k in range(n)))
    found = index.postings.join(asked, F.col("term") == F.col("term0")).withColumn("first", F.col("at") - F.col("offset0")).filter("first >= 0")
    found = found.select("key", "piece", "first", "window", *(f"{c}{k}" for k in range(1, n) for c in ("term", "offset")))
    for k in range(1, n):
        p = index.postings.select(F.col("key").alias("_key"), F.col("piece").alias("_piece"), F.col("at").alias("_at"), F.col("term").alias("_term"))
        found = found.join(p, (F.col("key") == F.col("_key")) & (F.col("piece") == F.col("_piece")) & (F.col("first") + F.col(f"offset{k}") == F.col("_at")) & (F.col(f"term{k}") == F.col("_term")), "left_semi")
    stored = index.pieces.select("key", "piece", "start", F.col("terms").alias("stored"))
    near = found.select("key", "piece", "first", "window").join(stored, ["key", "piece"]).join(plan.select("window", "size", "terms"), "window")
    return near.filter(F.slice("stored", F.col("first") + 1, F.col("size")) == F.col("terms")).select("key", (F.col("start") + F.col("first")).alias("start"), "size", "window").distinct()


def proximity_matches(windows: DataFrame, index: Index, span: int = 30, n: int = RAREST) -> DataFrame:
    """``(key, start, window)``: places where the ``n`` rarest terms of a window lie within ``span`` positions of the rarest.

    Each further term is a semi join on equal row, term and neighbouring block of positions.
    """
    plan = rarest_terms(windows, index, n)
    pick = lambda k: F.coalesce(F.get("rare", F.lit(k)), F.col("rare")[0])["term"]
    asked = plan.select("window", *(pick(k).alias(f"term{k}") for k in range(n)))
    placed = index.postings.join(index.pieces.select("key", "piece", "start"), ["key", "piece"]).select("term", "key", (F.col("start") + F.col("at")).alias("pos")).distinct()
    found = placed.join(asked, F.col("term") == F.col("term0")).drop("term")
    near = placed.select(F.col("key").alias("_key"), F.col("term").alias("_term"), F.col("pos").alias("_pos"), F.explode(F.array(*(F.floor(F.col("pos") / span) + d for d in (-1, 0, 1)))).alias("_block"))
    for k in range(1, n):
        found = found.join(near, (F.col("key") == F.col("_key")) & (F.col(f"term{k}") == F.col("_term")) & (F.floor(F.col("pos") / span) == F.col("_block")) & (F.abs(F.col("pos") - F.col("_pos")) <= span), "left_semi")
    return found.select("key", F.col("pos").alias("start"), "window")


def item_blocks(items: DataFrame, item_col: str, text_col: str, size: int) -> list[DataFrame]:
    """The windows of the items, in as many blocks as keep each below ``BLOCK_WORDS`` words (one item at least)."""
    windows = stage(item_windows(items, item_col, text_col, size), "windows")
    words = windows.groupBy("item").agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0] or 0
    blocks = 1 + words // BLOCK_WORDS
    return [windows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i) for i in range(blocks)]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """For every row: ``key, n_words, n_hit, n_items, items_sha256, contaminated``.

    A window is ``size`` consecutive words of an item (the whole item if shorter); a word
    inside any occurrence is hit. Null and empty texts have no words; an item without words
    has no window; an item without id makes hits but isn't counted; items that repeat an id
    count once. ``key`` is ``row_key``; rows that repeat have one result. No items: all clean.
    """
    found, lengths, owners = [], None, []
    for windows in item_blocks(items, item_col, item_text_col, size):
        index = build_index(docs, windows, id_col, text_col, size)
        lengths = lengths if lengths is not None else index.lengths
        found.append(phrase_matches(windows, index))
        owners.append(windows.select(F.xxhash64("terms").alias("window"), "item"))
    hits = stage(reduce(DataFrame.unionByName, found), "matches")
    owner = reduce(DataFrame.unionByName, owners).distinct()
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    covered = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).groupBy("key").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    of = hits.select("key", "window").distinct().join(owner, "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    one = lengths.dropDuplicates(["key"])
    out = one.join(covered, "key", "left").join(of, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def contamination_by_id(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``contamination`` with the id of each row in place of its key, one row for each row of ``docs``."""
    ids = docs.select(id_col, row_key(id_col, text_col).alias("key"))
    return ids.join(contamination(docs, items, id_col, text_col), "key").drop("key")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item; columns of any name are kept."""
    (name,) = free(docs, "contaminated_key")
    # Written out, its size is known before the texts are read: while it is small they aren't shuffled.
    bad = stage(contamination(docs, items, id_col, text_col).filter("contaminated").select(F.col("key").alias(name)), "contaminated")
    return docs.join(bad, row_key(id_col, text_col) == F.col(name), "left_anti")
