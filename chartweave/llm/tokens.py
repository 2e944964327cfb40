"""Exact token counts of a corpus, kept as a histogram of encoded lengths.

Documents are encoded once and summed by length. Suffix sums over the lengths then answer
totals, quantiles and totals truncated at a context limit, for every limit, exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from chartweave.llm.common import slices, spread_rows, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters that ``\\s`` stands for in the pattern.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space that are encoded by themselves.
_LONG = re.compile(f"[{_SPACE}]{{10000,}}")
#: Largest tokenizer file that is sent to the executors.
MAX_FILE = 64 << 20
#: Lengths in one block of the suffix sums.
BLOCK = 1024


def ranks_file(spark: SparkSession, path: str) -> bytes:
    """The tokenizer's file, read by Spark so that any store it knows will do."""
    rows = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MAX_FILE).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one file of at most {MAX_FILE} bytes is needed")
    return bytes(rows[0].content)


def encoded_length(encoding, text: str) -> int:
    """Tokens of a text.

    The pattern's look-ahead makes the tokenizer step back through a run of white space, deeper
    than its stack for runs of a million. Such a run is one piece up to its last character,
    which goes with what follows, or whole at the end of the text: it is encoded as that piece.
    """
    n = at = 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, keep: Sequence[str], text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every row; null and empty texts have 0, texts are encoded whole."""
    held = docs.sparkSession.sparkContext.broadcast(ranks_file(docs.sparkSession, path))

    def run(batches: Iterator):
        import base64

        import pyarrow as pa
        import tiktoken

        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, held.value.splitlines()) if a}
        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in slices(batches):
            n = [encoded_length(encoding, t) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    schema = StructType([docs.schema[c] for c in keep]).add("n_tokens", LongType())
    return spread_rows(docs.select(*keep, F.col(text_col).alias("_text"))).mapInArrow(run, schema)


def length_histogram(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_tokens, n_docs)``."""
    return counts.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The histogram with, at each length: how many documents are as long or longer, their tokens,
    the total if all were cut at this length, and the share of documents no longer than it.

    Lengths are summed in blocks; a group's blocks are few (longest text / 1,024), so no
    group meets in one task however many lengths it has.
    """
    by = list(by)
    rows = stage(hist, "lengths").withColumn("_tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy(*by, "_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by, F.lit(0))
    behind = blocks.select(*by, "_block", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_after"), F.sum("_d").over(every).alias("_docs"), F.sum("_t").over(every).alias("_all"))
    down = Window.partitionBy(*by, "_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("h._block") == F.col("b._block")
    for c in by:
        same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}"))
    own = rows.withColumn("_d", F.sum("n_docs").over(down)).withColumn("_t", F.sum("_tokens").over(down))
    joined = own.alias("h").join(behind.alias("b"), same)
    docs, tokens = F.col("h._d") + F.col("_docs_after"), F.col("h._t") + F.col("_tokens_after")
    return joined.select(
        *(F.col(f"h.{c}") for c in by), "n_tokens", "n_docs",
        docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("_all") - tokens + docs * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("_docs") - docs + F.col("n_docs")) / F.col("_docs")).alias("share_up_to"),
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, limit, total)``: tokens left if every document were cut at each limit.

    The smallest length at or above a limit says how many documents reach it.
    """
    by = list(by)
    asked = sums.select(*by, "n_tokens", "docs_at_least", "tokens_at_least", F.explode(F.array(*(F.lit(int(x)) for x in limits))).alias("limit"))
    reach = F.col("n_tokens") >= F.col("limit")
    out = asked.groupBy(*by, "limit").agg(F.max("tokens_at_least").alias("all"), F.max(F.when(reach, F.col("docs_at_least"))).alias("d"), F.max(F.when(reach, F.col("tokens_at_least"))).alias("t"))
    return out.select(*by, "limit", (F.col("all") - F.coalesce("t", F.lit(0)) + F.coalesce("d", F.lit(0)) * F.col("limit")).alias("total"))


def length_quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, share, n_tokens)``: the smallest length that at least this share of documents doesn't exceed."""
    by = list(by)
    asked = sums.select(*by, "n_tokens", "share_up_to", F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share"))
    return asked.filter(F.col("share_up_to") >= F.col("share")).groupBy(*by, "share").agg(F.min("n_tokens").alias("n_tokens"))
