"""Secret scans with DataFrame functions only.

Three patterns find known shapes. Beside them, each candidate string (a long run of one
character class) is read by a sliding window whose Shannon entropy follows from the counts
of its characters: a step changes two counts, and with them the sum of c*log2(c), by the
character that enters and the one that leaves. Runs of windows above the threshold of the
class are secrets, unless the candidate is on the allow-list or a pattern covers the run.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import free

#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
# The patterns of known shapes. The last two are the maximal runs that are long enough.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
WINDOW = 24
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{WINDOW},}}"
HEX_CLASS = r"^[0-9A-Fa-f]+$"
#: Code of the first character of candidates ("+"), and how many codes there are up to "z".
FIRST, ALPHABET = 43, 80
#: Window starts that one scan covers; longer candidates take several, with overlap.
BLOCK = 2048
#: Matches in one chunk of a running sum.
CHUNK = 256
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rules:
    """Least entropy of a window (bits a character) by class, and what is never a secret."""

    hex_bits: float = 3.0
    base64_bits: float = 4.0
    #: Patterns of candidates to leave alone: words without a digit, sample keys, alphabets, one hyphenated UUID.
    allow: tuple[str, ...] = (r"^[A-Za-z/_-]+$", r"(?i:example)", r"(?i:abcdefghijkl)", r"0123456789", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(lengths: Column) -> Column:
    """For an array of numbers the sum of all earlier ones, in chunks so that long arrays take linear time."""
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
    zero = lambda start: F.struct(start.cast("int").alias("sum"), F.array().cast("array<int>").alias("all"))
    running = lambda a, start: F.aggregate(a, zero(start), step, lambda acc: acc["all"])
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / CHUNK).cast("int")), lambda c: F.slice(a, c * CHUNK + 1, CHUNK))
    return bound(lengths, lambda a: bound(cut(a), lambda chunks: F.flatten(F.zip_with(chunks, running(F.transform(chunks, total), F.lit(0)), running))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of ``(start, end, part)`` of a pattern's matches in code points; ``part`` is the group."""
    p = F.lit(pattern)
    size = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    between = F.transform(F.split(text, pattern, -1), F.length)
    part = F.regexp_extract_all(text, p, F.lit(group))

    def placed(n: Column, gap: Column) -> Column:
        end = F.zip_with(before_each(F.zip_with(gap, n, lambda a, b: a + b)), F.zip_with(gap, n, lambda a, b: a + b), lambda x, y: x + y)
        return F.zip_with(F.zip_with(end, n, lambda e, k: F.struct((e - k).alias("start"), e.alias("end"))), part, lambda x, g: F.struct(x["start"].alias("start"), x["end"].alias("end"), g.alias("part")))

    return bound(size, lambda n: bound(F.slice(between, 1, F.size(n)), lambda gap: placed(n, gap)))


def _spans(kind: int, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def base_spans(text: Column) -> Column:
    """Spans of the three patterns as ``(start, kind, end)``, kind being an index of ``KINDS``."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= ASSIGN_LEAST)
    return F.concat(
        F.when(text.rlike(ASSIGN), _spans(0, assign)).otherwise(_none()),
        F.when(text.contains("AKIA"), _spans(1, matches(text, ACCESS))).otherwise(_none()),
        F.when(text.rlike(HEX), _spans(2, matches(text, HEX))).otherwise(_none()),
    )


def dense_runs(codes: Column, bits: Column) -> Column:
    """Spans ``(start, end)`` of an array of codes below ``ALPHABET`` whose windows reach ``bits``.

    The state of the scan is the count of each character in the window and the sum of c*log2(c).
    """
    f = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    zero = F.struct(F.array_repeat(F.lit(0), ALPHABET).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"))
    close = lambda acc: F.when(acc["to"] < 0, acc["runs"]).otherwise(F.concat(acc["runs"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end")))))

    def moved(acc: Column, i: Column, lo: Column, new: Column, old: Column) -> Column:
        counts = F.transform(acc["counts"], lambda c, k: F.when(k == new, c + 1).when(k == old, c - 1).otherwise(c))
        more, less = F.get(acc["counts"], new), F.get(acc["counts"], old)
        change = F.get(f, more + 1) - F.get(f, more) + F.when(old < 0, 0.0).otherwise(F.get(f, less - 1) - F.get(f, less))
        total = acc["sum"] + F.when(new == old, 0.0).otherwise(change)
        return bound(total, lambda t: judged(acc, F.when(new == old, acc["counts"]).otherwise(counts), t, i, (i - lo >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - t / WINDOW >= bits)))

    def judged(acc: Column, counts: Column, total: Column, i: Column, hit: Column) -> Column:
        first = i - (WINDOW - 1)
        apart = hit & ((acc["to"] < 0) | (first > acc["to"]))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(apart, first).otherwise(acc["from"]).alias("from"), F.when(hit, i + 1).otherwise(acc["to"]).alias("to"), F.when(apart, close(acc)).otherwise(acc["runs"]).alias("runs"))

    def scan(a: Column, lo: Column) -> Column:
        slide = lambda acc, i: bound(F.struct(F.get(a, i).alias("new"), F.when(i - lo >= WINDOW, F.get(a, i - WINDOW)).otherwise(-1).alias("old")), lambda x: moved(acc, i, lo, x["new"], x["old"]))
        return F.aggregate(F.sequence(lo, F.least(F.size(a), lo + (BLOCK + WINDOW - 1)) - 1), zero, slide, close)

    blocks = lambda a: F.sequence(F.lit(0), F.floor((F.size(a) - WINDOW) / BLOCK).cast("int"))
    return bound(codes, lambda a: bound(F.flatten(F.transform(blocks(a), lambda b: scan(a, b * BLOCK))), _merged))


def _merged(runs: Column) -> Column:
    """Ordered spans of blocks with those that touch or overlap made one."""
    prev, after = (lambda i: F.get(runs, i - 1)["end"]), (lambda i: F.get(runs, i + 1)["start"])
    heads = F.filter(runs, lambda r, i: (i == 0) | (r["start"] > prev(i)))
    tails = F.filter(runs, lambda r, i: (i == F.size(runs) - 1) | (after(i) > r["end"]))
    return F.zip_with(heads, tails, lambda h, t: F.struct(h["start"].alias("start"), t["end"].alias("end")))


def entropy_spans(text: Column, rules: Rules = Rules()) -> Column:
    """Spans of high entropy in the candidates that no pattern of the allow-list matches."""
    keep = lambda m: ~F.coalesce(F.expr("false") if not rules.allow else m["part"].rlike("|".join(f"(?:{p})" for p in rules.allow)), F.lit(False))
    found = F.filter(matches(text, CANDIDATE), keep)

    def one(m: Column) -> Column:
        is_hex = m["part"].rlike(HEX_CLASS)
        bits = F.when(is_hex, rules.hex_bits).otherwise(rules.base64_bits)
        codes = F.transform(F.split(m["part"], "", -1), lambda c: F.ascii(c) - FIRST)
        kind = F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
        return F.transform(dense_runs(F.slice(codes, 1, m["end"] - m["start"]), bits), lambda r: F.struct((m["start"] + r["start"]).alias("start"), kind.alias("kind"), (m["start"] + r["end"]).alias("end")))

    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(found, one))).otherwise(_none())


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_all``: sorted arrays of ``(start, kind, end)``.

    Positions are code points, ends exclusive. A span of the entropy scan is added unless a
    base span covers it; base spans always stay. Null and empty texts have no spans; rows that
    repeat have the same ones; an empty table stays empty. All columns are carried along,
    but those named ``secret_base`` and ``secret_all`` are replaced.
    """
    (extra,) = free(docs, "secret_added")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("secret_base", F.array_sort(base_spans(text)))
    added = base.withColumn(extra, entropy_spans(text, rules))
    fresh = F.filter(extra, lambda a: ~F.exists("secret_base", lambda b: (b["start"] <= a["start"]) & (b["end"] >= a["end"])))
    return added.withColumn("secret_all", F.when(F.size(extra) > 0, F.array_sort(F.concat("secret_base", fresh))).otherwise(F.col("secret_base"))).drop(extra)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans as text, for each row."""
    found = scan_secrets(docs.select(id_col, text_col), text_col, rules)
    count = lambda col, *kinds: F.size(F.filter(col, lambda s: s["kind"].isin([KINDS.index(k) for k in kinds]))).cast("long")
    return found.select(id_col, *(count("secret_base", k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_listed(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secret_all")).alias("spans"), count("secret_all", *KINDS[3:]).alias("n_entropy"))


def redact(docs: DataFrame, text_col: str = "text", rules: Rules = Rules(), length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span of a secret replaced by ``MARK``; overlapping spans become one.

    Rows without a secret are unchanged; in the others ``length_col``, if there, is counted
    anew. Columns of any name are kept.
    """
    # The row travels in one struct, so that no column of it can clash with a name used here.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    found = scan_secrets(packed, "text", rules)
    spans = F.transform("secret_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    # Running end of sorted spans: overlaps are joined from left to right.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("clear"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["clear"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"))))).otherwise(acc["clear"]).alias("clear"))
    clear = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["clear"], F.array(F.struct(acc["at"].alias("start"), F.length("text").alias("end")))))
    text = F.when(F.size("secret_all") > 0, F.array_join(F.transform(clear, lambda c: F.substring(F.col("text"), c["start"] + 1, c["end"] - c["start"])), MARK)).otherwise(F.col("text"))
    out = found.withColumn("clear", text)
    new = {text_col: F.col("clear")}
    if length_col and length_col in docs.columns:
        new[length_col] = F.when(F.size("secret_all") > 0, F.length("clear").cast(docs.schema[length_col].dataType)).otherwise(F.col("row").getField(length_col))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
