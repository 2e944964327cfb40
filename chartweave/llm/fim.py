"""Fill-in-middle rows, cut at borders that a compressed set of offsets holds.

A text's borders (the ends of its lines, words or characters) go into a set of containers,
one for each 65,536 offsets. A container is a sorted array, a bitmap or a list of runs,
whichever takes the least bytes, so the set of a very long text stays small. Cumulative
cardinalities lead to the container of the k-th border, and a select inside it gives the
offset. Two seeded draws pick the borders at which prefix and middle end.

Only the search for offsets is Python; texts are cut and put together by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from chartweave.llm.common import slices, spread_rows

PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS = ("line", "word", "character")
_SPAN = 1 << 16


@dataclass(frozen=True)
class Rules:
    """``rate`` and ``spm`` are percentages: of texts that are changed, and of those that start with the suffix.

    ``sentinels`` go before prefix, suffix and middle. None may hold another or overlap with one.
    """

    seed: int = 7
    unit: str = "line"
    rate: int = 100
    spm: int = 50
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")


class Borders:
    """An ordered set of offsets with ``select``; built from a strictly rising array."""

    def __init__(self, offsets):
        import numpy as np

        high = offsets >> 16
        self.keys, first = np.unique(high, return_index=True)
        #: ``upto[i]``: members in the containers before the i-th.
        self.upto = np.append(first, len(offsets))
        self.held = [_container((offsets[a:b] & (_SPAN - 1)).astype(np.uint16)) for a, b in zip(self.upto[:-1], self.upto[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.upto[-1])

    def kinds(self) -> list[str]:
        return [kind for kind, _ in self.held]

    def select(self, k: int) -> int:
        """The ``k``-th smallest member, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(self.upto.searchsorted(k, "right")) - 1
        return int(self.keys[i]) * _SPAN + _local_select(*self.held[i], k - int(self.upto[i]))


def _container(low) -> tuple[str, object]:
    """The smallest form of the members of one range: 2 bytes a member, 8,192 for the bitmap, or 4 a run."""
    import numpy as np

    starts = np.flatnonzero(np.diff(low.astype(np.int32), prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(low), _SPAN // 8):
        lengths = np.diff(starts, append=len(low))
        return "run", (low[starts], np.concatenate(([0], np.cumsum(lengths))))
    if 2 * len(low) <= _SPAN // 8:
        return "array", low
    bits = np.zeros(_SPAN, np.uint8)
    bits[low] = 1
    return "bitmap", np.packbits(bits, bitorder="little").view(np.uint64)


def _local_select(kind: str, held, k: int) -> int:
    import numpy as np

    if kind == "array":
        return int(held[k])
    if kind == "run":
        starts, upto = held
        i = int(upto.searchsorted(k, "right")) - 1
        return int(starts[i]) + k - int(upto[i])
    counts = np.bitwise_count(held).cumsum(dtype=np.int64)
    word = int(counts.searchsorted(k, "right"))
    inside = np.flatnonzero(np.unpackbits(held[word : word + 1].view(np.uint8), bitorder="little"))
    return word * 64 + int(inside[k - (int(counts[word - 1]) if word else 0)])


def border_offsets(text: str, unit: str = "line"):
    """Where the units of a text end, in code points. Units cover the text: a word takes the blanks after it."""
    import numpy as np

    if not text:
        return np.zeros(0, np.int64)
    if unit == "character":
        return np.arange(1, len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if unit == "line":
        ends = np.flatnonzero(points == 10) + 1
    else:
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def cut_offsets(text: str, first: int, second: int, unit: str = "line") -> tuple[int, int, int]:
    """``(n, prefix end, middle end)``: the draws, modulo n + 1, say after how many units prefix and middle end."""
    borders = Borders(border_offsets(text, unit))
    n = len(borders)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    at = lambda units: borders.select(units - 1) if units else 0
    return n, at(a), at(b)


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def transform(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fim_n`` (units), ``fim_form``, ``fim_prefix_end``, ``fim_middle_end`` (code points) and ``fim_text``.

    Each row is changed by itself, so rows that repeat an id are drawn alike, and a null id
    draws as the empty text. A null text counts as empty; empty texts and those that hold a
    sentinel stay plain: their ends are null and their text is the input. Texts of any length
    are cut whole. Columns of ``docs`` that have the name of a result are replaced; any other
    name is kept.
    """
    if rules.unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    at, unit = docs.columns.index(text_col), rules.unit
    digest = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    # The row travels in one struct, so that no column of it can clash with a name used here.
    packed = spread_rows(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(_draw(digest, k).alias(f"h{k + 1}") for k in range(4)))

    def run(batches: Iterator):
        import pyarrow as pa

        for b in slices(batches):
            texts = b.column(0).flatten()[at].to_pylist()
            found = [cut_offsets(t or "", x, y, unit) for t, x, y in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], [*b.schema.names, "n", "a", "b"])

    schema = StructType(packed.schema.fields[:])
    for name in ("n", "a", "b"):
        schema = schema.add(name, LongType())
    cut = packed.mapInArrow(run, schema)
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    plain = (text == "") | (F.col("h3") % 100 >= rules.rate)
    for mark in rules.sentinels:
        plain = plain | text.contains(mark)
    form = F.when(plain, PLAIN).when(F.col("h4") % 100 < rules.spm, SPM).otherwise(PSM)
    prefix, middle = F.substring(text, F.lit(1), F.col("a").cast("int")), F.substring(text, (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    suffix = F.substring(text, (F.col("b") + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = (F.lit(x) for x in rules.sentinels)
    made = F.when(F.col("form") == PLAIN, text).when(F.col("form") == SPM, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    ends = lambda c: F.when(F.col("form") != PLAIN, F.col(c))
    results = {"fim_n": F.col("n"), "fim_form": F.col("form"), "fim_prefix_end": ends("a"), "fim_middle_end": ends("b"), "fim_text": made}
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in results]
    return cut.withColumn("form", form).select(*own, *(v.alias(k) for k, v in results.items()))


def restored(made: Column, form: Column, rules: Rules = Rules()) -> Column:
    """The text that a transformed text and its form came from."""
    parts = F.split(made, "|".join(re.escape(x) for x in rules.sentinels))
    one = lambda i: F.element_at(parts, i)
    return F.when(form == PLAIN, made).when(form == SPM, F.concat(one(3), one(4), one(2))).otherwise(F.concat(one(2), one(4), one(3)))


def fim_digest(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and hashes of every row's transformed text, and the hash of the text rebuilt from it."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = transform(only, rules, "doc_id", "text")
    rebuilt = restored(F.col("fim_text"), F.col("fim_form"), rules)
    return rows.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_end").alias("prefix_chars"), (F.col("fim_middle_end") - F.col("fim_prefix_end")).alias("middle_chars"), F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"), F.sha2(rebuilt.cast("binary"), 256).alias("restored_sha256"))
