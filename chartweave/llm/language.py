"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of rows holds the filters of all languages side by side: bit ``l`` of a row belongs
to language ``l``. The rows an n-gram hashes to, combined with AND, give the set of languages
that contain it. A text's counts by language are popcounts of those masks; the share of a
filter's false positives, known from its fill, is taken off, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from chartweave.llm.common import remainder, slices, spread_rows

UNKNOWN = "und"
#: Training texts of one language at most, those of the smallest hash of the id.
SAMPLE_PER_LANGUAGE = 2_000
MAX_LANGUAGES = 64
#: Lengths of the n-grams, in characters.
GRAMS = (3, 4)
#: Rows of the table (a power of two), and rows an n-gram sets.
ROWS, HASHES = 1 << 18, 2
#: A language's filter gets the n-grams that are at least so much more frequent in it than in the mean of the others, and this frequent.
LIFT, LEAST = 2.0, 3e-5
_SLICE = 1 << 20


@dataclass
class Filters:
    """``table[row]`` has a bit for each language; ``noise[l]`` is a language's rate of false positives."""

    languages: list[str]
    table: object
    noise: object


def letters():
    """For each code point 1 if it is a letter."""
    import sys

    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def hashed(text: str, is_letter):
    """Hashes of a text's n-grams; runs of anything but letters read as one blank at each place.

    An n-gram is taken if it has a letter. Returns the hashes and the number of letters.
    """
    import numpy as np

    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = is_letter[points]
    # Blanks that follow a blank go, so that marks and digits between words don't count.
    stay = ok.copy()
    stay[0] = True
    stay[1:] |= ok[:-1]
    points, ok = np.where(ok, points, 32)[stay].astype(np.uint64), ok[stay]
    out, h = [], points * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + points[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n in GRAMS:
            out.append(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), int(ok.sum())


def mixed(h, k: int):
    """Row of the table for hash function ``k``."""
    import numpy as np

    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB if k else 0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(ROWS - 1)).astype(np.int64)


def votes(h, filters: Filters):
    """How many of the n-grams each language contains, less its false positives, and not below 0."""
    import numpy as np

    mask = filters.table[mixed(h, 0)]
    for k in range(1, HASHES):
        mask = mask & filters.table[mixed(h, k)]
    planes = mask.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    used = -(-len(filters.languages) // 8)
    counts = np.concatenate([np.bincount(planes[:, p], minlength=256) @ bits for p in range(used)])[: len(filters.languages)]
    return np.maximum(counts - len(h) * filters.noise, 0) / (1 - filters.noise)


def judge(text: str | None, filters: Filters, is_letter) -> tuple[str, float]:
    """A text's language and its share of the votes of the two best; ``und`` and 0 without a letter.

    A tie goes to the smaller name; a text none of whose n-grams is known gets the first
    language with score 0.
    """
    import numpy as np

    if not text or not filters.languages:
        return UNKNOWN, 0.0
    total, n_letters = np.zeros(len(filters.languages)), 0
    for at in range(0, len(text), _SLICE):
        h, n = hashed(text[max(0, at - max(GRAMS)) : at + _SLICE], is_letter)
        n_letters += n
        if len(h):
            total += votes(h, filters)
    if not n_letters:
        return UNKNOWN, 0.0
    best = int(total.argmax())
    two = np.sort(total)[-2:].sum()
    return filters.languages[best], float(total[best] / two) if two > 0 else 0.0


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """``(lang, text)`` of the training texts, spread over languages so that a hot one can't crowd out the rest.

    The rows are first chosen by id; their texts follow by a filter on the largest hash taken.
    """
    named = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(7)).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    ranked = named.select("lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= per_language)
    last = ranked.groupBy("lang").agg(F.max("h").alias("last")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(last) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    cut = F.lit(False)
    for r in last:
        cut = cut | ((F.col("lang") == r.lang) & (F.col("h") <= r["last"]))
    return named.filter(cut).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters of the languages in ``docs``, from at most ``per_language`` texts of each.

    Rows with a null text or language are not learnt from. N-grams are counted by Spark; those
    that stand out in a language come to the driver, at most ``1 / LEAST`` of each n-gram length.
    """
    import numpy as np

    def count(batches: Iterator):
        import pyarrow as pa

        is_letter = letters()
        for b in slices(batches):
            held: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(hashed(text, is_letter)[0])
            for lang, hs in held.items():
                gram, n = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = spread_rows(sample(docs, id_col, text_col, lang_col, per_language)).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    size = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(size, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).filter(F.col("rate") >= LEAST)
    rows = rate.toPandas()
    languages = sorted(r.lang for r in size.collect())
    table, noise = np.zeros(ROWS, np.uint64), np.zeros(len(languages))
    if not languages:
        return Filters(languages, table, noise)
    total = rows.groupby("gram")["rate"].sum()
    others = np.maximum(total.loc[rows["gram"]].to_numpy() - rows["rate"].to_numpy(), 0) / max(len(languages) - 1, 1)
    kept = rows[rows["rate"].to_numpy() >= LIFT * others] if len(languages) > 1 else rows
    for i, lang in enumerate(languages):
        h = kept.loc[kept["lang"] == lang, "gram"].to_numpy().view(np.uint64)
        for k in range(HASHES):
            table[mixed(h, k)] |= np.uint64(1 << i)
        noise[i] = float(((table >> np.uint64(i)) & np.uint64(1)).mean()) ** HASHES
    return Filters(languages, table, noise)


def identify(docs: DataFrame, filters: Filters, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` of every row with ``lang_pred`` and ``lang_score``; the filters (2 MB) go to the executors.

    Null texts and those without a letter are ``und`` with score 0. Every text is read whole,
    in slices of a million characters. Without any language all are ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table, filters.noise))

    def run(batches: Iterator):
        import pyarrow as pa

        is_letter, model = letters(), Filters(*held.value)
        for b in slices(batches):
            found = [judge(t, model, is_letter) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*b.schema.names[:-1], "lang_pred", "lang_score"])

    schema = StructType([docs.schema[c] for c in id_cols]).add("lang_pred", StringType()).add("lang_score", DoubleType())
    return spread_rows(docs.select(*id_cols, F.col(text_col).alias("_text"))).mapInArrow(run, schema)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Held-out evaluation: learn from rows whose crc32(id) mod 3 is not 1, judge every row by its text alone."""
    filters = fit(docs.filter(remainder(id_col, 3) != 1), id_col, text_col, lang_col)
    rows = docs.select(id_col, (remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("_text"))
    return identify(rows, filters, [id_col, "held_out"], "_text").select(id_col, "held_out", "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language can't be told: null, no letter, or no known n-gram.

    A table that has letters but no text with a language to learn from is refused, as all of it would go.
    """
    filters = fit(docs, id_col, text_col, lang_col)
    if not filters.languages and not docs.filter(F.col(text_col).rlike(r"\p{L}")).isEmpty():
        raise ValueError("no text has a language to learn from")
    held = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table, filters.noise))
    at = docs.columns.index(text_col)

    def run(batches: Iterator):
        import pyarrow as pa

        is_letter, model = letters(), Filters(*held.value)
        for b in slices(batches):
            found = (judge(t, model, is_letter) for t in b.column(at).to_pylist())
            yield b.filter(pa.array([lang != UNKNOWN and score > 0 for lang, score in found], pa.bool_()))

    return spread_rows(docs).mapInArrow(run, docs.schema)
