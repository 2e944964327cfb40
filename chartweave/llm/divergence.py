"""How far the sources of a language diverge in their words, by in-mapper stripes.

Each partition folds whole documents into hash stripes: for each term of a language its
sources with their document and word counts. A stripe table that grows beyond a bound is
spilled as rows, and Spark merges the stripes of a term by key. What the totals need (the
terms of a language, the words of each source) is summed from the merged stripes, and a
second pass over them emits the divergences: of a term from its language, and of each pair
of sources.

Most terms are missing from most sources. A pair's sum therefore starts from what it would
be if no term occurred at all, and a stripe only adds what its own entries change.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import slices, spread_rows, stage

#: Documents of a language that a term must occur in, and places of a source's list of terms.
LEAST_DOCS, TOP = 3, 200
#: Entries (term and source) a partition holds before it spills, and pairs a task sums before it passes them on.
HELD, PAIRS = 400_000, 1_000_000
#: Groups (language and source) whose totals may be sent to every task: 30 MB at most for names of 100 bytes.
MOST_GROUPS = 200_000
#: First ranks are taken in so many parts of a group's terms, so that none is ordered by one task.
PARTS = 32
_ONE = 10**9
_STRIPE = "lang string, term binary, sources array<string>, docs array<long>, counts array<long>"


def letters_only() -> bytes:
    """A ``bytes.translate`` table that lower-cases A-Z and blanks all ASCII but letters."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(docs: DataFrame) -> DataFrame:
    """Stripes of ``(lang, source, text)``: one row for each term, language and spill of a partition."""

    def run(batches: Iterator):
        from collections import Counter

        import pyarrow as pa

        table, one = letters_only(), 1 << 48  # documents above, words below
        stripes: dict[str, dict[bytes, dict[str, int]]] = {}
        held = 0

        def spill():
            langs, terms, ends, sources, both = [], [], [0], [], []
            for lang, by_term in stripes.items():
                langs += [lang] * len(by_term)
                for term, stripe in by_term.items():
                    terms.append(term)
                    sources += stripe
                    both += stripe.values()
                    ends.append(len(sources))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((sources, pa.string()), ([v >> 48 for v in both], pa.int64()), ([v & (one - 1) for v in both], pa.int64())))
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()), *lists], ["lang", "term", "sources", "docs", "counts"])
            stripes.clear()
            return out

        for b in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = stripes.setdefault(lang, {})
                for term, n in Counter(text.encode("utf-8", "surrogatepass").translate(table).split()).items():
                    stripe = own.get(term)
                    if stripe is None:
                        own[term] = {source: one + n}
                        held += 1
                    elif source in stripe:
                        stripe[source] += one + n
                    else:
                        stripe[source] = one + n
                        held += 1
                if held >= HELD:
                    yield spill()
                    held = 0
        if stripes:
            yield spill()

    return spread_rows(docs).mapInArrow(run, _STRIPE)


def merged(spilled: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One stripe a term of a language: ``(lang, term, n, entries)``, ``entries`` of ``(source, count)``.

    Terms in fewer than ``least_docs`` documents of the language are left out. A term meets
    one row of each spill, and its list has one entry a source at most.
    """
    entries = spilled.repartition("lang", "term").select("lang", "term", F.inline(F.arrays_zip("sources", "docs", "counts")))
    summed = entries.groupBy("lang", "term", "sources").agg(F.sum("docs").alias("docs"), F.sum("counts").alias("n"))
    stripes = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct(F.col("sources").alias("source"), F.col("n").alias("count"))).alias("entries"))
    return stripes.filter(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "n", "entries")


def totals(groups: DataFrame, stripes: DataFrame) -> DataFrame:
    """``(lang, source, group_n, v, lang_n)`` of every occurring group: its words, and the language's terms and words."""
    of_lang = stripes.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    of_group = stripes.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("count").alias("group_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("group_n"), zero("v"), zero("lang_n"))


def smoothed(count: str, size: str) -> Column:
    """``1 + floor(10^9 * (count + 1) / size)`` of two columns or expressions, exact for any count."""
    return F.expr(f"1L + (cast({_ONE} as decimal(10,0)) * (cast({count} as decimal(20,0)) + 1)) div cast({size} as decimal(20,0))")


def distance(p: str, q: str) -> Column:
    """``floor((p - q)^2 / q)`` of two columns; both lie between 1 and 10^9 + 1, so it fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _first(rows: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def term_part(stripes: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms a group has more of than its language, first ``top``."""
    entries = stripes.select("lang", F.col("term").alias("item"), "n", F.inline("entries")).join(groups, ["lang", "source"])
    scored = entries.withColumn("p", smoothed("count", "group_n + v")).withColumn("q", smoothed("n", "lang_n + v")).filter("p > q").select("lang", "source", "item", distance("p", "q").alias("value"))
    some = _first(scored.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))), top, "lang", "source", "part")
    return _first(some.drop("part", "rank"), top, "lang", "source")


def pair_sums(stripes: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, moved)``: what the terms that occur add to the distance of two groups without any.

    ``groups`` has a row for each group, and every task gets it; there may be ``MOST_GROUPS``.
    """
    rows = groups.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of language and source")
    by_lang: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.source)):
        by_lang.setdefault(r.lang, []).append((r.source, r.group_n + r.v))
    held = stripes.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = {lang: (pa.array([s for s, _ in own], pa.string()), np.array([max(n, 1) for _, n in own], np.int64)) for lang, own in held.value.items()}
        sums: dict[str, tuple] = {}

        def passed_on(lang):
            keys, values = sums.pop(lang)
            names = known[lang][0]
            a, b = np.divmod(keys, len(names))
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(values)], ["lang", "source", "item", "moved"])

        for batch in slices(batches, 2048):
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                entries = batch.column(1).filter(pc.equal(langs, lang))
                names, size = known[lang]
                fields = entries.flatten().flatten()
                at = pc.index_in(fields[0], names).to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.diff(entries.offsets.to_numpy())
                for keys, values in changes(at, fields[1].to_numpy().astype(np.int64), lengths, size):
                    sums[lang] = added(*sums.get(lang, (keys[:0], values[:0])), keys, values)
                    if len(sums[lang][0]) > PAIRS:
                        yield passed_on(lang)
        for lang in list(sums):
            yield passed_on(lang)

    found = stripes.select("lang", "entries").mapInArrow(run, "lang string, source string, item string, moved long")
    return found.groupBy("lang", "source", "item").agg(F.sum("moved").alias("moved"))


def added(keys, values, more_keys, more_values):
    """Two sums by key as one, with whole numbers."""
    import numpy as np

    both, where = np.unique(np.concatenate((keys, more_keys)), return_inverse=True)
    out = np.zeros(len(both), np.int64)
    np.add.at(out, where, np.concatenate((values, more_values)))
    return both, out


def share(count, size):
    """``smoothed`` on arrays; Python's own numbers where a long would not hold the product."""
    import numpy as np

    if len(count) and int(count.max()) >= 9 * 10**9:
        return np.array([1 + _ONE * (int(c) + 1) // int(s) for c, s in zip(count, size, strict=True)], np.int64)
    return 1 + _ONE * (count + 1) // size


def changes(at, count, lengths, size) -> Iterator:
    """``(pair, change)`` arrays of some stripes, pair = source * number of sources + other source.

    ``at`` and ``count`` are the stripes' entries one after the other, ``lengths`` of each
    stripe. With 0 for a term that a group lacks: the distance of two groups over all terms
    is that of (0, 0) times the terms; an entry of either group adds the change that it makes
    alone, and a stripe with both adds what is then still missing.
    """
    import numpy as np

    n, none = len(size), share(np.zeros(len(size), np.int64), size)
    d = lambda p, q: (p - q) * (p - q) // q
    p = share(count, size[at])
    pairs, times = np.unique(at * (_ONE + 2) + p, return_counts=True)
    s, ps = pairs // (_ONE + 2), pairs % (_ONE + 2)
    step = max(1, PAIRS // n)
    every = np.arange(n)
    for i in range(0, len(s), step):
        a, pa, m = s[i : i + step, None], ps[i : i + step, None], times[i : i + step, None]
        zero = d(none[a], none[None, :])
        yield (a * n + every).ravel(), (m * (d(pa, none[None, :]) - zero)).ravel()
        yield (every * n + a).ravel(), (m * (d(none[None, :], pa) - d(none[None, :], none[a]))).ravel()
    starts = np.cumsum(lengths) - lengths
    for k in np.unique(lengths[lengths > 1]).tolist():
        own = starts[lengths == k]
        step = max(1, PAIRS // (k * k))
        for i in range(0, len(own), step):
            of = own[i : i + step, None] + np.arange(k)
            x, y = (np.broadcast_to(v, (len(of), k, k)).reshape(-1) for v in (of[:, :, None], of[:, None, :]))
            a, b = at[x], at[y]
            yield a * n + b, d(p[x], p[y]) - d(p[x], none[b]) - d(none[a], p[y]) + d(none[a], none[b])


def pair_part(stripes: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value, rank)``: each group's distance from each other group of its language."""
    mine = groups.select("lang", "source", "v", smoothed("0", "greatest(group_n + v, 1)").alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), smoothed("0", "greatest(group_n + v, 1)").alias("q"))
    base = mine.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("v") * distance("p", "q")).alias("base"))
    both = base.join(pair_sums(stripes, groups), ["lang", "source", "item"], "left")
    rows = both.select("lang", "source", "item", (F.col("base") + F.coalesce(F.col("moved"), F.lit(0))).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of all documents.

    Null texts, languages and sources are empty ones; rows that repeat count each. A group
    without kept terms is compared like any other, and a language without kept terms has
    pairs of value 0. Only the three named columns are read, so other names can't clash; an
    empty table gives no rows. Equal values are ordered by the UTF-8 of the item.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    stripes = stage(merged(fold(rows), least_docs), "stripes", narrow=False)
    groups = stage(totals(rows.select("lang", "source").distinct(), stripes), "groups")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pair_part(stripes, groups), "pair").unionByName(part(term_part(stripes, groups, top), "term"))
