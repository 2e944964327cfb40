"""Delivery verification and patient matching (VER-01..11).

Each level gives rows ``item_key, level, status, detail``. Details name levels,
ratios and fields only, never a patient value.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.functions.dates import date_spellings
from chartweave.functions.text import norm_text

NAME_RATIO = 0.88
WINDOW_SLACK = 8
MIN_BYTES = 1024
LEVELS = ("L0", "L1", "L2", "L3", "L4", "L5", "L6")
HEADER_FIELDS = ("patient_name", "dob", "dos")


def best_ratio(needle: str | None, windows: Sequence[str] | None) -> float | None:
    """Best match ratio of the needle with some windows; one that can't beat the best so far is not compared in full."""
    if needle is None or windows is None:
        return None
    matcher, best = SequenceMatcher(autojunk=False), 0.0
    matcher.set_seq2(needle)
    for window in windows:
        matcher.set_seq1(window)
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
    return best


@F.pandas_udf(T.DoubleType())
def _ratio(needle: pd.Series, windows: pd.Series) -> pd.Series:
    return pd.Series([best_ratio(n, w) for n, w in zip(needle, windows, strict=True)], dtype="float64")


def candidate_windows(n: Column, h: Column, least: float = NAME_RATIO) -> Column:
    """The word-aligned windows of a text that can match a name with a ratio of ``least``.

    A window holds ``size`` = length of the name + slack characters, less at the end of the
    text. With m matching characters the ratio is 2m / (name + window), so m has a least
    value. Characters that don't match cut the rest into blocks, and a block of b characters
    has b - 1 pairs of neighbours: a window that matches holds at least ``m - blocks`` of the
    name's pairs. All but so many of the rarest pairs may be missing, so one of these is in
    it. What the text doesn't hold at all is the rarest; then no window is looked at.
    """
    return _bind(F.struct(n.alias("n"), h.alias("h"), F.length(n).alias("l")), lambda x: _candidates(x, least))


def _bind(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _candidates(x: Column, least: float) -> Column:
    n, h, l = x["n"], x["h"], x["l"]
    size = l + WINDOW_SLACK
    m = F.ceil(least / 2 * (l + size) - 1e-9).cast("int")
    missing = (l - 1) - (m - (1 + l + size - 2 * m)) + 1
    pairs = F.transform(F.sequence(F.lit(1), l - 1), lambda i: F.substring(n, i, F.lit(2)))
    # Rarest in the text itself, by how much it shrinks without the pair.
    counted = F.array_sort(F.transform(pairs, lambda g: F.struct((F.length(h) - F.length(F.replace(h, g, F.lit("")))).alias("c"), g.alias("g"))))
    rare = F.filter(F.slice(counted, 1, F.greatest(missing, F.lit(0))), lambda r: r["c"] > 0)
    inside = F.when((m <= l) & (l >= 2), _bind(F.transform(rare, lambda r: r["g"]), lambda g: F.when(F.size(g) > 0, _windows_with(h, size, g))))
    near_end = F.when(F.length(h) <= size, h).otherwise(_bind(F.substring(h, -size - 1, size + 1), lambda t: F.when(F.locate(" ", t) > 0, F.substring(t, F.locate(" ", t) + 1, size))))
    reaches = lambda t: 2 * F.least(F.length(t), l) >= least * (F.length(t) + l) - 1e-9
    end = F.when(near_end.isNotNull(), _bind(F.split(near_end, " "), lambda w: _windows(w, size, reaches)))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(inside, none), F.coalesce(end, none))


def _windows_with(h: Column, size: Column, pairs: Column) -> Column:
    """Windows of ``size`` characters at each word that hold one of ``pairs``, found as the text is read once."""
    literal = F.array_join(F.transform(pairs, lambda g: F.regexp_replace(g, r"(\p{Punct})", r"\\$1")), "|")
    # A word begins where no character but a blank stands before it.
    pattern = F.concat(F.lit("(?s)(?<![^ ])(?=.{0,"), (size - 2).cast("string"), F.lit("}(?:"), literal, F.lit("))(?=(.{1,"), size.cast("string"), F.lit("}))"))
    return F.regexp_extract_all(h, pattern, F.lit(1))


def _windows(words: Column, size: Column, keep) -> Column:
    """Windows at each word that ``keep`` takes; places are filtered first, so that only what is kept is held."""
    at = lambda i: F.substring(F.array_join(F.slice(words, i, F.floor(size / 2).cast("int") + 1), " "), F.lit(1), size)
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: keep(at(i))), at)


def with_name_ratio(df: DataFrame, needle: str, text: str, out: str = "ratio", least: float = NAME_RATIO) -> DataFrame:
    """VER-03. Best fuzzy ratio of a name anywhere in a text, or NULL if it is below ``least``.

    0 without a name or a text, and 1 for an exact hit. Otherwise Spark picks the windows that
    can reach ``least``, a number that grows with the text at most, and only these are compared.
    """
    df = df.withColumns({"_n": norm_text(needle, lower=True), "_h": norm_text(text, lower=True)})
    empty = (F.coalesce("_n", F.lit("")) == "") | (F.coalesce("_h", F.lit("")) == "")
    df = df.withColumn("_exact", F.when(empty, F.lit(0.0)).when(F.col("_h").contains(F.col("_n")), F.lit(1.0)))
    df = df.withColumn("_windows", F.when(F.col("_exact").isNull(), candidate_windows(F.col("_n"), F.col("_h"), least)))
    some = F.size("_windows") > 0
    df = df.withColumn("_fuzzy", _ratio(F.when(some, F.col("_n")), F.when(some, F.col("_windows"))))
    return df.withColumn(out, F.coalesce("_exact", F.when(F.col("_fuzzy") >= least, F.col("_fuzzy")))).drop("_n", "_h", "_exact", "_windows", "_fuzzy")


def date_present(day: Column | str, text: Column | str) -> Column:
    """Any spelling of the date in the text, by plain containment."""
    there = _bind(norm_text(text, lower=True), lambda hay: F.exists(date_spellings(day, ladder=True), lambda s: F.contains(hay, F.lower(s))))
    return F.coalesce(there, F.lit(False))


def _level(df: DataFrame, level: str, status: Column, detail: Column) -> DataFrame:
    return df.select("item_key", F.lit(level).alias("level"), status.alias("status"), detail.alias("detail"))


def verify_integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """VER-01 (L0). Size and hash of the file match the manifest."""
    f = files.select("file_path", F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    m = manifest.join(f, "file_path", "left")
    why = (
        F.when(F.col("_sha").isNull(), "file missing").when(F.col("size_bytes").isNull() | F.col("sha256").isNull(), "manifest has no size or hash")
        .when(~F.col("_size").eqNullSafe(F.col("size_bytes")), "size mismatch").when(F.col("_sha") != F.col("sha256"), "sha256 mismatch")
    )
    return _level(m, "L0", F.when(why.isNull(), "pass").otherwise("fail"), F.coalesce(why, F.lit("sha256 and size match")))


def verify_size(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """VER-02 (L1). Over 1 KiB, at least one page, the expected number of pages.

    ``pages`` has ``item_key, page_count`` and optionally ``expected_pages``.
    """
    p = pages if "expected_pages" in pages.columns else pages.withColumn("expected_pages", F.lit(None).cast("int"))
    m = manifest.join(p.select("item_key", "page_count", "expected_pages"), "item_key", "left")
    n = F.coalesce("page_count", F.lit(0))
    why = F.when(F.col("size_bytes") <= MIN_BYTES, "file too small").when(n < 1, "no pages").when(F.col("expected_pages") != n, "page count differs")
    return _level(m, "L1", F.when(why.isNull(), "pass").otherwise("fail"), F.coalesce(why, F.concat(n.cast("string"), F.lit(" page(s)"))))


def verify_identity(docs: DataFrame) -> DataFrame:
    """VER-04 (L2). Name ratio of at least 0.88; the birth date is a hard gate.

    ``docs`` has ``item_key, text, display_name, birth_date``.
    """
    d = with_name_ratio(docs, "display_name", "text")
    shown = F.when(F.col("ratio").isNull(), f"below {NAME_RATIO:.2f}").otherwise(F.format_string("%.2f", "ratio"))
    nameless = F.coalesce("display_name", F.lit("")) == ""
    no_date = F.col("birth_date").isNotNull() & ~date_present("birth_date", "text")
    low = F.coalesce(F.col("ratio") < NAME_RATIO, F.lit(True))
    status = F.when(nameless, "skip").when(no_date | low, "fail").otherwise("pass")
    detail = (
        F.when(nameless, "patient has no display name").when(no_date, F.concat(F.lit("birth_date not on page 1 (name ratio "), shown, F.lit(")")))
        .when(low, F.lit(f"patient_name ratio below {NAME_RATIO:.2f}")).otherwise(F.concat(F.lit("patient_name ratio "), shown))
    )
    return _level(d, "L2", status, detail)


def verify_header(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """VER-05 (L3). Declared header fields; an unknown name fails loudly."""
    if not fields:
        return _level(docs, "L3", F.lit("skip"), F.lit("no header fields declared"))
    unknown = [f for f in fields if f not in HEADER_FIELDS]
    if unknown:
        return _level(docs, "L3", F.lit("fail"), F.lit(f"unsupported header field {unknown[0]!r}"))
    d = with_name_ratio(docs, "display_name", "text") if "patient_name" in fields else docs
    tests = {
        "patient_name": (F.coalesce("display_name", F.lit("")) != "") & (F.col("ratio") >= NAME_RATIO) if "patient_name" in fields else None,
        "dob": F.col("birth_date").isNotNull() & date_present("birth_date", "text"),
        "dos": F.col("date_of_service").isNotNull() & date_present("date_of_service", "text"),
    }
    lost = F.filter(F.array(*[F.when(~F.coalesce(tests[f], F.lit(False)), F.lit(f)) for f in sorted(fields)]), lambda f: f.isNotNull())
    bad = F.size(lost) > 0
    return _level(d, "L3", F.when(bad, "fail").otherwise("pass"),
                  F.when(bad, F.concat(F.lit("header fields not found: "), F.array_join(lost, ", "))).otherwise(F.lit("header fields verified: " + ", ".join(sorted(fields)))))


def banner_matches(family: Column, birth: Column, banner_family: Column, banner_birth: Column) -> Column:
    """VER-06. Family name (any case) and birth date both equal; missing is a mismatch."""
    same = (F.lower(family) == F.lower(banner_family)) & (family != "") & (birth == banner_birth)
    return F.coalesce(same, F.lit(False))


def verify_banner(items: DataFrame, banner: DataFrame) -> DataFrame:
    """VER-06 (L4). ``banner`` has the destination's ``patient_id, banner_family, banner_birth``."""
    d = items.join(banner, "patient_id", "left")
    ok = banner_matches(F.col("family_name"), F.col("birth_date"), F.col("banner_family"), F.col("banner_birth"))
    return _level(d, "L4", F.when(ok, "pass").otherwise("fail"), F.when(ok, "banner matches patient").otherwise("WrongPatientError"))


def verify_metadata(manifest: DataFrame, reported: DataFrame) -> DataFrame:
    """VER-07 (L5). Reported size and page count agree where they are reported."""
    r = reported.select("item_key", F.col("size_bytes").alias("_size"), F.col("page_count").alias("_pages"))
    m = manifest.join(r, "item_key", "left")
    none = F.col("_size").isNull() & F.col("_pages").isNull()
    size_off = F.coalesce(F.col("_size") != F.col("size_bytes"), F.lit(False))
    page_off = F.coalesce(F.col("_pages") != F.col("page_count"), F.lit(False))
    status = F.when(none, "skip").when(size_off | page_off, "fail").otherwise("pass")
    detail = F.when(none, "destination reported nothing to check").when(size_off, "reported size_bytes mismatch").when(page_off, "reported page_count mismatch").otherwise(
        F.concat(F.lit("metadata verified: "), F.concat_ws(", ", F.when(F.col("_pages").isNotNull(), "page_count"), F.when(F.col("_size").isNotNull(), "size_bytes"))))
    return _level(m, "L5", status, detail)


def verify_round_trip(manifest: DataFrame, read_back: DataFrame) -> DataFrame:
    """VER-08 (L6). Byte-identical, or same pages and the identity proved again.

    ``read_back`` has ``item_key, back_sha256, back_pages, back_text``;
    ``manifest`` also has ``page_count, display_name, birth_date``.
    """
    m = with_name_ratio(manifest.join(read_back, "item_key", "left"), "display_name", "back_text")
    shown = F.when(F.col("ratio").isNull(), f"below {NAME_RATIO:.2f}").otherwise(F.format_string("%.2f", "ratio"))
    absent = F.col("back_sha256").isNull()
    same = F.col("back_sha256") == F.col("sha256")
    pages_off = ~F.col("back_pages").eqNullSafe(F.col("page_count"))
    nameless = F.coalesce("display_name", F.lit("")) == ""
    no_date = F.col("birth_date").isNotNull() & ~date_present("birth_date", "back_text")
    low = F.coalesce(F.col("ratio") < NAME_RATIO, F.lit(True))
    status = F.when(absent, "skip").when(same, "pass").when(pages_off | nameless | no_date | low, "fail").otherwise("pass")
    detail = (
        F.when(absent, "no destination doc resolved").when(same, "byte-identical read-back").when(pages_off, "read-back page_count differs")
        .when(nameless, "reprocessed bytes but no patient context to re-assert identity")
        .when(no_date, F.concat(F.lit("read-back lost the birth_date (name ratio "), shown, F.lit(")")))
        .when(low, F.lit(f"read-back patient_name ratio below {NAME_RATIO:.2f}")).otherwise("reprocessed")
    )
    return _level(m, "L6", status, detail)


def verify_ladder(level_rows: DataFrame, levels: Sequence[str] = LEVELS, items: DataFrame | None = None) -> DataFrame:
    """VER-09. Per item: the first failing level of each half decides its outcome.

    An item without a row of every selected level is ``incomplete``, never
    verified. ``items`` adds those for which no level ran at all.
    """
    rows = level_rows.filter(F.col("level").isin(*levels))
    post = F.col("level").isin("L5", "L6")
    failed = F.when(F.col("status") == "fail", F.col("level"))
    agg = rows.groupBy("item_key").agg(
        F.min(F.when(~post, failed)).alias("pre_failed"), F.min(F.when(post, failed)).alias("post_failed"), F.countDistinct(F.when(F.col("status").isNotNull(), F.col("level"))).alias("levels_run"),
        F.max(F.coalesce((F.col("level") == "L4") & (F.col("status") == "fail"), F.lit(False))).alias("wrong_patient"))
    if items is not None:
        agg = items.select("item_key").distinct().join(agg, "item_key", "left").fillna({"levels_run": 0, "wrong_patient": False})
    outcome = (
        F.when(F.col("pre_failed").isNotNull(), "pre_verify_failed").when(F.col("post_failed").isNotNull(), "post_verify_failed")
        .when(F.col("levels_run") < len(set(levels)), "incomplete").otherwise("verified")
    )
    return agg.withColumn("outcome", outcome)


def resolve_patients(source: DataFrame, dest: DataFrame) -> DataFrame:
    """VER-10. Exactly one destination record per patient, or none, or an error.

    ``source`` and ``dest`` have ``family_name, given_name, birth_date`` and a
    nullable ``identifier``; a patient with an identifier is only searched by
    it. Matches are counted, never listed.
    """
    by_id = source.filter(F.col("identifier").isNotNull())
    rest = source.filter(F.col("identifier").isNull())

    def counted(rows: DataFrame, keys: list[str], matched_on: str) -> DataFrame:
        d = dest.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.countDistinct("dest_id").alias("n"), F.min("dest_id").alias("dest_id"))
        return rows.join(d, keys, "left").withColumn("matched_on", F.lit(matched_on))

    # A missing part of the name or date is not searched on, so each
    # combination of filled parts is its own equality join.
    pieces = [counted(by_id, ["identifier"], "identifier")]
    parts = ("family_name", "given_name", "birth_date")
    for mask in range(1, 8):
        keys = [p for i, p in enumerate(parts) if mask >> i & 1]
        filled = F.lit(True)
        for p in parts:
            filled = filled & (F.col(p).isNotNull() if p in keys else F.col(p).isNull())
        pieces.append(counted(rest.filter(filled), keys, ",".join(keys)))
    # Nothing to search on: nobody is found, and the patient still has a row.
    nothing = rest.filter(F.coalesce(*[F.col(p).cast("string") for p in parts]).isNull())
    pieces.append(nothing.withColumn("n", F.lit(0).cast("bigint")).withColumn("matched_on", F.lit("")))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece, allowMissingColumns=True)
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("not_found")
    return out.select("patient_id", status.alias("resolution"), F.when(n == 1, F.col("dest_id")).alias("dest_id"), n.alias("n_matches"), "matched_on")


def match_rows(patients: DataFrame, rows: DataFrame) -> DataFrame:
    """VER-11. Destination rows whose text holds the birth date and every name part.

    ``rows`` has ``dest_id, row_text``. The date is taken out of the row text
    for an equality join, together with the first word of the family name, so
    that a common birth date does not pair everyone born that day.
    """
    day = F.explode(F.array_distinct(F.regexp_extract_all("row_text", F.lit(r"\b(\d{2}/\d{2}/\d{4})\b"), 1)))
    r = rows.withColumn("_t", F.lower("row_text")).withColumn("_day", day).withColumn("_w", F.explode(F.array_distinct(F.split("_t", r"[^\p{L}\p{N}]+"))))
    family, given = F.lower(F.coalesce("family_name", F.lit(""))), F.lower(F.coalesce("given_name", F.lit("")))
    first_word = F.get(F.filter(F.split(F.concat_ws(" ", family, given), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lit(0))
    p = patients.filter(F.col("birth_date").isNotNull()).select("patient_id", F.date_format("birth_date", "MM/dd/yyyy").alias("_day"), first_word.alias("_w"), family.alias("_f"), given.alias("_g"))
    # Namesakes are asked for once and equal row texts are read once: both are counted, not
    # paired. Of a text's destinations only the smallest and largest matter: one, or more.
    asked = p.select("_day", "_w", "_f", "_g").distinct()
    texts = r.groupBy("_day", "_w", "_t").agg(F.min("dest_id").alias("_low"), F.max("dest_id").alias("_top"))
    hit = F.contains("_t", F.col("_f")) & F.contains("_t", F.col("_g"))
    counted = asked.join(texts, ["_day", "_w"]).filter(hit).groupBy("_day", "_w", "_f", "_g").agg(F.min("_low").alias("dest_id"), F.max("_top").alias("_top"))
    found = p.join(counted, ["_day", "_w", "_f", "_g"]).select("patient_id", F.when(F.col("dest_id") == F.col("_top"), 1).otherwise(2).alias("n"), "dest_id")
    out = patients.select("patient_id").join(found, "patient_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("patient_id", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("not_found").alias("resolution"), F.when(n == 1, F.col("dest_id")).alias("dest_id"))
