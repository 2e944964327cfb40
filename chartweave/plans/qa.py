"""Document checks as tables (QA-01..05, JN-13).

``inputs`` has one row per document: ``doc_id, encounter_id, patient_id, text,
display_name, birth_date, date_of_service``. A check gives one row per finding,
or one row without a finding, so a document with very many findings is never
gathered into one list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.dates import date_spellings
from chartweave.functions.text import present, strip
from chartweave.operators.folds import VERDICT_RANK, document_verdict
from chartweave.session import cut_lineage

# Page sizes in points, and the tolerated difference.
PAGE_SIZES = {"Letter": (612.0, 792.0), "A4": (595.0, 842.0)}
PAGE_TOLERANCE = 2
CRASHED = "check crashed ({})"
# The finding texts of QA-01 to QA-03, which reports are compared by, stand below
# where they are used ("... not found on document", "... geometry not verified" and the like).


def qa_input(docs: DataFrame, encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """JN-13. Documents with their encounter and patient; a document that has none is an error."""
    e = encounters.select("encounter_id", "date_of_service", F.lit(True).alias("_e"))
    p = patients.select("patient_id", F.nullif(F.concat_ws(" ", "given_name", "family_name"), F.lit("")).alias("display_name"), "birth_date", F.lit(True).alias("_p"))
    joined = docs.join(e, "encounter_id", "left").join(p, "patient_id", "left")
    missing = F.raise_error(F.concat(F.lit("no encounter or patient for document "), F.col("doc_id").cast("string"))).cast("string")
    known = F.when(F.col("_e").isNull() | F.col("_p").isNull(), missing).otherwise(F.col("text"))
    return joined.withColumn("text", known).drop("_e", "_p")


def _any_spelling(day: Column | str, text: Column | str) -> Column:
    return F.coalesce(F.exists(date_spellings(day), lambda s: present(s, F.col(text) if isinstance(text, str) else text)), F.lit(False))


def _rows(df: DataFrame, check: str, findings: Column) -> DataFrame:
    """Long rows of a check from an array of (verdict, finding) structs."""
    return df.select("doc_id", F.explode_outer(findings).alias("f")).select(
        "doc_id", F.lit(check).alias("check"), F.coalesce("f.verdict", F.lit("pass")).alias("verdict"), F.col("f.finding").alias("finding"))


def _findings(*pairs: tuple[Column, str, Column]) -> Column:
    entries = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(verdict).alias("verdict"), text.alias("finding"))) for cond, verdict, text in pairs])
    return F.filter(entries, lambda e: e.isNotNull())


def check_identity(inputs: DataFrame) -> DataFrame:
    """QA-01. Name, birth date and visit date stand on the document; unreadable text holds none of them."""
    inputs = inputs.withColumn("text", F.coalesce("text", F.lit("")))
    name, dob, dos = F.col("display_name"), F.col("birth_date"), F.col("date_of_service")
    return _rows(inputs, "data_integrity", _findings(
        (name.isNotNull() & ~present(name, "text"), "fail", F.lit("patient name not found on document")),
        (dob.isNotNull() & ~_any_spelling("birth_date", "text"), "fail", F.lit("date of birth not found on document")),
        (name.isNull() & dob.isNull(), "warn", F.lit("record carries no identity anchors (name/DOB) to verify")),
        (dos.isNotNull() & ~_any_spelling("date_of_service", "text"), "fail", F.lit("date of service not found on document")),
    ))


def check_layout(docs: DataFrame, pages: DataFrame, page_size: str = "Letter") -> DataFrame:
    """QA-02. Pages exist, are not blank, and have the declared size."""
    expected = PAGE_SIZES.get(page_size)
    blank = F.coalesce(strip("text"), F.lit("")) == ""
    page = F.col("page_no").cast("string")
    found = [(blank, "fail", F.concat(F.lit("page "), page, F.lit(" is blank")))]
    if expected is not None:
        off = (F.abs(F.col("width") - expected[0]) > PAGE_TOLERANCE) | (F.abs(F.col("height") - expected[1]) > PAGE_TOLERANCE)
        size = F.concat(F.lit("page "), page, F.lit(" is "), F.format_string("%.0fx%.0f", "width", "height"), F.lit(f"pt, expected {page_size}"))
        found.append((off, "warn", size))
    per_page = pages.select("doc_id", F.explode(_findings(*found)).alias("f"))
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    whole = docs.select("doc_id").join(counts, "doc_id", "left")
    unknown = F.lit(expected is None) & F.col("n_pages").isNotNull()
    per_doc = whole.select("doc_id", F.explode(_findings(
        (F.col("n_pages").isNull(), "fail", F.lit("document has no pages")),
        (unknown, "warn", F.lit(f"unrecognized page size {page_size!r}: geometry not verified")))).alias("f"))
    found_rows = per_page.unionByName(per_doc).select("doc_id", "f.verdict", "f.finding")
    return whole.select("doc_id").join(found_rows, "doc_id", "left").select(
        "doc_id", F.lit("layout_pagination").alias("check"), F.coalesce("verdict", F.lit("pass")).alias("verdict"), "finding")


def check_vitals(inputs: DataFrame, observations: DataFrame, enabled: bool = True) -> DataFrame:
    """QA-03. Every charted vital value stands on the document."""
    if not enabled:
        return inputs.select("doc_id", F.lit("vitals_loinc").alias("check"), F.lit("pass").alias("verdict"), F.lit("vitals section disabled by flags").alias("finding"))
    vitals = observations.filter((F.col("category") == "vital-signs") & (F.coalesce("value", F.lit("")) != "")).select(
        "encounter_id", F.coalesce("display", "code").alias("_label"), F.col("value").alias("_value"))
    # A value occurs once per (encounter, label, value), however often charted.
    joined = inputs.select("doc_id", "encounter_id", F.coalesce("text", F.lit("")).alias("text")).join(vitals.distinct(), "encounter_id")
    finding = F.concat(F.lit("vital "), F.coalesce("_label", F.lit("")), F.lit(" value '"), F.col("_value"), F.lit("' not found"))
    missing = joined.filter(~F.coalesce(present("_value", "text"), F.lit(False))).select("doc_id", F.lit("fail").alias("verdict"), finding.alias("finding"))
    return inputs.select("doc_id").join(missing, "doc_id", "left").select(
        "doc_id", F.lit("vitals_loinc").alias("check"), F.coalesce("verdict", F.lit("pass")).alias("verdict"), "finding")


def check_staleness(inputs: DataFrame, run_date: str) -> DataFrame:
    """QA-04. The run's own date on a chart of another day warns."""
    today = F.lit(run_date).cast("date")
    other = ~F.coalesce(F.col("date_of_service") == today, F.lit(False))
    hits = F.filter(F.array_sort(date_spellings(today)), lambda s: other & present(s, F.col("text")))
    found = F.transform(hits, lambda s: F.struct(F.lit("warn").alias("verdict"), F.concat(F.lit("run date ("), s, F.lit(") appears on a chart dated "), F.coalesce(F.col("date_of_service").cast("string"), F.lit("None"))).alias("finding")))
    return _rows(inputs, "date_staleness", found)


#: Checks by name, each from ``inputs`` to rows ``doc_id, check, verdict, finding``.
CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {"data_integrity": check_identity}
#: Parts a failing batch is split into (a power of two), and jobs that look for what fails.
FAN_OUT_BITS, MOST_JOBS = 4, 2_000


def register(name: str):
    """Add a check under a name; a name that is taken is an error."""

    def add(check: Callable[[DataFrame], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"duplicate check {name}")
        CHECKS[name] = check
        return check

    return add


def row_check(name: str, fn: Callable[[Mapping], Sequence[tuple[str, str]]], columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A check from a Python function of one document, which gives its ``(verdict, finding)`` pairs.

    ``columns`` are what it reads. A document it raises on has one failed row, the others have theirs.
    """

    def check(inputs: DataFrame) -> DataFrame:
        def run(frames: Iterator):
            import pandas as pd

            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    doc, values = row[0], dict(zip(columns, row[1:], strict=True))
                    try:
                        found = list(fn(values)) or [("pass", None)]
                    except Exception as exc:  # noqa: BLE001 - one document must not end the batch
                        found = [("fail", CRASHED.format(type(exc).__name__))]
                    out += [(doc, name, verdict, finding) for verdict, finding in found]
                yield pd.DataFrame(out, columns=["doc_id", "check", "verdict", "finding"])

        kind = inputs.schema["doc_id"].dataType.simpleString()
        return inputs.select("doc_id", *columns).mapInPandas(run, f"doc_id {kind}, check string, verdict string, finding string")

    return check


def run_checks(inputs: DataFrame, checks: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, most_jobs: int = MOST_JOBS) -> DataFrame:
    """QA-05. Rows of every check over every document; where a check crashes, the document has one failed row.

    A check runs once and its rows are written out. If that fails, the batch is split by a
    hash of the document until the documents that fail stand alone; all others keep what the
    check says of them. A check that can't be planned fails on every document. ``most_jobs``
    bounds the search for each check: parts that are left then fail as a whole.
    """
    checks = CHECKS if checks is None else checks
    if not checks:
        raise ValueError("no check to run")
    return reduce(DataFrame.unionByName, [_isolated(inputs, name, check, most_jobs) for name, check in checks.items()])


def _isolated(inputs: DataFrame, name: str, check: Callable[[DataFrame], DataFrame], most_jobs: int) -> DataFrame:
    crashed = lambda part, why: part.select("doc_id", F.lit(name).alias("check"), F.lit("fail").alias("verdict"), F.lit(why).alias("finding")).distinct()
    try:
        rows = check(inputs)
    except Exception as exc:  # noqa: BLE001 - one bad check must not end the batch
        return crashed(inputs, _why(exc))
    try:
        return cut_lineage(rows)
    except Exception as exc:  # noqa: BLE001
        parts = _failing_parts(inputs, check, _why(exc), most_jobs)
    good, out = inputs, []
    for inside, why in parts:
        good = good.filter(~inside)
        out.append(crashed(inputs.filter(inside), why))
    return reduce(DataFrame.unionByName, out, cut_lineage(check(good)))


def _failing_parts(inputs: DataFrame, check: Callable[[DataFrame], DataFrame], why: str, most_jobs: int) -> list[tuple[Column, str]]:
    """Conditions on documents that fail alone, with the reason."""
    key = F.xxhash64("doc_id")
    found, todo, jobs = [], [(0, 0, why)], 0
    while todo:
        bits, prefix, why = todo.pop()
        inside = F.shiftrightunsigned(key, 64 - bits) == prefix if bits else F.lit(True)
        part = inputs.filter(inside)
        if bits == 64 or jobs >= most_jobs or part.select("doc_id").distinct().limit(2).count() < 2:
            found.append((inside, why))
            continue
        bits += FAN_OUT_BITS
        for r in part.select(F.shiftrightunsigned(key, 64 - bits).alias("p")).distinct().collect():
            jobs += 1
            try:
                check(inputs.filter(F.shiftrightunsigned(key, 64 - bits) == r.p)).write.format("noop").mode("overwrite").save()
            except Exception as exc:  # noqa: BLE001
                todo.append((bits, r.p, _why(exc)))
    return found


def _why(exc: Exception) -> str:
    """The kind of error, never its message, which may quote a chart."""
    condition = exc.getCondition() if isinstance(exc, PySparkException) else None
    return CRASHED.format(condition or type(exc).__name__)


def check_verdicts(results: DataFrame) -> DataFrame:
    """Verdict per document and check."""
    return document_verdict(results, ["doc_id", "check"])


__all__ = ["CHECKS", "VERDICT_RANK", "check_identity", "check_layout", "check_staleness", "check_verdicts", "check_vitals", "qa_input", "register", "row_check", "run_checks"]
