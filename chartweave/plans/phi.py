"""Personal-data scanning over text corpora (PHI-01..04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.text import redact

# Token and pattern shapes, and the synthetic-data conventions.
WORD = r"[A-Za-z]{2,}"
GUID = r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
OPAQUE = r"(?U)\b[A-Za-z0-9_-]{24,}\b"
SSN = r"(?U)\b(\d{3})-(\d{2})-(\d{4})\b"
PHONE = r"(?U)\(?\b(\d{3})\)?[ .-](\d{3})[ .-]\d{4}\b"
BIRTH = r"(?iU)(?:dob|birth)\W{0,40}?(\d{1,2}/\d{1,2}/(?:19|20)\d{2})"
SYNTHETIC_GUIDS = ("feedface-", "00000000-")
SYNTHETIC_AREAS = (0, 666)


def _all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def candidate_tokens(text: Column | str) -> Column:
    """Distinct lower-case tokens to test: words, word pairs, GUIDs, opaque runs."""
    words = F.transform(_all(text, WORD), F.lower)
    size = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(size - 1, F.lit(0))), F.slice(words, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    long_words = F.filter(words, lambda w: F.length(w) >= 4)
    return F.array_distinct(F.concat(long_words, pairs, F.transform(_all(text, GUID), F.lower), F.transform(_all(text, OPAQUE), F.lower)))


def scannable(df: DataFrame, text: str = "text") -> DataFrame:
    """PHI-03. Texts without a NUL anywhere; ``skipped_binary`` names the others."""
    return df.filter(~F.contains(F.coalesce(text, F.lit("")), F.lit("\u0000")))


def skipped_binary(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """PHI-03. Texts that no scan reads, because they hold a NUL."""
    return df.filter(F.contains(text, F.lit("\u0000"))).select(path)


def denylist_scan(df: DataFrame, deny: DataFrame, allow: DataFrame | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """PHI-01. Tokens whose hash is on the deny-list; only the hash is reported.

    ``deny`` has ``sha256``; ``allow`` has ``token``. The list side is
    broadcast only where its measured size permits.
    """
    tokens = df.select(path, F.explode(candidate_tokens(text)).alias("token"))
    hashed = tokens.withColumn("sha256", F.sha2(F.col("token").cast("binary"), 256))
    # The deny-list thins the tokens before anything else sees them.
    denied = hashed.join(deny.select("sha256").distinct(), "sha256", "left_semi")
    if allow is not None:
        denied = denied.join(allow.select("token").distinct(), "token", "left_anti")
    return denied.select(path, "sha256")


def _matches(text: str, pattern: str) -> Column:
    return F.explode(_all(text, pattern))


def pattern_findings(df: DataFrame, allow: DataFrame | None = None, path: str = "path", text: str = "text", fixture: Column | None = None) -> DataFrame:
    """PHI-02. GUID, SSN, phone and birth-date findings: ``path, kind, value``.

    ``fixture`` marks texts where phones and birth dates are expected.
    """
    base = df.select(path, text, (F.lit(False) if fixture is None else fixture).alias("_fix"))
    guid = base.select(path, F.lit("guid").alias("kind"), F.explode(F.transform(_all(text, GUID), F.lower)).alias("value"))
    guid = guid.filter(~F.col("value").startswith(SYNTHETIC_GUIDS[0]) & ~F.col("value").startswith(SYNTHETIC_GUIDS[1]))
    ssn = base.select(path, F.lit("ssn").alias("kind"), _matches(text, SSN).alias("value"))
    area = F.substring("value", 1, 3).cast("int")
    ssn = ssn.filter(~area.isin(*SYNTHETIC_AREAS) & (area < 900))
    open_text = base.filter(~F.col("_fix"))
    phone = open_text.select(path, F.lit("phone").alias("kind"), _matches(text, PHONE).alias("value"))
    phone = phone.filter(F.regexp_extract("value", PHONE, 2) != "555")
    birth = open_text.select(path, F.lit("birth_date").alias("kind"), F.explode(_all(text, BIRTH, 1)).alias("value"))
    out = guid.unionByName(ssn).unionByName(phone).unionByName(birth)
    if allow is not None:
        out = out.join(allow.select(F.col("token").alias("value")).distinct(), "value", "left_anti").select(path, "kind", "value")
    return out


def scan_summary(findings: DataFrame, path: str = "path", skipped: DataFrame | None = None) -> DataFrame:
    """PHI-03. Findings per text, and a row ``skipped_binary`` for each text that wasn't read."""
    found = findings.groupBy(path).agg(F.count(F.lit(1)).alias("n_findings")).withColumn("status", F.lit("findings"))
    if skipped is None:
        return found
    return found.unionByName(skipped.select(path, F.lit(None).cast("bigint").alias("n_findings"), F.lit("skipped_binary").alias("status")))


def redact_column(df: DataFrame, col: str) -> DataFrame:
    """PHI-04. The table with one text column redacted."""
    return df.withColumn(col, redact(col))
