"""Text column functions: cell hygiene, phones, note HTML, tokens, redaction."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell spellings that mean "no value".
NULL_TOKENS = (r"\N", "NULL", "null")
NUMERIC_SENTINELS = ("-1", "-1.0")

# Tags that end a paragraph, start a line, or separate cells.
PARAGRAPH_TAGS = ("p", "blockquote", "table", "h1", "h2", "h3", "h4", "h5", "h6")
LINE_TAGS = ("div", "br", "hr", "li", "ul", "ol", "tr", "section")
CELL_TAGS = ("td", "th")

# Personal-data shapes and what replaces them.
REDACTIONS = (
    (r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[REDACTED-SSN]"),
    (r"(?U)\(\d{3}\)\s*\d{3}-\d{4}|\b\d{3}[-.]\d{3}[-.]\d{4}\b", "[REDACTED-PHONE]"),
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[REDACTED-EMAIL]"),
    (r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", "[REDACTED-DATE]"),
)

# Filler blocks that carry no content, and the wrapper class.
EMPTY_BLOCKS = (
    r"(?i)<p[^>]*>\s*(?:&nbsp;|&#160;|<br\s*/?>)?\s*</p>",
    r"(?i)<div[^>]*>\s*(?:&nbsp;|&#160;|<br\s*/?>)?\s*</div>",
    r"(?i)<h([1-6])[^>]*>\s*(?:&nbsp;|&#160;|<br\s*/?>)?\s*</h\1>",
)
STRAY_NEWLINE = r"\n(?!</(?:p|div|ul|ol|li|h[1-6])>)(?!<(?:p|div|ul|ol|li|h[1-6])[ >])"
RICH_TEXT_CLASS = "pf-rich-text"

# Every character Python and Unicode count as white space.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_WS = r"\s\x1c-\x1f\x85\xa0  -     　"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, fn) -> Column:
    """``fn`` of a value as one small expression.

    A long chain of rewrites is inlined into generated code wherever it is
    used, and several of them exceed what one method may hold. Inside a
    higher-order function the chain stays a single node, evaluated once.
    """
    return F.transform(F.array(value), fn)[0]


def blank_to_null(col: Column | str) -> Column:
    """The column, with the empty string as NULL."""
    return F.nullif(_c(col), F.lit(""))


def strip(col: Column | str) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.trim(_c(col), F.lit(WHITESPACE))


def clean_cell(col: Column | str) -> Column:
    """FN-01. Trimmed text; null tokens and blanks become NULL."""
    text = strip(col)
    return F.when(~text.isin("", *NULL_TOKENS), text)


def clean_numeric(col: Column | str) -> Column:
    """FN-02. ``clean_cell`` plus the "not set" numbers."""
    text = clean_cell(col)
    return F.when(~text.isin(*NUMERIC_SENTINELS), text)


def format_phone(col: Column | str) -> Column:
    """FN-03. ``(XXX) XXX-XXXX`` for 10 digits, or 11 with a leading 1."""
    digits = F.regexp_replace(_c(col), "[^0-9]", "")
    pretty = F.regexp_replace(digits, r"^1?(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")
    return F.when(pretty.startswith("("), pretty).otherwise(clean_cell(col))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _unescape_reference(found: re.Match) -> str:
    ref = found.group()
    return html.unescape(ref) if ref[1] == "#" else html5.get(ref[1:], ref)


@F.pandas_udf(T.StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _CLOSED.sub(_unescape_reference, t), na_action="ignore")


def decode_entities(col: Column | str, closed: bool = False) -> Column:
    """Decode character references; ``closed`` leaves those without their semicolon as they are.

    The frequent ones are replaced inside the JVM. Only a value that still
    holds another reference is sent to Python; the rest travel as NULL.
    """
    text = _c(col)
    other = text.rlike(r"&(?:#|(?!(?:lt|gt|quot|nbsp|amp);)[A-Za-z])")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(text if name == "&nbsp;" else plain, F.lit(name), F.lit(char))
    return F.coalesce((_unescape_closed if closed else _unescape)(F.when(other, text)), plain)


_ANY_TAG = r"""</?[A-Za-z][^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""


def _tag(names: tuple[str, ...], close: str) -> str:
    alternatives = "|".join(names)
    return rf"""(?i)<{close}(?:{alternatives})(?=[\s/>])[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""


_BREAK = "\u0001"


def _html_structure(text: Column) -> Column:
    """Tags to line breaks and spaces; references are still encoded."""
    text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\z)", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)|<[!?][^>]*+>", "")
    text = F.regexp_replace(text, _tag(PARAGRAPH_TAGS, "/?"), _BREAK)
    text = F.regexp_replace(text, _tag(LINE_TAGS, ""), _BREAK)
    text = F.regexp_replace(text, _tag(CELL_TAGS, "/?"), " ")
    return F.regexp_replace(text, _ANY_TAG, "")


def _html_lines(text: Column) -> Column:
    text = F.regexp_replace(text, f"[{_WS}]+", " ")
    text = F.regexp_replace(text, f" *{_BREAK} *", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def html_to_text(col: Column | str) -> Column:
    """FN-04. Readable text of an HTML fragment, NULL when nothing is left."""
    return blank_to_null(_html_lines(decode_entities(_html_structure(_c(col)))))


def with_html_text(df: DataFrame, cols: Mapping[str, Column], closed: bool = False) -> DataFrame:
    """FN-04 for several columns of a table, each step computed once per row.

    A column function repeats its input where it is used twice. Here every
    step is a column of its own, so long notes are rewritten only once.
    """
    df = df.withColumns({f"_h_{out}": let(col, _html_structure) for out, col in cols.items()})
    df = df.withColumns({f"_d_{out}": decode_entities(f"_h_{out}", closed) for out in cols})
    df = df.withColumns({f"_t_{out}": let(F.col(f"_d_{out}"), _html_lines) for out in cols})
    df = df.withColumns({out: blank_to_null(f"_t_{out}") for out in cols})
    return df.drop(*[f"_{k}_{out}" for out in cols for k in "hdt"])


def escape_html(col: Column | str) -> Column:
    """Escape text for HTML or XML content and attributes."""
    text = _c(col)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _note_raw(text: Column) -> Column:
    raw = strip(F.coalesce(text, F.lit("")))
    return F.replace(F.replace(raw, F.lit("\\\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))


def _note_rich(raw: Column) -> Column:
    rich = F.regexp_replace(raw, STRAY_NEWLINE, "<br>\n")
    for pattern in EMPTY_BLOCKS:
        rich = F.regexp_replace(rich, pattern, "")
    return rich


def _note_final(raw: Column, rich: Column) -> Column:
    wrapper = F.concat(F.lit(f'<div class="{RICH_TEXT_CLASS}">'), rich, F.lit("</div>"))
    plain = strip(F.replace(escape_html(raw), F.lit("\n"), F.lit("<br>")))
    return F.when(~raw.contains("<"), plain).when(rich.contains(RICH_TEXT_CLASS), strip(rich)).otherwise(wrapper)


def sanitize_note_html(col: Column | str) -> Column:
    """FN-15. Repair note HTML for display; plain text is escaped."""
    raw = _note_raw(_c(col))
    return _note_final(raw, _note_rich(raw))


def with_note_html(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """FN-15 for several columns of a table, each step computed once per row."""
    df = df.withColumns({f"_r_{out}": let(col, _note_raw) for out, col in cols.items()})
    df = df.withColumns({f"_n_{out}": let(F.col(f"_r_{out}"), _note_rich) for out in cols})
    df = df.withColumns({out: _note_final(F.col(f"_r_{out}"), F.col(f"_n_{out}")) for out in cols})
    return df.drop(*[f"_{k}_{out}" for out in cols for k in "rn"])


def safe_token(col: Column | str, fallback: Column | str | None = None) -> Column:
    """FN-16. Text fit for a file name; ``fallback`` when nothing is left."""
    token = F.regexp_replace(_c(col), "[^A-Za-z0-9_-]+", "_")
    token = blank_to_null(F.regexp_replace(token, "^_+|_+$", ""))
    if fallback is None:
        return token
    return F.coalesce(token, F.lit(fallback) if isinstance(fallback, str) else fallback)


def document_name(
    family: Column | str, given: Column | str, service_date: Column | str, kind: Column | str
) -> Column:
    """FN-17. ``Family_Given_MM-dd-yyyy_kind.pdf`` with safe parts."""
    date_text = F.coalesce(F.date_format(_c(service_date), "MM-dd-yyyy"), F.lit("undated"))
    return F.concat(
        safe_token(family, "unknown"), F.lit("_"), safe_token(given, "unknown"), F.lit("_"),
        date_text, F.lit("_"), safe_token(kind, "unknown"), F.lit(".pdf"),
    )


def norm_text(col: Column | str, lower: bool = False) -> Column:
    """FN-28. Single spaces, trimmed, optionally lower case."""
    text = strip(F.regexp_replace(_c(col), f"[{_WS}]+", " "))
    return F.lower(text) if lower else text


def slug(col: Column | str) -> Column:
    """FN-29. Lower-case identifier of a heading."""
    token = F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", "_")
    return F.coalesce(blank_to_null(F.regexp_replace(token, "^_+|_+$", "")), F.lit("section"))


def redact(col: Column | str) -> Column:
    """FN-20. Replace SSN, phone, e-mail and date shapes."""
    text = _c(col)
    for pattern, label in REDACTIONS:
        text = F.regexp_replace(text, pattern, label)
    return text


def present(needle: Column | str, text: Column | str) -> Column:
    """FLT-06. The needle stands alone: no word character or dot beside it.

    The pattern is only built where the text holds the needle at all.
    """
    quoted = F.concat(F.lit(r"(?U)(?<![\w.])\Q"), F.replace(_c(needle), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\w.])"))
    return F.when(~F.contains(_c(text), _c(needle)), F.lit(False)).otherwise(F.call_function("rlike", _c(text), quoted))


def num_str(col: Column | str) -> Column:
    """FN-23. Number as clean text: whole numbers lose the decimal part."""
    number = _c(col).cast("double")
    whole = F.floor(number) == number
    return F.when(whole & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(
        number.cast("string")
    )


def fmt_copay(col: Column | str) -> Column:
    """FN-24. ``-`` for nothing, no decimals on whole amounts, else shortest."""
    raw = _c(col)
    number = raw.try_cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""), r"\.$", "")
    return (
        F.when(raw.isNull() | (raw == ""), F.lit("-"))
        .when(number.isNull() | F.isnan(number), raw)
        .when(F.floor(number) == number, number.cast("bigint").cast("string"))
        .otherwise(short)
    )


def decode_attachment(col: Column | str) -> Column:
    """FN-26. Base64 text to UTF-8 text; NULL when it is not base64."""
    raw = F.try_to_binary(_c(col), F.lit("base64"))
    return F.try_validate_utf8(raw.cast("string"))
