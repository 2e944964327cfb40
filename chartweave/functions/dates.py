"""Date and time column functions.

Every parser works on the written text. A value no rule knows is never turned
into a guess: ``mode`` says whether it raises, becomes NULL, or is kept for a
quarantine table (``parse_problem``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartweave.functions.text import let, strip

# One guard says which spellings are known; each rewrite below then turns one of
# them into text that a cast understands. Every step reads its input once, so
# the expression stays small however often a mapping uses it.
_HOUR, _SIXTY = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?)"
_ISO = rf"\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]{_HOUR}(?::{_SIXTY}(?::{_SIXTY}(?:[.,]\d+)?)?)?{_OFFSET}?)?"
_US_DAY = r"\d{1,2}/\d{1,2}/\d{4}"
_US = rf"{_US_DAY}(?:\s+(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d)?)?"
_US_12H = rf"{_US_DAY}\s+(?:0?[1-9]|1[0-2]):[0-5]?\d:[0-5]?\d\s+[AaPp][Mm]"
_TS = rf"\d{{8}}(?:{_HOUR}{_SIXTY}(?:{_SIXTY}(?:Z|[+-]\d{{2}}:?\d{{2}})?)?)?"
KNOWN = rf"^(?:{_ISO}|{_US}|{_US_12H}|{_TS})$"
YEAR_ONE = r"^(?:0001-.*|\d{1,2}/\d{1,2}/0001\b.*|0001\d{4}.*)$"

_US_TO_ISO_MOMENT = ((r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+([\d:]+))?$", "$3-$1-$2 $4"),)
_TO_ISO_MOMENT = (
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})", "$1-$2-$3 $4:$5:$6"),
    (r"^(.{10}[T ]\d{2})(?=Z|[+-]|$)", "$1:00"),
    (r"^(.{10}[T ]\d{2}:\d{2})(?=Z|[+-])", "$1:00"),
    (r",", "."),
    (r"(?<=:\d{2}|\.\d{1,9})([+-]\d{2})$", "$1:00"),
    (r"(?<=:\d{2}|\.\d{1,9})([+-]\d{2})(\d{2})$", "$1:$2"),
)
_TO_ISO_DAY = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}).*$", "$3-$1-$2"),
    (r"^(\d{4})(\d{2})(\d{2})\d*.*$", "$1-$2-$3"),
    (r"^(\d{4}-\d{2}-\d{2}).*$", "$1"),
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _rewrite(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


# The spelling most exports use needs no rewriting.
_PLAIN_ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]{_HOUR}:{_SIXTY}(?::{_SIXTY}(?:\.\d{{1,6}})?)?(?:Z|[+-]\d{{2}}:\d{{2}})?)?$"


def _moment(text: Column) -> Column:
    """Branches by spelling, most frequent first: a cell meets only the rewrites that can apply to it."""
    plain = F.when(~text.startswith("0001-"), text.try_cast("timestamp"))
    one_space = F.regexp_replace(text, r"\s+", " ")
    twelve_hour = F.when(~text.rlike(YEAR_ONE), F.try_to_timestamp(F.upper(one_space), F.lit("M/d/yyyy h:m:s a")))
    return (
        F.when(text.rlike(_PLAIN_ISO), plain)
        .when(text.rlike("[AaPp][Mm]$"), twelve_hour)
        .when(~text.rlike(KNOWN) | text.rlike(YEAR_ONE), F.lit(None).cast("timestamp"))
        .when(text.contains("/"), _rewrite(text, _US_TO_ISO_MOMENT).try_cast("timestamp"))
        .otherwise(_rewrite(text, _TO_ISO_MOMENT).try_cast("timestamp"))
    )


def _day(text: Column) -> Column:
    plain = F.when(~text.startswith("0001-"), F.substring(text, 1, 10).try_cast("date"))
    known = text.rlike(KNOWN) & ~text.rlike(YEAR_ONE)
    return F.when(text.rlike(_PLAIN_ISO), plain).when(known, _rewrite(text, _TO_ISO_DAY).try_cast("date"))


def _loud(text: Column, value: Column, mode: str, kind: str) -> Column:
    if mode == "null":
        return value
    if mode != "raise":
        raise ValueError(f"unknown mode {mode!r}; use 'raise' or 'null'")
    message = F.concat(F.lit(f"unrecognized {kind} format, length "), F.length(text).cast("string"))
    wrong = (text != "") & ~text.rlike(YEAR_ONE) & value.isNull()
    return F.when(wrong, F.raise_error(message).cast(kind)).otherwise(value)


def parse_dt(col: Column | str, mode: str = "null") -> Column:
    """FN-05. Timestamp of any known spelling; naive text is in the session zone (UTC).

    Year 1 is the "no value" stamp and becomes NULL in every mode.
    """
    def parse(cell: Column) -> Column:
        text = strip(cell)
        return _loud(text, _moment(text), mode, "timestamp")

    return let(_c(col), parse)


def parse_date(col: Column | str, mode: str = "null") -> Column:
    """FN-06. The calendar date as written: an offset never moves it."""
    def parse(cell: Column) -> Column:
        text = strip(cell)
        return _loud(text, _day(text), mode, "date")

    return let(_c(col), parse)


def parse_problem(col: Column | str) -> Column:
    """Why a cell cannot be read as a date/time, NULL when it can."""
    def problem(cell: Column) -> Column:
        text = strip(cell)
        bad = (text != "") & ~text.rlike(YEAR_ONE) & _moment(text).isNull()
        return F.when(bad, F.lit("unrecognized_format"))

    return let(_c(col), problem)


def to_local(col: Column | str, zone: Column | str) -> Column:
    """FN-07. Local wall clock of an instant, by IANA zone name."""
    return F.from_utc_timestamp(_c(col), zone)


def age_at(birth: Column | str, on: Column | str) -> Column:
    """FN-08. Completed years."""
    dob, day = _c(birth), _c(on)
    earlier = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(dob), F.dayofmonth(dob))
    return F.year(day) - F.year(dob) - earlier.cast("int")


def age_display(birth: Column | str, on: Column | str, mode: str = "raise") -> Column:
    """FN-09. Days under one month, months under two years, else years."""
    dob, day = _c(birth), _c(on)
    days = F.datediff(day, dob)
    months = (
        (F.year(day) - F.year(dob)) * 12 + F.month(day) - F.month(dob)
        - (F.dayofmonth(day) < F.dayofmonth(dob)).cast("int")
    )
    years = age_at(dob, day)

    def counted(n: Column, one: str, many: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))

    text = (
        F.when(months < 1, counted(days, "day", "days"))
        .when(months < 24, counted(months, "mo", "mos"))
        .otherwise(counted(years, "yr", "yrs"))
    )
    if mode == "null":
        return F.when(days >= 0, text)
    wrong = F.raise_error(F.lit("age_display: birth date is after the as-of date")).cast("string")
    return F.when(days < 0, wrong).when(days >= 0, text)


def date_spellings(col: Column | str, ladder: bool = False) -> Column:
    """FN-18. Every way a chart may write a date, without duplicates.

    ``ladder=True`` gives the delivery checks' set, which also has the
    unpadded dashed form.
    """
    day = _c(col)
    patterns = ["MMMM dd, yyyy", "MMM dd, yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "M/d/yyyy"]
    if ladder:
        patterns.append("M-d-yyyy")
    return F.when(day.isNotNull(), F.array_distinct(F.array(*[F.date_format(day, p) for p in patterns])))


def fmt_date_short(col: Column | str) -> Column:
    """FN-19. ``MM/dd/yy``."""
    return F.date_format(_c(col), "MM/dd/yy")


def fmt_date_us(col: Column | str) -> Column:
    """FN-19. ``MM/dd/yyyy``."""
    return F.date_format(_c(col), "MM/dd/yyyy")


def fmt_date_long(col: Column | str) -> Column:
    """FN-19. ``MMMM dd, yyyy``."""
    return F.date_format(_c(col), "MMMM dd, yyyy")


def fmt_signed_at(col: Column | str, zone: str) -> Column:
    """FN-19. ``MMM d, yyyy h:mm AM`` in local time, no leading zeros."""
    return F.date_format(to_local(col, zone), "MMM d, yyyy h:mm a")


def fmt_time(col: Column | str, zone: str) -> Column:
    """FN-19. ``h:mm AM`` in local time."""
    return F.date_format(to_local(col, zone), "h:mm a")


def fmt_addendum_at(col: Column | str, zone: str) -> Column:
    """VW-11. ``MM/dd/yyyy hh:mm am`` in local time, empty when absent."""
    text = F.date_format(to_local(col, zone), "MM/dd/yyyy hh:mm a")
    return F.coalesce(F.replace(F.replace(text, F.lit("AM"), F.lit("am")), F.lit("PM"), F.lit("pm")), F.lit(""))


def fhir_date(col: Column | str) -> Column:
    """FN-21. Lenient date: partial dates are padded, bad ones are NULL."""
    day = F.substring_index(_c(col), "T", 1)
    padded = (
        F.when(day.rlike(r"^\d+$") & (F.length(day) == 4), F.concat(day, F.lit("-01-01")))
        .when(day.rlike(r"^\d{4}-\d{2}$"), F.concat(day, F.lit("-01")))
        .when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)
    )
    return padded.try_cast("date")


def fhir_datetime(col: Column | str) -> Column:
    """FN-21. Lenient timestamp: a partial or date-only value is its midnight."""
    text = _c(col)
    exact = F.when(text.rlike(rf"^{_ISO}$"), _moment(text))
    return F.coalesce(exact, fhir_date(text).cast("timestamp"))


def cda_ts(col: Column | str) -> Column:
    """FN-30. ``yyyyMMddHHmmss+0000`` text of an instant (session zone UTC)."""
    return F.date_format(_c(col), "yyyyMMddHHmmssxx")


def cda_date(col: Column | str) -> Column:
    """FN-30. ``yyyyMMdd`` text of a date."""
    return F.date_format(_c(col), "yyyyMMdd")
