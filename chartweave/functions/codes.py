"""Clinical codes: vital signs, pain answers, BMI, code shapes, script labels.

The tables below are fixed values: results depend on their exact spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kind, primary code, display, unit, other accepted codes.
VITALS = (
    ("height", "8302-2", "Body height", "[in_i]", ()),
    ("weight", "3141-9", "Body weight", "[lb_av]", ("29463-7",)),
    ("bmi", "39156-5", "Body mass index (BMI) [Ratio]", "kg/m2", ()),
    ("bmi_percentile", "59576-9", "Body mass index (BMI) [Percentile]", "%", ()),
    ("systolic_bp", "8480-6", "Systolic blood pressure", "mm[Hg]", ()),
    ("diastolic_bp", "8462-4", "Diastolic blood pressure", "mm[Hg]", ()),
    ("heart_rate", "8867-4", "Heart rate", "/min", ()),
    ("respiratory_rate", "9279-1", "Respiratory rate", "/min", ()),
    ("temperature", "8310-5", "Body temperature", "[degF]", ()),
    ("oxygen_saturation", "2708-6", "Oxygen saturation in Arterial blood", "%", ("59408-5",)),
    ("pain_severity", "72514-3", "Pain severity - 0-10 verbal numeric rating [Score]", "{score}", ()),
    ("head_circumference", "8287-5", "Head Occipital-frontal circumference", "[in_i]", ("9843-4",)),
)

# Chart row label of each kind, and the order of the rows.
VITAL_LABELS = {
    "height": "Height",
    "weight": "Weight",
    "bmi": "BMI",
    "bmi_percentile": "BMI Percentile",
    "systolic_bp": "Systolic BP",
    "diastolic_bp": "Diastolic BP",
    "heart_rate": "Pulse",
    "respiratory_rate": "Respiratory rate",
    "temperature": "Temperature",
    "oxygen_saturation": "O2 Saturation",
    "pain_severity": "Pain",
    "head_circumference": "Head Circumference",
}
VITAL_ROW_ORDER = (
    "Height", "Weight", "BMI", "BMI Percentile", "Blood Pressure", "Temperature",
    "Pulse", "Respiratory rate", "O2 Saturation", "Pain", "Head Circumference",
)

# Pain answer codes and their level.
PAIN_LEVELS = {
    "LA6111-4": 0, "LA6112-2": 1, "LA6113-0": 2, "LA6114-8": 3, "LA6115-5": 4, "LA6116-3": 5,
    "LA6117-1": 6, "LA6118-9": 7, "LA6119-7": 8, "LA6120-5": 9, "LA6121-3": 10,
    "LA10137-0": 5, "LA10138-8": 6, "LA10139-6": 7, "LA10140-4": 8, "LA10141-2": 9, "LA13942-0": 10,
}

# Script transition text, prefix, label, and the label's priority.
SCRIPT_LABELS = (
    ("order sent", "ESCRIPT", "VERIFIED", 50),
    ("prescription printed", "SCRIPT", "PRINTED", 48),
    ("cancellation request sent to pharmacy", "ESCRIPT", "CANCELLATION REQUESTED", 80),
    ("cancellation approved by pharmacy", "ESCRIPT", "CANCELLED", 90),
    ("cancellation denied by pharmacy", "ESCRIPT", "CANCELLATION DENIED", 85),
    ("prescription dispensed", "ESCRIPT", "DISPENSED", 100),
    ("prescription partially dispensed", "ESCRIPT", "PARTIALLY DISPENSED", 95),
    ("prescription not dispensed", "ESCRIPT", "NOT DISPENSED", 92),
    ("refill request received", "ESCRIPT", "REFILL REQUEST RECEIVED", 10),
    ("refill request approved", "ESCRIPT", "REFILL REQUEST APPROVED", 10),
    ("refill request denied", "ESCRIPT", "REFILL REQUEST DENIED", 10),
    ("refill request replaced", "ESCRIPT", "REFILL REQUEST REPLACED", 10),
    ("change request approved", "ESCRIPT", "CHANGE REQUEST APPROVED", 10),
    ("change request denied", "ESCRIPT", "CHANGE REQUEST DENIED", 10),
    ("therapeutic interchange request received", "ESCRIPT", "INTERCHANGE REQUEST RECEIVED", 10),
    ("script clarification", "ESCRIPT", "CLARIFICATION", 10),
    ("prescription recorded", "SCRIPT", "RECORDED", 45),
    ("out of stock", "ESCRIPT", "OUT OF STOCK", 10),
    ("prior authorization request received", "ESCRIPT", "PRIOR AUTH REQUESTED", 10),
)

# Status word priority, used when no transition text is known.
STATUS_PRIORITY = {
    "error": 100, "failed": 100, "cancelled": 90, "canceled": 90, "dispensed": 100,
    "verified": 50, "sent": 40, "recorded": 45, "printed": 48,
}

# Order of benefits.
BENEFIT_ORDER = {"primary": 0, "secondary": 1, "tertiary": 2, "quaternary": 3, "other": 99}

# Code shapes.
ICD10_SHAPE = r"(?U)\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?)\b"
SNOMED_SHAPE = r"(?U)\b([0-9]{6,18})\b"
PLAN_TYPE_SHAPE = r"(?i)\((PPO|HMO|EPO|POS|HDHP|PFFS)\)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def map_lit(values: dict) -> Column:
    """A literal map column for a small fixed dictionary."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict, key: Column | str) -> Column:
    """The value of ``key`` in a small fixed dictionary, NULL when absent."""
    return F.try_element_at(map_lit(values), F.coalesce(_c(key), F.lit("")))


VITAL_KIND_BY_CODE = {code: kind for kind, primary, _, _, more in VITALS for code in (primary, *more)}
VITAL_DISPLAY_BY_CODE = {code: disp for _, primary, disp, _, more in VITALS for code in (primary, *more)}
VITAL_LABEL_BY_CODE = {code: VITAL_LABELS[kind] for code, kind in VITAL_KIND_BY_CODE.items()}
VITAL_CODE_BY_KIND = {kind: primary for kind, primary, _, _, _ in VITALS}
PAIN_CODES = tuple(c for c, k in VITAL_KIND_BY_CODE.items() if k == "pain_severity")


def vitals_dim(spark: SparkSession) -> DataFrame:
    """One row per accepted vital code (a fixed 15 rows)."""
    rows = [
        (code, kind, primary, display, unit, VITAL_LABELS[kind])
        for kind, primary, display, unit, more in VITALS
        for code in (primary, *more)
    ]
    return spark.createDataFrame(rows, "code string, kind string, primary_code string, display string, unit string, label string")


def pain_display(col: Column | str) -> Column:
    """FN-10. 0..10 display value of a pain answer; unknown text is kept."""
    raw = F.nullif(_c(col), F.lit(""))
    text = F.regexp_replace(F.trim(raw), "^LOINC:", "")
    number = text.try_cast("double")
    whole = F.when(number.between(-0.9999999999, 10.9999999999), number.cast("int"))
    return F.coalesce(lookup(PAIN_LEVELS, text).cast("string"), whole.cast("string"), text)


def bmi_metric(weight_kg: Column | str, height_cm: Column | str) -> Column:
    """FN-11. kg/m2 to two decimals, NULL when it cannot be computed."""
    w, h = _c(weight_kg), _c(height_cm)
    return F.when((w > 0) & (h > 0), F.round(w / F.pow(h / 100.0, F.lit(2)), 2))


def bmi_imperial(weight_lb: Column | str, height_in: Column | str) -> Column:
    """FN-11. The same from pounds and inches."""
    w, h = _c(weight_lb), _c(height_in)
    return F.when((w > 0) & (h > 0), F.round(F.lit(703.0) * w / F.pow(h, F.lit(2)), 2))


def to_cm(value: Column | str, unit: Column | str) -> Column:
    """FN-12. Inches to centimetres when the unit starts with ``in``."""
    v = _c(value)
    return F.when(F.lower(F.coalesce(_c(unit), F.lit(""))).startswith("in"), v * 2.54).otherwise(v)


def to_kg(value: Column | str, unit: Column | str) -> Column:
    """FN-12. Pounds to kilograms when the unit starts with ``lb``."""
    v = _c(value)
    return F.when(F.lower(F.coalesce(_c(unit), F.lit(""))).startswith("lb"), v * 0.45359237).otherwise(v)


def _first_match(col: Column | str, shape: str) -> Column:
    return F.nullif(F.regexp_extract(_c(col), shape, 1), F.lit(""))


def extract_icd10(col: Column | str) -> Column:
    """FN-13. First ICD-10 shaped code in free text."""
    return _first_match(col, ICD10_SHAPE)


def extract_snomed(col: Column | str) -> Column:
    """FN-13. First SNOMED shaped code in free text."""
    return _first_match(col, SNOMED_SHAPE)


def plan_type_suffix(col: Column | str) -> Column:
    """FN-14. Plan type from a ``(PPO)``-style part of a plan name."""
    return F.upper(_first_match(col, PLAN_TYPE_SHAPE))


def luminance(rgb: Column | str) -> Column:
    """FN-27. 0..255 luminance of a 24-bit colour."""
    v = _c(rgb).cast("int")
    r = F.shiftright(v, 16).bitwiseAND(255)
    g = F.shiftright(v, 8).bitwiseAND(255)
    b = v.bitwiseAND(255)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b
