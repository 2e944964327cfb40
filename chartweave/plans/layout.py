"""Layout statistics over document corpora (LAY-01..10).

``spans``: ``sample_index, page_index, text, font, size, bold, x0, y0, x1, y1,
page_width, page_height``. Positions and sizes come rounded to 0.1 pt, so the
distinct values of a page scale are few, whatever the number of spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.functions.codes import luminance
from chartweave.functions.text import norm_text, strip
from chartweave.operators.selection import counted_medians, exact_quantiles, greedy_ranges

# Tolerances and thresholds.
SIZE_TOLERANCE = 0.25
COLUMN_TOLERANCE = 1.0
STATIC_SHARE = 0.6
TOP_SHARE = 0.15
MAX_COLUMNS = 6
BAND_LUMINANCE = (200.0, 252.0)
WHITE = 0xF8
DEFAULT_BAND = "#f1f1f1"
# Label patterns and the field each one names, in order.
LABEL_PATTERNS = (
    (r"(?i)^(dob|date of birth)\b", "dob"), (r"(?i)^(provider|seen by|rendering provider)\b", "provider"), (r"(?i)^(patient|name)\b", "patient_name"),
    (r"(?i)^(sex|gender)\b", "sex"), (r"(?i)^(date of service|dos|visit date|encounter date)\b", "dos"), (r"(?i)^(age)\b", "age"),
)


def type_clusters(spans: DataFrame, tolerance: float = SIZE_TOLERANCE) -> DataFrame:
    """LAY-01. (font, size, bold) clusters weighted by characters."""
    weight = F.greatest(F.length(strip("text")), F.lit(1)).cast("bigint")
    rows = spans.select("font", "bold", F.col("size").cast("double").alias("v"), weight.alias("w"))
    return greedy_ranges(rows, ["font", "bold"], tolerance).select("font", F.col("mean").alias("size"), "bold", F.col("total").alias("weight"))


def type_scale(spans: DataFrame) -> DataFrame:
    """LAY-02. Role of each cluster: body, h1..h3 or small."""
    c = type_clusters(spans)
    body = c.agg(F.max_by(F.struct("font", "size", "bold"), F.struct("weight", "size", "font")).alias("_b"))
    c = c.crossJoin(body)  # one row: the heaviest cluster
    is_body = (F.col("font") == F.col("_b.font")) & (F.col("size") == F.col("_b.size")) & (F.col("bold") == F.col("_b.bold"))
    bigger = F.col("size") > F.col("_b.size") + SIZE_TOLERANCE
    near = (F.col("font") == F.col("_b.font")) & (F.abs(F.col("size") - F.col("_b.size")) <= SIZE_TOLERANCE)
    heading = ~is_body & (bigger | (F.col("bold") & ~near))
    # Clusters are few (fonts x sizes), so one ordered pass over them is small.
    order = Window.partitionBy("_h").orderBy(F.desc("size"), "font", "bold")
    ranked = c.withColumn("_h", heading).withColumn("_body", is_body).withColumn("_rank", F.row_number().over(order))
    role = F.when(F.col("_body"), "body").when(F.col("_h"), F.concat(F.lit("h"), F.least(F.col("_rank"), F.lit(3)).cast("string"))).otherwise("small")
    return ranked.select("font", "size", "bold", "weight", role.alias("role"))


def sample_count(spans: DataFrame) -> DataFrame:
    """Samples and the number of them that makes a text recurring."""
    n = spans.agg(F.countDistinct("sample_index").alias("n_samples"))
    return n.withColumn("threshold", F.greatest(F.ceil(F.col("n_samples") * STATIC_SHARE), F.lit(1)).cast("bigint"))


def _recurring(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts that occur in enough samples: distinct pairs, then a count."""
    pairs = rows.select("line", "sample_index").distinct()
    counted = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(sample_count(spans)).filter(F.col("n") >= F.col("threshold"))


def heading_spans(spans: DataFrame) -> DataFrame:
    """Spans whose style has a heading role."""
    roles = type_scale(spans).filter(F.col("role").startswith("h")).select("font", "size", "bold", "role")
    return spans.join(roles, ["font", "size", "bold"]).withColumn("line", norm_text("text")).filter(F.col("line") != "")


def section_taxonomy(spans: DataFrame) -> DataFrame:
    """LAY-04. Recurring heading texts with their role, count and position."""
    h = heading_spans(spans)
    y = F.round(F.col("y0") / F.coalesce(F.nullif("page_height", F.lit(0.0)), F.lit(1.0)), 3)
    h = h.withColumn("y", y)
    # The role of the first span counts; spans at the same place are ordered by role.
    stats = h.groupBy("line").agg(
        F.min_by("role", F.struct("sample_index", "page_index", "y0", "x0", "role")).alias("role"), F.countDistinct("sample_index").alias("n_samples_with"),
        F.bool_and(F.col("page_index") == 0).alias("first_page_only"))
    stats = stats.join(counted_medians(h, ["line"], "y").select("line", F.round("median", 3).alias("median_y")), "line", "left")
    return stats.crossJoin(sample_count(spans)).filter(F.col("n_samples_with") >= F.col("threshold")).select(
        F.col("line").alias("text"), "role", "n_samples_with", "median_y", "first_page_only").orderBy("median_y", F.desc("n_samples_with"), "text")


def static_text(spans: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """LAY-03, SET-04. Recurring lines that are not section headings."""
    lines = spans.withColumn("line", norm_text("text")).filter(F.col("line") != "")
    found = _recurring(lines, spans).select(F.col("line").alias("text"), "n")
    headings = section_taxonomy(spans) if headings is None else headings
    return found.join(headings.select("text"), "text", "left_anti")


def column_grid(spans: DataFrame, k: int = MAX_COLUMNS) -> DataFrame:
    """LAY-05, WIN-09. The ``k`` most used column starts, left to right."""
    rows = spans.select(F.col("x0").cast("double").alias("v"), F.lit(1).cast("bigint").alias("w"))
    top = greedy_ranges(rows, [], COLUMN_TOLERANCE).orderBy(F.desc("total"), "mean").limit(k)
    return top.select(F.col("mean").alias("x0"), F.col("total").alias("n")).orderBy("x0")


def gutters(rects: DataFrame) -> DataFrame:
    """LAY-05. Clustered vertical edges of filled rectangles."""
    edges = rects.filter(F.col("fill_color").isNotNull()).select(F.explode(F.array("x0", "x1")).alias("v"))
    rows = edges.select(F.col("v").cast("double").alias("v"), F.lit(1).cast("bigint").alias("w"))
    return greedy_ranges(rows, [], COLUMN_TOLERANCE).select(F.col("mean").alias("x"))


def page_breaks(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LAY-06. (samples per page count, lowest content position, running headers)."""
    pages = spans.groupBy("sample_index").agg((F.max("page_index") + 1).alias("pages")).groupBy("pages").agg(F.count(F.lit(1)).alias("n_samples"))
    height = F.coalesce(F.nullif("page_height", F.lit(0.0)), F.lit(1.0))
    lowest = spans.agg(F.round(F.max(F.col("y1") / height), 3).alias("max_content_y"))
    top = spans.filter(F.col("y0") / height <= TOP_SHARE).withColumn("line", norm_text("text")).filter(F.col("line") != "")
    return pages, lowest, _recurring(top, spans).select(F.col("line").alias("text"), "n")


def page_geometry(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """LAY-07. Modal page size and 5% / 95% margins. ``pages``: one row per page."""
    sizes = pages.groupBy("page_width", "page_height").agg(F.count(F.lit(1)).alias("n"))
    modal = sizes.agg(F.max_by(F.struct("page_width", "page_height"), F.struct(F.col("n"), (F.col("page_width") * F.col("page_height")).alias("a"), F.col("page_width").alias("w"))).alias("m"))
    q = exact_quantiles(spans, {"l": ("x0", 0.05), "r": ("x1", 0.95), "t": ("y0", 0.05), "b": ("y1", 0.95)})
    at = {k: F.lit(v).cast("double") for k, v in q.items()}
    edge = lambda c: F.greatest(F.coalesce(F.round(c, 1), F.lit(0.0)), F.lit(0.0))
    w, h = F.col("m.page_width"), F.col("m.page_height")
    return modal.select(w.alias("width"), h.alias("height"), edge(at["l"]).alias("margin_left"), edge(w - at["r"]).alias("margin_right"), edge(at["t"]).alias("margin_top"), edge(h - at["b"]).alias("margin_bottom"))


def fill_colors(rects: DataFrame) -> DataFrame:
    """LAY-08. Fill colours by use."""
    return rects.filter(F.col("fill_color").isNotNull()).groupBy("fill_color").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fill_color")


def stroke_widths(rects: DataFrame) -> DataFrame:
    """LAY-08. Distinct stroke widths."""
    return rects.filter(F.col("stroke_color").isNotNull() & (F.col("stroke_width") > 0)).select("stroke_width").distinct()


def heading_band(rects: DataFrame, window: tuple[float, float] = BAND_LUMINANCE) -> DataFrame:
    """LAY-08. The most used light tint, else the most used non-white fill."""
    c = fill_colors(rects)
    part = lambda n: F.shiftright(F.col("fill_color").cast("int"), n).bitwiseAND(255)
    white = (part(16) >= WHITE) & (part(8) >= WHITE) & (part(0) >= WHITE)
    order = F.struct((-F.col("n")).alias("n"), F.col("fill_color").alias("c"))
    band = F.min_by("fill_color", F.when(luminance("fill_color").between(*window), order))
    other = F.min_by("fill_color", F.when(~white, order))
    pick = c.agg(F.coalesce(band, other).alias("c"))
    return pick.select(F.coalesce(F.concat(F.lit("#"), F.lpad(F.lower(F.hex("c")), 6, "0")), F.lit(DEFAULT_BAND)).alias("heading_fill"))


def suppress_single_sample(df: DataFrame, spans: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """LAY-09. With one sample no text may be told from patient data, so none is shown."""
    n = sample_count(spans).select("n_samples")
    out = df.crossJoin(n)  # one row: the number of samples
    return out.select(*[F.when(F.col("n_samples") > 1, F.col(c)).alias(c) if c in text_cols else F.col(c) for c in df.columns])


def label_slots(static: DataFrame, patterns: Sequence[tuple[str, str]] = LABEL_PATTERNS) -> DataFrame:
    """LAY-10. Static labels that name a known field; the first label of a field counts.

    A label takes the first field whose pattern it matches. Fields are
    distinct patterns, so a label passed over is not placed elsewhere.
    """
    slot = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(s)) for p, s in patterns])
    return static.withColumn("slot", slot).filter(F.col("slot").isNotNull()).groupBy("slot").agg(F.min("text").alias("label"))
