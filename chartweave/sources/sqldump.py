"""SRC-03/04. SQL-dump export: ``INSERT`` statements as a table.

A dump file can be far larger than one task should hold, and its values may
span lines, so a file is read as lines in parallel splits. Which lines start a
value tuple is decided by running sums over the lines (open quotes, then open
brackets), and the statement a tuple belongs to is carried forward the same
way. Only one logical record at a time reaches the small tuple splitter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.functions.text import strip
from chartweave.operators.windows import block_scan, order_block
from chartweave.session import cut_lineage
from chartweave.sources.tsv import path_exists

# The tables read, and the folders that hold data.
ACTIVITY_TABLES = ("PERSON", "PERSON_ALIAS", "ENCOUNTER", "CLINICAL_EVENT", "CE_BLOB", "CE_BLOB_RESULT")
REFERENCE_TABLES = ("CODE_VALUE",)
KNOWN_TABLES = ACTIVITY_TABLES + REFERENCE_TABLES
DATA_FOLDERS = ("activity", "reference")

HEAD = r"INSERT\s+(?:IGNORE\s+)?INTO\s+`?(\w+)`?\s*(?:\(([^)]*)\)\s*)?VALUES"
_HEAD = re.compile(HEAD, re.IGNORECASE)
_SPACE = re.compile(r"\s*")
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]++|\\.|'')*+)'|([^,()'\s][^,()]*))\s*([,)])", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)|''", re.DOTALL)
# Escapes that do not stand for themselves.
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}

PARSED = T.ArrayType(
    T.StructType([
        T.StructField("tbl", T.StringType()), T.StructField("cols", T.StringType()), T.StructField("vals", T.ArrayType(T.StringType())),
    ])
)


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "'" if m.group(1) is None else _ESCAPED.get(m.group(1), m.group(1)), text)


def _tuple_at(text: str, pos: int) -> tuple[list[str | None], int] | None:
    """Values of the tuple whose bracket opens at ``pos`` and where it ends."""
    values: list[str | None] = []
    pos += 1
    while True:
        m = _VALUE.match(text, pos)
        if m is None:
            return None
        if m.group(1) is not None:
            values.append(_unescape(m.group(1)))
        else:
            bare = m.group(2).strip()
            values.append(None if bare.upper() == "NULL" else bare)
        pos = m.end()
        if m.group(3) == ")":
            return values, pos


def split_record(text: str) -> list[dict]:
    """Heads and tuples of one record, in order.

    A tuple before any head belongs to the statement that is still open. A
    head or an end mark is an item without values, for the carry.
    """
    items: list[dict] = []
    table, cols, explicit, pos = None, None, False, 0
    while pos < len(text):
        pos = _SPACE.match(text, pos).end()
        if pos >= len(text):
            break
        char = text[pos]
        head = _HEAD.match(text, pos) if char in "iI" else None
        if head is not None:
            table, cols, explicit, pos = head.group(1).upper(), head.group(2) or "", True, head.end()
            items.append({"tbl": table, "cols": cols, "vals": None})
        elif char == "(":
            found = _tuple_at(text, pos)
            if found is None:
                if explicit:
                    raise ValueError(f"malformed INSERT: unreadable value tuple at offset {pos}")
                pos += 1
                continue
            items.append({"tbl": table, "cols": cols, "vals": found[0]})
            pos = found[1]
        elif char == ";":
            table, cols, explicit, pos = None, None, False, pos + 1
            items.append({"tbl": "", "cols": None, "vals": None})
        elif char == "-" and text.startswith("--", pos) or char == "#":
            end = text.find("\n", pos)
            pos = len(text) if end < 0 else end
        else:
            pos += 1
    return items


@F.pandas_udf(PARSED)
def _split_records(text: pd.Series) -> pd.Series:
    return text.map(split_record)


def _comment(line: Column) -> Column:
    return line.rlike(r"^\s*(?:--|#)")


def _quotes(line: Column) -> Column:
    plain = F.regexp_replace(line, r"\\.", "")
    return F.length(plain) - F.length(F.replace(plain, F.lit("'"), F.lit("")))


def _brackets(line: Column) -> Column:
    """Opening minus closing brackets outside quoted text."""
    bare = F.regexp_replace(F.regexp_replace(line, r"\\.", ""), r"'[^']*+'", "")
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("("), F.lit("")))
    closed = F.length(bare) - F.length(F.replace(bare, F.lit(")"), F.lit("")))
    return F.when(_comment(line), F.lit(0)).otherwise(opened - closed)


def logical_records(lines: DataFrame) -> DataFrame:
    """Lines (``_src``, ``_ord``, ``value``) as records that hold whole tuples.

    A scan reads its input twice (rows and block summaries), so the steps are
    materialised between scans instead of being computed again and again.
    """
    marked = lines.withColumn("_q", _quotes(F.col("value")) % 2)
    spans = marked.filter((F.col("_q") == 1) | (_brackets(F.col("value")) != 0) | F.col("value").rlike(r"(?i)^\s*VALUES"))
    if spans.limit(1).isEmpty():
        return lines
    keys, order, block = ["_src"], ["_ord"], order_block("_ord")
    # A comment line closes nothing and opens nothing when it starts outside a
    # string, so an apostrophe in it resets the count instead of flipping it.
    odd_comment = _comment(F.col("value")) & (F.col("_q") == 1)
    flips = F.when(odd_comment, 0).otherwise(F.col("_q"))
    marked = block_scan(marked.withColumn("_flip", flips).withColumn("_odd", odd_comment), keys, order, block,
                        {"_flips": ("sum", "_flip"), "_after": ("lag", "_odd")})
    before = F.col("_flips") - F.col("_flip")
    marked = cut_lineage(marked.withColumn("_before", before).withColumn("_mark", F.when(F.col("_after"), before)))
    marked = block_scan(marked, keys, order, block, {"_base": ("last", "_mark")})
    inside = (F.col("_before") - F.coalesce("_base", F.lit(0))) % 2 == 1
    # Bracket balance of the part of each line that is outside any string.
    tail = F.when(inside, F.regexp_replace(F.regexp_replace("value", r"\\.", ""), r"^[^']*+'?", "")).otherwise(F.col("value"))
    open_tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"\\.", ""), r"'[^']*+'", ""), r"'[^']*+$", "")
    delta = F.length(F.replace(open_tail, F.lit(")"), F.lit(""))) - F.length(F.replace(open_tail, F.lit("("), F.lit("")))
    marked = marked.withColumn("_in", inside).withColumn("_delta", F.when(_comment(F.col("value")) & ~inside, 0).otherwise(delta))
    marked = block_scan(cut_lineage(marked), keys, order, block, {"_depth": ("sum", "_delta")})
    starts = ~F.col("_in") & (F.col("_depth") - F.col("_delta") == 0) & ~F.col("value").rlike(r"(?i)^\s*VALUES")
    marked = block_scan(cut_lineage(marked.withColumn("_start", F.when(starts, F.col("_ord")))), keys, order, block, {"_rec": ("last", "_start")})
    grouped = marked.groupBy("_src", F.coalesce("_rec", F.lit(-1)).alias("_ord")).agg(F.sort_array(F.collect_list(F.struct("_ord", "value"))).alias("_l"))
    return grouped.select("_src", "_ord", F.array_join("_l.value", "\n").alias("value"))


def parse_dump_lines(lines: DataFrame, ddl: DataFrame) -> DataFrame:
    """SRC-03. Rows of every statement: table, ordered columns, values.

    ``ddl`` has (``table_name``, ``columns``). A tuple with the wrong number
    of values ends the job: its cells could not be told apart.
    """
    parsed = logical_records(lines).select("_src", "_ord", F.posexplode(_split_records("value")).alias("_pos", "_i"))
    head = F.when(F.col("_i.vals").isNull(), F.struct("_i.tbl", "_i.cols"))
    own = F.struct(F.col("_i.tbl").alias("tbl"), F.col("_i.cols").alias("cols"))
    parsed = block_scan(cut_lineage(parsed.withColumn("_h", head)), ["_src"], ["_ord", "_pos"], order_block("_ord"), {"_open": ("last", "_h")})
    rows = parsed.filter(F.col("_i.vals").isNotNull()).withColumn("_s", F.when(F.col("_i.tbl").isNotNull(), own).otherwise(F.col("_open")))
    rows = rows.filter(F.coalesce(F.col("_s.tbl"), F.lit("")) != "")
    named = F.transform(F.split("_s.cols", ","), lambda c: strip(F.replace(c, F.lit("`"), F.lit(""))))
    rows = rows.join(ddl, F.col("_s.tbl") == F.col("table_name"), "left")
    columns = F.when(F.coalesce(F.col("_s.cols"), F.lit("")) != "", named).otherwise(F.col("columns"))
    wrong = F.raise_error(F.concat(F.lit("malformed INSERT in "), F.col("_src"), F.lit(": wrong number of values for "), F.col("_s.tbl")))
    values = F.col("_i.vals")
    checked = F.when(F.size(columns) == F.size(values), F.map_from_arrays(columns, values)).otherwise(wrong.cast("map<string,string>"))
    return rows.select(F.col("_s.tbl").alias("table_name"), checked.alias("cells"), F.struct(F.col("_src").alias("src"), F.col("_ord").alias("rec"), F.col("_pos").alias("pos")).alias("_ord"))


def ddl_columns(ddl_text: DataFrame) -> DataFrame:
    """SRC-04. (``table_name``, ordered ``columns``) of each CREATE TABLE."""
    pattern = r"(?is)CREATE\s+TABLE\s+`?(\w+)`?\s*\((.*?)\)\s*(?:ENGINE|;|\z)"
    both = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), 1).alias("t"), F.regexp_extract_all("value", F.lit(pattern), 2).alias("b"))
    tables = ddl_text.select(F.explode(both).alias("x")).select(F.upper("x.t").alias("table_name"), F.col("x.b").alias("body"))
    defined = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^\s*`\w+`\s"))
    cols = F.transform(defined, lambda x: F.regexp_extract(x, r"^\s*`(\w+)`\s", 1))
    return tables.select("table_name", cols.alias("columns")).filter(F.size("columns") > 0).dropDuplicates(["table_name"])


def as_table(rows: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One table of the parsed rows, with its declared columns.

    Cells a statement names beyond the declared columns are kept in ``_extra``.
    """
    mine = rows.filter(F.col("table_name") == table.upper())
    extra = F.map_filter("cells", lambda k, v: ~k.isin(*columns) & v.isNotNull())
    return mine.select(*[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns], extra.alias("_extra"), "_ord")


def dump_block() -> Column:
    """Order block of dump rows (see ``block_scan``)."""
    return F.struct(F.col("_ord.src"), order_block("_ord.rec"))


def _list_files(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    statuses = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in statuses if s.getPath().getName().endswith(".sql"))


def table_of(file_name: str) -> str:
    """Table of a dump file: its stem without a trailing part number."""
    stem = file_name.rsplit("/", 1)[-1].removesuffix(".sql")
    return re.sub(r"_\d+$", "", stem).upper()


def read_schema(spark: SparkSession, root: str) -> DataFrame:
    files = _list_files(spark, f"{root.rstrip('/')}/v500/schema")
    if not files:
        return spark.createDataFrame([], "table_name string, columns array<string>")
    text = spark.read.text(files, wholetext=True)
    return ddl_columns(text.select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value")))


def read_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(list(files))
    value = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "\r$", "")
    return lines.select(F.col("_metadata.file_name").alias("_src"), F.monotonically_increasing_id().alias("_ord"), value.alias("value"))


def read_sql_dump(spark: SparkSession, root: str, table: str, ddl: DataFrame | None = None) -> DataFrame | None:
    """SRC-03. One table of a dump, or None when the export does not have it."""
    ddl = read_schema(spark, root) if ddl is None else ddl
    files = [f for folder in DATA_FOLDERS for f in _list_files(spark, f"{root.rstrip('/')}/v500/{folder}") if table_of(f) == table.upper()]
    # A column list is a few hundred names, whatever the data size.
    declared = ddl.filter(F.col("table_name") == table.upper()).limit(1).collect()
    if not declared:
        if files:
            raise ValueError(f"data for {table} is present but no CREATE TABLE names its columns")
        return None
    columns = list(declared[0]["columns"])
    if not files:
        schema = ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([], f"{schema}, _extra map<string,string>, _ord struct<src:string,rec:bigint,pos:int>")
    return as_table(parse_dump_lines(read_lines(spark, files), ddl), table, columns)


def read_dump_export(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every known table the export has."""
    ddl = read_schema(spark, root)
    found = {t: read_sql_dump(spark, root, t, ddl) for t in KNOWN_TABLES}
    return {t: df for t, df in found.items() if df is not None}
