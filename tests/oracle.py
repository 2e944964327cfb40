"""Compare registered queries with their SQL, the way the driver does."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return True, len(got), took, "rows only"
    rel = con.sql(sql)
    ecols, want = rows_of(rel.columns, rel.fetchall())
    if cols != ecols:
        return False, len(got), took, f"columns {cols} != {ecols}"
    if len(got) != len(want):
        return False, len(got), took, f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            diff = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
            return False, len(got), took, f"first diff {diff} in {str(g)[:300]}"
    types = dict(df.dtypes)
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return True, len(got), took, "" if len(got) else f"EMPTY {types} {kinds}"


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from chartweave.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(**{"spark.sql.debug.maxToStringFields": "20"})
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, n, took, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, n, took, note = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {n:7d} rows {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
