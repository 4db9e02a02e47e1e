"""Compares registered queries with their SQL on one data directory: python tests/compare.py DIR [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v: object) -> object:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, float) or type(v).__name__ in {"float64", "float32"}:
            return str(int(v)) if abs(v) < 1e15 and float(v).is_integer() else f"{float(v):.9g}"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, pd.Timestamp):
            return str(v)
        if type(v).__name__ == "Decimal":
            return str(int(v)) if v == int(v) else str(v)
        return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False, name=None))


def differences(left: pd.DataFrame, right: pd.DataFrame) -> list[str]:
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} and {sorted(right.columns)}"]
    a, b = canonical(left), canonical(right)
    if a == b:
        return []
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return [f"rows {len(a)} and {len(b)}", *(f"only Spark {r}" for r in list((x - y))[:3]), *(f"only SQL {r}" for r in list((y - x))[:3])]


def main() -> int:
    import __spark_entry__ as entry
    from gridloom.session import local_session

    directory, names = sys.argv[1], sys.argv[2:]
    queries, sql = entry.queries(), entry.oracle_sql()
    spark, con, bad = local_session(8), connect(directory), 0
    for name in names or queries:
        began = time.time()
        try:
            got = queries[name](spark, directory).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(e)[:600]}", flush=True)
            continue
        took = time.time() - began
        if name not in sql:
            print(f"{name}: {len(got)} rows, {took:.1f} s, no SQL", flush=True)
            continue
        try:
            expected = con.execute(sql[name]).fetch_df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: SQL FAILED {str(e)[:900]}", flush=True)
            continue
        found = differences(got, expected)
        bad += bool(found)
        print(f"{name}: {len(got)} rows, {took:.1f} s, {'DIFFERS ' + '; '.join(found) if found else 'equal'}", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
