"""Compare every registered query with its SQL twin in DuckDB.

    python check.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """One comparable form for both engines' values."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark_df, con, sql) -> str:
    """Empty when both sides hold the same rows, else what differs."""
    relation = con.execute(sql)
    theirs_cols = [d[0] for d in relation.description]
    theirs = rows_of(theirs_cols, relation.fetchall())
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(theirs_cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(theirs_cols)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}"
    types = [type(v).__name__ for v in next(iter(mine), ())]
    theirs_types = [type(v).__name__ for v in next(iter(theirs), ())]
    if types != theirs_types and mine:
        return f"types {types} vs {theirs_types}"
    return "" if mine else "EMPTY RESULT"


def main() -> int:
    import bindings
    from sheetwise.session import local_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    folder = f"/root/testdata/sf{opts.sf}"
    bindings.load_all()
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name, fn in bindings.QUERIES.items():
        if opts.names and not any(name.startswith(p) for p in opts.names):
            continue
        began = time.time()
        try:
            df = fn(spark, folder)
            if name in bindings.SQL:
                wrong = compare(df, con, bindings.SQL[name])
            else:
                wrong = "" if df.count() else "EMPTY RESULT"
        except Exception as error:  # keep going, report all
            wrong = f"{type(error).__name__}: {str(error)[:400]}"
        bad += bool(wrong)
        kind = "sql " if name in bindings.SQL else "rows"
        print(f"{'FAIL' if wrong else 'ok  '} {kind} {time.time() - began:6.2f}s {name} {wrong}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
