"""Run queries against their SQL in DuckDB: same columns, types, row count and values.

python tests/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def cell(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, function, sql, folder) -> str | None:
    """None if equal, else what differs."""
    df = function(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    other_names = [c[0] for c in result.description]
    other_types = {c[0]: str(c[1]) for c in result.description}
    other = result.fetchall()
    names, mine = table_of(df.columns, rows)
    names2, theirs = table_of(other_names, other)
    if names != names2:
        return f"columns {names} / {names2}"
    wrong = {n: (t, other_types[n]) for n, t in df.dtypes if TYPES.get(t, t) != other_types[n]}
    note = f"types {wrong}" if wrong else ""
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)} {note}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(bad)} of {len(mine)} rows differ, e.g. {bad[0]} {note}"
    return note or None


def main() -> int:
    from cohortframe.plans import catalog
    from cohortframe.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    con = connect(args.sf)
    oracles, failed = catalog.oracle_sql(), 0
    for name, function in catalog.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, function, oracles[name], args.sf)
            else:
                problem = None if function(spark, args.sf).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              f"{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
