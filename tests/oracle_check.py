"""Run registered queries next to their SQL: python tests/oracle_check.py [folder] [name-part ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}" if value != 0 else "0.000000"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}"


def canonical(columns, rows):
    pick = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in pick], sorted([tuple(_norm(r[i]) for i in pick) for r in rows])


def compare(spark, con, name, query, sql, folder):
    df = query(spark, folder)
    start = time.time()
    columns, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    spent = f"spark {time.time() - start:.1f}s"
    if sql is None:
        return f"rows-only {len(rows)} {spent}", True
    cur = con.execute(sql)
    other_columns, others = canonical([d[0] for d in cur.description], cur.fetchall())
    if columns != other_columns:
        return f"columns {columns} / {other_columns}", False
    if len(rows) != len(others):
        return f"row counts {len(rows)} / {len(others)}", False
    different = [(a, b) for a, b in zip(rows, others) if a != b]
    if different:
        return f"{len(different)} of {len(rows)} rows differ, e.g.\n   {different[0][0]}\n   {different[0][1]}", False
    return f"ok {len(rows)} {spent}", True


def main() -> None:
    import __spark_entry__ as entry
    from flightloom.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    from flightloom.plans.registry import ORIGIN as origin

    queries, sqls, bad = entry.queries(), entry.oracle_sql(), []
    for name, query in queries.items():
        if args and not any(part in name or part == origin.get(name) for part in args):
            continue
        start = time.time()
        try:
            text, fine = compare(spark, con, name, query, sqls.get(name), folder)
        except Exception as error:  # noqa: BLE001
            text, fine = "".join(traceback.format_exception_only(error))[:1500], False
        if not fine:
            bad.append(name)
        print(f"{'  ' if fine else '!!'} {name}: {text} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
