"""Run registered queries beside their SQL check in DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows {took:.1f}s"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns differ: spark {sorted(df.columns)} sql {sorted(cols)}"
    kinds = [
        f"{f.name}: {f.dataType.simpleString()} vs {types[f.name]}"
        for f in df.schema.fields
        if KINDS.get(f.dataType.simpleString()) != types[f.name]
    ]
    if kinds:
        return False, f"types differ: {kinds}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else []
        only_b = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else []
        return False, f"{len(a)} vs {len(b)} rows; cols {sorted(cols)}\n  spark only {only_a}\n  sql only {only_b}"
    return True, f"{len(a)} rows {took:.1f}s"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from cairnfield.session import build_session

    sf = os.environ.get("SF", "0.01")
    folder = f"/root/testdata/sf{sf}"
    wanted = sys.argv[1:]
    spark = build_session("oracle", "local[8]", 8)
    con = connect(folder)
    sqls = oracle_sql()
    failed = []
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(len(failed), "failed", failed)
