"""Compare queries with their SQL on the given tables: ``python tests/check.py SF [names]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def as_rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a DataFrame and a SQL result, None if nothing."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    given = {d[0]: str(d[1]).upper() for d in result.description}
    types = {name: _TYPES.get(kind, kind) for name, kind in df.dtypes}
    if any(given[name] != kind for name, kind in types.items()):
        return f"types {types} and {given}"
    expected, got = as_rows(names, result.fetchall()), as_rows(df.columns, df.collect())
    if expected == got:
        return None
    extra, lacking = got - expected, expected - got
    return (
        f"{got.total()} rows, {expected.total()} expected; {extra.total()} extra,"
        f" {lacking.total()} lacking\n  extra   {sorted(extra, key=str)[:2]}"
        f"\n  lacking {sorted(lacking, key=str)[:2]}"
    )


def main(sf: str, *names: str) -> int:
    from litscore.registry import oracle_sql, queries
    from litscore.session import local_session

    spark, sf_dir = local_session(), f"/root/testdata/sf{sf}"
    con, checks, failed = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            problem = differences(query(spark, sf_dir), con, checks[name]) if name in checks else "no SQL"
        except Exception as error:  # noqa: BLE001 - reported, and the others still run
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{name:26s} {time.time() - started:6.2f}s {problem or 'equal'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
