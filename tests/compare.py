"""Compare every registered query with its SQL twin, types and values included."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """The first thing that differs, or None."""
    names = sorted(df.columns)
    found = dict(df.dtypes)
    expected = con.sql(sql)
    types = dict(zip(expected.columns, (str(t) for t in expected.types)))
    if names != sorted(types):
        return f"columns {names} against {sorted(types)}"
    wrong = {n: (found[n], types[n]) for n in names if TYPES.get(found[n]) != types[n]}
    if wrong:
        return f"types {wrong}"
    left = ordered([tuple(r) for r in df.select(names).collect()])
    right = ordered(expected.select(*names).fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if not all(map(same, a, b)):
            return f"row {str(a)[:300]} against {str(b)[:300]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con = make_session(), connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name in wanted:
        started = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            message = difference(df, con, sqls[name]) if name in sqls else f"rows {df.count()}"
            ok = message is None or name not in sqls
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {message or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
