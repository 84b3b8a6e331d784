"""Run registered queries against their expected SQL; used by the tests and by hand.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def comparable(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def run(spark, con, folder: str, name: str) -> str | None:
    """None when query and SQL agree, else what differs."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, folder)
    got = comparable(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = comparable(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == wanted:
        return None
    missing = [w for w in wanted if w not in set(got)][:3]
    extra = [g for g in got if g not in set(wanted)][:3]
    return f"{len(got)} rows, expected {len(wanted)}; missing {missing}; extra {extra}"


if __name__ == "__main__":
    from quillbook.session import local_session

    session = local_session(os.environ.get("CPUS", "8"))
    from __spark_entry__ import queries

    folder = sys.argv[1]
    con = connect(folder)
    for name in sys.argv[2:] or queries():
        start = time.time()
        try:
            problem = run(session, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {(problem or '')[:900]}", flush=True)
