"""Compare named queries with their SQL on DuckDB.  ``python tests/oracle.py SF_DIR [name ...]``"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return f"{value:.9g}" if value else "0"
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description; also the two run times and the row count."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = canonical(df.columns, df.collect())
    spark_s = time.time() - start
    if sql is None:
        return (None if got else "no rows"), spark_s, 0.0, len(got)
    start = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = canonical(columns, rel.fetchall())
    sql_s = time.time() - start
    problem = None
    if sorted(columns) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} / {sorted(columns)}"
    elif got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        problem = f"rows {len(got)} / {len(want)}; first differences {str(bad)[:600]}"
    elif not got:
        problem = "no rows"
    return problem, spark_s, sql_s, len(got)


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from passagemill.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8", **{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    sql, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            problem, a, b, n = differences(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, a, b, n = f"{type(error).__name__}: {str(error)[:700]}", 0, 0, 0
        failed += problem is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:26} n={n:<7} spark {a:6.2f}s sql {b:6.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
