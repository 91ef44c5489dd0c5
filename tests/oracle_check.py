"""Runs queries next to their SQL counterparts in DuckDB and prints one line per query.

python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from colloquy.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def table(rows: list, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    mine = table([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows"
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        out = con.execute(sql)
        columns = [c[0] for c in out.description]
        theirs = table(out.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if mine == theirs:
        return None
    only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} vs {len(theirs)} rows; {str(only)[:600]}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    session = build_session(master="local[8]", spark__sql__shuffle__partitions=8,
                            spark__driver__memory="8g",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("OFF")
    for query in names:
        start = time.time()
        try:
            verdict = compare(session, query, folder)
        except Exception as error:  # noqa: BLE001 - a report line per query
            verdict = f"{type(error).__name__}: {str(error)[:500]}"
        kind = "sql" if query in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {kind:4} {query:20} "
              f"{time.time() - start:6.1f}s {verdict or ''}", flush=True)
