"""Run registered queries next to their SQL on DuckDB and compare whole results.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9)
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    return value


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(record[i]) for i in order) for record in records]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise a short account of the difference."""
    left_columns, left = _rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    cursor = con.execute(sql)
    names = [item[0] for item in cursor.description]
    right_columns, right = _rows(names, cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows; {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} != {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from archtrail.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if problem is None else "FAIL"
        kind = "sql " if name in sqls else "rows"
        print(f"{mark} {kind} {name:32s} {time.time() - began:6.2f}s {problem or ''}", flush=True)
        failed += [name] if problem else []
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
