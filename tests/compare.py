"""Run registered queries next to their SQL and compare the rows.

Usage: python tests/compare.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    """Values as comparable text; numbers of all types alike."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}" if abs(value) < 1e6 else f"{float(value):.10g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return rows_of(columns, result.fetchall())


def compare(spark, sf_dir, query, sql):
    """None when both sides agree, else a short description."""
    df = query(spark, sf_dir)
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if rows else "no rows"
    other_columns, other = sql_rows(sf_dir, sql)
    if columns != other_columns:
        return f"columns {columns} vs {other_columns}"
    if len(rows) != len(other):
        return f"{len(rows)} rows vs {len(other)}"
    for a, b in zip(rows, other):
        if a != b:
            return f"{str(a)[:300]} vs {str(b)[:300]}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from cohortloom.session import local_session

    QUERIES, ORACLES = queries(), oracle_sql()

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8", 8)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{name:32s} {kind:4s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
