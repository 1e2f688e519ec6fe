"""Run registered queries and their SQL on the same tables and compare the results.

``python -m checks.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return v


def _sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(
        [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in flat],
        key=_sort_key,
    )


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    sc, sr = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    dc, dr = rows_of(names, cur.fetchall())
    if sc != dc:
        return f"columns {sorted(set(sc) ^ set(dc))}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} spark, {len(dr)} sql"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if not bad:
        return None
    a, b = bad[0]
    cells = [(c, x, y) for c, x, y in zip(sc, a, b) if x != y]
    return f"{len(bad)} of {len(sr)} rows differ, first: {cells[:4]}"


def main() -> int:
    from pyspark.sql import SparkSession

    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    failed = 0
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, root)
            if name in ORACLE:
                problem = compare(df, con, ORACLE[name])
                note = problem or "equal"
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as err:  # one bad query must not hide the others
            problem = note = f"{type(err).__name__}: {str(err)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - began:6.2f}s  {note}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
