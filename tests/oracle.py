"""Run queries beside their reference SQL and compare whole results.

    python tests/oracle.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return repr(v)


def table(columns: list[str], rows: list[tuple]):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """None when both agree, else a short description of the difference."""
    df = query(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1])
    rel = con.sql(sql)
    want = table(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if got[1] != want[1]:
        extra = sorted(set(got[1]) - set(want[1]))[:3]
        missing = sorted(set(want[1]) - set(got[1]))[:3]
        return f"rows {len(got[1])} vs {len(want[1])}\n   spark {extra}\n   sql   {missing}", len(got[1])
    return None, len(got[1])


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as contract

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracle = contract.queries(), contract.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    spark, con, bad = session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            diff, rows = compare(spark, con, queries[name], oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, rows = f"{type(e).__name__}: {str(e)[:400]}", -1
        took = time.time() - start
        state = "FAIL" if diff else ("ok" if name in oracle else "rows")
        print(f"{state:5s}{name:40s}{rows:8d} {took:6.2f}s" + (f"\n   {diff}" if diff else ""), flush=True)
        bad += bool(diff)
    print(f"{len(names)} queries, {bad} failed, {sum(n in oracle for n in names)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main())
