"""Runs every query with SQL on both engines and compares sorted rows. python -m tests.oracle [sf_dir] [name...]"""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}" if math.isfinite(x) else str(x)
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    rel = connection(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if ours == theirs:
        kinds = {k: str(v) for k, v in zip(rel.columns, rel.types)}
        odd = [f"{c}: {t} and {kinds[c]}" for c, t in df.dtypes if (t, kinds[c]) not in {("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"), ("double", "DOUBLE")}]
        return "types " + "; ".join(odd) if odd else ""
    only = [x for x in ours if x not in set(theirs)][:2], [x for x in theirs if x not in set(ours)][:2]
    return f"{len(ours)} and {len(theirs)} rows; only here {only[0]}, only there {only[1]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    at = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for name, sql in e.oracle_sql().items():
        if len(sys.argv) < 3 or name in sys.argv[2:]:
            try:
                print(name, differences(spark, at, e.queries()[name], sql) or "ok", flush=True)
            except Exception as x:
                print(name, "FAILED", str(x)[:300].replace("\n", " "), flush=True)
