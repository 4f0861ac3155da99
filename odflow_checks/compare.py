"""Run the registered queries against their SQL and compare whole results.

Usage: python -m odflow_checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from odflow_checks.catalog import QUERIES
from odflow_checks.oracle import SQL


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v) for v in row)


def _same(a, b) -> bool:
    return a == b and type(a) is type(b)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where both results are equal, otherwise what differs first."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    position = [names.index(n) for n in order]
    expected = sorted((tuple(r[i] for i in position) for r in result.fetchall()), key=_key)
    actual = sorted((tuple(r) for r in df.select(*order).collect()), key=_key)
    if len(expected) != len(actual):
        return f"{len(actual)} rows against {len(expected)}"
    for a, e in zip(actual, expected):
        if not all(map(_same, a, e)):
            return f"{dict(zip(order, a))} against {dict(zip(order, e))}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in chosen:
        began = time.time()
        try:
            problem = difference(QUERIES[name](spark, sf_dir), con, SQL[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - began:6.1f}s  {problem or 'ok'}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
