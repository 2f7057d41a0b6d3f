"""Compare registered queries with their DuckDB twins: python -m tests.compare [SF_DIR] [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TESTDATA = os.environ.get("TESSELLA_TESTDATA", "/root/testdata")


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return db


def plain(value):
    """A comparable form of a cell."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(x)) for k, x in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, bytearray):
        return bytes(value)
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark: SparkSession, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both sides give the same columns and rows."""
    df = query(spark, sf_dir)
    found = df.collect()
    db = connect(sf_dir).execute(sql)
    columns = [d[0] for d in db.description]
    want = db.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = table(df.columns, found), table(columns, want)
    if a == b:
        return ""
    other = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{name}: {len(a)} and {len(b)} rows; {str(other)[:900]}"


def main(args: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = next((x for x in args if os.path.isdir(x)), f"{TESTDATA}/sf0.01")
    names = [x for x in args if not os.path.isdir(x)]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            said = difference(spark, name, query, sql, sf_dir) if sql else f"no SQL, {query(spark, sf_dir).count()} rows"
        except Exception as e:  # a report of all queries goes on
            said = f"{name}: {type(e).__name__} {str(e)[:700]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name:40} {time.time() - began:6.1f} s  {said or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
