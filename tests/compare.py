"""Holds queries against their SQL, and serves as a command: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs between a DataFrame and a SQL text's rows; empty if nothing does."""
    own_names, own = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names, rows = rows_of([x[0] for x in cursor.description], cursor.fetchall())
    if own_names != names:
        return f"columns {own_names} and {names}"
    if len(own) != len(rows):
        return f"{len(own)} and {len(rows)} rows"
    bad = [(a, b) for a, b in zip(own, rows, strict=True) if repr(a) != repr(b)]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"{DATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    con = connection(sf)
    wanted, bad = sys.argv[2:], 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            df = query(spark, sf)
            sql = entry.oracle_sql().get(name)
            said = differences(df, sql, con) if sql else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{'ok ' if not said else '-- '} {name} {time.time() - began:.1f} s {said}", flush=True)
    print(f"{bad} differ")
