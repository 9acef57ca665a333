"""Compare a registered query with its reference SQL, as multisets of rows.

Run as a script: ``python tests/compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]).upper() for c in cursor.description}
    expected_rows = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    whole = {"int": "INT", "bigint": "INT"}
    for name, spark_type in df.dtypes:
        duck = types[name]
        if spark_type in whole and not any(t in duck for t in ("INT", "NUMBER")):
            return f"type of {name}: {spark_type} != {duck}"
        if "HUGEINT" in duck or "DECIMAL" in duck:
            return f"type of {name}: {duck}"
    got, expected = rows_of(df.columns, df.collect()), rows_of(columns, expected_rows)
    if got == expected:
        return None
    extra, missing = got - expected, expected - got
    return (
        f"{sum(got.values())} rows, expected {sum(expected.values())}; "
        f"extra {str(list(extra)[:2])[:700]}; missing {str(list(missing)[:2])[:700]}"
    )


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from tonewatch.session import drop_scratch

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                rows = df.collect()
                result = f"rows only ({len(rows)}): {[str(r)[:160] for r in rows[:4]]}"
            else:
                result = differences(df, con, sql)
        except Exception as error:  # noqa: BLE001
            causes = [line for line in str(error).splitlines() if line.startswith("Caused by")]
            result = f"{type(error).__name__}: {str(error)[:300]} {causes}".replace("\n", " ")
        bad += result is not None and not result.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.1f}s  {result or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    drop_scratch(spark)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
